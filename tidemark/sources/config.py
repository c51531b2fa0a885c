"""Layered configuration: defaults, user file, project file, environment; the last to set a field wins."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

DEFAULTS = {"thresholds": {"score": 3.0, "cyclomatic": 0, "cognitive": 0, "risk": 0.0, "density": 50.0}, "view": {"hide_t4": True}, "ignore": {"patterns": []}}
PREFIX = "TIDEMARK_"


def nearest(name: str, start: Path) -> Path | None:
    """The file of that name in ``start`` or the nearest folder above."""
    return next((p / name for p in (start, *start.parents) if (p / name).is_file()), None)


def _fields(table: dict, at: tuple = ()) -> dict[tuple, object]:
    out = {}
    for key, value in table.items():
        out |= _fields(value, (*at, key)) if isinstance(value, dict) else {(*at, key): value}
    return out


def load(files: list[Path], environment: dict[str, str] | None = None) -> tuple[dict, dict[str, str]]:
    """(configuration, where each dotted field came from); ValueError names every file that can't be read."""
    layers, errors = [("defaults", _fields(DEFAULTS))], []
    for path in files:
        try:
            layers.append((str(path), _fields(tomllib.loads(path.read_text()))))
        except (OSError, tomllib.TOMLDecodeError) as error:
            errors.append(f"{path}: {error}")
    if errors:
        raise ValueError("; ".join(errors))
    environment = dict(os.environ if environment is None else environment)
    known = {"_".join(at).upper(): at for at in _fields(DEFAULTS)}
    found = {known[k.removeprefix(PREFIX)]: tomllib.loads(f"v = {v}")["v"] for k, v in environment.items() if k.startswith(PREFIX) and k.removeprefix(PREFIX) in known}
    layers.append(("environment", found))
    values: dict[tuple, object] = {}
    source: dict[str, str] = {}
    for name, fields in layers:
        values |= fields
        source |= {".".join(at): name for at in fields}
    out: dict = {}
    for at, value in values.items():
        table = out
        for key in at[:-1]:
            table = table.setdefault(key, {})
        table[at[-1]] = value
    return out, source
