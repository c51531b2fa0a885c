"""Readable names for mangled symbols, as a Pandas UDF: the length-prefixed parts of a symbol are no regular language."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship

# Escapes of the legacy mangling.
ESCAPES = {"$LT$": "<", "$GT$": ">", "$LP$": "(", "$RP$": ")", "$C$": ",", "$RF$": "&", "$BP$": "*", "$u20$": " ", "$u7b$": "{", "$u7d$": "}", "$u27$": "'", "$u5b$": "[", "$u5d$": "]", "..": "::"}
HASH = re.compile(r"h[0-9a-f]{16}$")


def readable(symbol: str | None) -> str | None:
    """The path of a legacy symbol without its hash; other names are returned as they are."""
    if symbol is None:
        return None
    start = re.match(r"_{0,2}ZN", symbol)
    if not start:
        return symbol
    at, parts = start.end(), []
    while (size := re.compile(r"\d+").match(symbol, at)) is not None:
        at = size.end() + int(size[0])
        parts.append(symbol[size.end() : at])
    if not parts or symbol[at : at + 1] != "E":
        return symbol
    if len(parts) > 1 and HASH.fullmatch(parts[-1]):
        parts.pop()
    name = "::".join(p.removeprefix("_") if p.startswith("_$") else p for p in parts)
    for escape, text in ESCAPES.items():
        name = name.replace(escape, text)
    return name


def demangled(symbol: Column) -> Column:
    ship(SparkSession.active())

    @F.pandas_udf("string")
    def run(symbols: pd.Series) -> pd.Series:
        return symbols.map(readable)

    return run(symbol)
