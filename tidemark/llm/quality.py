"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` characters. Every passage is
encoded from the shapes of its characters and words; gated attention, learned
from document labels alone, weighs the passages, and the weighted mean of their
representations gives the document's score (Ilse, Tomczak, Welling, 2018).
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import ship, small_batches
from tidemark.llm.text import whole

PASSAGE = 1024
#: Labelled documents of each class that the classifier is fitted on, at most.
PER_CLASS = 1000
KINDS = 12
#: Pairs of neighbouring characters' kinds, share of distinct words, mean word length, passage length.
WIDTH = KINDS * KINDS + 3
HIDDEN, GATES, EPOCHS, RATE, DECAY = 24, 12, 160, 0.02, 1e-4
#: Passages that are scored together.
LOT = 4096


def _kind(c: str) -> int:
    if c == "\n":
        return 4
    if c.isspace():
        return 3
    if c in ".,;:":
        return 5
    if c in "!?":
        return 6
    if c in "|[]{}<>=\\":
        return 8
    category = unicodedata.category(c)
    return {"Ll": 0, "Lu": 1, "Nd": 2, "Lo": 10}.get(category, {"P": 7, "S": 9}.get(category[0], 11)) if c not in "#$%&*@" else 9


_KINDS: np.ndarray | None = None


def _kinds() -> np.ndarray:
    global _KINDS
    if _KINDS is None:
        _KINDS = np.array([_kind(chr(c)) for c in range(0x3000)] + [10], dtype=np.int64)
    return _KINDS


def encode(text: str) -> np.ndarray:
    """One row of features for each passage of the whole text; an empty text is one empty passage."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = _kinds()[np.minimum(points, 0x3000)]
    n = max(1, -(-len(points) // PASSAGE))
    pairs = np.zeros((n, KINDS * KINDS))
    if len(points) > 1:
        place = np.arange(len(points) - 1) // PASSAGE
        pairs = np.bincount(place * KINDS * KINDS + kinds[:-1] * KINDS + kinds[1:], minlength=n * KINDS * KINDS).reshape(n, -1).astype(float)
    out = np.zeros((n, WIDTH), dtype=np.float32)
    out[:, :-3] = np.sqrt(pairs / np.maximum(pairs.sum(axis=1, keepdims=True), 1))
    for i in range(n):
        words = text[i * PASSAGE : (i + 1) * PASSAGE].split()
        if words:
            out[i, -3:] = len(set(words)) / len(words), min(2, sum(map(len, words)) / len(words) / 10), len(words) ** 0.5 / 16
    return out


@dataclass
class Attention:
    """The fitted weights; ``mean`` and ``scale`` standardise the features."""

    mean: np.ndarray
    scale: np.ndarray
    embed: np.ndarray
    shift: np.ndarray
    tanh: np.ndarray
    gate: np.ndarray
    mix: np.ndarray
    out: np.ndarray
    bias: float

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        h = np.tanh(x @ self.embed + self.shift)
        a, s = np.tanh(h @ self.tanh), 1 / (1 + np.exp(-(h @ self.gate)))
        raw = (a * s) @ self.mix
        bags = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        weight = np.exp(raw - np.maximum.reduceat(raw, starts)[bags])
        weight /= np.add.reduceat(weight, starts)[bags]
        z = np.add.reduceat(h * weight[:, None], starts)
        return h, a, s, weight, bags, z, z @ self.out + self.bias

    def score(self, bags: Iterable[np.ndarray]) -> np.ndarray:
        """Probability of label 1 for each bag of encoded passages, to nine places; bags go through in lots of about LOT passages."""
        out, held, n = [], [], 0
        for bag in bags:
            held.append(bag)
            n += len(bag)
            if n >= LOT:
                out.append(self._logits(held))
                held, n = [], 0
        if held:
            out.append(self._logits(held))
        logit = np.concatenate(out) if out else np.zeros(0)
        return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 9)

    def _logits(self, bags: list[np.ndarray]) -> np.ndarray:
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self._forward((np.concatenate(bags) - self.mean) / self.scale, starts)[-1]

    def attention(self, bag: np.ndarray) -> np.ndarray:
        """The passages' weights; they sum to 1."""
        return self._forward((bag - self.mean) / self.scale, np.array([0]))[3]


def gradient(model: Attention, x: np.ndarray, starts: np.ndarray, y: np.ndarray, importance: np.ndarray) -> dict[str, np.ndarray]:
    """Slopes, by the weights' names, of the sum over documents of ``importance`` times the cross entropy; ``x`` holds standardised passages, ``starts`` where each document's begin."""
    h, a, s, weight, at, z, logit = model._forward(x, starts)
    error = importance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)
    dz = np.outer(error, model.out)[at]
    dh = weight[:, None] * dz
    pull = (h * dz).sum(axis=1)
    draw = weight * (pull - np.add.reduceat(weight * pull, starts)[at])
    both = np.outer(draw, model.mix)
    da, ds = both * s * (1 - a * a), both * a * s * (1 - s)
    dh += da @ model.tanh.T + ds @ model.gate.T
    inner = dh * (1 - h * h)
    return {"embed": x.T @ inner, "shift": inner.sum(axis=0), "tanh": h.T @ da, "gate": h.T @ ds, "mix": (a * s).T @ draw, "out": z.T @ error, "bias": error.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Attention:
    """Adam on the cross entropy of document labels, classes weighing the same; without both classes the model scores every document 0.5."""
    rng = np.random.default_rng(seed)
    rows = np.concatenate(bags) if bags else np.zeros((1, WIDTH))
    mean, scale = rows.mean(axis=0, dtype=float), rows.std(axis=0, dtype=float) + 0.02
    shapes = {"embed": (WIDTH, HIDDEN), "shift": (HIDDEN,), "tanh": (HIDDEN, GATES), "gate": (HIDDEN, GATES), "mix": (GATES,), "out": (HIDDEN,)}
    model = Attention(mean, scale, **{k: rng.normal(0, (2 / sum(s)) ** 0.5, s) for k, s in shapes.items()}, bias=0.0)
    if len(set(labels.tolist())) < 2:
        model.out[:] = 0
        return model
    x, starts, y = ((rows - mean) / scale).astype(np.float32), np.cumsum([0, *map(len, bags[:-1])]), labels.astype(float)
    importance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    names = [*shapes, "bias"]
    first, second = ({k: np.zeros_like(getattr(model, k)) for k in names} for _ in range(2))
    for step in range(1, EPOCHS + 1):
        slopes = gradient(model, x, starts, y, importance)
        for k in names:
            slope = slopes[k] + DECAY * getattr(model, k)
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope**2
            setattr(model, k, getattr(model, k) - RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
    return model


def third(id_col: Column) -> Column:
    """crc32 of the id as text, mod 3; null ids have none."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Attention:
    """Fit on labelled documents whose id's crc32 mod 3 is not 1.

    Of each class, the ``per_class`` ids that come first by hash are read and
    fitted in one task, so that task does not grow with the number of
    documents; the driver gets the weights. Null ids or labels and labels
    without a document don't count; without labels of both classes the model
    scores every document 0.5. Rows that repeat an id are all read.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    usable = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(third(F.col(id_col)) != 1).join(docs.select(id_col), id_col, "left_semi")
    chosen = [usable.where(F.col("label") == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    sample = docs.select(F.col(id_col), whole(F.col(text_col)).alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), id_col)

    @F.pandas_udf("binary")
    def encoded(text: pd.Series) -> pd.Series:
        return pd.Series([encode(t).tobytes() for t in text], dtype=object)

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id": [], "label": [], "x": []}), *batches]).sort_values(["id", "label", "x"])
        model = fit([np.frombuffer(x, np.float32).reshape(-1, WIDTH) for x in rows["x"]], rows["label"].to_numpy(int))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    rows = sample.select(F.col(id_col).alias("id"), "label", encoded("text").alias("x")).repartition(1).mapInPandas(fitted, "model binary").collect()
    return pickle.loads(rows[0]["model"]) if rows else fit([], np.zeros(0, int))


def scored(docs: DataFrame, model: Attention, to: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``to``: the score (0 to 1) of the whole text.

    Null texts count as empty, repeated rows each get their score, an empty
    table gives an empty result. A column of that name is replaced, others of
    any name are kept.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(map(encode, text)), dtype=float)

    return docs.withColumn(to, score(whole(F.col(text_col))))


def account(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of ``docs``; a null id is not held out. Other columns are not read."""
    rows = scored(docs.select(F.col(id_col), F.col(text_col).alias("text")), train(docs, labels, id_col=id_col, text_col=text_col))
    held_out = F.coalesce(third(F.col(id_col)) == 1, F.lit(False))
    return rows.select(id_col, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier predicts to have quality 1, all columns unchanged.

    Null texts count as empty; rows with null ids are scored like others, and
    repeated rows stay or go together. Without labels of both classes all rows
    stay. An empty table gives an empty result.
    """
    return scored(docs, train(docs, labels), "__tidemark_score").where("__tidemark_score >= 0.5").drop("__tidemark_score")
