"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidate edges.

Documents with one set of word shingles are one class. A class's sketch hashes
each shingle once: the hash's top bits choose one of ``BINS`` bins, which keep
their smallest hash, and an empty bin copies the first full one of a
pseudorandom sequence of bins that is the same for all documents (optimal
densification, Shrivastava 2017). ``BANDS`` bands of ``ROWS`` bins are bucket
keys. In a bucket, each member is only paired with a hub, the smallest id, so
pairs grow with members; every pair is confirmed on the full sets. Buckets that
then still hold more than one component have their members paired with another
hub, and the documents of those that even then do go through an exact prefix
join across components, so a link that no hub shows is found too. Keys that
hold many rows (buckets, hubs) are split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.membership import among, without
from tidemark.llm.scratch import materialize, ship, small_batches
from tidemark.llm.text import whole
from tidemark.operators.components import components
from tidemark.operators.hot import PARTS, attach, hot

WORDS, PERCENT = 5, 85
BINS_LOG, ROWS = 7, 4
BINS = 1 << BINS_LOG
BANDS = BINS // ROWS
#: Bins that an empty bin tries; a bin that finds none takes the next full one in order.
TRIES = 2048
#: Distinct words whose hashes a worker remembers.
REMEMBERED = 100_000
_A, _B = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(33))) * _B
    return x ^ (x >> np.uint64(33))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``words`` words, A-Z lower-cased; with fewer words, of the whole sequence; none without words."""
    found = text.encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    n = min(words, len(each))
    factors = _mixed(np.arange(1, n + 1, dtype=np.uint64) * _B) | np.uint64(1)
    total = np.full(len(each) - n + 1, n if n < words else 0, np.uint64)
    for i in range(n):
        total += each[i : len(each) - n + 1 + i] * factors[i]
    return np.unique(_mixed(total))


def _sequence() -> np.ndarray:
    global _TRIED
    if _TRIED is None:
        _TRIED = (_mixed(np.arange(BINS * TRIES, dtype=np.uint64) + np.uint64(1 << 40)) >> np.uint64(64 - BINS_LOG)).astype(np.int64).reshape(BINS, TRIES)
    return _TRIED


_TRIED: np.ndarray | None = None
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS_LOG)


def sketch(members: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, empty bins densified; ``members`` are sorted and at least one."""
    at = np.minimum(np.searchsorted(members, _EDGES), len(members) - 1)
    values = members[at]
    full = (values >> np.uint64(64 - BINS_LOG)) == np.arange(BINS, dtype=np.uint64)
    if full.all():
        return values
    empty = np.flatnonzero(~full)
    source = np.empty(len(empty), np.int64)
    left = np.arange(len(empty))
    for low, high in ((0, 16), (16, TRIES)):
        tried = _sequence()[empty[left], low:high]
        hit = full[tried]
        done = hit.any(axis=1)
        source[left[done]] = tried[done, hit[done].argmax(axis=1)]
        left = left[~done]
        if not len(left):
            break
    if len(left):
        whole_bins = np.flatnonzero(full)
        source[left] = whole_bins[np.searchsorted(whole_bins, empty[left]) % len(whole_bins)]
    values = values.copy()
    values[empty] = values[source]
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the sketch, the band's number included."""
    rows = _mixed(values).reshape(BANDS, ROWS)
    factors = _mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return _mixed((rows * factors).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))


def _sketched(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, n, digest, bands): the set's size, 128 bits that stand for it, and its band keys (null for an empty set)."""

    @F.pandas_udf("n long, digest binary, bands array<long>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        import hashlib

        rows = []
        for text in texts:
            found = shingles(text, words)
            rows.append((len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), bands(sketch(found)).view(np.int64)) if len(found) else (0, None, None))
        return pd.DataFrame(rows, columns=["n", "digest", "bands"])

    return _texts(docs, id_col, text_col).select("id", sketched("text").alias("s")).select("id", "s.n", "s.digest", "s.bands")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, members): full sets of the documents that ``ids`` names, a few others among them."""

    @F.pandas_udf("array<long>")
    def members(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts], dtype=object)

    return among(_texts(docs, id_col, text_col), ids).select("id", members("text").alias("members"))


def _with_set(joined: DataFrame, pairs: DataFrame, sets: DataFrame, end: str, other: str, total: int) -> DataFrame:
    """``joined``, the ``pairs`` with more columns, with the set of_<end> of the document ``end``; the pairs of one that has many are cut in lots, for each of which its set is copied."""
    per = pairs.groupBy(end).agg(F.count(F.lit(1)).alias("n"))
    lots = F.broadcast(hot(per, total).select(end, F.ceil(F.col("n") * PARTS / max(total, 1)).alias("lots")))
    own = F.coalesce("lots", F.lit(1))
    dealt = joined.join(lots, end, "left").withColumn("lot", F.pmod(F.xxhash64(other), own)).drop("lots")
    copies = sets.select(F.col("id").alias(end), F.col("members").alias(f"of_{end}")).join(lots, end, "left")
    copies = copies.select(end, f"of_{end}", F.explode(F.sequence(F.lit(0).cast("long"), own - 1)).alias("lot"))
    return dealt.join(copies, [end, "lot"]).drop("lot")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a table with 100 * intersection >= percent * union of their full sets."""
    total = pairs.count()
    joined = _with_set(_with_set(pairs, pairs, sets, "b", "a", total), pairs, sets, "a", "b", total)
    n, m = F.size("of_a"), F.size("of_b")
    possible = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    common = F.size(F.array_intersect("of_a", "of_b"))
    return joined.where(possible).where(100 * common >= percent * (n + m - common)).select("a", "b")


def _pairs(*ends: DataFrame) -> DataFrame:
    """(a, b), a < b, once each, from tables (x, y)."""
    every = ends[0]
    for more in ends[1:]:
        every = every.unionByName(more)
    return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def _open(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(key, id, component) of the buckets (key, id) whose members are of more than one component."""
    named = buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    per = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("n"))
    return attach(named, per, "key", buckets.count()).where("low < high").select("key", "id", "component")


def _to_own_hubs(opened: DataFrame, total: int) -> DataFrame:
    """Each member of the buckets (key, id, component) with a pseudorandom hub of its bucket, where that is of another component."""
    hubs = opened.groupBy("key").agg(F.min_by(F.struct("id", "component"), F.xxhash64("key", "id")).alias("hub"), F.count(F.lit(1)).alias("n"))
    return attach(opened, hubs, "key", total).where("component <> hub.component").select(F.col("id").alias("x"), F.col("hub.id").alias("y"))


def _by_prefix(opened: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All pairs of the given documents that are of different components and can be similar enough.

    The exact filter of PPJoin (Xiao et al., 2008): with every set in one order
    of its members, rare ones first, similar sets share a member in their first
    few, and where they first meet bounds what they can share in all. Documents
    that differ from each other by rare members of their own, as the edited
    copies of one text do, meet nowhere, so no crowd's pairs are compared.
    """
    listed = opened.select("id", "component").distinct().join(sets.dropDuplicates(["id"]), "id").select("id", "component", F.size("members").alias("n"), F.explode("members").alias("member"))
    listed = materialize(listed, "listed")
    counts = materialize(listed.groupBy("member").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "counts")
    # A member of one document only meets nothing; it still takes its place in the order, before all others.
    placed = listed.join(counts, "member", "left").withColumn("at", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "member")))
    n = F.col("n")
    probe, index = n - F.ceil(n * percent / 100) + 1, n - F.ceil(n * (2 * percent) / (100 + percent)) + 1
    first = materialize(placed.where(F.col("df").isNotNull() & (F.col("at") <= probe)).withColumn("indexed", F.col("at") <= index).drop("df"), "prefixes")
    x, y = first.alias("x"), first.where("indexed").alias("y")
    order = (F.col("y.n") < F.col("x.n")) | ((F.col("y.n") == F.col("x.n")) & (F.col("y.id") < F.col("x.id")))
    needed = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    reach = 1 + F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= needed
    met = (F.col("x.member") == F.col("y.member")) & order & (F.col("y.n") * 100 >= F.col("x.n") * percent) & (F.col("x.component") != F.col("y.component")) & reach
    return x.join(y, met).select(F.col("x.id").alias("x"), F.col("y.id").alias("y"))


def classes(docs: DataFrame, percent: int = PERCENT, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id_col, n_shingles, component_id, kept).

    A document's set is that of shingles(); documents are linked where 100 *
    intersection >= percent * union, and component_id is the smallest id
    reachable through links. Null texts and texts without words have an empty
    set and are linked with nothing. Rows that share an id are one node: what
    one of them is linked with, all are. Rows with a null id link others with
    nothing; one whose set another row has takes that row's component, else
    component_id is null and the row is kept. Ids are integers. Other columns
    are not read. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = materialize(_sketched(docs, id_col, text_col, words), "sketches")
    firsts = rows.where("digest is not null and id is not null").groupBy("digest").agg(F.min(F.struct("id", "bands")).alias("f"))
    keys = materialize(firsts.select("digest", F.col("f.id").alias("first"), "f.bands"), "keys")
    members = keys.select(F.col("first").alias("id"), F.explode("bands").alias("key"))
    ends = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n"))
    hubs = materialize(ends.where("hub < last").drop("last"), "hubs")
    buckets = materialize(attach(members, hubs, "key", hubs.agg(F.sum("n")).first()[0] or 0).drop("n"), "buckets")
    tried = materialize(_pairs(buckets.select(F.col("hub").alias("x"), F.col("id").alias("y"))), "pairs")
    sets = materialize(_sets(docs, buckets.select("id").distinct(), id_col, text_col, words), "sets")
    found = components(_confirmed(tried, sets, percent).unionByName(_repeated(rows, keys)))
    opened = buckets.select("key", "id")
    for turn in range(2):
        opened = materialize(_open(opened.select("key", "id"), found), "open")
        if not (total := opened.count()):
            break
        pairs = _by_prefix(opened, sets, percent) if turn else _to_own_hubs(opened, total)
        more = materialize(_confirmed(materialize(_pairs(pairs), "pairs"), sets, percent), "links")
        if more.count():
            found = components(found.select(F.col("component").alias("a"), F.col("id").alias("b")).unionByName(more))
    named = keys.join(found.withColumnRenamed("id", "first"), "first", "left").select("digest", F.coalesce("component", "first").alias("component_id"))
    set_rows = rows.where("digest is not null").select("id", "n", "digest").join(named, "digest", "left").select("id", "n", "component_id")
    empty = rows.where("digest is null").select("id", "n", F.col("id").alias("component_id"))
    whole_id = F.coalesce("component_id", "id")
    return set_rows.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), whole_id.alias("component_id"), F.col("id").eqNullSafe(whole_id).alias("kept"))


def _repeated(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Links (a, b) from an id that has several sets to the first id of each of their classes."""
    several = rows.where("digest is not null and id is not null").groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("id")
    return rows.select("id", "digest").join(several, "id").join(keys.select("digest", "first"), "digest").select(F.col("first").alias("a"), F.col("id").alias("b"))


def deduplicate(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged: of each component the row with the smallest id.

    Documents without words all stay, and so do rows with a null id, which
    nothing tells apart. Rows that share a kept id stay together.
    """
    found = classes(docs, percent, words, id_col, text_col)
    dropped = materialize(found.where(~F.col("kept") & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id")).distinct(), "dropped")
    return without(docs, F.col(id_col).cast("long"), dropped)
