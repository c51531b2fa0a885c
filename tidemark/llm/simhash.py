"""Document fingerprints: SimHash, and permuted block tables for Hamming search.

The distinct words of a text, lower-cased in A-Z, vote with their length (a
stand-in for rarity: common words are short) on each of 64 bits. Two bits'
votes share one long, so a fingerprint is 32 sums. Only DataFrame functions are
used.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize, n_shuffle
from tidemark.llm.text import lower_ascii, whole, words
from tidemark.operators.hot import attach

BITS = 64
#: The search's radius, and the blocks that a fingerprint is cut into: tables have BLOCKS - RADIUS blocks as their key.
RADIUS, BLOCKS = 3, 6
#: A group of a block table may compare so many pairs; larger groups are cut by further bits.
PAIRS = 4096

#: Ranges of ids at most: their bounds are literals of the plan.
RANGES = 1 << 14


def votes(term: Column) -> list[Column]:
    """33 sums over a text's terms (null: no vote): 32 of the yes votes on bits k and k + 32, then all votes."""
    weight = F.char_length(term).cast("long")
    hashed = F.xxhash64(term)
    packed = [F.sum(weight * F.shiftrightunsigned(hashed, k).bitwiseAND(F.lit(0x100000001))).alias(f"v{k}") for k in range(BITS // 2)]
    return [*packed, F.sum(weight).alias("votes")]


def fingerprint() -> Column:
    """64 bits as a long from the sums of votes(): a bit is set where yes votes outnumber the others; 0 without terms."""

    def bit(k: int) -> Column:
        yes = F.col(f"v{k % 32}").bitwiseAND(F.lit(0xFFFFFFFF)) if k < 32 else F.shiftrightunsigned(F.col(f"v{k % 32}"), 32)
        return F.when(yes * 2 > F.col("votes"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))

    return reduce(lambda a, b: a.bitwiseOR(b), map(bit, range(BITS)))


def terms(text: Column) -> Column:
    return F.array_distinct(words(lower_ascii(text)))


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), BITS // 4, "0"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint long), one row for each id: texts of an id that is repeated vote together. Null texts are empty."""
    split = docs.select(F.col(id_col), F.explode_outer(terms(whole(F.col(text_col)))).alias("term"))
    return split.groupBy(id_col).agg(*votes(F.col("term"))).select(id_col, fingerprint().alias("fingerprint"))


def _signed(mask: int) -> int:
    mask &= (1 << 64) - 1
    return mask - (1 << 64) if mask >> 63 else mask


def _cut(bits: list[int], n: int) -> list[list[int]]:
    return [bits[i * len(bits) // n : (i + 1) * len(bits) // n] for i in range(n)]


def within_radius(queries: DataFrame, table: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fingerprint, distance): for distinct longs in ``queries.fingerprint``, every other fingerprint of ``table`` within ``radius``.

    Two fingerprints that differ in at most ``radius`` bits agree on at least
    ``blocks - radius`` blocks: for each choice of so many blocks, both sides
    are hashed by those bits and only rows of one key are compared. A group
    that would compare more than PAIRS pairs is cut again by each of
    ``radius + 1`` blocks of its free bits, one of which must agree too, until
    no group is larger; nothing is dropped.
    """
    spark = queries.sparkSession
    sides = queries.select("fingerprint", F.lit(True).alias("asks")).distinct().unionByName(table.select("fingerprint", F.lit(False).alias("asks")).distinct())
    masks = {sum(1 << b for block in chosen for b in block) for chosen in combinations(_cut(list(range(BITS)), blocks), blocks - radius)}
    rows = sides.withColumn("mask", F.explode(F.array(*(F.lit(_signed(m)) for m in sorted(masks)))))
    found = None
    while masks:
        rows = materialize(rows.withColumn("key", F.col("fingerprint").bitwiseAND(F.col("mask"))), "blocks")
        sizes = rows.groupBy("mask", "key").agg(F.count_if("asks").alias("n"), F.count_if(~F.col("asks")).alias("m")).where("n > 0 and m > 0")
        # With no more free bits than the radius, a group has few fingerprints and needs no cut.
        cuttable = F.bit_count("mask") < BITS - radius
        sizes = materialize(sizes.withColumn("large", (F.col("n") * F.col("m") > PAIRS) & cuttable), "sizes")
        fit = rows.join(sizes.where("not large").select("mask", "key"), ["mask", "key"], "left_semi")
        pairs = fit.where("asks").select("mask", "key", F.col("fingerprint").alias("query")).join(fit.where("not asks").select("mask", "key", "fingerprint"), ["mask", "key"])
        pairs = pairs.withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))).where(f"distance between 1 and {radius}").select("query", "fingerprint", "distance")
        found = pairs if found is None else found.unionByName(pairs)
        if sizes.where("large").isEmpty():
            break
        finer = []
        for m in masks:
            free = [b for b in range(BITS) if not m >> b & 1]
            finer += [(_signed(m), _signed(m | sum(1 << b for b in block))) for block in _cut(free, radius + 1) if len(free) > radius]
        masks = {b for _, b in finer}
        if finer:
            rows = rows.join(sizes.where("large").select("mask", "key"), ["mask", "key"], "left_semi").drop("key").join(F.broadcast(spark.createDataFrame(finer, "mask long, finer long")), "mask").select("fingerprint", "asks", F.col("finer").alias("mask")).distinct()
    return found.distinct()


def _longs(values: list[int]) -> str:
    return "array(" + ",".join(f"{v}L" for v in values) + ")"


def _bucket(bounds: list[int], id_col: Column) -> Column:
    """How many of the ascending bounds are at most the id, found in two steps; null ids: 0."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    at = F.size(F.filter(F.expr(_longs([g[0] for g in groups])), lambda b: b <= id_col))
    inner = F.size(F.filter(F.element_at(F.expr("array(" + ",".join(map(_longs, groups)) + ")"), at), lambda b: b <= id_col))
    return F.when(id_col.isNull() | (at == 0), 0).otherwise((at - 1) * step + inner)


def beside_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(bucket, place, ghost, id, text, next_text): each text beside that of the next lower id; the lowest has the highest's.

    Ids are cut into ranges of about equal counts. Each range's first document
    is also sent to the range that ends where it begins, as a ghost, so one
    exchange puts all neighbours together and no task holds the whole order.
    Null ids come last; rows of one id are ordered by text hash.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col)).alias("text"))
    parts = min(8 * n_shuffle(docs.sparkSession), RANGES)
    cuts = ",".join(f"{i / parts:.8f}" for i in range(1, parts))
    bounds = rows.agg(F.expr(f"percentile_approx(id, array({cuts}), {10 * parts})").alias("b")).first()["b"]
    bucket = _bucket(sorted(set(bounds or [])), F.col("id"))
    heads = rows.select(bucket.alias("bucket"), "id").groupBy("bucket").agg(F.max("id").alias("id")).collect()  # a row for each range
    order = sorted(heads, key=lambda r: -r["bucket"])
    ghosts = [(r["bucket"], r["id"], order[i - 1]["bucket"]) for i, r in enumerate(order)] or [(0, None, 0)]
    ghosts = F.broadcast(docs.sparkSession.createDataFrame(ghosts, "bucket int, id long, also int").alias("g"))
    placed = rows.withColumn("bucket", bucket).alias("r").join(ghosts, (F.col("r.bucket") == F.col("g.bucket")) & F.col("r.id").eqNullSafe(F.col("g.id")), "left")
    own = F.struct(F.col("r.bucket").alias("bucket"), F.lit(False).alias("ghost"))
    other = F.struct(F.col("also").alias("bucket"), F.lit(True).alias("ghost"))
    sent = placed.select("r.id", "r.text", F.explode(F.when(F.col("also").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("to")).select("to.*", "id", "text")
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    return sent.select("bucket", F.row_number().over(order).alias("place"), "ghost", "id", "text", F.lead("text").over(order).alias("next_text"))


def account(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", asks: Column | None = None) -> DataFrame:
    """One row per document: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_fingerprints, near_documents, near_id).

    The edited text is the text whose last floor(n_chars / 2) code points are
    replaced by the first as many (or all) of the next lower id's text, for the
    lowest id the highest's. near_fingerprints counts the other fingerprints of
    the table within RADIUS bits, near_documents the other documents that have
    one of these or the row's own, and near_id is the smallest of their ids
    (of those with the row's own, if the row itself is not the first), for
    rows that ``asks`` picks (ids divisible by 20, if None); null for the
    others. Ids are integers. Null texts are empty; empty texts
    have fingerprint 0. An empty table gives an empty result.
    """
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    texts = beside_next(docs, id_col, text_col)
    edited = F.concat(F.substring("text", F.lit(1), (n - half)), F.substring("next_text", F.lit(1), half))
    texts = texts.select("bucket", "place", "ghost", "id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("ghost"), edited).alias("edited"))
    keys = ("bucket", "place", "ghost", "id", "n_chars", "edited_sha256")
    both = texts.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)).select(*keys, F.explode(F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t"))))).alias("x"))
    split = both.select(*keys, "x.which", F.explode_outer(terms(F.col("x.t"))).alias("term"))
    prints = split.groupBy(*keys, "which").agg(*votes(F.col("term"))).select(*keys, "which", fingerprint().alias("f"))
    wide = prints.groupBy(*keys).agg(F.max(F.when(F.col("which") == 0, F.col("f"))).alias("own"), F.max(F.when(F.col("which") == 1, F.col("f"))).alias("edited"))
    wide = wide.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))).where("not ghost")
    rows = materialize(wide.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "own", "edited", "next"), "fingerprints")
    asks = F.col(id_col) % 20 == 0 if asks is None else asks
    asked = rows.where(asks).select(F.col("own").alias("fingerprint"))
    firsts = materialize(rows.groupBy("own").agg(F.min(id_col).alias("first"), F.count(F.lit(1)).alias("rows")), "firsts")
    hits = within_radius(asked, firsts.select(F.col("own").alias("fingerprint"))).join(firsts.withColumnRenamed("own", "fingerprint"), "fingerprint")
    counts = hits.groupBy(F.col("query").alias("own")).agg(F.count(F.lit(1)).alias("near"), F.sum("rows").alias("near_rows"), F.min("first").alias("near_first"))
    told = attach(rows, firsts.join(counts, "own", "left"), "own", rows.count(), "rows")
    near_documents = F.coalesce("near_rows", F.lit(0)) + F.col("rows") - 1
    near_id = F.least(F.col("near_first"), F.when(F.col("first") != F.col(id_col), F.col("first")))
    return told.select(id_col, "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), F.when(asks, F.coalesce("near", F.lit(0))).alias("near_fingerprints"), F.when(asks, near_documents).alias("near_documents"), F.when(asks, near_id).alias("near_id"))
