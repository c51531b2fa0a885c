"""Mixing sources to target weights.

Each source's words, in a fixed order of its documents, are packed into blocks
of ``block_tokens`` words. The mix consists of slots, dealt to output shards;
every slot draws its source from the target shares, so a shard's source counts
are multinomial. What the draws miss of a source's quota is settled by moving
surplus slots, then each source's slots are mapped through a pseudorandom
permutation of its block indices (one permutation for each pass over the
source) and joined with the blocks by index. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import materialize
from tidemark.llm.text import n_words, whole
from tidemark.operators.hot import attach
from tidemark.operators.running import running

#: Rounds of the swap-or-not permutation.
ROUNDS = 24
SLOTS_PER_SHARD = 4096
#: Width of the cells by which slots meet the sources' shares.
CELL = 4096
#: Slots that a task maps through permutations, and the most tasks.
SLOTS_PER_TASK, MOST_TASKS = 1 << 15, 20_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...], repeats: float) -> DataFrame:
    """(key, source, source_size, target, rows) from rows (source, size).

    Sources in code-point order, null last, take ``weights`` in turn and share
    all words; no target exceeds ``repeats`` times its source, and the excess
    goes to the others by weight until none is above. Sources may be many: they
    are ordered and summed range by range. ``rows`` counts a source's documents
    and ``key`` stands for it, null included.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")).withColumn("key", source_key(F.col("source")))
    listed = running(per, [F.col("source").asc_nulls_last()], {}, "turn")
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("turn") % len(weights) + 1).cast("int"))
    filled = listed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(repeats)).withColumn("full_at", F.col("cap") / F.col("weight"))
    # Ordered by the level at which a source is full, the full ones come first. The level is right where it doesn't pass the next one's.
    ordered = materialize(running(filled, [F.col("full_at"), F.col("source").asc_nulls_last()], {"caps": "cap", "weights": "weight"}), "ordered")
    all_words, all_weights = ordered.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(float(all_words or 0)) - F.col("caps")) / (F.lit(float(all_weights or 1)) - F.col("weights"))
    final = ordered.withColumn("level", level).where("level <= full_at").agg(F.min(F.struct("full_at", "level"))["level"]).first()[0]
    target = F.col("cap") if final is None else F.least(F.col("cap"), F.col("weight") * F.lit(final))
    return ordered.select("key", "source", "source_size", target.alias("target"), "rows")


def source_key(source: Column) -> Column:
    """A source as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def permuted(index: Column, n: Column, *key: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by ``key``, puts ``index``.

    Swap-or-not (Hoang, Morris, Rogaway, 2012): in each round x and its mirror
    k - x mod n change places if a keyed bit of the larger one says so. That
    works on any n without a walk of unknown length.
    """

    def one_round(x: Column, i: Column) -> Column:
        mirror = F.pmod(F.xxhash64(F.lit("mirror"), i, *key) - x, n)
        swap = F.xxhash64(F.lit("swap"), i, F.greatest(x, mirror), *key).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), one_round)


def packed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size, start): where each document's words begin in its source's stream.

    The order within a source is by a hash of the id, in about sqrt(rows)
    chunks: words are summed by chunk, then within it, so no task holds a whole
    source.
    """
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), n_words(F.col(text_col)).alias("size")), "sizes")
    chunks = max(1, round(sizes.count() ** 0.5))
    hashed = sizes.withColumn("h", F.xxhash64(F.lit("order"), "id", "size")).withColumn("chunk", F.pmod("h", F.lit(chunks)))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = hashed.groupBy("source", "chunk").agg(F.sum("size").alias("words")).select("source", "chunk", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "chunk").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = hashed.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = local.alias("a").join(bases.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk")))
    return materialize(joined.select("a.id", "a.source", "a.size", (F.col("base") + F.col("local")).alias("start")), "packed")


def _within(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """Each point with the interval that holds it, low <= at < high; intervals don't overlap. Both are cut into cells of CELL, so a task gets few of either."""
    cells = intervals.where(F.col(low) < F.col(high)).withColumn("cell", F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor((F.col(high) - 1) / CELL))))
    joined = points.withColumn("cell", F.floor(F.col(at) / CELL)).join(cells, "cell")
    return joined.where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("cell")


def draws(targets: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    """(key, block, times, shards): how often, and into which shards, the mix takes each block."""
    spark = targets.sparkSession
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long")
    wanted = targets.select("key", "source_size", "target", F.ceil(F.col("source_size") / block_tokens).alias("blocks")).withColumn("quota", quota)
    quotas = materialize(running(wanted, [F.col("key")], {"from": "quota"}, "number"), "quotas").select("key", "number", "blocks", "quota", "from")
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = -(-total // SLOTS_PER_SHARD)
    slots = spark.range(total).select((F.col("id") % F.lit(shards or 1)).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), F.col("id")), F.lit(total or 1)).alias("u"))
    hit = _within(slots, "u", quotas.select("number", F.col("from").alias("low"), (F.col("from") + F.col("quota")).alias("high")), "low", "high")
    counts = materialize(running(hit.groupBy("number", "shard").agg(F.count(F.lit(1)).alias("n")), [F.col("number"), F.col("shard")], {"before": "n"}), "counts")
    # The settlement: slots beyond a source's quota, in order, fill the quotas that the draws left open.
    got = counts.groupBy("number").agg(F.sum("n").alias("got"), F.min("before").alias("first"), F.count(F.lit(1)).alias("n_shards"))
    both = quotas.join(got, "number", "left").na.fill(0, ["got", "first", "n_shards"]).withColumn("over", F.greatest(F.col("got") - F.col("quota"), F.lit(0))).withColumn("open", F.greatest(F.col("quota") - F.col("got"), F.lit(0)))
    totals = materialize(running(both.drop("from"), [F.col("number")], {"over_from": "over", "open_from": "open"}), "totals")
    drawn = attach(counts.withColumnRenamed("n", "drawn"), totals, "number", counts.count(), "n_shards").withColumn("base", F.col("before") - F.col("first"))
    own = drawn.select("key", "blocks", "shard", "base", F.least(F.col("base") + F.col("drawn"), F.col("quota")).alias("end")).where("base < end")
    beyond = drawn.where("base + drawn > quota").select("shard", F.explode(F.sequence(F.greatest("base", "quota"), F.col("base") + F.col("drawn") - 1)).alias("at"), "over_from", "quota")
    surplus = beyond.select("shard", (F.col("over_from") + F.col("at") - F.col("quota")).alias("at"))
    lacking = totals.select("key", "blocks", "got", F.col("open_from").alias("low"), (F.col("open_from") + F.col("open")).alias("high"))
    refilled = _within(surplus, "at", lacking, "low", "high").select("key", "blocks", "shard", (F.col("got") + F.col("at") - F.col("low")).alias("base")).withColumn("end", F.col("base") + 1)
    # Few rows stand for many slots here, so they are dealt out anew before they become slots.
    dealt = own.unionByName(refilled).repartition(max(1, min(-(-total // SLOTS_PER_TASK), MOST_TASKS)), "key", "shard", "base")
    taken = dealt.withColumn("slot", F.explode(F.sequence("base", F.col("end") - 1)))
    block = permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), F.lit(seed), F.col("key"), F.floor(F.col("slot") / F.col("blocks")))
    return taken.select("key", block.alias("block"), "shard").groupBy("key", "block").agg(F.count(F.lit(1)).alias("times"), F.sort_array(F.collect_list("shard")).alias("shards"))


def spread(placed: DataFrame, block_tokens: int) -> DataFrame:
    """Each document once for each block that it has words in: (..., block, skip, words); documents without words give no row."""
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_tokens), F.floor((F.col("start") + F.col("size") - 1) / block_tokens))))
    low = F.greatest(F.col("start"), F.col("block") * block_tokens)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_tokens)
    return cut.withColumn("skip", low - F.col("start")).withColumn("words", high - low)


def _drawn_pieces(placed: DataFrame, targets: DataFrame, block_tokens: int, seed: int) -> DataFrame:
    pieces, taken = spread(placed, block_tokens).alias("p"), draws(targets, block_tokens, seed).alias("t")
    return pieces.join(taken, (source_key(F.col("p.source")) == F.col("t.key")) & (F.col("p.block") == F.col("t.block"))).select("p.*", "times", "shards")


def account(docs: DataFrame, weights=(5, 2, 1), repeats: float = 3.0, block_tokens: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: (id_col, size, source_size, target, taken).

    ``size`` counts the words of the text (null: 0), ``source_size`` and
    ``target`` are its source's words and target words, ``taken`` the words of
    it that the mix takes, repeats counted, ``repeats`` times its size at most.
    A null source is a source of its own. Empty texts take nothing. Rows that
    repeat an id and size are kept apart. Other columns are not read. An empty
    table gives an empty result. Equal inputs give equal results.
    """
    placed = packed(docs, id_col, text_col, source_col)
    targets = materialize(source_targets(placed, weights, repeats), "targets")
    taken = _drawn_pieces(placed, targets, block_tokens, seed).groupBy("id", "source", "size", "start").agg(F.sum(F.col("times") * F.col("words")).alias("taken"))
    # Documents that the mix leaves out are added as rows of their own, so no outer join is needed.
    summed = taken.unionByName(placed.withColumn("taken", F.lit(0).cast("long"))).where("size > 0").groupBy("id", "source", "size", "start").agg(F.sum("taken").alias("taken"))
    every = summed.drop("start").unionByName(placed.where("size = 0").drop("start").withColumn("taken", F.lit(0).cast("long")))
    told = attach(every.select("id", "size", "taken", source_key(F.col("source")).alias("key")), targets.drop("source"), "key", placed.count(), "rows")
    return told.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights=(5, 2, 1), repeats: float = 3.0, block_tokens: int = 64, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the columns of ``docs`` with the text cut to a drawn piece, plus (mix_shard, mix_words).

    A piece is what one drawn block holds of one document, with the white space
    before its words; a document's last piece also has what follows. A block
    drawn more than once gives its pieces as often, each with the shard that
    drew it. Documents without words give no row. Rows that repeat id, source
    and size are numbered and kept apart. Nulls as for account(). A column
    named mix_shard or mix_words is replaced.
    """
    placed = packed(docs, id_col, text_col, source_col)
    targets = materialize(source_targets(placed, weights, repeats), "targets")
    pieces = _drawn_pieces(placed, targets, block_tokens, seed)
    plan = pieces.groupBy("id", "source", "size", "start").agg(F.collect_list(F.struct("skip", "words", "shards")).alias("__pieces"))
    same = ("__id", "__source", "__size")
    plan = plan.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), "start", "__pieces").withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy("start"))).drop("start")
    inner = docs.select(F.struct(docs.columns).alias("__row"), F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), n_words(F.col(text_col)).alias("__size")).where("__size > 0")
    inner = inner.withColumn("__nth", F.row_number().over(Window.partitionBy(*same).orderBy("__id")))
    joined = inner.alias("a").join(plan.alias("b"), F.col("a.__id").eqNullSafe(F.col("b.__id")) & F.col("a.__source").eqNullSafe(F.col("b.__source")) & (F.col("a.__size") == F.col("b.__size")) & (F.col("a.__nth") == F.col("b.__nth")))
    parts = F.regexp_extract_all(whole(F.col(f"__row.{text_col}")), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+\z)?"), F.lit(0))
    # The words are bound to a lambda's variable, so they are split once for each document and not for each piece.
    def cut(words: Column, piece: Column) -> Column:
        text = F.array_join(F.slice(words, (piece["skip"] + 1).cast("int"), piece["words"].cast("int")), "")
        return F.struct(text.alias("text"), piece["words"].alias("words"), piece["shards"].alias("shards"))

    pieces = F.transform(F.array(parts), lambda words: F.transform("__pieces", lambda piece: cut(words, piece)))[0]
    out = joined.select("__row", F.explode(pieces).alias("__piece")).select("__row", F.col("__piece.text").alias("__text"), F.col("__piece.words").alias("mix_words"), F.explode("__piece.shards").alias("mix_shard"))
    columns = [F.col("__text").alias(c) if c == text_col else F.col(f"__row.{c}").alias(c) for c in docs.columns if c not in ("mix_shard", "mix_words")]
    return out.select(*columns, "mix_shard", "mix_words")
