"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition's words that have not been met yet are laid out in one linked list
of symbols. The index holds, for each merge rank, every position at which its
pair stands; ranks are taken from a heap in ascending order, all positions of a
rank are merged at once and only the neighbours' entries change. Ids are kept
as little-endian unsigned 32-bit integers in a binary column.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.scratch import ship, small_batches
from tidemark.llm.text import whole

#: Unicode's white space, as the tokenizer's pattern means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level split: contractions, then letters, numbers and other marks with a space before them, then white space.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Occurrences from which a rank is merged by array operations.
MANY = 16
#: Words whose ids a worker remembers; beyond that it forgets them all.
REMEMBERED = 150_000


def byte_letters() -> dict[str, int]:
    """Letter to byte: printable Latin-1 letters stand for themselves, the other bytes for letters from 256 up in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Bpe:
    """A byte-level BPE vocabulary, from the text of a tokenizer file; ValueError where it needs what is not supported."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or spec["normalizer"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is supported")
        if split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"]:
            raise ValueError("only the byte-level split without a prefix space is supported")
        letters = byte_letters()
        vocab = model["vocab"]
        self.of_byte = np.zeros(256, np.int32)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        self.ranks: dict[int, int] = {}  # by left << 32 | right
        self.made: list[tuple[int, int, int]] = []
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.ranks.setdefault(vocab[left] << 32 | vocab[right], len(self.made))
            self.made.append((vocab[left], vocab[right], vocab[left + right]))
        self.pairs = np.array(sorted(self.ranks), np.int64)
        self.pair_ranks = np.array([self.ranks[p] for p in self.pairs.tolist()], np.int64)
        used: dict[int, int] = {}
        for rank, (left, right, _) in enumerate(self.made):
            used.setdefault(left, rank)
            used.setdefault(right, rank)
        #: Whether what a rank makes is part of no pair of a lower rank, so all its occurrences can be merged at once.
        self.settled = [used.get(new, rank + 1) > rank for rank, (_, _, new) in enumerate(self.made)]
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added} | {i: t.encode() for t, i in added.items()}
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        import regex

        self.find = regex.compile(SPLIT).findall
        self.known: dict[str, bytes] = {}

    def _ranks_at(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Each pair's rank; -1 where no merge joins it."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, self.pair_ranks[at], -1)

    def _occurrences(self, ids: array, after: array) -> dict[int, list[int]]:
        """The index: each merge rank's positions, ascending."""
        index: dict[int, list[int]] = defaultdict(list)
        if len(ids) and len(self.pairs):
            ids_view, after_view = np.frombuffer(ids, np.int32), np.frombuffer(after, np.int32)
            at = np.flatnonzero(after_view >= 0)
            ranks = self._ranks_at(ids_view[at], ids_view[after_view[at]])
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for start, places in zip([0, *cuts.tolist()] if len(at) else [], np.split(at, cuts), strict=False):
                if ranks[start] >= 0:
                    index[int(ranks[start])] = places.tolist()
        return index

    def _merge_all(self, places: np.ndarray, rank: int, ids: np.ndarray, after: np.ndarray, before: np.ndarray, enter) -> None:
        """Merge every standing occurrence of a pair of two different symbols at once and enter the pairs that this makes."""
        left, right, new = self.made[rank]
        then = after[places]
        places = places[(ids[places] == left) & (then >= 0) & (ids[then] == right)]
        then = after[places]
        following = after[then]
        ids[places], ids[then], after[places] = new, -1, following
        linked = following >= 0
        before[following[linked]] = places[linked]
        for at in (places[linked], before[places][before[places] >= 0]):
            ranks = self._ranks_at(ids[at], ids[after[at]])
            for r, p in zip(ranks[ranks >= 0].tolist(), at[ranks >= 0].tolist(), strict=True):
                enter(r, p)

    def learn(self, words: list[str]) -> None:
        """Encode distinct words, none empty, together and remember them."""
        encoded = [word.encode("utf-8", "replace") for word in words]
        ends = np.cumsum([len(x) for x in encoded])
        symbols = self.of_byte[np.frombuffer(b"".join(encoded), np.uint8)]
        step = np.arange(len(symbols), dtype=np.int32)
        links = step + 1, step - 1
        links[0][ends - 1] = links[1][np.append(0, ends[:-1])] = -1
        # Arrays whose elements Python reads fast; numpy sees the same memory.
        ids, after, before = (array("i", x.tobytes()) for x in (symbols, *links))
        index = self._occurrences(ids, after)
        ids_view, after_view, before_view = (np.frombuffer(x, np.int32) for x in (ids, after, before))
        active = list(index)
        heapq.heapify(active)

        def enter(rank: int, at: int) -> None:
            if rank not in index:
                heapq.heappush(active, rank)
            index[rank].append(at)

        rank_of = self.ranks.get
        while active:
            rank = heapq.heappop(active)
            places = index.pop(rank, None)
            if places is None:
                continue
            left, right, new = self.made[rank]
            if len(places) > MANY and self.settled[rank] and left != right:
                self._merge_all(np.array(places, np.int32), rank, ids_view, after_view, before_view, enter)
                continue
            places.sort()
            for n, at in enumerate(places):
                if ids[at] != left or (then := after[at]) < 0 or ids[then] != right:
                    continue  # an entry that an earlier merge has overtaken
                ids[at], ids[then] = new, -1
                following = after[at] = after[then]
                lowest = rank
                if following >= 0:
                    before[following] = at
                    if (r := rank_of(new << 32 | ids[following])) is not None:
                        enter(r, at)
                        lowest = min(lowest, r)
                if (prior := before[at]) >= 0 and (r := rank_of(ids[prior] << 32 | new)) is not None:
                    enter(r, prior)
                    lowest = min(lowest, r)
                if lowest < rank:  # a lower rank became active: it comes before the rest of this one
                    for rest in places[n + 1 :]:
                        enter(rank, rest)
                    break
        standing = ids_view >= 0
        packed = ids_view[standing].astype("<u4").tobytes()
        until = (np.cumsum(standing)[ends - 1] * 4).tolist()
        start = 0
        for word, end in zip(words, until, strict=True):
            self.known[word] = packed[start:end]
            start = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed; strings of added tokens become those tokens."""
        split = []
        for text in texts:
            if self.added_split is None or "<" not in text and self.added_split.search(text) is None:
                split.append([self.find(text)])
            else:
                split.append([[part] if i % 2 else self.find(part) for i, part in enumerate(self.added_split.split(text))])
        met = {w for parts in split for words in parts[::2] for w in words}
        if len(self.known) + len(met) > REMEMBERED:
            self.known.clear()
        new = [w for w in met if w not in self.known]
        if new:
            self.learn(new)
        known = self.known
        out = []
        for parts in split:
            out.append(b"".join(self.added[words[0]] if i % 2 else b"".join([known[w] for w in words]) for i, words in enumerate(parts)))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids, added tokens included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[int, Bpe] = {}


def _loaded(definition) -> Bpe:
    key = hash(definition.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(definition.value)
    return _LOADED[key]


#: Characters that a batch of texts is cut at, so a worker holds the words of few texts at once.
BATCH_CHARS = 2_000_000


def _batches(texts: list[str]) -> Iterator[list[str]]:
    batch, chars = [], 0
    for text in texts:
        batch.append(text)
        chars += len(text)
        if chars > BATCH_CHARS:
            yield batch
            batch, chars = [], 0
    if batch:
        yield batch


class Tokenizer:
    """The vocabulary file at ``path``, read on the driver and sent to the workers (it is as large as the vocabulary)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            definition = file.read()
        Bpe(definition)
        ship(spark)
        small_batches(spark)
        shared = spark.sparkContext.broadcast(definition)

        @F.pandas_udf("binary")
        def encode(text: pd.Series) -> pd.Series:
            bpe = _loaded(shared)
            return pd.Series([ids for batch in _batches(text.tolist()) for ids in bpe.encode(batch)], dtype=object)

        @F.pandas_udf("string")
        def decode(ids: pd.Series) -> pd.Series:
            bpe = _loaded(shared)
            return pd.Series([bpe.decode(x) for x in ids], dtype=object)

        @F.pandas_udf("ids binary, decoded string")
        def both(text: pd.Series) -> pd.DataFrame:
            bpe = _loaded(shared)
            ids = [x for batch in _batches(text.tolist()) for x in bpe.encode(batch)]
            return pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series([bpe.decode(x) for x in ids], dtype=object)})

        self._encode, self._decode, self._both = encode, decode, both

    def encode(self, docs: DataFrame, text_col: str = "text", to: str = "ids") -> DataFrame:
        """``docs`` with the column ``to``: packed ids of the whole text (null: empty). A column of that name is replaced; all others and all rows stay."""
        return docs.withColumn(to, self._encode(whole(F.col(text_col))))

    def decode(self, docs: DataFrame, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
        """``docs`` with the column ``to``: the text of the packed ids (null: empty)."""
        return docs.withColumn(to, self._decode(F.coalesce(F.col(ids_col), F.lit(b""))))

    def round_trip(self, docs: DataFrame, text_col: str = "text") -> DataFrame:
        """``docs`` with ids and decoded, as encode() and then decode() give them, in one pass through one worker."""
        own = [c for c in docs.columns if c.lower() not in ("ids", "decoded", "__tidemark_coded")]
        return docs.select(*own, self._both(whole(F.col(text_col))).alias("__tidemark_coded")).select(*own, "__tidemark_coded.ids", "__tidemark_coded.decoded")


def account(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) for every row: digests of its ids and of the text that they decode to."""
    coded = Tokenizer(docs.sparkSession, path).round_trip(docs.select(F.col(id_col), F.col(text_col).alias("text")))
    return coded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
