import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer_path

LIBRARY = Library.from_file(tokenizer_path())
OWN = bpe.Bpe(open(tokenizer_path(), encoding="utf-8").read())


def ids_of(text):
    return [int.from_bytes(x[i : i + 4], "little") for x in OWN.encode([text]) for i in range(0, len(x), 4)]


TEXTS = [
    "", " ", "  \n\n x", "Hello world's  end", "aaaaaaaaaaaaaaaaaaaaaaaa", "été Ünï  ", "日本語 テキスト 123", "a<|endoftext|>b<|endoftext|>", "<|endoftext", "<",
    "\u3000\u2003x\x85y\xa0 z\x1c\x1d", "I'll we've they're 'S 'tis", "x" * 5000, "\t\tif (a==b){return 0;}\r\n", "🙂👍🏽 é", "\x00\x01\ufffd",
]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_round_trip(text):
    ids = ids_of(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.decode(OWN.encode([text])[0]) == text == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_on_any_text(text):
    assert ids_of(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bytes_that_are_no_text_decode_to_replacement():
    first = OWN.encode(["é"])[0]
    half = int(OWN.of_byte[0xC3]).to_bytes(4, "little")
    assert OWN.decode(first + half) == "é\ufffd"


def test_account(spark):
    rows = [(1, "a b", 9), (2, None, 9), (3, "", 9), (3, "", 9), (None, "x " * 3000, 9)]
    out = bpe.account(spark.createDataFrame(rows, "doc_id long, text string, ids int"), tokenizer_path())
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id or 0, r.n_tokens) for r in out.collect()) == [(0, len(ids_of("x " * 3000))), (1, 2), (2, 0), (3, 0), (3, 0)]
    assert bpe.account(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_round_trip_is_encode_then_decode(spark):
    tokenizer = bpe.Tokenizer(spark, tokenizer_path())
    docs = spark.createDataFrame([(1, "Hello  world é", "x"), (2, None, "y"), (3, "a<|endoftext|>b", "z")], "doc_id long, text string, ids string")
    one = tokenizer.round_trip(docs).orderBy("doc_id").collect()
    two = tokenizer.decode(tokenizer.encode(docs)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.ids, r.decoded) for r in one] == [(r.doc_id, r.ids, r.decoded) for r in two]
    assert [r.decoded for r in one] == ["Hello  world é", "", "a<|endoftext|>b"]
