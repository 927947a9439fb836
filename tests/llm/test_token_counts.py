"""Token counts against the library."""

import random

import pytest
from pyspark.sql import functions as F

public = pytest.importorskip("public_tokenizers")

from marlstone.llm import tokencount as K  # noqa: E402


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def own():
    return K.Counter(public.path("byte_bpe_50k.json"))


POOL = ["a", "aaa", "aaaaaaa", " ", "  ", "\n", "\t", "\r\n", "'s", "'ll", "'LL", "<|endoftext|>", "<|endoftext", "é", "漢字", "\U0001f600", "՘", "1", "23", "²", "…", "　", "\x1c", "\x85", "\xa0", "​", "---", " the", "ing", "\x00", "A1b2C3"]


def test_odd_strings_and_characters(own, library):
    rng = random.Random(1)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choices(POOL, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice(points)) if rng.random() < 0.5 else rng.choice(POOL) for _ in range(20)) for _ in range(1500)]
    assert own.count(texts) == library(texts)


def test_long_pre_tokens_and_texts(own, library, monkeypatch):
    rng = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = ["a" * 50_001, "".join(rng.choices(letters, k=60_000)), "漢字" * 20_000, "ab " * 20_000 + "  \n\n " + "q" * 9_000 + " end"]
    want = library(texts)
    assert own.count(texts) == want
    monkeypatch.setattr(K, "PART", 1000)
    monkeypatch.setattr(K, "ROOM", 500)
    assert K.Counter(public.path("byte_bpe_50k.json"), memory=50).count(texts) == want


def test_a_pair_joins_at_every_second_place():
    merges = K.Merges({c: i for i, c in enumerate(K.alphabet())} | {"aa": 256, "aaaa": 257, "ab": 258}, [["a", "a"], ["aa", "aa"], ["a", "b"]])
    assert merges.count([b"aaaaa", b"aab", b"aaab", b"b", b"", b"ab"]).tolist() == [2, 2, 2, 1, 0, 1]


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        K.Counter(public.path("word_bpe_49k.json"))


def test_query_counts_whole_texts(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: n for r, n in zip(rows, library([r["text"] or "" for r in rows]), strict=True)}
    got = K.op13_rank_synchronous(spark, sf_dir).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == want and len(got) == len(rows)
    size = {r["doc_id"]: len((r["text"] or "").encode()) for r in rows}
    assert all(r["n_bytes"] == size[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 1024) for r in got)


def test_odd_rows(spark, odd, library):
    rows = [(str(i) if i else None, t) for i, t in enumerate(odd)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({"n_tokens": F.lit("x"), "Text2": F.lit(1)})
    got = K.token_counts(docs).collect()
    assert sorted((r["doc_id"] or "", r["n_tokens"]) for r in got) == sorted((d or "", n) for (d, _), n in zip(rows, library([t or "" for t in odd]), strict=True))
    assert K.token_counts(docs.limit(0)).count() == 0
