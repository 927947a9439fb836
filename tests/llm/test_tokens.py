import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs

from marlstone.llm import tokenbin as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def model():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


TEXTS = ["a  b", "a \nb", "\n\na b", "it's, don't  ", " lead", "tab\tand space x y", "one\ntwo\nthree four", "x <|endoftext|> y <|endoftext|>", "end ", "a\n", "\n", "don 's 't\n's", "1 22 333\n4", "é́ ​ z \x1c q"]


def test_pieces_equal_whole_texts(model, words, odd):
    coder = T.Encoder(PATH, memory=50)
    texts = [t or "" for t in [*odd, *TEXTS, *[words(200, s).replace(" ", "\n", 5) for s in range(10)]]]
    for _ in range(2):
        for text, ids in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(ids, coder.kind).tolist() == model.encode(text, add_special_tokens=False).ids, text
    assert len(coder.known) <= 50


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000))
    mph = T.PerfectHash.build(keys)
    assert sorted(mph(keys).tolist()) == list(range(len(keys)))
    assert T.PerfectHash.build(keys[:0])(keys[:3]).tolist() == [-1, -1, -1]


def test_round_trip(make, odd, words, model, tmp_path, spark):
    texts = [*odd, *TEXTS, *[words(50, s) for s in range(30)]]
    docs = make(texts)
    folder = f"file://{tmp_path}/shards"
    manifest = T.write_shards(docs, folder, PATH)
    got = sorted(T.read_documents(manifest, folder).collect())
    at = 0
    for (doc, start, n, crc), t in zip(got, texts, strict=True):
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        assert (start, n, crc) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), doc
        at += len(ids)
    shards = manifest.orderBy("shard").collect()
    files, _ = fs.FileSystem.from_uri(folder)
    ranges = [(s["low"], s["high"]) for s in shards]
    assert ranges == sorted(ranges) and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    shard = T.ShardReader(files, shards[0]["name"])
    assert shard.get(shards[0]["low"]) is not None
    assert shard.get(10**12) is None


def test_rows_that_repeat_or_lack_ids(spark):
    rows = spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "c"), (None, "d")], "doc_id long, text string")
    got = T.tokenised(rows).collect()
    assert sorted((r["doc_id"] is None, r["n_tokens"]) for r in got) == [(False, 2), (False, 3), (False, 3), (True, 2)]
    assert sorted(r["start"] for r in got)[0] == 0 and len({r["start"] for r in got}) == 4
    assert T.tokenised(rows.limit(0)).count() == 0
