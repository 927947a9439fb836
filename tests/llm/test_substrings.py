import hashlib

import pytest

from marlstone.llm import substrings as S


def brute(rows, n=50):
    first = {}
    split = {i: (t or "").encode().split() for i, t in rows}
    for i in sorted(split):
        w = split[i]
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [S.HOT, 2])
def test_equals_brute_force(make, words, odd, hot):
    passage, other = words(60, 1), words(49, 2)
    texts = [*odd, words(300, 3), words(100, 4) + " " + passage, passage + " " + words(120, 5), words(10, 6) + " " + passage + "\n" + passage, words(300, 3), other, other + " a", passage, "same " * 200, "same " * 90, *[words(70, 50 + i) + " " + passage + " " + words(5, i) for i in range(6)]]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.without_repeats(make(texts), hot=hot).collect()}
    assert got == brute(list(enumerate(texts)))


def test_hashes_depend_on_words_alone(words):
    w = words(5000, 9).encode().split()
    h = S.word_hashes(w)
    assert (S.word_hashes(w[1234:])[:10] == h[1234:1244]).all()
    assert (S.minimisers(h[700:900])[:50] == S.minimisers(h)[700:750]).all()
    old, S.CHUNK = S.CHUNK, 500
    try:
        assert (S.word_hashes(w) == h).all() and (S._runs(h, 50, S.WORD_BASES[0])[2000:2100] == S._runs(h[2000:2149], 50, S.WORD_BASES[0])).all()
    finally:
        S.CHUNK = old


def test_ids_that_repeat_or_lack(spark, words):
    t = words(80, 1)
    rows = spark.createDataFrame([(4, t), (4, t), (4, t + " x"), (None, t)], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_removed"]) for r in S.without_repeats(rows).collect())
    assert got == [(False, 0), (False, 0), (False, 0), (True, 80)]
    assert S.without_repeats(rows.limit(0)).count() == 0
