import numpy as np

from marlstone.llm import decontam as D


def test_wand_finds_all_above(words):
    items = [(i, words(12 + i % 30, i)) for i in range(300)]
    index = D.Index(items)
    rng = np.random.default_rng(1)
    for _ in range(200):
        terms = rng.choice(len(index.terms), 60, replace=False).tolist()
        scores = {}
        for t in terms:
            for item, x in zip(index.items[t], index.impacts[t], strict=True):
                scores[item] = scores.get(item, 0.0) + x
        for threshold in (0.2, 0.35, 0.6):
            assert {i for i, _ in index.above(terms, threshold)} == {i for i, s in scores.items() if s >= threshold - 1e-9}


def test_promising_passages_hold_all_scores(words, monkeypatch):
    index = D.Index([(i, words(20 + i % 20, i)) for i in range(100)])
    monkeypatch.setattr(D, "CELLS", 60)
    text = D.plain_words(words(900, 77))
    ids = np.array([index.terms.get(w, -1) for w in text], np.int32)
    for threshold in (0.2, 0.3):
        kept = set(index.promising(ids, threshold))
        n = max(1, -(-(len(ids) - index.longest) // index.longest))
        for k in range(n):
            terms = {t for t in ids[k * index.longest : (k + 2) * index.longest].tolist() if t >= 0}
            if index.above(sorted(terms), threshold):
                assert k in kept


def contained(text, items):
    line = b" " + b" ".join(D.plain_words(text)) + b" "
    return {i for i, t in items if D.plain_words(t) and b" " + b" ".join(D.plain_words(t)) + b" " in line}


def test_planted_items_are_found_and_others_not(make, words, odd, spark):
    items = [(i, words(30, 500 + i) + ". " + words(8, 700 + i) + "?") for i in range(20)] + [(20, None), (21, ""), (22, words(30, 500) + ". " + words(8, 700) + "?")]
    texts = [*odd]
    for s in range(40):
        t = words(200, s)
        if s % 4 == 0:
            cut = 17 * s % 900
            t = t[:cut] + " " + items[s // 4][1].upper() + "\n" + t[cut:]
        texts.append(t)
    texts.append(words(38, 90) + " " + " ".join(reversed(items[3][1].split())))
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make(texts)
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, bench).collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j in contained(t, items)}
    clean = D.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {i for i, _ in got}
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0


def test_items_in_blocks_give_the_same(make, words, spark, monkeypatch):
    items = [(i, words(30, 500 + i) + ". " + words(8, 700 + i)) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make([words(50, s) + " " + items[s][1] + " " + words(50, s + 50) for s in range(12)])
    one = sorted(D.contaminated(docs, bench).select("doc_id", "item_id").collect())
    monkeypatch.setattr(D, "ITEMS_BYTES", 600)
    assert len(D.indexes(bench)) > 1
    assert sorted(D.contaminated(docs, bench).select("doc_id", "item_id").collect()) == one == [(i, i) for i in range(12)]


def test_question_and_answer():
    assert D.question_answer("What is the way to go? Over the hill.") == ([b"what", b"is", b"the", b"way", b"to", b"go"], [b"over", b"the", b"hill"])
    q, a = D.question_answer("one two three four")
    assert (len(q), len(a)) == (3, 1)
    assert D.question_answer(None) == ([], [])
