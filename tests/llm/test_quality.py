from collections import Counter

from pyspark.sql import functions as F

from marlstone.llm import quality as Q


def brute(text):
    text = text or ""
    w = text.encode().split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
        seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    gone = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), dup, len(gone)


def test_counts_equal_brute_force(make, words, odd):
    texts = [*odd, words(60, 1), "a b c a b c", "a a a a", "a a a", "x\ny\nx\n\n\nx\n ", words(30, 2) + " # ** <p> | &&", (words(20, 3) + "\n") * 3]
    got = {r["doc_id"]: r for r in Q.quality(make(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(t), i
        n, _, _, _, repeat = brute(t)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_bands_reject_odd_spelling_only(make, words):
    good = [words(120, s) for s in range(300)]
    bad = [words(120, 1000 + s).upper() for s in range(8)]
    got = {r["doc_id"]: r for r in Q.quality(make(good + bad)).collect()}
    assert sum(got[i]["kept"] for i in range(300)) >= 297
    assert not any(got[300 + i]["kept"] for i in range(8))


def test_few_documents_have_no_bands(make, words):
    assert all(r["kept"] for r in Q.quality(make([words(120, s) for s in range(5)] + [words(120, 9).upper()])).collect())


def test_script_stands_in_for_language(make, words):
    docs = make([words(120, s) for s in range(120)] + ["один два три четыре " * 20], langs=[None] * 121)
    rows = Q.quality(docs).collect()
    assert {r["script"] for r in rows} == {"latin", "cyrillic"}
    assert Q.quality(docs.drop("lang")).count() == 121


def test_keep_good_keeps_columns(make, words, odd):
    docs = make([*odd, words(80, 1), words(80, 1)]).withColumn("text_hash", F.lit("mine")).withColumn("kept", F.lit(0))
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r["text_hash"] for r in kept.collect()] == ["mine", "mine"]
    assert Q.keep_good(docs.limit(0)).count() == 0


def test_small_groups_are_judged_by_wider_bands(make, words):
    good = [words(120, s) for s in range(200)] + [words(n, n) for n in (90, 170, 480, 3000)]
    bad = [words(n, 1000 + n).upper() for n in (90, 170, 480, 3000)] + [words(120, 9).upper()]
    langs = ["en"] * 208 + ["rare"]
    got = {r["doc_id"]: r for r in Q.quality(make(good + bad, langs=langs)).collect()}
    assert not any(got[204 + i]["kept"] for i in range(5))
    assert sum(got[i]["kept"] for i in range(200)) >= 197


def test_few_documents_meet_fixed_limits(make):
    from random import Random

    noise = " ".join("".join(chr(Random(9 * i + j).randint(0x100, 0x24F)) for j in range(8)) for i in range(80))
    assert [r["outside"] for r in Q.quality(make([noise])).collect()] == [["fallback_share"]]
