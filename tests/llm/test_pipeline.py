from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from marlstone.llm import decontam, mixing, quality
from marlstone.llm.common import row_hash, table


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    from marlstone.llm.common import staged

    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in C.STAGES:
        new = staged(stage(spark, docs, sf_dir), name)
        out.append((name, docs, new))
        docs = new
    return {name: (a, b) for name, a, b in out}


def firsts(texts):
    """Least doc_id of each group of texts whose five-word shingles have a Jaccard similarity of 0.8 or more, by brute force."""
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    held = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        held[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    for a, b in combinations(sorted(texts), 2):
        if len(held[a] & held[b]) >= 0.8 * len(held[a] | held[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_do_what_their_operators_say(steps, spark, sf_dir):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "mixing", "sharding"]
    a, b = steps["quality_rules"]
    assert ids(b) == ids(quality.quality(a).where("kept"))
    a, b = steps["near_duplicates"]
    want, kept = firsts({r["doc_id"]: r["text"] for r in a.collect()}), set(ids(b))
    assert want <= kept and len(kept - want) <= max(1, 0.1 * (len(ids(a)) - len(want)))  # keys find most pairs, not all (here one of 0.83 has one segment in common), and link none that brute force doesn't
    a, b = steps["decontamination"]
    held = {r[0] for r in decontam.contaminated(a, table(spark, sf_dir, "benchmark")).select("doc_id").collect()}
    assert held and set(ids(b)) == set(ids(a)) - held
    a, b = steps["mixing"]
    drawn = mixing.mix(a, identity=row_hash(a, 1)).withColumnRenamed("doc_id", "k").join(a.select("doc_id", row_hash(a, 1).alias("k")), "k")
    assert ids(b) == {r["doc_id"]: r["copies"] for r in drawn.collect() if r["copies"]}
    a, b = steps["sharding"]
    assert ids(a) == ids(b) and b.columns == [*a.columns, "shard", "slot"]
    assert all(x.columns == table(spark, sf_dir, "documents").columns for n, (_, x) in steps.items() if n != "sharding")


def test_run_agrees_with_the_stages(steps, spark, sf_dir):
    assert sorted(C.run(spark, sf_dir).select("doc_id", "shard", "slot").collect()) == sorted(steps["sharding"][1].select("doc_id", "shard", "slot").collect())


def test_odd_rows_in_every_stage(spark, sf_dir, words, odd):
    """Nulls in every column, empty and long texts, repeats, ties in doc_id, columns with names of the library's own, and no rows."""
    texts = [*odd, words(80, 1), words(80, 1), words(80, 2), words(80, 3) + " tail"]
    rows = [(None if i % 5 == 4 else i // 2, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "web", None) for i, t in enumerate(texts)] * 2
    clashing = ("id", "fp", "group", "k1", "copy", "rank", "kept", "text_hash", "source_size", "_k1", "_kept_id", "_mixed_id")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(c).alias(c) for c in clashing])
    for name, stage in C.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.columns == [*docs.columns, *(["shard", "slot"] if name == "sharding" else [])], name
        kept = out.select("doc_id", "text").collect()
        assert {tuple(r) for r in kept} <= {(r[0], r[1]) for r in rows}, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
