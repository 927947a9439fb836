import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from texts; ids count from 0."""

    def make(texts, sources=None, langs=None):
        rows = [(i, t, (langs or {}).get(i, "en") if isinstance(langs, dict) or langs is None else langs[i], None if sources is None else sources[i], len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    return make


@pytest.fixture(scope="session")
def words():
    """Seeded text of invented words."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice(["ta", "ri", "no", "the", "ed", "lu", "ga", "sho"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    return lambda n, seed: " ".join(random.Random(seed).choices(vocabulary, k=n))


ODD = [None, "", " ", "\n\n", "x", "naïve ünïcödé — ｆｕｌｌ 漢字 \U0001f600"]


@pytest.fixture(scope="session")
def odd():
    """Texts that are null, empty or strange, a repeat, and a very long one."""
    return [*ODD, "x", "long " * 60_000]
