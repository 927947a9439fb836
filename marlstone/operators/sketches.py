"""Mergeable sketches: kept by day, merged over any span, with stated errors; and frequent items.

A sketch of a day is small and made once; that of a month is merged from its days
without reading a row. Estimates differ between engines, so the queries return exact
figures beside a boolean that says whether the estimate lies within its bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import small
from marlstone.plans.registry import query
from marlstone.session import Tables
from marlstone.sources.files import kept

#: Bits of the distinct-count sketch, size of the quantile sketch, and their errors: four standard errors of distinct counts, and the share of rows by which a quantile's rank may be off.
DISTINCT_BITS, QUANTILE_SIZE = 12, 800
DISTINCT_ERROR, QUANTILE_ERROR = 4 * 0.0163, 0.01


def sketched(df: DataFrame, by: list[str], distinct: str, value: str) -> DataFrame:
    """``by``, rows, and sketches of the distinct values of one column and of the quantiles of another; nulls are in neither, NaN not in quantiles."""
    real = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(distinct, F.lit(DISTINCT_BITS)).alias("distinct_sketch"), F.call_function("kll_sketch_agg_double", real, F.lit(QUANTILE_SIZE)).alias("quantile_sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of larger groups from those of smaller ones."""
    return sketches.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.call_function("kll_merge_agg_double", F.col("quantile_sketch")).alias("quantile_sketch"))


def distinct_estimate(sketch: str = "distinct_sketch") -> Column:
    """Number of distinct values."""
    return F.hll_sketch_estimate(sketch)


def quantile_estimate(p: float, sketch: str = "quantile_sketch") -> Column:
    """A value whose rank is near the share ``p``; null for an empty sketch."""
    filled = F.call_function("kll_sketch_get_n_double", F.col(sketch)) > 0
    return F.when(filled, F.call_function("kll_sketch_get_quantile_double", F.col(sketch), F.lit(float(p))))


def frequent(df: DataFrame, item: str, share: float, by: list[str] | None = None) -> DataFrame:
    """``by``, item and n of every item that makes up more than ``share`` of the rows of its group; exact.

    Items are first counted in hashed cells, fewer than there are items: an item can only
    be frequent if its cell is, in each of two independent hashings. Items of such cells
    alone are counted one by one, so rare ones, the most, never make a row of a shuffle. A
    null is an item.
    """
    by = by or []
    cells = max(64, int(16 / share))
    names = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)]
    groups = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*names, F.col(f"`{item}`").alias("_item")).withColumns({f"_c{s}": F.pmod(F.xxhash64(F.lit(s), F.col("_item")), F.lit(cells)) for s in (1, 2)})
    totals = kept(rows.groupBy(*groups).agg(F.count("*").alias("_rows")))
    left = rows
    for c in ("_c1", "_c2"):
        counted = rows.groupBy(*groups, c).agg(F.count("*").alias("_n"))
        heavy = kept(_joined(counted, totals, groups).where(F.col("_n") > F.col("_rows") * share).select(*groups, c))
        left = left.join(small(heavy.withColumnsRenamed({g: f"{g}_" for g in [*groups, c]})), _equal([*groups, c]), "left_semi")
    counted = left.groupBy(*groups, "_item").agg(F.count("*").alias("n"))
    out = _joined(counted, totals, groups).where(F.col("n") > F.col("_rows") * share)
    return out.select(*[F.col(g).alias(c) for g, c in zip(groups, by, strict=True)], F.col("_item").alias(item), "n")


def _equal(columns: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in columns], F.lit(True))


def _joined(counted: DataFrame, totals: DataFrame, groups: list[str]) -> DataFrame:
    other = totals.withColumnsRenamed({g: f"{g}_" for g in groups})
    return counted.join(small(other), _equal(groups)).drop(*[f"{g}_" for g in groups])


def by_day(t: Tables) -> DataFrame:
    """The stored daily sketches of events: their users, and the quantiles of their values."""
    return kept(sketched(t.events.withColumn("day", F.to_date("ts")), ["day", "event_type"], "user_id", "value"))


@query("""SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, count(*) AS n, true AS users_near, true AS median_near, true AS p99_near FROM events GROUP BY ALL""")
def sketches_by_week(t: Tables) -> DataFrame:
    """Weekly distinct users and quantiles merged from daily sketches, each held against the exact figure."""
    week = lambda c: F.to_date(F.date_trunc("week", F.col(c)))
    weekly = kept(merged(by_day(t).withColumn("week", week("day")), ["event_type", "week"]))
    guessed = weekly.select("event_type", "week", F.col("rows").alias("n"), distinct_estimate().alias("users"), quantile_estimate(0.5).alias("median"), quantile_estimate(0.99).alias("p99"))
    rows = t.events.select("event_type", "user_id", "value", week("ts").alias("week")).join(F.broadcast(guessed), ["event_type", "week"])  # five types of event by week
    share = lambda c: F.count_if(F.col("value") < F.col(c)) / F.count("*")
    upto = lambda c: F.count_if(F.col("value") <= F.col(c)) / F.count("*")
    near = lambda c, p: (share(c) <= p + QUANTILE_ERROR) & (upto(c) >= p - QUANTILE_ERROR)
    out = rows.groupBy("event_type", "week", "n", "users").agg(F.count_distinct("user_id").alias("exact"), near("median", 0.5).alias("median_near"), near("p99", 0.99).alias("p99_near"))
    return out.select("event_type", "week", "n", (F.abs(F.col("users") - F.col("exact")) <= F.col("exact") * DISTINCT_ERROR + 1).alias("users_near"), "median_near", "p99_near")


@query(r"""SELECT source, word, n FROM (SELECT source, word, count(*) AS n, sum(count(*)) OVER (PARTITION BY source) AS total
FROM (SELECT source, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word FROM documents) GROUP BY source, word) WHERE n > total * 0.01""")
def frequent_words(t: Tables) -> DataFrame:
    """Words that make up more than a hundredth of their source."""
    words = t.documents.select("source", F.explode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("word"))
    return frequent(words, "word", 0.01, ["source"])


@query("""SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 0.0007 * (SELECT count(*) FROM lineitem)""")
def frequent_parts(t: Tables) -> DataFrame:
    """Parts that are in more than seven of ten thousand lines."""
    return frequent(t.lineitem, "l_partkey", 0.0007)


def bottom_k(df: DataFrame, k: int, keys: list[str], by: list[str] | None = None, weight: str | None = None, salt: str = "") -> DataFrame:
    """``k`` rows of each group: those of least md5 of ``keys``, or, with ``weight``, a priority sample.

    The number of a row is uniform and fixed by its keys, so the sample is the same in
    any engine and at any layout, samples of parts merge to that of the whole, and a
    row of both of two tables is in both samples or comes close. With a weight w the
    rows of greatest w / u are taken, u being the number; ``priority`` is that quotient
    and ``threshold`` the (k + 1)-th greatest: max(w, threshold) is an unbiased share of
    a row in the sum of weights. Rows with equal keys tie in any order of the other columns;
    a null weight, or one that isn't above 0, is never taken.
    """
    by = by or []
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in keys])
    whole = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")
    number = (whole.cast("double") + 0.5) / float(1 << 52)
    ties = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if not df.schema[c].dataType.simpleString().startswith("map")]
    groups = [F.col(f"`{c}`") for c in by] or [F.lit(0)]
    if weight is None:
        rows = df.withColumn("_number", number)
        kth = F.row_number().over(Window.partitionBy(*groups).orderBy("_number", *ties))
        return rows.withColumn("_nth", kth).where(F.col("_nth") <= k).drop("_number", "_nth")
    w = F.col(f"`{weight}`").cast("double")
    rows = df.where(w > 0).withColumn("priority", w / number)
    spread = Window.partitionBy(*groups).orderBy(F.desc("priority"), *ties)
    few = rows.withColumn("_nth", F.row_number().over(spread)).where(F.col("_nth") <= k + 1)
    next_ = F.max(F.when(F.col("_nth") == k + 1, F.col("priority"))).over(Window.partitionBy(*groups))
    return few.withColumn("threshold", F.coalesce(next_, F.lit(0.0))).where(F.col("_nth") <= k).drop("_nth")


_NUMBER = "(CAST('0x' || substr(md5(concat_ws('|', '{}', {})), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


@query(f"""SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_NUMBER.format('s1', 'CAST(doc_id AS VARCHAR)')}) <= 20""")
def stratified_sample(t: Tables) -> DataFrame:
    """Twenty documents of each source, by the least hashes of their ids."""
    return bottom_k(t.documents.select("doc_id", "source"), 20, ["doc_id"], ["source"], salt="s1")


_PRIORITY = f"SELECT o_orderkey, o_orderpriority, o_totalprice, o_totalprice / ({_NUMBER.format('p', 'CAST(o_orderkey AS VARCHAR)')}) AS priority FROM orders WHERE o_totalprice > 0"


@query(f"""SELECT o_orderkey, o_orderpriority, round(greatest(o_totalprice, coalesce(threshold, 0)), 4) AS share FROM (
  SELECT *, max(CASE WHEN nth = 101 THEN priority END) OVER (PARTITION BY o_orderpriority) AS threshold FROM (
    SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY priority DESC) AS nth FROM ({_PRIORITY}))) WHERE nth <= 100""")
def priority_sample(t: Tables) -> DataFrame:
    """A hundred orders of each priority by their price, each with its share in the sum of all prices."""
    out = bottom_k(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), 100, ["o_orderkey"], ["o_orderpriority"], weight="o_totalprice", salt="p")
    return out.select("o_orderkey", "o_orderpriority", F.round(F.greatest("o_totalprice", "threshold"), 4).alias("share"))


@query("SELECT o_orderpriority, true AS near FROM orders GROUP BY o_orderpriority")
def priority_sums(t: Tables) -> DataFrame:
    """Sums of prices from priority samples of a thousand, within a fifth of the exact ones."""
    out = bottom_k(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), 1000, ["o_orderkey"], ["o_orderpriority"], weight="o_totalprice", salt="p")
    guessed = out.groupBy("o_orderpriority").agg(F.sum(F.greatest("o_totalprice", "threshold")).alias("guess"))
    exact = t.orders.where("o_totalprice > 0").groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("exact"))
    return guessed.join(exact, "o_orderpriority").select("o_orderpriority", (F.abs(F.col("guess") / F.col("exact") - 1) < 0.2).alias("near"))
