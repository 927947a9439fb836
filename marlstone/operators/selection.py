"""Exact order statistics of groups of any size, by distributed selection.

A quantile sketch of each group proposes two values between which a wanted rank should
lie. A pass over the rows counts exactly what lies below, at, between and above them;
the part that holds the rank becomes the next bounds, and so on until it is one value
or holds few, which alone are sorted. The sketch only steers: counts are exact, so the
result is. Each pass aggregates partially to five counts for each group and rank, so no
task ever holds a group, however large it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.joins import small
from marlstone.plans.registry import query
from marlstone.session import Tables
from marlstone.sources.files import kept

#: Size of the sketches that propose cuts, the error of their ranks that is allowed for, and values of a range that may be sorted.
SKETCH, ERROR, FEW = 2048, 0.01, 4096


def percentiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], interpolate: bool = True, few: int = FEW) -> DataFrame:
    """``by`` and for each name of ``at`` the percentile of ``value`` that it maps to, a number from 0 to 1.

    Interpolated between the two nearest ranks, or, without ``interpolate``, the value of
    least rank whose share reaches the percentile. Null values don't count; NaN is
    greater than any number, as it is in a sort; a group without values gets null. Ties
    need no rule, as equal values are one. Values are compared as doubles. The
    result doesn't depend on the layout of the rows.
    """
    keys = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)]
    groups = [f"_g{i}" for i in range(len(by))] or ["_g"]
    rows = df.select(*(keys or [F.lit(0).alias("_g")]), F.col(f"`{value}`").cast("double").alias("_v"))
    real = F.col("_v").isNotNull() & ~F.isnan("_v")
    bounds = kept(rows.groupBy(*groups).agg(F.count("_v").alias("_n"), F.count_if(real).alias("_reals"), F.min(F.when(real, F.col("_v"))).alias("_low"), F.max(F.when(real, F.col("_v"))).alias("_high"), F.max("_v").alias("_most"), _sketch(F.when(real, F.col("_v"))).alias("_s")))

    # one row for each group and wanted rank, ranks from 0
    names = list(at)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(at[c])).alias("p")) for i, c in enumerate(names)]))
    asked = bounds.where("_n > 0").withColumn("_w", wanted).select("*", F.col("_w.i").alias("_i"), F.col("_w.p").alias("_p"))
    place = F.col("_p") * (F.col("_n") - 1)
    # the least rank whose share of the rows reaches p
    least = F.greatest(F.ceil(F.col("_p") * F.col("_n")) - 1, F.lit(0)).cast("long")
    ranks = [F.floor(place).cast("long"), F.ceil(place).cast("long")] if interpolate else [least]
    asked = asked.withColumn("_at", place).withColumn("_r", F.explode(F.array_distinct(F.array(*ranks))))
    first = asked.select(*groups, "_i", "_r", "_low", "_high", "_s", F.lit(0).cast("long").alias("_before"), F.col("_reals").alias("_many"))
    done = asked.where("_r >= _reals").select(*groups, "_i", "_r", F.col("_most").alias("_x"))  # ranks of NaN
    open_ = kept(first.where("_r < _many"))
    found = [kept(done)]
    while True:
        # a range of one value is found; a range of few values is sorted; others are cut again
        settled = open_.where("_low = _high").select(*groups, "_i", "_r", F.col("_low").alias("_x"))
        found.append(settled)
        rest = open_.where("_low < _high")
        sortable = rest.where(F.col("_many") <= few)
        found.append(_sorted(rows, sortable, groups))
        rest = kept(rest.where(F.col("_many") > few))
        if rest.isEmpty():
            break
        open_ = _narrowed(rows, rest, groups)
    values = found[0]
    for part in found[1:]:
        values = values.unionByName(part)
    x = asked.select(*groups, "_i", "_at", "_r").join(values.withColumnsRenamed({c: f"{c}_" for c in (*groups, "_i", "_r")}), _same([*groups, "_i", "_r"]))
    low, high = F.min_by("_x", "_r"), F.max_by("_x", "_r")
    share = F.first("_at") - F.min("_r")
    each = x.groupBy(*groups, "_i").agg(F.when((F.count("*") == 1) | (low == high), low).otherwise(low + (high - low) * share).alias("_x"))
    wide = each.groupBy(*groups).agg(*[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(c) for i, c in enumerate(names)])
    out = bounds.select(*groups).join(wide.withColumnsRenamed({g: f"{g}_" for g in groups}), _same(groups), "left")
    return out.select(*[F.col(g).alias(c) for g, c in zip(groups, by, strict=False)], *names)


def _same(groups: list[str]) -> Column:
    """Equal groups, null included."""
    out = F.lit(True)
    for g in groups:
        out = out & F.col(g).eqNullSafe(F.col(f"{g}_"))
    return out


def _within(rows: DataFrame, open_: DataFrame, groups: list[str]) -> DataFrame:
    """The rows that lie in the bounds of a wanted rank of their group, once for each."""
    bounds = open_.withColumnsRenamed({g: f"{g}_" for g in groups})
    return rows.join(small(bounds), _same(groups)).where((F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high")))


def _sorted(rows: DataFrame, open_: DataFrame, groups: list[str]) -> DataFrame:
    """The wanted values of ranges that hold few, by sorting those."""
    order = Window.partitionBy(*groups, "_i", "_r").orderBy("_v")
    ranked = _within(rows, open_, groups).withColumn("_k", F.col("_before") + F.row_number().over(order) - 1)
    return ranked.where("_k = _r").select(*groups, "_i", "_r", F.col("_v").alias("_x"))


def _sketch(value: Column) -> Column:
    return F.call_function("kll_sketch_agg_double", value, F.lit(SKETCH))


def _narrowed(rows: DataFrame, open_: DataFrame, groups: list[str]) -> DataFrame:
    """Each wanted rank with the part of its bounds that holds it: the part's least and greatest value, the values before it, those in it, and their sketch.

    The two cuts are values that occur and are parts of their own. So a part of copies of
    one value ends the search, and the part between loses two distinct values at least.
    """
    share = (F.col("_r") - F.col("_before") + 0.5) / F.col("_many")
    steps = round(2 / ERROR)
    quantiles = F.call_function("kll_sketch_get_quantile_double", F.col("_s"), F.array(*[F.lit(i / steps) for i in range(steps + 1)]))
    near = lambda i: F.element_at("_q", (F.greatest(F.lit(0), F.least(F.lit(steps), i)) + 1).cast("int"))
    cuts = open_.withColumn("_q", quantiles).select(*groups, "_i", "_r", "_before", "_low", "_high", near(F.floor(share * steps) - 1).alias("_a"), near(F.ceil(share * steps) + 1).alias("_b"))
    cuts = kept(cuts)
    v, a, b = F.col("_v"), F.col("_a"), F.col("_b")
    part = F.when(v < a, 0).when(v == a, 1).when(v < b, 2).when(v == b, 3).otherwise(4)
    counted = _within(rows, cuts, groups).groupBy(*groups, "_i", "_r", "_before", part.alias("_part")).agg(F.count("*").alias("_many"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), _sketch(F.col("_v")).alias("_s"))
    order = Window.partitionBy(*groups, "_i", "_r").orderBy("_part")  # five rows at most
    upto = counted.withColumn("_before", F.col("_before") + F.sum("_many").over(order) - F.col("_many"))
    return kept(upto.where((F.col("_r") >= F.col("_before")) & (F.col("_r") < F.col("_before") + F.col("_many"))).drop("_part"))


def median(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by`` and the interpolated ``median`` of ``value``; see percentiles."""
    return percentiles(df, by, value, {"median": 0.5})


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.999), 6) AS p999 FROM events GROUP BY event_type""")
def selected_percentiles(t: Tables) -> DataFrame:
    """Exact interpolated percentiles by distributed selection."""
    out = percentiles(t.events, ["event_type"], "value", {"median": 0.5, "p90": 0.9, "p999": 0.999})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "p90", "p999")])


@query("""SELECT quantile_disc(n_chars, 0.01) AS p1, quantile_disc(n_chars, 0.5) AS median, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS longest FROM documents""")
def selected_lengths(t: Tables) -> DataFrame:
    """Percentiles of all lengths, as values that occur."""
    out = percentiles(t.documents, [], "n_chars", {"p1": 0.01, "median": 0.5, "p99": 0.99, "longest": 1.0}, interpolate=False)
    return out.select(*[F.col(c).cast("long").alias(c) for c in ("p1", "median", "p99", "longest")])


@query("""SELECT source, lang, round(quantile_cont(n_chars, 0.5), 6) AS median, round(quantile_cont(n_chars, 0.25), 6) AS lower, round(quantile_cont(n_chars, 0.75), 6) AS upper FROM documents GROUP BY source, lang""")
def selected_quartiles(t: Tables) -> DataFrame:
    """Quartiles of the lengths of each source and language, one of which is hot."""
    out = percentiles(t.documents, ["source", "lang"], "n_chars", {"lower": 0.25, "median": 0.5, "upper": 0.75})
    return out.select("source", "lang", *[F.round(c, 6).alias(c) for c in ("lower", "median", "upper")])
