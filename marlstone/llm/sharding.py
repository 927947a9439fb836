"""Uniform shuffle into shards of exact size, through a hypergeometric communication matrix."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bind, fresh, repeated, row_hash, staged, table, unit

#: Rows that one local permutation sorts, on average.
LOCAL_ROWS = 16_384


def _draw(total: Column, good: Column, picks: Column, u: Column) -> Column:
    """A hypergeometric number: good ones among ``picks`` drawn from ``total`` that hold ``good``.

    Inversion from the mode outwards. Probabilities relative to the mode follow by
    their ratios, so nothing underflows; ten standard deviations on either side
    hold all of the mass that a double can tell.
    """
    low = F.greatest(F.lit(0).cast("long"), picks + good - total)
    high = F.least(picks, good)
    mode = F.least(high, F.greatest(low, F.floor((picks + 1).cast("double") * (good + 1) / (total + 2))))
    spread = F.sqrt(picks.cast("double") * good / F.greatest(total, F.lit(1)) * (total - good) / F.greatest(total, F.lit(1)))
    reach = F.ceil(10 * spread).cast("long") + 20
    bound = F.struct(low.alias("low"), high.alias("high"), mode.cast("long").alias("mode"), reach.alias("reach"), total.alias("n"), good.alias("k"), picks.alias("m"), u.alias("u"))

    def inner(b: Column) -> Column:
        up = F.when(b["mode"] < b["high"], F.sequence(b["mode"] + 1, F.least(b["high"], b["mode"] + b["reach"]))).otherwise(F.array().cast("array<bigint>"))
        down = F.when(b["mode"] > b["low"], F.sequence(b["mode"] - 1, F.greatest(b["low"], b["mode"] - b["reach"]))).otherwise(F.array().cast("array<bigint>"))
        ratio_up = lambda k: (b["k"] - k + 1).cast("double") * (b["m"] - k + 1) / (k.cast("double") * (b["n"] - b["k"] - b["m"] + k))
        ratio_down = lambda k: (k + 1).cast("double") * (b["n"] - b["k"] - b["m"] + k + 1) / ((b["k"] - k).cast("double") * (b["m"] - k))

        def walk(values: Column, ratio, first: Column, aim: Column) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), first.alias("sum"), F.lit(None).cast("long").alias("pick"))

            def step(acc: Column, k: Column) -> Column:
                w = acc["w"] * ratio(k)
                return F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), F.coalesce(acc["pick"], F.when(acc["sum"] + w > aim, k)).alias("pick"))

            return F.aggregate(values, start, step)

        zero, never = F.lit(0.0), F.lit(math.inf)
        mass = F.struct(walk(up, ratio_up, zero, never)["sum"].alias("up"), walk(down, ratio_down, zero, never)["sum"].alias("down"))

        def choose(t: Column) -> Column:
            aim = b["u"] * (1 + t["up"] + t["down"])
            return F.when(aim < 1, b["mode"]).otherwise(F.coalesce(walk(up, ratio_up, F.lit(1.0), aim)["pick"], walk(down, ratio_down, 1 + t["up"], aim)["pick"], b["mode"]))

        return bind(mass, choose)

    return bind(bound, inner)


def _split(columns: Column, rows: Column, seed: int, node: Column) -> Column:
    """How many rows of each shard fall to the left child that takes ``rows`` of them: multivariate hypergeometric."""
    total = F.aggregate(columns, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("n"), rows.alias("m"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, good: Column) -> Column:
        got = _draw(acc["n"], good, acc["m"], unit(F.lit(seed), node, F.size(acc["out"])))
        return bind(got, lambda g: F.struct((acc["n"] - good).alias("n"), (acc["m"] - g).alias("m"), F.array_append(acc["out"], g).alias("out")))

    return F.aggregate(columns, start, step)["out"]


def matrix(counts: DataFrame, depth: int, shards: int, seed: int) -> DataFrame:
    """(block, cells): rows of each of 2^depth blocks that go to each shard, drawn as a uniform shuffle would.

    ``counts`` is (block, n). Row sums are the blocks' counts, column sums the
    shards' sizes. A node of a binary tree over the blocks holds its column sums,
    and splits them between its children; one level is one pass over a small table.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    nodes = counts.sparkSession.range(1).select(F.lit(0).cast("long").alias("node"), F.array(*[F.lit(s).cast("long") for s in sizes]).alias("cells"))
    for level in range(1, depth + 1):
        child = counts.groupBy(F.shiftright("block", depth - level).alias("child")).agg(F.sum("n").alias("rows"))
        left = child.where("child % 2 = 0").select((F.col("child") / 2).cast("long").alias("node"), "rows")
        both = nodes.join(left, "node", "left").select("node", "cells", F.coalesce("rows", F.lit(0).cast("long")).alias("rows"))
        both = both.withColumn("first", _split(F.col("cells"), F.col("rows"), seed + level, F.col("node")))
        second = F.zip_with("cells", "first", lambda a, b: a - b)
        nodes = staged(both.select(F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), F.col("first").alias("cells")), F.struct((2 * F.col("node") + 1).alias("node"), second.alias("cells")))).alias("x")).select("x.*"), "matrix")
    return nodes.select(F.col("node").alias("block"), "cells")


def places(rows: DataFrame, shards: int, seed: int) -> DataFrame:
    """(k1, k2, shard, slot) for rows (k1, k2), which may repeat: a uniform shuffle.

    Rows are dealt to blocks by a hash of their key and number; the matrix says how
    many rows of a block go to each shard; a block's rows, in the order of a second
    hash, are cut accordingly; and each shard orders its rows by a third hash. Both
    permutations sort about LOCAL_ROWS rows at a time, however many there are: a
    shard is ordered in ranges of its hash whose sizes are counted beforehand.
    """
    counted = rows.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    slim = staged(repeated(counted, "n", "copy").select("k1", "k2", "copy"), "shuffle_rows")
    n = slim.count()
    depth = max(0, math.ceil(math.log2(max(1, n / LOCAL_ROWS))))
    digest = lambda k: F.xxhash64(F.lit(seed), F.lit(k), "k1", "k2", "copy")
    first = slim.withColumn("block", F.shiftrightunsigned(digest(1), 64 - depth) if depth else F.lit(0).cast("long"))
    counts = staged(first.groupBy("block").agg(F.count("*").alias("n")), "blocks")
    empty = F.struct(F.lit(0).cast("long").alias("s"), F.array().cast("array<bigint>").alias("a"))
    sums = F.aggregate("cells", empty, lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.array_append(acc["a"], acc["s"] + x).alias("a")))["a"]
    cut = matrix(counts, depth, shards, seed).select("block", sums.alias("cuts"))
    local = Window.partitionBy("block").orderBy(digest(2), "k1", "k2", "copy")
    ranked = first.withColumn("rank", F.row_number().over(local)).join(cut, "block")
    sent = ranked.select("k1", "k2", "copy", F.size(F.filter("cuts", lambda c: c < F.col("rank"))).alias("shard"), F.shiftrightunsigned(digest(3), 11).alias("order"))
    parts = max(1, math.ceil(n / shards / LOCAL_ROWS))
    sent = staged(sent.withColumn("part", F.floor(F.col("order").cast("double") / float(1 << 53) * parts).cast("int")), "exchanged")
    per = sent.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = per.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    again = Window.partitionBy("shard", "part").orderBy("order", "k1", "k2", "copy")
    out = sent.withColumn("rank", F.row_number().over(again)).join(before, ["shard", "part"])
    return out.select("k1", "k2", "shard", (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """``docs`` with shard and slot: a uniform shuffle into shards whose sizes differ by one row at most.

    Slots count from 0 without gaps. Places are drawn for two hashes of a row; the
    rows themselves move once, to meet their places. Equal rows get a place each,
    independently; one of them meets all these places, so many equal rows shuffle as
    one. Nulls hash like any value; an empty table gives no rows. Columns of
    ``docs`` that are named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    k1, k2, rank, p1, p2 = fresh(docs, "sh_key", "sh_other", "sh_rank", "sh_place_key", "sh_place_other")
    keyed = docs.withColumns({k1: row_hash(docs, seed), k2: row_hash(docs, seed + 1)})
    drawn = places(keyed.select(F.col(k1).alias("k1"), F.col(k2).alias("k2")), shards, seed).withColumnsRenamed({"k1": p1, "k2": p2})
    one = keyed.withColumn(rank, F.row_number().over(Window.partitionBy(k1, k2).orderBy(k1))).where(F.col(rank) <= 1)
    return one.join(drawn, (F.col(k1) == F.col(p1)) & (F.col(k2) == F.col(p2))).select(*docs.columns, "shard", "slot")


def op6_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    """Query: shard and slot of every document, under the law of equal row counts."""
    docs = table(spark, sf_dir, "documents")
    slim = staged(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32")), "sizes")
    out = sharded(slim)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
