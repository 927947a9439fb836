"""Mixing sources to target weights: copies by dependent rounding, in a reduction tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bind, bounded, fresh, n_words, numbered, repeated, row_hash, staged, table, unit

WEIGHTS = (5.0, 2.0, 1.0)
#: Rows that one step of the tree folds; each gives one residual to the next level.
FAN_IN = 256


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_rows, target): one row for each source of ``sized`` (source, size).

    Sources by code point, null last, take the weights in turn and share ``share``
    times all sizes. A target stops at ``most`` times its source's size; the excess
    goes to the others by weight, until none is above. Sources are aggregated
    first and numbered by ranges, so there may be as many as web domains; each
    round of resharing sends two sums to the driver.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    ranked = numbered(per, F.col("source").asc_nulls_last(), "rank")
    turn = F.col("rank") % len(weights)
    per = staged(ranked.select("source", "source_size", "n_rows", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")).alias("weight")), "sources")
    total = share * (per.agg(F.sum("source_size")).first()[0] or 0)
    unit_share = None
    while True:
        full = F.lit(False) if unit_share is None else F.col("weight") * unit_share > most * F.col("source_size")
        row = per.agg(F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        new = (total - most * (row["full"] or 0)) / row["open"] if row["open"] else (unit_share or 0.0)
        if new == unit_share:
            break
        unit_share = new
    return per.select("source", "source_size", "n_rows", F.least(F.col("weight") * unit_share, most * F.col("source_size")).alias("target"))


def _fold(rows: Column, seed: int) -> Column:
    """Pivotal rounding of an array of structs (doc_id, size, base, p) in its order.

    Gives a struct (out, left): out holds structs (doc_id, size, copies), left the
    one row that is still open. A step takes the open row and the next, and moves
    size-weighted probability between them, in a random direction and by the most
    that keeps both within 0 and 1. So one of them becomes integral, each keeps
    its expected copies, and the expected sum of sizes never changes.
    """
    one = "struct<doc_id:bigint,size:bigint,base:bigint,p:double>"
    start = F.struct(F.lit(None).cast(one).alias("left"), F.array().cast("array<struct<doc_id:bigint,size:bigint,copies:bigint>>").alias("out"))

    def settle(x: Column, up: Column | bool) -> Column:
        more = F.lit(int(up)) if isinstance(up, bool) else up.cast("int")
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (x["base"] + more).cast("long").alias("copies"))

    def open_(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["base"].alias("base"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["left"]
        ratio = x["size"] / a["size"]
        moves = F.struct(F.least(1 - a["p"], x["p"] * ratio).alias("up"), F.least(a["p"], (1 - x["p"]) * ratio).alias("down"), ratio.alias("ratio"), unit(F.lit(seed), a["doc_id"], a["size"], x["doc_id"], x["size"]).alias("u"))

        def decide(m: Column) -> Column:
            rise = m["u"] * (m["up"] + m["down"]) < m["down"]
            a_done = F.when(rise, 1 - a["p"] <= x["p"] * m["ratio"]).otherwise(a["p"] <= (1 - x["p"]) * m["ratio"])
            x_p = F.when(rise, x["p"] - m["up"] / m["ratio"]).otherwise(x["p"] + m["down"] / m["ratio"])
            a_p = F.when(rise, a["p"] + m["up"]).otherwise(a["p"] - m["down"])
            return F.struct(
                F.when(a_done, open_(x, x_p)).otherwise(open_(a, a_p)).alias("left"),
                F.array_append(acc["out"], F.when(a_done, settle(a, rise)).otherwise(settle(x, ~rise))).alias("out"),
            )

        return F.when(a.isNull(), F.struct(x.alias("left"), acc["out"].alias("out"))).otherwise(bind(moves, decide))

    return F.aggregate(rows, start, step)


def copies(sized: DataFrame, goals: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, copies): one row for each row of ``sized`` (doc_id, source, size).

    A row's expected copies are its source's target over its source's size; the
    whole part is certain, the rest is rounded by ``_fold`` over blocks of about
    FAN_IN rows of one source, larger sizes first. Each block leaves one open row,
    and blocks of these are folded in turn until a source has one, which is drawn.
    So a source's taken size misses its target by less than one document. A hot
    source only has more blocks. Equal rows are counted, numbered and spread over
    blocks by their number. Rows of size 0 take no part in the rounding.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    same = sized.groupBy(F.col("source").alias("_s"), "doc_id", "size").agg(F.count("*").alias("same"))
    rows = repeated(same, "same", "copy").join(bounded(goals), F.col("_s").eqNullSafe(F.col("source"))).select(
        "doc_id", "source", "size", "copy", "source_size", "target", "n_rows", F.floor(rate).alias("base"), (rate - F.floor(rate)).alias("p")
    )
    fixed = (F.col("size") == 0) | (F.col("p") == 0)
    done = [rows.where(fixed).select("doc_id", "size", "source_size", "target", F.col("base").alias("copies"))]
    blocks = F.ceil(F.col("n_rows") / FAN_IN)
    level = rows.where(~fixed).select(
        "source", "source_size", "target", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "copy"), blocks).alias("block"), F.struct("doc_id", "size", "base", "p").alias("row")
    )
    most, depth = (goals.agg(F.max("n_rows")).first()[0] or 0), 0
    n_blocks = -(-most // FAN_IN)
    while True:
        ordered = F.array_sort(F.collect_list(F.struct((-F.col("row.size")).alias("o"), F.col("row.doc_id").alias("i"), F.col("row.p").alias("q"), F.col("row"))))
        folded = level.groupBy("source", "block").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.transform(ordered, lambda x: x["row"]).alias("rows"))
        folded = staged(folded.select("source", "block", "source_size", "target", _fold(F.col("rows"), seed + depth).alias("f")), "mixed")
        done.append(folded.select("source_size", "target", F.explode("f.out").alias("d")).select("d.doc_id", "d.size", "source_size", "target", "d.copies"))
        if n_blocks <= 1:
            break
        n_blocks, depth = -(-n_blocks // FAN_IN), depth + 1
        level = folded.where("f.left is not null").select("source", "source_size", "target", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("f.left").alias("row"))
    last = folded.where("f.left is not null").select("source_size", "target", F.col("f.left").alias("x"))
    drawn = (unit(F.lit(seed - 1), F.col("x.doc_id"), F.col("x.size")) < F.col("x.p")).cast("int")
    done.append(last.select("x.doc_id", "x.size", "source_size", "target", (F.col("x.base") + drawn).cast("long").alias("copies")))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7, identity: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for every row of ``docs`` (doc_id, text, source).

    The size of a text is its number of words; a null or empty text has size 0
    and gets no fractional copy. A null source is a source. Repeated rows are
    rounded each. Without a source column all rows are of the null source. An
    empty table gives no rows. The random draws depend on ``seed`` and the rows
    alone, so reruns agree. ``identity`` gives another number than doc_id by which
    rows are told apart, and takes its name.
    """
    source = (F.col("source") if "source" in docs.columns else F.lit(None)).cast("string")
    sized = staged(docs.select((F.col("doc_id") if identity is None else identity).cast("long").alias("doc_id"), source.alias("source"), n_words(F.col("text")).alias("size")), "sized")
    return copies(sized, targets(sized, weights, share, most), seed)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the same columns.

    Rows are told apart by a hash of all their columns. Equal rows can take each
    other's places, so one of them comes back as often as the mix takes all.
    """
    size, key, other, rank, copies_, taken_key, taken_size = fresh(docs, "mix_size", "mix_key", "mix_other", "mix_rank", "mix_copies", "taken_key", "taken_size")
    taken = mix(docs, identity=row_hash(docs, 1), **options).groupBy(F.col("doc_id").alias(taken_key), F.col("size").alias(taken_size)).agg(F.sum("copies").alias(copies_))
    rows = docs.withColumns({size: n_words(F.col("text")), key: row_hash(docs, 1), other: row_hash(docs, 2)})
    one = rows.withColumn(rank, F.row_number().over(Window.partitionBy(key, other).orderBy(size))).where(F.col(rank) <= 1).drop(rank)
    both = one.join(taken.where(F.col(copies_) > 0), (F.col(key) == F.col(taken_key)) & (F.col(size) == F.col(taken_size)))
    return repeated(both, copies_, rank).select(*docs.columns)


def op2_pivotal_mix(spark, sf_dir: str) -> DataFrame:
    """Query: what the mix takes of every document."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies")
