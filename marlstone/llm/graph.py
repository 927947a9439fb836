"""Connected components of a link table, by rounds of star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import dropped, staged


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
    return tuple(row)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links`` has two columns of one orderable type; each row joins two nodes.

    Returns (node, root): root is the least node of the component. Nodes without
    a link to another node are absent. Large-star and small-star rounds alternate;
    each halves the depth of the trees, so their number grows with the logarithm
    of the longest path. A node's least neighbour is found by a partial aggregate
    and joined back, so a node with many links is split between tasks. Only a
    count and two checksums of the edges reach the driver.
    """
    a, b = links.columns
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    edges = staged(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        new_mark = _mark(new)
        dropped(edges)
        edges, same, mark = new, new_mark == mark, new_mark
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
