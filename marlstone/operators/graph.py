"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.sources.files import kept


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that a row of ``links`` names: root is the least node that can be reached.

    In each round a node takes the least root of its neighbours and itself, and then
    the root of that root, so roots travel twice as far each time. Least roots are found
    by partial aggregates; a node with very many links is no task of its own. Only
    whether anything changed reaches the driver. Null ends are no nodes.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = kept(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots = kept(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")))
    while True:
        near = edges.join(roots, F.col("v") == F.col("node")).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        nearer = kept(roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")))
        far = nearer.select(F.col("node").alias("root"), F.col("root").alias("far"))
        jumped = kept(nearer.join(far, "root").select("node", "old", F.least("root", "far").alias("root")))
        roots = jumped.select("node", "root")
        if jumped.where("root <> old").isEmpty():
            return roots
