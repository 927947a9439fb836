"""Arrays and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables


@query("""SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: length(w) > 8)) AS long_words, list_max(list_transform(string_split(text, ' '), lambda w: length(w))) AS longest FROM documents""")
def higher_order(t: Tables) -> DataFrame:
    """filter, transform and array_max."""
    words = F.split("text", " ")
    return t.documents.select("doc_id", F.size(F.filter(words, lambda w: F.length(w) > 8)).cast("long").alias("long_words"), F.array_max(F.transform(words, lambda w: F.length(w))).cast("long").alias("longest"))


@query("""SELECT vec_id, i - 1 AS at, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) r(i)""")
def exploded(t: Tables) -> DataFrame:
    """posexplode of whole arrays."""
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("at", "x")).select("vec_id", F.col("at").cast("long").alias("at"), F.col("x").cast("double").alias("x"))


@query("""SELECT n_nationkey, CAST(n_regionkey AS INTEGER) AS via_map FROM nation""")
def maps(t: Tables) -> DataFrame:
    """A map built from entries and read by key."""
    return t.nation.select("n_nationkey", F.map_from_entries(F.array(F.struct("n_name", "n_regionkey")))[F.col("n_name")].alias("via_map"))


@query("""SELECT vec_id, CAST(embedding[65] AS DOUBLE) AS past, CAST(embedding[1] AS DOUBLE) AS first_one, CAST(embedding[64] AS DOUBLE) AS last_one FROM embeddings""")
def array_access(t: Tables) -> DataFrame:
    """get and try_element_at give null out of range, where ``[]`` and element_at raise; get counts from 0, element_at from 1 or from the end."""
    e = F.col("embedding")
    past = F.coalesce(F.get(e, F.lit(64)), F.try_element_at(e, F.lit(65)))
    return t.embeddings.select("vec_id", past.cast("double").alias("past"), e[0].cast("double").alias("first_one"), F.element_at(e, -1).cast("double").alias("last_one"))
