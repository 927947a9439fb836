"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm.common import staged, table
from marlstone.llm.decontam import drop_contaminated
from marlstone.llm.mixing import mixed
from marlstone.llm.quality import keep_good
from marlstone.llm.sharding import sharded
from marlstone.llm.simhash import one_of_each

#: No stage but the last is expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's fertility bands.

    Null and empty texts have no words, so they go; repeated rows are judged alike; a null
    language is replaced by the text's script. An empty table gives no rows, and
    columns of any name stay as they are.
    """
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by five-word shingles of a similarity of 0.8 or more: that of least doc_id.

    Texts without words are one group. Rows without a doc_id come last in a group; of
    rows that tie in doc_id the least text hash stays, of equal rows one. An empty
    table gives no rows, and columns of any name stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none, and items without words match nothing; repeated rows
    are judged alike. An empty table on either side is no error.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source; texts without words have size 0 and no share. Equal
    rows take each other's places. An empty table gives no rows.
    """
    return mixed(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard and slot; columns of these names are replaced.

    Nulls hash like any value, equal rows get a place each, an empty table gives no rows.
    """
    return sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
