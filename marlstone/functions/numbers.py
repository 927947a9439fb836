"""Numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables


@query("""SELECT c_custkey, round(c_acctbal, 1) AS r, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, round(sqrt(abs(c_acctbal)), 6) AS root, round(ln(abs(c_acctbal) + 1), 6) AS log,
round(power(c_nationkey, 2), 2) AS square, abs(c_acctbal) AS size, CAST(sign(c_acctbal) AS DOUBLE) AS s FROM customer""")
def math_functions(t: Tables) -> DataFrame:
    """Rounding, roots, logarithms and signs."""
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.round(x, 1).alias("r"), F.floor(x).alias("f"), F.ceil(x).alias("c"), F.round(F.sqrt(F.abs(x)), 6).alias("root"), F.round(F.log(F.abs(x) + 1), 6).alias("log"), F.round(F.pow("c_nationkey", F.lit(2)), 2).alias("square"), F.abs(x).alias("size"), F.signum(x).alias("s"))


@query("""SELECT CAST(floor(c_acctbal / 1000) AS BIGINT) AS band, count(*) AS n FROM customer GROUP BY 1""")
def histogram(t: Tables) -> DataFrame:
    """Rows in bands of equal width."""
    return t.customer.groupBy(F.floor(F.col("c_acctbal") / 1000).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CAST(trunc(c_acctbal) AS INTEGER) AS whole, CAST(round_even(c_acctbal, 0) AS DOUBLE) AS even FROM customer""")
def casts_to_whole(t: Tables) -> DataFrame:
    """A cast of a double to an integer cuts the fraction off; bround rounds halves to even."""
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", x.cast("int").alias("whole"), F.bround(x, 0).cast("double").alias("even"))
