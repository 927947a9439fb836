"""Dates and times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, weekofyear(o_orderdate) AS w, dayofweek(o_orderdate) AS dow FROM orders""")
def date_parts(t: Tables) -> DataFrame:
    """Parts of a date; Sunday is day 0."""
    day = F.col("o_orderdate")
    long = lambda c, name: c.cast("long").alias(name)
    return t.orders.select("o_orderkey", long(F.year(day), "y"), long(F.month(day), "m"), long(F.dayofmonth(day), "d"), long(F.quarter(day), "q"), long(F.weekofyear(day), "w"), long(F.dayofweek(day) - 1, "dow"))


@query("""SELECT o_orderkey, last_day(o_orderdate) AS ends, CAST(date_trunc('month', o_orderdate) AS DATE) AS starts, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS days,
CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS later, strftime(o_orderdate, '%Y/%m/%d') AS written, epoch_us(o_orderdate) AS micros FROM orders""")
def date_arithmetic(t: Tables) -> DataFrame:
    """Month ends, differences, intervals and formats."""
    day = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.last_day(day).alias("ends"), F.date_trunc("month", day).cast("date").alias("starts"), F.datediff(F.lit("2002-01-01").cast("date"), day.cast("date")).cast("long").alias("days"),
                           F.add_months(day.cast("date"), 1).alias("later"), F.date_format(day, "yyyy/MM/dd").alias("written"), F.unix_micros(day.cast("timestamp")).alias("micros"))
