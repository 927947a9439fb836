"""JSON held in strings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract(props, '$.k') AS BIGINT) AS number, CAST(json_extract(props, '$.none') AS BIGINT) AS none FROM events""")
def json_paths(t: Tables) -> DataFrame:
    """Paths and a typed parse."""
    parsed = F.from_json("props", "k bigint, none bigint")
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"), parsed["k"].alias("number"), parsed["none"].alias("none"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def variant_paths(t: Tables) -> DataFrame:
    """The same through a VARIANT."""
    return t.events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))
