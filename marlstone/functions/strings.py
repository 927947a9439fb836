"""String and hash functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.registry import query
from marlstone.session import Tables


@query("""SELECT c_custkey, length(c_name) AS n, lower(c_name) AS low, upper(c_mktsegment) AS up, substr(c_name, 1, 4) AS head, replace(c_name, '0', '') AS nz, trim('  ' || c_mktsegment || ' ') AS tr,
lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, reverse(c_name) AS back, concat_ws('-', c_name, c_mktsegment) AS both, instr(c_name, '#') AS at FROM customer""")
def string_functions(t: Tables) -> DataFrame:
    """Common string functions."""
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select("c_custkey", F.length(name).cast("long").alias("n"), F.lower(name).alias("low"), F.upper(seg).alias("up"), F.substring(name, 1, 4).alias("head"), F.replace(name, F.lit("0"), F.lit("")).alias("nz"), F.trim(F.concat(F.lit("  "), seg, F.lit(" "))).alias("tr"),
                             F.lpad(F.col("c_nationkey").cast("string"), 4, "0").alias("padded"), F.reverse(name).alias("back"), F.concat_ws("-", name, seg).alias("both"), F.instr(name, "#").cast("long").alias("at"))


@query("""SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '_', 'g') AS blanked, len(string_split(p_type, ' ')) AS words, regexp_matches(p_name, '^[a-m]') AS early FROM part""")
def regex_functions(t: Tables) -> DataFrame:
    """Regular expressions."""
    return t.part.select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.regexp_replace("p_name", "[aeiou]", "_").alias("blanked"), F.size(F.split("p_type", " ")).cast("long").alias("words"), F.col("p_name").rlike("^[a-m]").alias("early"))


@query("""SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""")
def edit_distance(t: Tables) -> DataFrame:
    """Levenshtein distance within regions."""
    a, b = t.nation.alias("a"), t.nation.alias("b")
    j = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return j.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").cast("long").alias("d"))


@query("""SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents""")
def digests(t: Tables) -> DataFrame:
    """Digests of whole texts."""
    return t.documents.select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query()
def engine_hashes(t: Tables) -> DataFrame:
    """crc32, xxhash64 and initcap, which the other engine lacks."""
    return t.customer.select("c_custkey", F.crc32("c_name").alias("crc"), F.xxhash64("c_name").alias("xx"), F.initcap("c_mktsegment").alias("title"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS plain FROM pages""")
def html_text(t: Tables) -> DataFrame:
    """Host and plain text of pages."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    return t.pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " ")).alias("plain"))
