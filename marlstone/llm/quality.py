"""Quality rules: repetition and length, and tokeniser fertility within bands per language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded, fresh, ready, staged, table

SYMBOLS = "#*$%&|<>"
MEASURES = ("chars_per_token", "fallback_share", "entropy")
_FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("fallback_share", pa.float64()), ("entropy", pa.float64()), ("script", pa.string())]
_NOT_COUNTED = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])
#: Unicode ranges by the name of their script; letters elsewhere count as "other".
SCRIPTS = (("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("indic", 0x900, 0xDFF), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))
#: A tokeniser gets pieces of a long text, cut between words, of about so many characters.
PIECE = 1 << 18
#: Bands of a group with too few documents come from so many length classes to either side, then from its language (or script), then its script.
WIDER = (0, 1, 2, 4)
#: Without any bands, the least and most of each measure; in scripts other than Latin all tokens may be single bytes.
FIXED = {"chars_per_token": (0.2, 12.0), "fallback_share": (0.0, 0.5), "entropy": (0.4, 1.0)}


@cache
def _tokeniser(path: str) -> tuple:
    """A sentencepiece model, and which of its ids are single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def repeat_words(words: list[bytes], n: int = 3) -> int:
    """Words within windows of ``n`` words that occur at least twice."""
    if len(words) <= n:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    code, base = at[: len(at) - n + 1], len(ids)
    for k in range(1, n):  # exact: windows are renumbered before numbers could overflow
        code = np.unique(code, return_inverse=True)[1] * base + at[k : len(at) - n + 1 + k]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    starts = np.zeros(len(at) + 1, np.int64)
    hit = np.nonzero(counts[inverse] > 1)[0]
    np.add.at(starts, hit, 1)
    np.add.at(starts, hit + n, -1)
    return int((np.cumsum(starts[:-1]) > 0).sum())


def script_of(text: str) -> str:
    """The script of most letters of a text; "none" without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = points[(points > 0x40) & ~((points > 0x5A) & (points < 0x61)) & ~((points > 0x7A) & (points < 0xC0))]
    if not len(points):
        return "none"
    counts = {name: int(((points >= a) & (points <= b)).sum()) for name, a, b in SCRIPTS}
    counts["other"] = len(points) - sum(counts.values())
    return max(counts, key=counts.get)


def _pieces(text: str) -> list[str]:
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = text.find(" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.append(text[at:end])
        at = end
    return out


def measure(text: str | None, path: str) -> tuple:
    """The base counts and the tokeniser's measures of one text, in the order of _FIELDS."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.encode("utf-8", "surrogatepass").split())
        seen.add(line)
    base = (len(words), len(data.translate(None, _NOT_COUNTED)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words))
    model, is_byte = _tokeniser(path)
    clean = text.encode("utf-8", "replace").decode()
    ids = np.array([i for p in _pieces(clean) for i in model.encode(p, num_threads=1)], dtype=np.int64)
    if not len(ids):
        return (*base, 0, 0.0, 0.0, script_of(text))
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    return (*base, len(ids), float(is_byte[ids].mean()), float(-(p * np.log2(p)).sum()), script_of(text))


def measures(docs: DataFrame, tokeniser: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """``keep`` columns, the base counts, n_tokens, chars_per_token, fallback_share, entropy (bits a token, over the logarithm of the number of tokens) and script, of every whole text."""
    ready(docs.sparkSession)
    slim = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{kinds}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, fallback_share double, entropy double, script string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.as_py(), tokeniser) for t in batch.column(len(keep))]
            cols = list(zip(*rows, strict=True)) or [[] for _ in _FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *[pa.array(c, kind) for c, (_, kind) in zip(cols, _FIELDS, strict=True)]], names=[*keep, *[n for n, _ in _FIELDS]])

    out = slim.mapInArrow(work, schema)
    some = F.greatest("n_tokens", F.lit(2)).cast("double")
    return out.withColumn("chars_per_token", F.col("word_chars") / F.greatest("n_tokens", F.lit(1))).withColumn("entropy", F.col("entropy") / F.log2(some))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def name_of() -> Column:
    """Language of a document, or its script where the language is null."""
    return F.coalesce(F.concat(F.lit("lang:"), F.col("lang")), F.concat(F.lit("script:"), F.col("script")))


def class_of(bins: int = 2) -> Column:
    """Length class of a document: ``bins`` classes for each doubling of its words."""
    return F.floor(bins * F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def bands(measured: DataFrame, fewest: int = 100, least: tuple[float, ...] = (0.003, 0.0015, 0.0015)) -> DataFrame:
    """For each group (name, class, script), of each measure the middle (mid_*) and the usual distance from it (away_*).

    The middle is the median over all documents that pass the base rules, the
    distance the median one from it, but not under ``least``. Short texts vary
    more and entropy falls with length, so bands are those of one language and one
    length class. Where under ``fewest`` such documents are, they come from the
    neighbouring classes (WIDER), else from all of the language, else from all of
    the script; a group whose script has fewer has none. Values are counted in
    steps of 1/1000, so the medians are exact, alike in each run, and found on a
    table that doesn't grow with the corpus.
    """
    values = F.array(*[F.struct(F.lit(m).alias("measure"), F.round(F.col(m) * 1000).cast("long").alias("v")) for m in MEASURES])
    counted = measured.where(~base_failed()).select(name_of().alias("name"), class_of().alias("class"), "script", F.explode(values).alias("x")).select("name", "class", "script", "x.*")
    counted = staged(counted.groupBy("name", "class", "script", "measure", "v").agg(F.count("*").alias("n")), "fertility_counts")
    near = lambda k: F.transform(F.sequence(F.lit(-k), F.lit(k)), lambda d: F.concat_ws("/", F.lit(str(k)), "name", F.col("class") + d))
    wide = [F.concat_ws("/", F.lit("all"), "name"), F.concat_ws("/", F.lit("script"), "script")]
    long = counted.select(F.explode(F.concat(*[near(k) for k in WIDER], F.array(*wide))).alias("grp"), "measure", "v", "n")

    def median(hist: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("grp", "measure")
        upto = hist.select("grp", "measure", "v", F.sum("n").over(w.orderBy("v")).alias("upto"), F.sum("n").over(w).alias("group_n"))
        return upto.where("2 * upto >= group_n").groupBy("grp", "measure").agg(F.min("v").alias(name), F.first("group_n").alias("group_n"))

    hist = staged(long.groupBy("grp", "measure", "v").agg(F.sum("n").alias("n")), "fertility")
    mid = staged(median(hist, "mid").where(F.col("group_n") >= fewest).select("grp", "measure", "mid"), "middles")
    away = median(hist.join(mid, ["grp", "measure"]).groupBy("grp", "measure", F.abs(F.col("v") - F.col("mid")).alias("v")).agg(F.sum("n").alias("n")), "away")
    both = mid.join(away, ["grp", "measure"])
    cols = [F.max(F.when(F.col("measure") == m, F.col(c) / 1000)).alias(f"{c}_{m}") for m in MEASURES for c in ("mid", "away")]
    found = both.groupBy("grp").agg(*cols)
    groups = counted.select("name", "class", "script").distinct()
    tries = F.array(*[F.concat_ws("/", F.lit(str(k)), "name", "class") for k in WIDER], *wide)
    tried = groups.select("name", "class", "script", F.posexplode(tries).alias("level", "grp")).join(found, "grp")
    out = tried.groupBy("name", "class", "script").agg(F.min_by(F.struct(*found.columns[1:]), "level").alias("b")).select("name", "class", "script", "b.*")
    return out.select("name", "class", "script", *[f"mid_{m}" for m in MEASURES], *[F.greatest(f"away_{m}", F.lit(x)).alias(f"away_{m}") for m, x in zip(MEASURES, least, strict=True)])


def judged(measured: DataFrame, width: float = 7.0, joint: float = 9.0) -> DataFrame:
    """``measured`` with base_failed, outside and kept.

    outside names the measures that lie over ``width`` usual distances from their
    middle, and "joint" where the distances of chars_per_token and entropy add up
    to over ``joint``: text of odd spelling loses on both. A document is kept if it
    passes the base rules and outside is empty. Where a group has no bands, outside
    names the measures beyond FIXED.
    """
    limits = bounded(staged(bands(measured), "bands"))
    out = measured.withColumn("base_failed", base_failed()).join(limits.select(F.col("name").alias("_name"), F.col("class").alias("_class"), F.col("script").alias("_script"), *limits.columns[3:]), (name_of() == F.col("_name")) & (class_of() == F.col("_class")) & (F.col("script") == F.col("_script")), "left")
    far = {m: (F.col(m) - F.col(f"mid_{m}")) / F.col(f"away_{m}") for m in MEASURES}
    beyond = {m: ~F.col(m).between(lo, hi) for m, (lo, hi) in FIXED.items()}
    beyond["fallback_share"] &= F.col("script") == "latin"
    odd = [F.when(F.when(F.col("_name").isNull(), beyond[m]).otherwise(F.abs(z) > width), F.lit(m)) for m, z in far.items()]
    odd.append(F.when(F.abs(far["chars_per_token"] + far["entropy"]) > joint, F.lit("joint")))
    out = out.withColumn("outside", F.array_compact(F.array(*odd)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0)).drop("_name", "_class", "_script", *limits.columns[3:])


def quality(docs: DataFrame, tokeniser: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, and lang if there is one): counts, measures and verdict.

    A null or empty text has no words and fails the base rules. A missing or null
    lang is replaced by the text's script. Repeated rows are judged each; an
    empty table gives none.
    """
    if tokeniser is None:
        import public_tokenizers

        tokeniser = public_tokenizers.path("piece_bpe_32k.model")
    slim = docs.select("doc_id", "text", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    return judged(staged(measures(slim, tokeniser), "measures"))


def keep_good(docs: DataFrame, tokeniser: str | None = None) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the same columns.

    Rows are told apart by doc_id and a hash of the text, so equal rows share
    their verdict.
    """
    if tokeniser is None:
        import public_tokenizers

        tokeniser = public_tokenizers.path("piece_bpe_32k.model")
    lang = (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string")
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", lang.alias("lang"))
    measured = staged(measures(slim, tokeniser, keep=("doc_id", "text_hash", "lang")), "measures")
    bad = judged(measured).where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    (mark,) = fresh(docs, "text_hash")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    return marked.join(bad, marked["doc_id"].eqNullSafe(bad["bad_id"]) & (marked[mark] == bad["bad_hash"]), "left_anti").select(*docs.columns)


def op4_tokeniser_fertility(spark, sf_dir: str) -> DataFrame:
    """Query: counts, measures and verdict of every document."""
    out = quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *[F.round(m, 6).alias(m) for m in MEASURES], "outside")
