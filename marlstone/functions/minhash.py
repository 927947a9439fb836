"""Near-duplicate texts by min-wise signatures of word shingles.

A text's shingles are hashed once. The top bits of a hash name one of BINS bins; the
least hash of a bin is its sample of the set (one permutation for all bins), so a
signature costs one sort of the hashes and no row moves. Two sets agree in a bin that
either fills with a probability of their Jaccard similarity. Bins in groups of four
are join keys; a pair of similarity 0.8 shares none of the 32 keys once in twenty million.
Candidates are held against each other by b-bit signatures (16 bits of each
least hash); those that may still reach the threshold are compared by their sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import connected
from marlstone.operators.joins import small
from marlstone.plans.registry import query
from marlstone.session import Tables
from marlstone.sources.files import kept

#: Hashes have 60 bits, of which the first 7 name the bin; signatures keep 16.
BITS, BIN, B = 60, 7, 16
#: Kinds of keys: the first bits of a hash that name the group of bins, and the sizes of sets that have them.
KINDS = ((5, 256, 1 << 62), (4, 64, 256), (3, 0, 64))
#: Sets of a key that are all compared with each other; of more, all with one of them, and the others in longer keys.
FEW = 32
#: Further keys that a crowded key is joined with, each in turn, and how many keys the longest is made of.
LONGER, DEPTH = 8, 4


def _hashes(text: bytes | None, words: int, kind: str) -> np.ndarray:
    """The distinct 60-bit hashes of a text's runs of so many words, in order; a shorter text is one run, a text without words has none."""
    split = (text or b"").split()
    if not split:
        return np.zeros(0, np.int64)
    run = (lambda x: hashlib.md5(x, usedforsecurity=False).digest()) if kind == "md5" else (lambda x: xxhash.xxh64_digest(x, 42))
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1)
    starts = np.concatenate(([0], ends[: max(len(split) - words, 0)])).tolist()
    line = b" ".join(split)
    found = b"".join([run(line[i:j])[:8] for i, j in zip(starts, (ends[min(words, len(split)) - 1 :] - 1).tolist(), strict=True)])
    return np.unique((np.frombuffer(found, ">u8") >> np.uint64(64 - BITS)).astype(np.int64))


def _lists(found: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))


def hashed(text: Column, words: int) -> Column:
    """A text's hashes as an array."""
    @F.arrow_udf("array<long>")
    def work(texts: pa.Array) -> pa.Array:
        return _lists([_hashes(x.as_py(), words, "xxh64") for x in texts.cast(pa.binary())])

    return work(text)


def signed(docs: DataFrame, words: int = 5, kind: str = "xxh64") -> DataFrame:
    """(doc_id, text_hash, set, n, mins): each text's set of hashes by a digest of 128 bits, its size, and the least hash of each bin that it fills, in order.

    ``kind`` names the hash, "xxh64" or "md5", which any engine has. Batches travel in Arrow;
    a text's words are joined once, runs are cuts of that, and only the signature goes back.
    """
    @F.arrow_udf("struct<set string, n long, mins array<long>>")
    def work(texts: pa.Array) -> pa.Array:
        sets, sizes, mins = [], [], []
        for x in texts.cast(pa.binary()):
            h = _hashes(x.as_py(), words, kind)
            sets.append(xxhash.xxh3_128_hexdigest(h.tobytes()))
            sizes.append(len(h))
            mins.append(h[np.unique(h >> (BITS - BIN), return_index=True)[1]])
        return pa.StructArray.from_arrays([pa.array(sets, pa.string()), pa.array(sizes, pa.int64()), _lists(mins)], ["set", "n", "mins"])

    # not to be run once more for a filter on what it gives
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), work.asNondeterministic()("text").alias("_s"))
    return rows.select("doc_id", "text_hash", "_s.*")


def b_bit(mins: Column) -> Column:
    """Bin and low bits of each least hash as one number."""
    return F.transform(mins, lambda x: (F.shiftright(x, BITS - BIN) * (1 << B) + x.bitwiseAND((1 << B) - 1)).cast("int"))


def keys(mins: Column, n: Column) -> Column:
    """One hash for each group of bins, of the least hashes there; null where all are empty, and for groups that aren't the set's.

    Groups are of 4 bins, of 8 for sets of under 256 hashes, and of 16 for those of under
    64, so that a key of a small set doesn't hang on one or two hashes that a passage
    shared by many texts has too. A set within a fifth of a limit has both kinds, so two
    alike have one kind in common.
    """
    def of(bits: int, kind: int):
        def key(band: Column) -> Column:
            own = F.filter(mins, lambda x: F.shiftright(x, BITS - bits) == band)
            return F.when(F.size(own) > 0, F.xxhash64(F.lit(kind), band, own))

        return key

    groups = []
    for kind, (bits, least, most) in enumerate(KINDS):
        mine = (n * 1.25 >= least) & (n * 0.8 < most)
        wide = F.sequence(F.lit(0).cast("long"), F.lit((1 << bits) - 1).cast("long"))
        none = F.array_repeat(F.lit(None).cast("long"), 1 << bits)
        groups.append(F.when(mine, F.transform(wide, of(bits, kind))).otherwise(none))
    return F.concat(*groups)


class _Sets:
    """Distinct sets of a table: keys, signatures and, for those asked for, the hashes themselves."""

    def __init__(self, docs: DataFrame, words: int, threshold: float):
        self.docs, self.words, self.threshold = docs.select("doc_id", "text"), words, threshold
        self.members = kept(signed(docs, words))
        one = self.members.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("mins").alias("mins"), F.min("text_hash").alias("text_hash"))
        self.one = kept(one.select("set", "n", "text_hash", b_bit(F.col("mins")).alias("sig"), keys(F.col("mins"), F.col("n")).alias("keys")))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that may reach the threshold.

        The b-bit signatures leave out pairs that lie four standard errors beneath it.
        """
        sig = lambda c: self.one.select(F.col("set").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n").alias(f"n_{c}"))
        both = pairs.join(sig("a"), "a").join(sig("b"), "b")
        bins = lambda c: F.transform(c, lambda x: F.shiftright(x, B))
        agree, filled = F.size(F.array_intersect("sig_a", "sig_b")), F.size(F.array_union(bins("sig_a"), bins("sig_b")))
        error = 4 * F.sqrt(filled * (self.threshold * (1 - self.threshold)))
        sizes = F.least("n_a", "n_b") >= self.threshold * F.greatest("n_a", "n_b")
        return kept(both.where(sizes).where(agree >= filled * self.threshold - error).select("a", "b"))

    def exact(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of those of ``pairs`` whose sets reach the threshold; only their texts are read again."""
        asked = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct().join(self.one.select("set", "text_hash"), "set")
        texts = self.docs.withColumn("text_hash", F.xxhash64("text")).join(small(asked.select("text_hash").distinct()), "text_hash", "left_semi").dropDuplicates(["text_hash", "text"])
        hashes = hashed(F.col("text"), self.words)
        sets = kept(texts.select("text_hash", hashes.alias("hashes")).join(asked, "text_hash").select("set", "hashes"))
        of = lambda c: sets.select(F.col("set").alias(c), F.col("hashes").alias(f"hashes_{c}"))
        both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("shared", F.size(F.array_intersect("hashes_a", "hashes_b")))
        both = both.select("a", "b", (F.col("shared") / (F.size("hashes_a") + F.size("hashes_b") - F.col("shared"))).alias("similarity"))
        return kept(both.where(F.col("similarity") >= self.threshold).distinct())


def near_duplicates(docs: DataFrame, threshold: float = 0.8, words: int = 5) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) that connect like sets of shingles, and members (doc_id, set, group_id).

    ``docs`` has doc_id, of any type with an order, and text. Rows of one set are members
    of it and make no links. group_id is the least doc_id of the sets that links connect. A
    text without words is in no set: its set is null and its group its own doc_id. Sets
    that a key brings together are all compared if they are few; in a crowded key each is
    compared with one, those that it is then connected to are done there, and the others
    meet in longer keys, until keys are small. Sets that links connect already aren't
    compared again, so a large group has links enough to hold it together, not all. Rows with equal or null doc_id are rows each. An
    empty table gives no rows.
    """
    sets = _Sets(docs, words, threshold)
    held = sets.one.select("set", F.posexplode("keys").alias("band", "key")).where("key is not null").select("key", "set", "band", F.lit(1).alias("depth"))
    links, roots = None, sets.one.select("set", F.col("set").alias("root")).limit(0)
    while True:
        rooted = held.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))
        # a key whose sets are all connected has nothing more to say
        counted = rooted.groupBy("key").agg(F.count("*").alias("many"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", "many")
        held = kept(rooted.join(counted, "key"))
        if held.isEmpty():
            break
        few, crowd = held.where(F.col("many") <= FEW), held.where(F.col("many") > FEW)
        side = lambda c: few.select("key", F.col("set").alias(c), F.col("root").alias(f"root_{c}"))
        pairs = side("a").join(side("b"), "key").where("a < b and root_a <> root_b").select("a", "b")
        # one head for a key; where keys are as long as they get, several, so that few rounds are left
        order = Window.partitionBy("key").orderBy(F.xxhash64("set", "key"), "set")
        heads = crowd.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= F.when(F.col("depth") < DEPTH, 1).otherwise(2 * FEW)).select("key", F.col("set").alias("head"), F.col("root").alias("head_root"))
        led = kept(crowd.join(heads, "key").where("root <> head_root"))
        near = sets.likely(pairs.unionByName(led.select(F.least("head", "set").alias("a"), F.greatest("head", "set").alias("b"))).distinct())
        new = sets.exact(near)
        if links is None or not new.isEmpty():
            links = new if links is None else kept(links.unionByName(new))
            roots = connected(links, "a", "b").withColumnRenamed("node", "set")
        # what is like no head of its key goes on
        now = led.join(roots.withColumnRenamed("root", "set_now"), "set", "left").join(roots.select(F.col("set").alias("head"), F.col("root").alias("head_now")), "head", "left")
        same = F.coalesce("set_now", "set") == F.coalesce("head_now", "head")
        state = now.groupBy("key", "set", "band", "depth").agg(F.bool_or(same).alias("done"))
        rest = kept(state.where("not done").join(heads.select("key", F.col("head").alias("set")), ["key", "set"], "left_anti").select("key", "set", "band", "depth"))
        if rest.isEmpty():
            break
        held = rest.where(F.col("depth") >= DEPTH).unionByName(_longer(rest.where(F.col("depth") < DEPTH), sets.one))
    if links is None:
        links = sets.exact(sets.one.select(F.col("set").alias("a"), F.col("set").alias("b")).limit(0))
    links = links.distinct()
    named = sets.members.select("doc_id", F.when(F.col("n") > 0, F.col("set")).alias("set")).join(small(roots), "set", "left").withColumn("root", F.coalesce("root", "set"))
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("group_id"))
    members = named.join(least, "root", "left").select("doc_id", "set", F.coalesce("group_id", "doc_id").alias("group_id"))
    return links, members


def _longer(rest: DataFrame, one: DataFrame) -> DataFrame:
    """Sets under their key joined with each of the next further keys that they have."""
    bands = sum(1 << bits for bits, _, _ in KINDS)
    after = F.transform(F.sequence(F.lit(1), F.lit(bands - 1)), lambda i: F.struct(F.pmod(F.col("band") + i, F.lit(bands)).cast("int").alias("band"), F.get("keys", F.pmod(F.col("band") + i, F.lit(bands)).cast("int")).alias("key")))
    some = F.slice(F.filter(after, lambda x: x["key"].isNotNull()), 1, LONGER)
    both = rest.join(one.select("set", "keys"), "set").select("key", "set", "depth", F.explode(some).alias("next"))
    return both.select(F.xxhash64("key", "next.key").alias("key"), "set", F.col("next.band").alias("band"), (F.col("depth") + 1).alias("depth")).distinct()


_SHINGLES = r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w)"""


@query(_SHINGLES + """,
h AS (SELECT doc_id, CAST('0x' || substr(md5(s), 1, 15) AS BIGINT) AS h FROM s),
m AS (SELECT doc_id, h >> 53 AS bin, min(h) AS h FROM h GROUP BY doc_id, bin)
SELECT doc_id, n, sig FROM (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id) JOIN (SELECT doc_id, list(CAST(bin * 65536 + (h & 65535) AS INTEGER) ORDER BY bin) AS sig FROM m GROUP BY doc_id) USING (doc_id)""")
def minhash_signatures(t: Tables) -> DataFrame:
    """The b-bit signature of every document with words, of hashes that both engines have."""
    return signed(t.documents, kind="md5").where("n > 0").select("doc_id", "n", b_bit(F.col("mins")).alias("sig"))


@query(_SHINGLES.replace("WITH w", "WITH RECURSIVE w") + """,
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE shared / (x.n + y.n - shared) >= 0.8),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT doc_id, min(other) AS group_id FROM r GROUP BY doc_id""")
def minhash_groups(t: Tables) -> DataFrame:
    """The group of near-duplicates of every document; the twin compares all pairs that share a shingle."""
    return near_duplicates(t.documents)[1].select("doc_id", "group_id")
