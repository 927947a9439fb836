"""Token ids as binary shards, with a minimal perfect hash index for keyed access.

A shard is three files. ``NAME.ids`` holds the ids of its documents one after
another, as little-endian unsigned 16-bit integers (32-bit for vocabularies over
65,536). ``NAME.mph`` holds the index: a header, the levels of a minimal perfect
hash of the document keys, and by hash slot a fingerprint of the key, the first
id and the number of ids. ``NAME.docs`` lists the doc_ids in order, as 64-bit integers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.common import NO_ID, ready, shared_root, staged, table

MAGIC, END = b"MSTOKEN1", 2
#: Bytes of text that a shard holds, about; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 256 << 20
#: Words whose ids a worker remembers; more are encoded anew each time.
MEMORY = 700_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# --- encoding -----------------------------------------------------------------


class Encoder:
    """A byte-level tokeniser of the tokenizers library that remembers the ids of words.

    The vocabulary's own rule never lets a token span a space or line feed that
    follows a character which isn't white space. So a text in which each of these
    stands alone is cut before them, and its ids are those of the pieces in turn;
    any other text is encoded as a whole. Pieces not yet known are encoded in one
    call, from a text of their own: in byte-level vocabularies a piece's first id
    is the only one that begins with the space or line feed.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.memory, self.known = memory, {}
        self.wide = self.model.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.cuts = self._can_cut()

    def _can_cut(self) -> bool:
        """Whether the vocabulary is of the kind that the pieces rely on."""
        a, b = "fa lo\nmi, so'\nla", ["fa", " lo", "\nmi,", " so'", "\nla"]
        ids = self.model.encode(a, add_special_tokens=False).ids
        return ids == [i for x in b for i in self.model.encode(x, add_special_tokens=False).ids]

    def _whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes."""
        split, out = [], []
        for text in texts:
            pieces = text.replace("\n", " \n").split(" ") if self.cuts else None
            split.append(pieces)
        missing = set()
        known = self.known
        for pieces in split:
            if pieces:
                missing.update(p for p in pieces[1:] if p not in known)
        odd = {p for p in missing if not p or p[-1].isspace() or (p[1:2] if p[0] == "\n" else p[0]).isspace() or p == "\n"}
        fresh = [p for p in missing if p not in odd]
        new = dict(zip(fresh, self._learn_pieces(fresh), strict=True)) if fresh else {}
        for text, pieces in zip(texts, split, strict=True):
            if not text:
                out.append(b"")
            elif not pieces or (odd and not odd.isdisjoint(pieces[1:])) or not pieces[0] or pieces[0][-1].isspace():
                out.append(self._whole(text))
            else:
                ids = list(map(known.get, pieces[1:]))
                if None in ids:
                    ids = [new[p] if i is None else i for p, i in zip(pieces[1:], ids, strict=True)]
                out.append(self._whole(pieces[0]) + b"".join(ids))
        return out

    def _learn_pieces(self, pieces: list[str]) -> list[bytes]:
        found = self.model.encode_batch_fast([p if p[0] == "\n" else " " + p for p in pieces], add_special_tokens=False)
        ids = [np.array(e.ids, self.kind).tobytes() for e in found]
        room = self.memory - len(self.known)
        self.known.update(zip(pieces[:room], ids[:room], strict=True))
        return ids


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- minimal perfect hash -----------------------------------------------------


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    h = (keys.astype(np.uint64) + np.uint64(seed)) * GOLDEN
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, in levels of bits.

    At each level the keys left hash into twice as many bits; a bit that one key
    alone hits is set and is that key's. A key's number is the rank of its bit
    over all levels, so n keys get the numbers 0 to n - 1.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(v).astype(np.int64) for v in levels]
        self.ranks, total = [], 0
        for c in counts:
            self.ranks.append(total + np.concatenate(([0], np.cumsum(c)[:-1])))
            total += int(c.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.view(np.uint64), []
        while len(left):
            words = max(1, -(-2 * len(left) // 64))
            at = (_hash(left, len(levels) + 1) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; those of no key of the set get any number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left, k = np.arange(len(keys)), keys.view(np.uint64)
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = (_hash(k[left], level + 1) % np.uint64(len(bits) * 64)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            got = rank[word] + np.bitwise_count(below).astype(np.int64)
            out[left[here]] = got[here]
            left = left[~here]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys.view(np.uint64), 0x5EED) >> np.uint64(32)).astype(np.uint32)


def index_bytes(keys: np.ndarray, starts: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """The index file of a shard."""
    mph = PerfectHash.build(keys)
    slot = mph(keys)
    prints, first, many = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
    prints[slot], first[slot], many[slot] = fingerprint(keys), starts, counts
    head = MAGIC + struct.pack("<QII", len(keys), width, len(mph.levels)) + struct.pack(f"<{len(mph.levels)}Q", *map(len, mph.levels))
    return b"".join([head, *(v.astype("<u8").tobytes() for v in mph.levels), first.tobytes(), many.tobytes(), prints.tobytes()])


class ShardReader:
    """Keyed access to a shard: one hash, one fingerprint, one read."""

    def __init__(self, files: fs.FileSystem, name: str):
        with files.open_input_file(f"{name}.mph") as f:
            data = f.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{name} is no token shard")
        n, self.width, k = struct.unpack_from("<QII", data, 8)
        sizes = struct.unpack_from(f"<{k}Q", data, 24)
        at = 24 + 8 * k
        levels = []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at).astype(np.uint64))
            at += 8 * size
        self.mph = PerfectHash(levels)
        self.first, self.many = np.frombuffer(data, "<u8", n, at), np.frombuffer(data, "<u8", n, at + 8 * n)
        self.prints = np.frombuffer(data, "<u4", n, at + 16 * n)
        self.payload = files.open_input_file(f"{name}.ids")

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where the fingerprint says that a key isn't in the shard."""
        slot = self.mph(keys)
        if not len(self.prints):
            return slot
        return np.where((slot >= 0) & (self.prints[np.maximum(slot, 0)] == fingerprint(keys)), slot, -1)

    def ids(self, slot: int) -> np.ndarray:
        """The ids of the document in a slot."""
        size = int(self.many[slot]) * self.width
        return np.frombuffer(self.payload.read_at(size, int(self.first[slot]) * self.width), f"<u{self.width}")

    def get(self, key: int) -> np.ndarray | None:
        """The ids of a document, or None."""
        slot = int(self.find(np.array([key], np.int64))[0])
        return None if slot < 0 else self.ids(slot)

    def close(self) -> None:
        self.payload.close()


# --- jobs ---------------------------------------------------------------------


def write_shards(docs: DataFrame, folder: str, tokeniser: str, end: int = END) -> DataFrame:
    """Encode ``docs`` (doc_id, text) into shards under ``folder``, in ascending doc_id order.

    Returns the manifest (shard, name, low, high, n_docs, n_ids), one row for each
    shard. Rows are dealt to shards by ranges of doc_id and, within one, of the
    text's hash. Each task writes files under a name of its own and its manifest
    row names them, so a task that is run again or twice leaves no half-read shard.
    ``folder`` is a location that every executor reaches, by any scheme that
    pyarrow knows. Rows with one doc_id are told apart by their number: the key of
    the k-th of them is a hash of doc_id and k (doc_id itself for the first).
    """
    ready(docs.sparkSession)
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("text_hash"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    dealt = ordered.repartitionByRange(n, "doc", "text_hash").sortWithinPartitions("doc", "text_hash")
    out = pa.schema([("name", pa.string()), ("low", pa.int64()), ("low_hash", pa.int64()), ("high", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = encoder(tokeniser)
        files, base = fs.FileSystem.from_uri(folder)
        name, sink = f"{base}/{uuid.uuid4().hex}", None
        docs_, counts, low_hash = [], [], 0
        last = np.array([end], coder.kind).tobytes()
        width = np.dtype(coder.kind).itemsize
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                files.create_dir(base, recursive=True)
                sink = files.open_output_stream(f"{name}.ids")
                low_hash = batch.column(1)[0].as_py()
            texts = [(t or "").encode("utf-8", "replace").decode() for t in batch.column(2).to_pylist()]
            for i in range(0, len(texts), 64):
                for ids in coder.encode(texts[i : i + 64]):
                    sink.write(ids + last)
                    counts.append(len(ids) // width + 1)
            docs_.append(batch.column(0).to_numpy())
        if sink is not None:
            sink.close()
            doc, many = np.concatenate(docs_), np.array(counts, np.int64)
            with files.open_output_stream(f"{name}.mph") as f:
                f.write(index_bytes(keys_of(doc), np.cumsum(many) - many, many, width))
            with files.open_output_stream(f"{name}.docs") as f:
                f.write(doc.astype("<i8").tobytes())
            rows = [[name], [int(doc[0])], [low_hash], [int(doc[-1])], [len(doc)], [int(many.sum())]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, out, strict=True)], schema=out)

    found = staged(dealt.select("doc", "text_hash", "text").mapInArrow(work, "name string, low long, low_hash long, high long, n_docs long, n_ids long"), "manifest")
    order = Window.orderBy("low", "low_hash")
    return found.withColumn("shard", F.row_number().over(order) - 1).withColumn("first_id", F.sum("n_ids").over(order) - F.col("n_ids"))


def keys_of(docs: np.ndarray) -> np.ndarray:
    """A shard's keys from its sorted doc_ids: the id, or for its k-th row after the first a hash of id and k."""
    new = np.concatenate(([True], docs[1:] != docs[:-1]))
    k = np.arange(len(docs)) - np.nonzero(new)[0][np.cumsum(new) - 1]
    return np.where(k == 0, docs.view(np.uint64), _hash(docs.view(np.uint64) ^ _hash(k.astype(np.uint64), 1), 2)).view(np.int64)


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): every document, read back from the shards through their indexes.

    start counts the ids of all documents before. One task reads one shard at a
    time, and one document of it at a time.
    """
    out = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = ShardReader(files, name)
                with files.open_input_file(f"{name}.docs") as f:
                    doc = np.frombuffer(f.read(), "<i8")
                slots = shard.find(keys_of(doc))
                if (slots < 0).any():
                    raise ValueError(f"{name}: the index lacks a document")
                crc = [zlib.crc32(shard.ids(s).astype("<u4").tobytes()) for s in slots.tolist()]
                shard.close()
                cols = (doc, before + shard.first[slots].astype(np.int64), shard.many[slots].astype(np.int64), crc)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=out)

    spread = manifest.select("name", "first_id", "shard")
    spread = spread.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count()), "shard").select("name", "first_id")
    done = spread.mapInArrow(work, "doc long, start long, n_tokens long, ids_crc32 long")
    return done.select(F.nullif(F.col("doc"), F.lit(NO_ID)).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def tokenised(docs: DataFrame, tokeniser: str | None = None, folder: str | None = None, end: int = END) -> DataFrame:
    """Shards of ``docs`` (doc_id, text), written under ``folder`` and read back: see write_shards and read_documents.

    A null or empty text is its end id alone. A null doc_id comes last. Repeated
    rows are each written. An empty table writes no shard and gives no rows. The
    folder is one of its own under spark.checkpoint.dir unless given.
    """
    if tokeniser is None:
        import public_tokenizers

        tokeniser = public_tokenizers.path("byte_bpe_50k.json")
    folder = folder or f"{shared_root(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_documents(write_shards(docs, folder, tokeniser, end), folder)


def op8_perfect_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: place, length and checksum of every document's ids, as read back from the files."""
    return tokenised(table(spark, sf_dir, "documents"))
