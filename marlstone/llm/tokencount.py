"""Token counts of a byte-level vocabulary, by merging ragged arrays of pre-tokens in step.

A text is cut at special strings and then into pre-tokens by the vocabulary's
pattern. Pre-tokens not met before are gathered in batches: their bytes are one
flat array of symbols with offsets. Each round finds the lowest-ranked pair of
every sequence, joins all its places in all sequences at once, and drops the
sequences that hold no pair any more. The symbols left are the tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import ready, table

#: Tokens beyond which a text is over the limit.
LIMIT = 1024
#: Pre-tokens whose counts a worker remembers, and the longest of them in characters; others are merged each time.
MEMORY, SHORT = 500_000, 64
#: Characters of text that are cut, and bytes of pre-tokens that are merged, at a time.
PART, ROOM = 1 << 20, 4 << 20
#: Rank of a pair that doesn't merge.
NONE = np.int32(2**31 - 1)


def alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, others from U+0100 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The merges of a vocabulary as sorted arrays."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]]):
        self.size = np.int64(max(vocabulary.values()) + 1)
        self.byte = np.array([vocabulary[c] for c in alphabet()], np.int64)
        left, right = (np.array([vocabulary[m[i]] for m in merges], np.int64) for i in (0, 1))
        self.joined = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NONE for pairs that don't merge."""
        if not len(self.keys):
            return np.full(len(left), NONE, np.int32)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols left of each piece when no pair merges any more."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out, cuts = np.empty(len(pieces), np.int64), [0]
        total = np.cumsum(sizes)
        while cuts[-1] < len(pieces):
            before = int(total[cuts[-1] - 1]) if cuts[-1] else 0
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(total, before + ROOM, "right"))))
        for a, b in zip(cuts, cuts[1:], strict=False):
            out[a:b] = self._merged(b"".join(pieces[a:b]), sizes[a:b])
        return out

    def _merged(self, data: bytes, sizes: np.ndarray) -> np.ndarray:
        out, who = sizes.copy(), np.flatnonzero(sizes > 1)
        symbols = self.byte[np.frombuffer(data, np.uint8)][np.repeat(sizes > 1, sizes)]
        sizes = sizes[who]
        ranks = self._ranks(symbols, sizes)
        while len(who):
            starts = np.cumsum(sizes) - sizes
            least = np.minimum.reduceat(ranks, starts)
            alive = least != NONE
            if not alive.all():
                out[who[~alive]] = sizes[~alive]
                rows = np.repeat(alive, sizes)
                symbols, ranks, who, sizes, least = symbols[rows], ranks[rows], who[alive], sizes[alive], least[alive]
                if not len(who):
                    break
            at = np.flatnonzero(ranks == np.repeat(least, sizes))
            # of places that overlap, as in "aaa", every second from the left is joined
            fresh = np.diff(at, prepend=-2) != 1
            first = np.flatnonzero(fresh)
            nth = np.arange(len(at)) - np.repeat(first, np.diff(first, append=len(at)))
            at = at[nth % 2 == 0]
            symbols[at] = self.joined[ranks[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(who)), sizes)
            sizes = sizes - np.bincount(owner[at], minlength=len(who))
            # the joined symbol takes the place of two; only its pairs to both sides are new
            ends = np.cumsum(sizes) - 1
            ranks, symbols = ranks[keep], symbols[keep]
            new = at - np.arange(len(at))
            final = np.zeros(len(symbols), bool)
            final[ends] = True
            for place in (new, new[new > 0] - 1):
                place = place[~final[place]]
                ranks[place] = self.rank(symbols[place], symbols[place + 1])
            ranks[ends] = NONE
        return out

    def _ranks(self, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        out = np.full(len(symbols), NONE, np.int32)
        if len(symbols):
            out[:-1] = self.rank(symbols[:-1], symbols[1:])
            out[np.cumsum(sizes) - 1] = NONE
        return out


class Counter:
    """Counts tokens of texts as the tokenizers library gives them for a byte-level vocabulary file."""

    def __init__(self, path: str, memory: int = MEMORY):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        special = spec["added_tokens"] or []
        if model["type"] != "BPE" or not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in special):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.merges = Merges(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self.library = Tokenizer.from_file(path).pre_tokenizer
        # the pattern of byte-level pre-tokenisers, a fixed value
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(special, key=lambda t: -len(t["content"])))) if special else None
        self.safe = regex.compile(r"[!-~][ \n]")
        self.memory, self.known = memory, {}
        self.same, self.other = set(), set()

    def cut(self, text: str) -> Iterator[list[str]]:
        """Lists of the pre-tokens of a text without special strings.

        Characters are tried once each; a text with one that the library's tables
        class in another way is cut by the library. A long text is cut before a
        space or line feed that follows a printable ASCII character, where a
        pre-token always begins.
        """
        for c in (chars := set(text)) - self.same - self.other:
            probe = f"a{c}1{c}!{c} {c}{c} a{c}"
            alike = [span for _, span in self.library.pre_tokenize_str(probe)] == [m.span() for m in self.pattern.finditer(probe)]
            (self.same if alike else self.other).add(c)
        by_library = not chars.isdisjoint(self.other)
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PART and (m := self.safe.search(text, at + PART)):
                end = m.start() + 1
            part = text[at:end]
            yield [part[a:b] for _, (a, b) in self.library.pre_tokenize_str(part)] if by_library else self.pattern.findall(part)
            at = end

    def count(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        out, held, size = [0] * len(texts), [], 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special:
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                for pieces in self.cut(part):
                    held.append((i, pieces))
                    size += len(pieces)
                    if size > PART:
                        self._settle(held, out)
                        held, size = [], 0
        self._settle(held, out)
        return out

    def _settle(self, held: list[tuple[int, list[str]]], out: list[int]) -> None:
        known = self.known
        missing = list({p for _, pieces in held for p in pieces if p not in known})
        new = dict(zip(missing, self.merges.count([p.encode() for p in missing]).tolist(), strict=True))
        short = [p for p in missing if len(p) <= SHORT][: max(0, self.memory - len(known))]
        known.update((p, new[p]) for p in short)
        rest = new if len(short) < len(missing) else None
        for i, pieces in held:
            out[i] += sum(map(known.__getitem__, pieces)) if rest is None else sum(rest[p] if (n := known.get(p)) is None else n for p in pieces)


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokeniser: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs`` (doc_id of any type, text).

    No row moves: each task counts the texts that it reads. A null or empty text
    has no bytes and no tokens; special strings inside a text are one token each,
    as the library has it by default. Rows with equal or null doc_ids are counted
    each for itself; other columns are not read; an empty table gives no rows. A
    text is held whole, its pre-tokens a part at a time.
    """
    if tokeniser is None:
        import public_tokenizers

        tokeniser = public_tokenizers.path("byte_bpe_50k.json")
    ready(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokeniser)
        for batch in batches:
            counts = own.count([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_rank_synchronous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: bytes and tokens of every document."""
    return token_counts(table(spark, sf_dir, "documents"))
