"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context."""

from __future__ import annotations

import base64
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import ready, table

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates: runs of these characters with a letter and a digit in them, what follows a colon or an equals sign, and quoted text without spaces.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
VALUE = re.compile(r"""[:=][\x20\t]*["'`]?([^\s"'`<>]{6,})""")
QUOTES = ('"', "'", "`")
QUOTED = re.compile(r"""["'`]([^\s"'`<>]{6,})["'`]""")
_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
#: Characters of context on each side, and of a candidate; longer candidates are read in windows of so many characters, STEP apart, and the greatest score counts.
BEFORE, INSIDE, AFTER = 20, 44, 12
STEP = 11
#: Windows that the network takes at once.
TOGETHER = 512
LENGTH = BEFORE + INSIDE + AFTER
VOCABULARY, OTHER = 97, 96


# --- patterns -----------------------------------------------------------------


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, kinds by number."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(_HEX):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _mixed(x: str) -> bool:
    return any(c.isdigit() for c in x) and any(c.isalpha() for c in x)


def _outside(start: int, end: int, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a candidate that no pattern's span covers."""
    for a, _, b in base:
        if start < b and a < end:
            if start < a:
                yield start, a
            start = b
    if start < end:
        yield start, end


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of every candidate of a text that the patterns' spans don't cover.

    Runs are cut where spans of the patterns lie; values and quoted text are read
    whole, as a pattern may have found their beginning only.
    """
    found = set()
    for m in RUN.finditer(text):
        found.update((s, e) for s, e in _outside(*m.span(), base) if e - s >= 16 and _mixed(text[s:e]))
    for shape in (VALUE, QUOTED):
        for m in shape.finditer(text):
            s, e = m.span(1)
            if text[e : e + 1] not in QUOTES:  # a sentence may end here
                e = s + len(m[1].rstrip(".,;:!?)]}"))
            if e - s >= 6 and next(_outside(s, e, base), None):
                found.add((s, e))
    return sorted(found)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate itself, or windows that cover all of it."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [*((s, s + INSIDE) for s in range(start, end - INSIDE, STEP)), (end - INSIDE, end)]


def encoded(text: str, start: int, end: int) -> tuple[bytes, bytes]:
    """A window in its context as character numbers, and which of them are the window's."""
    before, inside, after = text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]
    line = before.rjust(BEFORE, "\0") + inside.ljust(INSIDE, "\0") + after.ljust(AFTER, "\0")
    codes = bytes(0 if c == "\0" else ord(c) - 31 if 32 <= ord(c) < 127 else OTHER for c in line)
    mask = bytes(BEFORE) + b"\1" * len(inside) + bytes(LENGTH - BEFORE - len(inside))
    return codes, mask


# --- labelled findings --------------------------------------------------------

_WORDS = "build user cache index release order batch session server client image module report record image queue filter worker schema layout render config version access update branch stage".split()
_NAMES = ("key", "auth", "bearer", "Authorization: Bearer", "credential", "private_key", "client_id", "access", "pwd", "pass", "signature", "x-auth", "login", "db_pass")
_PLAIN = ("file", "path", "id", "build", "image", "sha256sum", "commit", "version", "ref", "trace", "see", "from", "page", "name", "title", "note", "type", "mode", "class", "author", "license")
_DULL = "required enabled optional string default disabled public private readonly unknown missing keyboard".split()


def labelled(contexts: list[str], n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """``n`` findings (text, start, end) in pieces of ``contexts``, half of them secrets, and their labels."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    rand = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(len(alphabet), size=int(k)))
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"

    def secret() -> str:
        k = int(rng.integers(9))
        if k == 0:
            return rand(hexa, pick([32, 40, 48, 64]))
        if k == 1:
            return pick(["ghp_", "glpat-", "sk-", "pk_live_", "xoxb-", "npm_", "hf_"]) + rand(alnum, rng.integers(20, 41))
        if k == 2:
            return rand(alnum + "+/", 40)
        if k == 3:
            return "AKIA" + rand(string.ascii_uppercase + string.digits, 16)
        if k == 4:
            return "eyJ" + base64.urlsafe_b64encode(rng.bytes(int(rng.integers(18, 60)))).decode().rstrip("=")
        if k == 5:
            return rand(alnum + "_-", rng.integers(18, 33))
        if k == 6:
            return base64.b64encode(rng.bytes(int(rng.integers(15, 33)))).decode()
        return ""

    def password() -> str:
        """Words, digits and signs as people choose them."""
        x = "".join(pick([w, w.capitalize(), w.replace("e", "3").replace("o", "0")]) for w in (pick(_WORDS) for _ in range(int(rng.integers(1, 5)))))
        return x + pick(["", rand(string.digits, rng.integers(1, 5)), pick("!@#$%&*") + rand(string.digits, rng.integers(1, 4))])

    def harmless() -> str:
        k = int(rng.integers(14))
        words = lambda a, b, sep: sep.join(pick(_WORDS) for _ in range(int(rng.integers(a, b))))
        number = lambda a, b: rand(string.digits, rng.integers(a, b))
        if k == 0:
            return "-".join(rand(hexa, m) for m in (8, 4, 4, 4, 12))
        if k == 1:
            return "/".join([words(1, 2, ""), words(1, 3, "_") + number(1, 4), words(1, 3, "-")]) + "/lib64"
        if k == 2:
            return words(2, 4, "_") + "_" + number(1, 6)
        if k == 3:
            return f"20{number(2, 3)}-{number(2, 3)}-{number(2, 3)}T{number(2, 3)}_{number(2, 3)}_{number(2, 3)}Z"
        if k == 4:
            return words(2, 4, "") + number(1, 5)
        if k == 5:
            return words(2, 4, "-") + "-v" + number(1, 2) + "-" + number(1, 3)
        if k == 6:
            return pick(["A1", "x9", "0a", "1-", "=2"]) * int(rng.integers(9, 20)) + pick(_WORDS)
        if k == 8:
            return pick([words(1, 2, ""), words(2, 4, "."), words(2, 3, "-"), words(1, 2, "").capitalize(), words(1, 3, "/"), prose()])
        if k == 11:
            return prose().strip(".,").capitalize() + pick(["", "", number(1, 3)])
        if k == 12:
            return pick([number(1, 3) + ":" + number(2, 3) + ":" + number(2, 3), number(1, 4) + "." + number(2, 7), "#" + rand(hexa, pick([6, 8])), number(2, 4) + "," + number(3, 4) + "." + number(2, 3), number(3, 5) + "-" + number(3, 5) + "-" + number(3, 5), number(1, 3) + "%," + number(1, 4) + "px"])
        if k == 9:
            return pick(["https://", "http://", "//", "s3://"]) + words(2, 4, ".") + "/" + "/".join(words(1, 3, "-") for _ in range(int(rng.integers(1, 5)))) + pick(["", "?id=" + number(2, 6), ".html"])
        if k == 10:
            return path(int(rng.integers(4, 16)))
        return pick(_WORDS).upper() + "-" + number(4, 8) + "-" + pick(_WORDS).upper() + "-" + number(2, 5)

    def path(parts: int) -> str:
        piece = lambda: "_".join(pick(_WORDS) for _ in range(int(rng.integers(1, 3)))) + pick(["", "", rand(string.digits, rng.integers(1, 4))])
        return "/" + "/".join(piece() for _ in range(parts))

    def prose() -> str:
        return pick(pick(contexts).split() or _WORDS) if contexts else pick(_WORDS)

    rows, labels = [], np.zeros(n, np.float32)
    while len(rows) < n:
        good = bool(rng.integers(2))
        inner = secret() if good else harmless()
        chosen = good and not inner  # what people choose is a secret by its name only
        value = inner = inner or password()
        run = not chosen and bool(RUN.fullmatch(value)) and _mixed(value)
        if good and run and not rng.integers(5):
            value = path(int(rng.integers(1, 8))) + "/" + value + path(int(rng.integers(1, 8)))
        style = int(rng.integers(4)) if run else 2 if good else 2 + 2 * int(rng.integers(2))
        name = pick(_NAMES) if good else pick([pick(_PLAIN), prose()])
        if not good and style == 2 and not rng.integers(8):
            name, value = pick(_NAMES), pick(_DULL)
        if len(value) < 6 or (style < 2 or style == 3) and not _mixed(value):
            continue
        around = pick(contexts) if contexts else " ".join(pick(_WORDS) for _ in range(20))
        at = int(rng.integers(len(around) + 1))
        quote = pick(["", '"', "'"])
        lead = (" ", " ", f" {name}{pick([' = ', ': ', '=', ':'])}{quote}", f" {pick(_PLAIN)} ", f" {quote or chr(34)}")[style]
        text = around[:at] + lead + value + (quote or pick([" ", "\n", ". ", '" ', ", "])) + " " + around[at:]
        start = at + len(lead)
        spots = windows(start, start + len(value))
        if good and len(value) > INSIDE:  # a window that holds enough of the secret to tell
            begin = start + value.index(inner)
            spots = [(s, e) for s, e in spots if min(e, begin + len(inner)) - max(s, begin) >= min(len(inner), 28)]
        labels[len(rows)] = good
        rows.append((text, *pick(spots)))
    return rows, labels


# --- network ------------------------------------------------------------------


@dataclass
class Network:
    """Embedding, one convolution of width 5, maxima over all and means over the candidate, one hidden layer; Platt scale and threshold."""

    weights: dict[str, np.ndarray]
    scale: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def forward(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        w = self.weights
        x = np.concatenate([w["embed"][codes], mask[:, :, None]], axis=2)
        n, length, depth = x.shape
        cols = np.lib.stride_tricks.sliding_window_view(x, 5, axis=1).transpose(0, 1, 3, 2).reshape(n, length - 4, 5 * depth)
        pre = cols @ w["conv"] + w["conv_b"]
        act = np.maximum(pre, 0)
        top = act.argmax(1)
        inner = mask[:, 2:-2, None] / np.maximum(mask[:, 2:-2].sum(1), 1)[:, None, None]
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], (act * inner).sum(1)], axis=1)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_b"], 0)
        return (hidden @ w["out"] + w["out_b"])[:, 0], (codes, cols, pre, top, inner, pooled, hidden)

    def gradients(self, kept: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        w, (codes, cols, pre, top, inner, pooled, hidden) = self.weights, kept
        g = {"out": hidden.T @ d[:, None], "out_b": d.sum(keepdims=True)}
        dh = (d[:, None] @ w["out"].T) * (hidden > 0)
        g["dense"], g["dense_b"] = pooled.T @ dh, dh.sum(0)
        dp = dh @ w["dense"].T
        k = pre.shape[2]
        da = dp[:, None, k:] * inner
        np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :k], 1)
        da = da * (pre > 0)
        n, length, _ = da.shape
        g["conv"], g["conv_b"] = cols.reshape(n * length, -1).T @ da.reshape(n * length, -1), da.sum((0, 1))
        dc = (da @ w["conv"].T).reshape(n, length, 5, -1)[..., :-1]
        g["embed"] = np.zeros_like(w["embed"])
        for j in range(5):
            np.add.at(g["embed"], codes[:, j : j + length], dc[:, :, j])
        return g

    def probability(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = [self.forward(codes[i : i + 512], mask[i : i + 512])[0] for i in range(0, len(codes), 512)]
        return 1 / (1 + np.exp(-(self.scale * np.concatenate(out) + self.shift))) if out else np.zeros(0)


def arrays(rows: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    pairs = [encoded(*r) for r in rows]
    shape = (len(rows), LENGTH)
    return np.frombuffer(b"".join(p[0] for p in pairs), np.uint8).reshape(shape).astype(np.int64), np.frombuffer(b"".join(p[1] for p in pairs), np.uint8).reshape(shape).astype(np.float32)


def train(rows: list[tuple[str, int, int]], labels: np.ndarray, recall: float = 0.97, epochs: int = 12, seed: int = 5) -> Network:
    """A network fitted to seven tenths of the findings; scale and threshold are fitted to parts of their own.

    The scores of one held-out part are turned into probabilities by Platt's
    logistic fit. The threshold is the largest that still finds ``recall`` of the
    secrets of the other.
    """
    rng = np.random.default_rng(seed)
    codes, mask = arrays(rows)
    order = rng.permutation(len(rows))
    held, last, fit = np.split(order, [len(rows) * 3 // 20, len(rows) * 3 // 10])
    init = lambda *shape: (rng.standard_normal(shape) * np.sqrt(2 / shape[0])).astype(np.float32)
    net = Network({"embed": (rng.standard_normal((VOCABULARY, 10)) * 0.5).astype(np.float32), "conv": init(55, 24), "conv_b": np.zeros(24, np.float32), "dense": init(48, 16), "dense_b": np.zeros(16, np.float32), "out": init(16, 1), "out_b": np.zeros(1, np.float32)})
    m = {k: np.zeros_like(v) for k, v in net.weights.items()}
    v = {k: np.zeros_like(x) for k, x in net.weights.items()}
    t = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            z, kept = net.forward(codes[batch], mask[batch])
            t += 1
            for k, g in net.gradients(kept, ((1 / (1 + np.exp(-z)) - labels[batch]) / len(batch)).astype(np.float32)).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.weights[k] = (net.weights[k] - 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    z = net.forward(codes[held], mask[held])[0].astype(np.float64)
    a, b, y = 1.0, 0.0, labels[held]
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * z + b)))
        a, b = a - 0.05 * float(((p - y) * z).mean() + 1e-3 * a), b - 0.05 * float((p - y).mean())
    net.scale, net.shift = a, b
    good = np.sort(net.probability(codes[last], mask[last])[labels[last] > 0])
    net.threshold = float(good[int((1 - recall) * len(good))]) if len(good) else 0.5
    return net


def fitted(docs: DataFrame, findings: int = 6000, contexts: int = 200, seed: int = 5) -> Network:
    """A network trained on ``findings`` labelled findings, set in pieces of at most ``contexts`` documents.

    The pieces, 400 characters each from anywhere in a text, are those of least
    hash, so the sample is the same in each run and bounded whatever the corpus.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text"), F.lit(1))).cast("int")
    slim = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("h"), F.substring(F.col("text"), at, F.lit(400)).alias("piece"))
    share = min(1.0, 4 * contexts / max(1, docs.count()))  # so that tasks send the driver few more than it keeps
    few = slim.where(F.shiftrightunsigned("h", 11) < int(share * (1 << 53)))
    pieces = [r["piece"] for r in few.orderBy("h", "piece").limit(contexts).collect()]
    return train(*labelled([p for p in pieces if p], findings, seed), seed=seed)


# --- jobs ---------------------------------------------------------------------


def scan(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """(doc_id, spans): one row for each row of ``docs`` (doc_id, text).

    spans are structs (kind, start, end, score) in code points, end exclusive, by
    start and then kind. The patterns' spans are always there. The network reads every
    candidate (runs, values, quoted text) whole, in windows of ``INSIDE`` characters;
    those whose greatest score reaches its threshold are joined where they overlap,
    and their parts outside the patterns' spans are added (kind cnn). Long runs of
    base64, such as images in text, look like keys to it.
    A null or empty text has none; repeated rows come back each; an empty table
    gives no rows.
    """
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(network or fitted(docs))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            bases, best, asked, whose = [], {}, [], []

            def judged() -> None:
                for c, p in zip(whose, net.probability(*arrays(asked)).tolist(), strict=True):
                    best[c] = max(p, best.get(c, 0.0))
                asked.clear(), whose.clear()

            for i, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                bases.append(base_spans(text))
                for c in candidates(text, bases[i]):
                    for s, e in windows(*c):
                        at = min(s, BEFORE)
                        asked.append((text[s - at : e + AFTER], at, at + e - s))
                        whose.append((i, *c))
                        if len(asked) >= TOGETHER:
                            judged()
            if asked:
                judged()
            added = [[] for _ in bases]
            for (i, s, e), p in sorted(best.items()):
                if p >= net.threshold:
                    last = added[i][-1] if added[i] else None
                    if last and s < last[1]:
                        last[1:] = [max(e, last[1]), max(p, last[2])]
                    else:
                        added[i].append([s, e, p])
            found = [[(s, k, e, 1.0) for s, k, e in base] + [(x, 3, y, round(p, 4)) for s, e, p in more for x, y in _outside(s, e, base)] for base, more in zip(bases, added, strict=True)]
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(f)] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    slim = docs.select("doc_id", "text")
    of = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(work, f"doc_id {of}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def op7_character_network(spark, sf_dir: str) -> DataFrame:
    """Query: secrets of every document."""
    found = scan(table(spark, sf_dir, "documents"))
    line = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"] != "cnn")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("cnn"))
