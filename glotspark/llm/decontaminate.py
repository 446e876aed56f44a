"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters. A
test item gives every run of ``n`` consecutive words as a window; an item of fewer words, but not
none, is one window. Document token windows are hashed in numpy and looked up in the broadcast
set; every hit is verified word by word before it counts. ``scan`` reports the hits of each
document, ``decontaminate`` removes the hit documents or only the hit spans.

The set holds each item's normalised text once, and of a window its hash, its item and its place in
that text, 28 bytes: arrays, built without a step for each window. It is broadcast in parts of at
most ``max_bytes`` of item text, so a part takes about 8 times that. One part is the rule; more text
makes more passes over the documents, with what was found so far kept between them.

Defined results: null or empty texts have no words and no hits; items without words hit nothing;
rows with one item_id are one item; a null item_id is the item ""; a window of several items counts
for each; texts of any length are taken whole; an empty table gives an empty one. ``scan`` keeps columns
of other names and replaces those named like its outputs; ``decontaminate`` keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.llm import bytewords as bw
from glotspark.llm.batches import add_columns, map_arrow
from glotspark.llm.store import Stash

#: Words in a window.
N = 10

#: Bytes of item text whose windows are broadcast at once.
MAX_BYTES = 16 << 20

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
OUTPUTS = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "hit_spans": T.ArrayType(SPAN), "hit_words": T.BinaryType()}


@dataclass
class Windows:
    """The windows of one length, sorted by hash, and a bitmap over the hashes' low bits."""

    length: int
    hashes: np.ndarray
    bitmap: np.ndarray
    item: np.ndarray
    start: np.ndarray
    end: np.ndarray


@dataclass
class TestSet:
    """names: of the items; words: their words, each with a space behind, one text after the other."""

    names: list[str] = field(default_factory=list)
    words: bytes = b""
    windows: list[Windows] = field(default_factory=list)


def _joined(p: bw.Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The piece's words with a space behind each, and where each begins and ends there."""
    size = p.end - p.start
    end = np.cumsum(size + 1) - 1
    inside = np.zeros(len(p.data) + 1, np.int8)
    np.add.at(inside, p.start, 1)
    np.add.at(inside, p.end, -1)
    out = np.full(int(end[-1]) + 1 if len(end) else 0, 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[end] = False
    out[letters] = p.data[np.cumsum(inside[:-1]).astype(bool)]
    return out, end - size, end


def build(item_ids: list, texts: pa.Array, n: int = N) -> TestSet:
    """The windows of some items. Two windows that share a hash are kept apart by their words."""
    found: dict[int, list[tuple[np.ndarray, ...]]] = {}
    said, base = [], 0
    for p in bw.pieces(bw.arrow_texts(texts), bw.ALNUM):
        h, (words, start, end) = p.hashes(), _joined(p)
        count = np.diff(p.word_at)
        for length in sorted({min(n, int(c)) for c in np.unique(count)} - {0}):
            hashes, at = bw.windows(h, p.word_at, length)
            owner = np.searchsorted(p.word_at, at, "right") - 1
            if length < n:
                own = count[owner] == length
                hashes, at, owner = hashes[own], at[own], owner[own]
            found.setdefault(length, []).append((hashes, (owner + p.first).astype(np.int32), base + start[at], base + end[at + length - 1]))
        said.append(words.tobytes())
        base += len(words)
    out = TestSet(["" if x is None else str(x) for x in item_ids], b"".join(said))
    for length, parts in sorted(found.items()):
        hashes, item, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        bits = max(10, int(np.ceil(np.log2(len(hashes) + 1))) + 5)
        bitmap = np.zeros(1 << bits, bool)
        bitmap[(hashes & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
        out.windows.append(Windows(length, hashes, bitmap, item[order], start[order], end[order]))
    return out


def hits(p: bw.Piece, tests: TestSet) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Which words of the piece stand in a verified window, and the items found in each text."""
    h = p.hashes()
    depth = np.zeros(len(h) + 1, np.int32)
    items: dict[int, set[str]] = {}
    raw = None
    for w in tests.windows:
        hashes, at = bw.windows(h, p.word_at, w.length)
        near = np.flatnonzero(w.bitmap[(hashes & np.uint64(len(w.bitmap) - 1)).astype(np.int64)])
        first, last = np.searchsorted(w.hashes, hashes[near]), np.searchsorted(w.hashes, hashes[near], "right")
        same = first < last
        for a, b, at_word in zip(first[same].tolist(), last[same].tolist(), at[near[same]].tolist(), strict=True):
            raw = p.data.tobytes() if raw is None else raw
            words = b" ".join(raw[p.start[j] : p.end[j]] for j in range(at_word, at_word + w.length))
            own = {tests.names[w.item[k]] for k in range(a, b) if tests.words[w.start[k] : w.end[k]] == words}
            if own:
                depth[at_word] += 1
                depth[at_word + w.length] -= 1
                items.setdefault(int(np.searchsorted(p.word_at, at_word, "right")) - 1, set()).update(own)
    return np.cumsum(depth[:-1]) > 0, items


def _scan_part(docs: DataFrame, tests, text: str, first: bool) -> DataFrame:
    def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
        out: dict[str, list] = {name: [] for name in OUTPUTS}
        old = None if first else (part.column("hit_words").to_pylist(), part.column("items").to_pylist())
        for p in bw.pieces(bw.arrow_texts(part.column(text)), bw.ALNUM):
            hit, items = hits(p, tests.value)
            if old:
                for i in range(len(p)):
                    a, b = p.word_at[i], p.word_at[i + 1]
                    hit[a:b] |= np.unpackbits(np.frombuffer(old[0][p.first + i], np.uint8), count=b - a).astype(bool)
                    items.setdefault(i, set()).update(old[1][p.first + i])
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[p.word_at[1:]] - total[p.word_at[:-1]]
            out["n_words"] += np.diff(p.word_at).tolist()
            out["n_hit"] += n_hit.tolist()
            out["items"] += [sorted(items.get(i, ())) for i in range(len(p))]
            for i in range(len(p)):
                a, b, spans = p.word_at[i], p.word_at[i + 1], []
                if n_hit[i]:
                    edge = np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))
                    for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                        spans.append({"start": int(p.start[a + x] - p.at[i]), "end": int(p.end[a + y - 1] - p.at[i])})
                out["hit_spans"].append(spans)
                out["hit_words"].append(np.packbits(hit[a:b]).tobytes())
        return {n: pa.array(v, T_ARROW[n]) for n, v in out.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add_columns(batches, text, make)

    kept = [f for f in docs.schema.fields if f.name not in OUTPUTS]
    return docs.transform(map_arrow, run, T.StructType(kept + [T.StructField(n, t) for n, t in OUTPUTS.items()]))


T_ARROW = {
    "n_words": pa.int64(),
    "n_hit": pa.int64(),
    "items": pa.list_(pa.string()),
    "hit_spans": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    "hit_words": pa.binary(),
}


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items, hit_spans (byte offsets) and hit_words (packed bits)."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col(item).cast("string").alias("item"), F.coalesce(item_text, F.lit("")).alias("text"))
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // max_bytes))
    stash = Stash(spark, "decontaminate")
    for k in range(parts):
        own = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) if parts > 1 else tests
        rows = own.toArrow()
        bound = spark.sparkContext.broadcast(build(rows.column("item").to_pylist(), rows.column("text"), n))
        docs = _scan_part(docs, bound, text, first=k == 0)
        if k < parts - 1:
            docs = stash.keep(docs, f"part{k}")
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "document", text: str = "text", **how) -> DataFrame:
    """docs without the hit documents, or (mode "span") with the hit spans cut out of the texts."""
    own = {c: f"_own_{c}" for c in docs.columns if c in OUTPUTS}
    back = [F.col(own[c]).alias(c) if c in own else F.col(c) for c in docs.columns]
    found = scan(docs.withColumnsRenamed(own), benchmark, text=text, **how)
    if mode == "document":
        return found.where("n_hit = 0").select(back)
    if mode != "span":
        raise ValueError("mode is 'document' or 'span'")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
            out = []
            for t, spans in zip(part.column(text).to_pylist(), part.column("hit_spans").to_pylist(), strict=True):
                if spans:
                    raw, at, left = t.encode(), 0, []
                    for s in spans:
                        left.append(raw[at : s["start"]])
                        at = s["end"]
                    t = b"".join([*left, raw[at:]]).decode()
                out.append(t)
            return {text: pa.array(out, pa.string())}

        yield from add_columns(batches, text, make)

    fields = [f for f in found.schema.fields if f.name != text] + [T.StructField(text, T.StringType())]
    return found.transform(map_arrow, run, T.StructType(fields)).select(back)
