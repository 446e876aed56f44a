"""Jaccard self-join of texts on word n-grams, with rare-first prefix filtering.

Texts whose shingle sets are equal form a class and take part once. Rare first means first of all
that a shingle which no other class has can have no part in a link: every shingle is counted over
all classes (packed fingerprints, dealt out in buckets), and only classes of which enough shingles
stand elsewhere too go on. Their shingles are ordered by how many of them hold each, ties by hash;
those counts are of a table of counters, and sharing a counter only makes the order less sharp, any
fixed order finds every pair. Each class sends its prefix - at least one of its first
n - ceil(t n) + 1 shingles is shared by any partner - to the tasks that own those shingles:

* up to ``few`` classes that share one are paired there, subject to the length filter and the
  positional filter; the suffix filter then compares how the two sets spread over 64 classes of
  hashes, and what is left is verified once per pair on the whole sets;
* more classes than that are not paired: they are linked to one of them. Of the connected groups that
  this gives, the larger ones are compared with one of their classes first; what that has not connected
  is compared block by block, each pair in one block pair only, again behind length and suffix
  filters. A block pair sends out a spanning forest of its links. Shingles that very many texts hold
  connect their classes without being brought together at all.

Either way a class pair that reaches the threshold is linked or already connected, so components
are exact; no group of copies is ever expanded into all pairs between tasks.

Defined results: a text with fewer words than ``words`` has its whole word sequence as the one
shingle; without words, empty or null it has none and links with nothing; each repeated row is a
text of its own; a null doc_id stays null and, where no equal text has one, links with nothing; texts
of any length are taken whole; a pair exactly at the threshold is linked; an empty table gives an empty
one; columns named like inner ones do not matter, as only id and text are read. Sets are compared by 64-bit hashes of their shingles, and classes by 128-bit hashes of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.llm import bytewords as bw
from glotspark.llm.batches import Runs, map_arrow
from glotspark.llm.components import components
from glotspark.llm.neardup import forest
from glotspark.llm.store import Stash

#: Words in a shingle.
WORDS = 5

#: Similarity, in hundredths, from which two texts are linked.
PERCENT = 80

#: Counters for the order of shingles: as many as there are shingles to order, within these bounds (4 and 64 MB).
CELLS, MAX_CELLS = 1 << 20, 1 << 24

#: Shingles that a task of the first step sends on at once, and that a bucket has about.
SHEET, BUCKET = 1 << 19, 1 << 21

#: Buckets into which a sheet is cut at once; more than that are dealt out in two steps.
FANOUT = 1 << 10

#: Classes that are paired under one shingle; more are compared block by block.
FEW = 24

#: Classes in a block.
BLOCK = 256

#: A shingle whose counter is beyond this, and beyond four times the mean, is not brought together.
HOT = 4096

_STRIP = 1 << 14
_SPREAD = 64
_BITMAP = 1 << 26


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the text, its sorted distinct shingle hashes as signed integers)."""
    for p in bw.pieces(bw.arrow_texts(texts), bw.NOT_SPACE):
        h = p.hashes()
        shingles, at = bw.windows(h, p.word_at, words)
        begin = np.searchsorted(at, p.word_at)
        for i in range(len(p)):
            a, b = int(p.word_at[i]), int(p.word_at[i + 1])
            if b - a >= words:
                own = np.unique(shingles[begin[i] : begin[i + 1]])
            else:
                own = np.array([bw.whole(h[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64)
            yield p.first + i, own.view(np.int64)


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(hashlib.blake2b(np.sort(tokens).tobytes(), digest_size=16).digest(), np.int64)
    return int(a), int(b)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n + (-percent * n) // 100 + 1


def least_overlap(n, m, percent: int = PERCENT):
    """The smallest intersection at which sets of n and m reach the threshold."""
    return -((-percent * (n + m)) // (100 + percent))


def ordered(tokens: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """The tokens, rare first."""
    return tokens[np.lexsort((tokens, cells[tokens.view(np.uint64) & np.uint64(len(cells) - 1)]))]


def spread(tokens: np.ndarray) -> np.ndarray:
    """How many of the tokens fall in each class of hashes."""
    return np.bincount((tokens.view(np.uint64) >> np.uint64(58)).astype(np.int64), minlength=_SPREAD).astype(np.uint32)


def _first_pass(docs: DataFrame, words: int) -> DataFrame:
    """For each text the size of its set and its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            n, k1, k2 = [np.zeros(batch.num_rows, np.int64) for _ in range(3)]
            for i, tokens in shingle_sets(batch.column("text"), words):
                n[i] = len(tokens)
                if len(tokens):
                    k1[i], k2[i] = class_key(tokens)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(k1), pa.array(k2)], names=["doc_id", "n", "k1", "k2"])

    return docs.transform(map_arrow, run, "doc_id long, n long, k1 long, k2 long")


_DEALT = "bucket int, sheet long, wide boolean, payload binary"
_DEALT_SCHEMA = pa.schema([("bucket", pa.int32()), ("sheet", pa.int64()), ("wide", pa.bool_()), ("payload", pa.binary())])
_TEXT_BITS = 13  # of an owner: a sheet has at most 2^13 texts


def _rows(bucket: np.ndarray, buckets: int, owner: np.ndarray, prints: np.ndarray, sheet: int, wide: bool) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has some: owners (texts of the sheet in 16 bits, or whole owners in 64), then prints."""
    order = np.argsort(bucket, kind="stable")
    edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edge))
    own, what = owner[order], prints[order]
    rows = [own[edge[k] : edge[k + 1]].tobytes() + what[edge[k] : edge[k + 1]].tobytes() for k in full.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), sheet)), pa.array(np.full(len(full), wide)), pa.array(rows, pa.binary())], schema=_DEALT_SCHEMA)


def _unpack(raw: bytes, sheet: int, wide: bool, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Owners (sheet and text as one number) and prints of a row."""
    own = np.dtype(np.int64 if wide else np.uint16)
    n = len(raw) // (own.itemsize + width.itemsize)
    owner = np.frombuffer(raw, own, n).astype(np.int64)
    return owner if wide else owner | sheet << _TEXT_BITS, np.frombuffer(raw, width, n, n * own.itemsize)


def _sheets(docs: DataFrame, bits, words: int, coarse: int, width: np.dtype) -> DataFrame:
    """The shingles of the texts whose bit is set, as fingerprints by bucket, and a row of bucket -1 for each sheet.

    A sheet is some texts of one task; that row holds their classes and sizes. A bucket is the
    remainder of a shingle's high half. The number of rows follows the number of sheets: a sheet has
    at most ``coarse`` buckets, whatever the size of the table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        keys, sets, size, number = [], [], 0, 0

        def sheet() -> Iterator[pa.RecordBatch]:
            name = task << 24 | number
            lengths = np.fromiter(map(len, sets), np.int64, len(sets))
            tokens = np.concatenate(sets).view(np.uint64)
            about = np.concatenate([np.array(keys, np.int64), lengths]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([name]), pa.array([False]), pa.array([about], pa.binary())], schema=_DEALT_SCHEMA)
            owner = np.repeat(np.arange(len(sets), dtype=np.uint16), lengths)
            yield from _rows(((tokens >> np.uint64(32)) % np.uint64(coarse)).astype(np.int64), coarse, owner, tokens.astype(width), name, False)

        for batch in (b.slice(i, 512) for b in batches for i in range(0, b.num_rows, 512)):
            at = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bits.value[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1))
            for _, own in shingle_sets(batch.column("text"), words):
                if not len(own):
                    continue
                keys.append(class_key(own)[0])
                sets.append(own)
                size += len(own)
                if size >= SHEET or len(sets) >= 1 << _TEXT_BITS:
                    yield from sheet()
                    keys, sets, size, number = [], [], 0, number + 1
        if sets:
            yield from sheet()

    place = F.pmod(F.xxhash64("doc_id"), F.lit(_BITMAP))
    return docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")).transform(map_arrow, run, _DEALT)


def _dealt_again(sheets: DataFrame, coarse: int, fine: int, buckets: int, shuffle: int) -> DataFrame:
    """The second step: each coarse bucket's rows, spread over several tasks, cut into its fine buckets.

    What a task cuts at once is a sheet again, with a negative number and owners of many sheets.
    """
    width = np.dtype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        at, size = None, 0

        def cut() -> Iterator[pa.RecordBatch]:
            owner, prints = (np.concatenate(x) for x in zip(*held, strict=True))
            part = ((prints >> np.uint64(32)) // np.uint64(coarse) % np.uint64(fine)).astype(np.int64)
            for batch in _rows(part, fine, owner, prints, -1 - (task << 24 | number), True):
                bucket = pa.array((batch.column("bucket").to_numpy().astype(np.int64) * coarse + at).astype(np.int32))
                yield pa.RecordBatch.from_arrays([bucket, *batch.columns[1:]], schema=_DEALT_SCHEMA)

        for batch in batches:
            for bucket, sheet, wide, raw in zip(*(batch.column(c) for c in _DEALT_SCHEMA.names), strict=True):
                if bucket.as_py() < 0:
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py()], f.type) for x, f in zip((bucket, sheet, wide, raw), _DEALT_SCHEMA, strict=True)], schema=_DEALT_SCHEMA)
                    continue
                if held and (bucket.as_py() != at or size >= SHEET):
                    yield from cut()
                    held, size, number = [], 0, number + 1
                at = bucket.as_py()
                held.append(_unpack(raw.as_py(), sheet.as_py(), wide.as_py(), width))
                size += len(held[-1][1])
        if held:
            yield from cut()

    spread = F.pmod(F.xxhash64("sheet"), F.lit(max(1, buckets // coarse)))
    return sheets.repartition(max(shuffle, buckets), "bucket", spread).sortWithinPartitions("bucket").transform(map_arrow, run, _DEALT)


def _live(docs: DataFrame, classes: DataFrame, words: int, percent: int, bucket_size: int = BUCKET, fanout: int = FANOUT) -> DataFrame:
    """k1 of the classes that can have a partner: at least percent of their shingles stand elsewhere too.

    Exact but for fingerprints that agree by chance, which only let a class through. Buckets are
    as many as keep about bucket_size shingles in each. Each row that a bucket got is answered with one
    row: which of its texts have how many shingles that others have as well. The answers to a sheet
    are summed where they meet again, so all rows follow the sheets.
    """
    spark = docs.sparkSession
    total = classes.agg(F.sum("n")).first()[0] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, -(-total // bucket_size))
    twice = buckets > fanout
    coarse = int(np.ceil(np.sqrt(buckets))) if twice else buckets
    width = np.dtype(np.uint64 if twice else np.uint32)
    bits = spark.sparkContext.broadcast(_bitmap(classes, "rep"))
    texts = (1 << _TEXT_BITS) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The answer to each row: owners, then numbers of shared shingles. Rows about sheets go through as they are."""
        runs = Runs(["bucket"])

        def work(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if table is None or not len(table):
                return
            bucket = table.column("bucket").to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part = table.slice(a, b - a)
                if bucket[a] < 0:
                    yield from part.select(_DEALT_SCHEMA.names).to_batches()
                    continue
                rows = [(sheet.as_py(), wide.as_py(), raw.as_py()) for sheet, wide, raw in zip(*(part.column(c) for c in ("sheet", "wide", "payload")), strict=True)]
                owners, prints = zip(*(_unpack(raw, sheet, wide, width) for sheet, wide, raw in rows), strict=True)
                ends = np.cumsum([len(x) for x in prints])
                prints = np.concatenate(prints)
                order = np.argsort(prints, kind="stable")
                same = prints[order[1:]] == prints[order[:-1]]
                shared = np.zeros(len(order), bool)
                shared[order[1:][same]] = shared[order[:-1][same]] = True
                out = []
                for (sheet, wide, _), owner, end in zip(rows, owners, ends.tolist(), strict=True):
                    whose, n = np.unique(owner[shared[end - len(owner) : end]], return_counts=True)
                    if len(whose):
                        packed = whose.tobytes() if wide else (whose & texts).astype(np.uint16).tobytes()
                        out.append((int(bucket[a]), sheet, wide, packed + n.astype(np.uint32).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _DEALT_SCHEMA, strict=True)], schema=_DEALT_SCHEMA)

        for batch in batches:
            yield from work(runs.take(batch))
        yield from work(runs.rest())

    found = pa.schema([("sheet", pa.int64()), ("text", pa.int32()), ("k1", pa.int64()), ("n", pa.int64()), ("shared", pa.int64())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each sheet its texts with class, size and number of shared shingles; of a sheet of the second step the owners' numbers."""
        at, about, owners, numbers = None, None, [], []

        def out() -> pa.RecordBatch:
            owner = np.concatenate([np.zeros(0, np.int64), *owners])
            number = np.concatenate([np.zeros(0, np.int64), *numbers])
            if about is not None:
                both = np.frombuffer(about, np.int64)
                size = len(both) // 2
                total = np.bincount(owner & texts, number, size).astype(np.int64)
                return pa.RecordBatch.from_arrays([pa.array(np.full(size, at)), pa.array(np.arange(size, dtype=np.int32)), pa.array(both[:size]), pa.array(both[size:]), pa.array(total)], schema=found)
            owner, place = np.unique(owner, return_inverse=True)
            total = np.bincount(place, number, len(owner)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(owner >> _TEXT_BITS), pa.array((owner & texts).astype(np.int32)), pa.nulls(len(owner), pa.int64()), pa.nulls(len(owner), pa.int64()), pa.array(total)], schema=found)

        for batch in batches:
            for bucket, sheet, wide, raw in zip(*(batch.column(c) for c in _DEALT_SCHEMA.names), strict=True):
                if sheet.as_py() != at:
                    if at is not None:
                        yield out()
                    at, about, owners, numbers = sheet.as_py(), None, [], []
                if bucket.as_py() < 0:
                    about = raw.as_py()
                else:
                    owner, number = _unpack(raw.as_py(), at, wide.as_py(), np.dtype(np.uint32))
                    owners.append(owner)
                    numbers.append(number.astype(np.int64))
        if at is not None:
            yield out()

    sheets = _sheets(docs, bits, words, coarse, width)
    if twice:
        sheets = _dealt_again(sheets, coarse, coarse, buckets, shuffle)
        buckets = coarse * coarse
    deal = F.when(F.col("bucket") < 0, F.xxhash64("sheet")).otherwise(F.col("bucket").cast("long"))
    answers = sheets.withColumn("deal", deal).repartition(min(buckets, 1 << 16), "deal").sortWithinPartitions("bucket").drop("deal").transform(map_arrow, count, _DEALT)
    counted = answers.repartition("sheet").sortWithinPartitions("sheet").transform(map_arrow, gather, "sheet long, text int, k1 long, n long, shared long")
    summed = counted.groupBy("sheet", "text").agg(F.max("k1").alias("k1"), F.max("n").alias("n"), F.sum("shared").alias("shared"))
    return summed.where(100 * F.col("shared") >= percent * F.col("n")).select("k1").distinct()


def _strips(sets: DataFrame, cells: int) -> DataFrame:
    """Each task's counters of the sets' shingles, in strips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for raw in batch.column("tokens"):
                counts[np.frombuffer(raw.as_py(), np.uint64) & np.uint64(cells - 1)] += 1
        strips = counts.reshape(-1, min(_STRIP, cells))
        full = np.flatnonzero(strips.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([strips[k].tobytes() for k in full], pa.binary())], names=["strip", "counts"])

    return sets.select("tokens").transform(map_arrow, run, "strip int, counts binary")


def _counters(strips: DataFrame, cells: int) -> np.ndarray:
    """The sum of all tasks' counters. Each strip is summed row by row; only sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in batches:
            for strip, raw in zip(batch.column("strip").to_pylist(), batch.column("counts"), strict=True):
                if strip != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["strip", "counts"])
                    at, total = strip, np.zeros(min(_STRIP, cells), np.uint64)
                total += np.frombuffer(raw.as_py(), np.uint32)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["strip", "counts"])

    # two steps, so that no task reads all rows of a strip from a large table
    part = strips.withColumn("part", F.pmod(F.xxhash64("counts"), F.lit(64)))
    first = part.repartition("strip", "part").sortWithinPartitions("strip").select("strip", "counts").transform(map_arrow, _summed, "strip int, counts binary")
    out = np.zeros(cells, np.uint64)
    for row in first.repartition("strip").sortWithinPartitions("strip").transform(map_arrow, run, "strip int, counts binary").toLocalIterator():
        out[row.strip * min(_STRIP, cells) :][: min(_STRIP, cells)] = np.frombuffer(row.counts, np.uint64)
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of one strip added up, as far as 32 bits hold."""
    at, total = None, None
    for batch in batches:
        for strip, raw in zip(batch.column("strip").to_pylist(), batch.column("counts"), strict=True):
            own = np.frombuffer(raw.as_py(), np.uint32)
            if strip == at:
                total = np.minimum(total.astype(np.uint64) + own, np.iinfo(np.uint32).max).astype(np.uint32)
                continue
            if at is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["strip", "counts"])
            at, total = strip, own
    if at is not None:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["strip", "counts"])


def _prefixes(sets: DataFrame, cells, percent: int, hot: int) -> DataFrame:
    """token, k1, n, at (place in the order), hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = cells.value
        edge = max(hot, 4 * int(table.mean()))
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, tokens, keys, sizes, places = batch.slice(i, 512), [], [], [], []
                for k1, raw in zip(part.column("k1").to_pylist(), part.column("tokens"), strict=True):
                    own = np.frombuffer(raw.as_py(), np.int64)
                    p = int(prefix_length(np.int64(len(own)), percent))
                    tokens.append(ordered(own, table)[:p])
                    keys.append(np.full(p, k1))
                    sizes.append(np.full(p, len(own), np.int32))
                    places.append(np.arange(p, dtype=np.int32))
                if tokens:
                    yield _prefix_batch(tokens, keys, sizes, places, table, edge)

    return sets.select("k1", "tokens").transform(map_arrow, run, "token long, k1 long, n int, at int, hot boolean")


def _prefix_batch(tokens, keys, sizes, places, table, edge) -> pa.RecordBatch:
    t = np.concatenate(tokens)
    hot = table[t.view(np.uint64) & np.uint64(len(table) - 1)] > edge
    return pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.concatenate(keys)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places)), pa.array(hot)], names=["token", "k1", "n", "at", "hot"])


def _candidates(prefixes: DataFrame, few: int, percent: int) -> DataFrame:
    """a, b, kind: pairs of classes to verify (0), links into groups to compare (1: classes, 2: by way of a token)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(["token"])

        def work(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if table is None or not len(table):
                return
            token, k, n, at, hot = (table.column(c).to_numpy() for c in ("token", "k1", "n", "at", "hot"))
            hot = hot.astype(bool)
            out = [(token[hot], k[hot], 2)] if hot.any() else []
            # a class that several tasks sent stands together
            keep = np.ones(len(token), bool)
            keep[1:] = (token[1:] != token[:-1]) | (k[1:] != k[:-1]) | (n[1:] != n[:-1])
            keep &= ~hot
            token, k, n, at = token[keep], k[keep], n[keep].astype(np.int64), at[keep].astype(np.int64)
            if len(token):
                begin = np.concatenate([[0], np.flatnonzero(np.diff(token)) + 1])
                size = np.diff(np.concatenate([begin, [len(token)]]))
                for m in np.unique(size[size > 1]).tolist():
                    own = begin[size == m]
                    if m > few:
                        for a in own.tolist():
                            out.append((np.full(m - 1, k[a]), k[a + 1 : a + m], 1))
                        continue
                    i, j = np.triu_indices(m, 1)
                    x, y = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
                    low, high = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
                    bound = np.minimum(at[x], at[y]) + 1 + np.minimum(n[x] - at[x], n[y] - at[y]) - 1
                    good = (100 * low >= percent * high) & (bound >= least_overlap(low, high, percent)) & (k[x] != k[y])
                    if good.any():
                        out.append((np.minimum(k[x], k[y])[good], np.maximum(k[x], k[y])[good], 0))
            for a, b, kind in out:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), kind, np.int32))], names=["a", "b", "kind"])

        for batch in batches:
            yield from work(runs.take(batch))
        yield from work(runs.rest())

    deal = F.when(F.col("hot"), F.xxhash64("token", "k1")).otherwise(F.col("token"))
    return prefixes.withColumn("deal", deal).repartition("deal").sortWithinPartitions("token", "k1").drop("deal").transform(map_arrow, run, "a long, b long, kind int")


def _bitmap(ids: DataFrame, name: str) -> np.ndarray:
    """A bit for each hashed id, 8 MB at most; more ids than it can tell apart only filter less."""
    place = F.pmod(F.xxhash64(name), F.lit(_BITMAP))
    rows = ids.select((place + 1).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toArrow()
    out = np.zeros(_BITMAP // 8, np.uint8)
    for bucket, bits in zip(rows.column("bucket").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """The sets of the wanted texts (doc_id, k1): rep, k1, n, spread, tokens."""
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("place").to_numpy()
            batch = batch.filter(pa.array((bits.value[at // 8] >> (at % 8).astype(np.uint8)) & 1 == 1))
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                ids, rows = part.column("doc_id"), [own for _, own in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([class_key(r)[0] if len(r) else None for r in rows], pa.int64()), pa.array([len(r) for r in rows], pa.int64()), pa.array([spread(r).tobytes() for r in rows], pa.binary()), pa.array([r.tobytes() for r in rows], pa.binary())],
                    names=["doc_id", "k1", "n", "spread", "tokens"],
                )

    place = F.pmod(F.xxhash64("doc_id"), F.lit(_BITMAP))
    found = docs.where("doc_id is not null").select("doc_id", "text", place.alias("place")).transform(map_arrow, run, "doc_id long, k1 long, n long, spread binary, tokens binary")
    return found.join(wanted, (found.doc_id == wanted.rep) & (found.k1 == wanted.k1)).select("rep", found.k1, "n", "spread", "tokens").dropDuplicates(["rep", "k1"])


def _may_link(n: np.ndarray, m: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The length filter, and the suffix filter given a bound of the intersection."""
    return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & (common >= least_overlap(n, m, percent))


def _verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """rep, other of the pairs that reach the threshold."""

    def both(rows: DataFrame, columns: list[str]) -> DataFrame:
        for end in ("a", "b"):
            own = sets.select(F.col("k1").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns])
            rows = rows.join(own, end)
        return rows

    def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(f"spread_{e}").to_pylist()), np.uint32).reshape(-1, _SPREAD) for e in ("a", "b"))
                n, m = (batch.column(f"n_{e}").to_numpy() for e in ("a", "b"))
                yield batch.filter(pa.array(_may_link(n, m, np.minimum(x, y).sum(1, dtype=np.int64), percent))).select(["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.filter(pa.array(good)).select(["rep_a", "rep_b"])

    left = stash.keep(both(pairs, ["n", "spread"]).transform(map_arrow, suffix, "a long, b long"), "suffix")
    return both(left, ["rep", "tokens"]).transform(map_arrow, verify, "rep_a long, rep_b long").toDF("rep", "other")


def _near_pivots(rows: DataFrame, percent: int, stash: Stash) -> DataFrame:
    """rows (k1, group, blocks and the sets' columns) of groups of several blocks, with pivot (its rep) and whether they link to it.

    A group's pivot is its class with the smallest key. Rows and pivots meet by a computed key, so that
    a hot group can be split between tasks.
    """
    pivots = rows.groupBy("group").agg(F.min("k1").alias("k1"))
    pivots = stash.keep(rows.join(pivots, ["group", "k1"]).select(F.concat(F.lit("="), "group").alias("g"), F.col("rep").alias("pivot"), F.col("n").alias("pivot_n"), F.col("tokens").alias("pivot_tokens")), "pivots")
    names = ["k1", "group", "blocks", "rep", "n", "spread", "tokens", "pivot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("tokens"), batch.column("pivot_tokens"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(linked)], names=[*names, "linked"])

    met = rows.join(pivots, F.concat(F.lit("="), rows.group) == pivots.g).select(*names, "pivot_tokens")
    return stash.keep(met.transform(map_arrow, run, "k1 long, group long, blocks int, rep long, n long, spread binary, tokens binary, pivot long, linked boolean"), "near")


def _compared_blocks(groups: DataFrame, sets: DataFrame, percent: int, block: int, stash: Stash) -> DataFrame:
    """rep, other: a spanning forest of the links within each group (k1, group).

    A group of one block is compared in one unit. Of a larger one all classes are compared with one
    of them, the pivot, first; those linked to it are connected, so they need not meet each other: only the
    others are compared, block by block, among themselves and with all. A group of near copies thus
    costs about as many comparisons as it has classes.
    """
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = stash.keep(sizes.where("blocks > 1").select(F.col("group").alias("g"), "blocks"), "sizes")
    rows = groups.join(sizes, groups.group == sizes.g, "left").select("k1", "group", F.coalesce("blocks", F.lit(1)).alias("blocks")).join(sets, "k1")
    small = rows.where("blocks = 1").select(F.xxhash64("group").alias("unit"), F.lit(True).alias("alone"), F.lit(True).alias("side"), "rep", "n", "spread", "tokens")
    near = _near_pivots(rows.where("blocks > 1"), percent, stash)
    other = near.where("not linked").groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("other_blocks"))
    other = stash.keep(other.select(F.concat(F.lit("="), "group").alias("g"), "other_blocks"), "others")
    left = near.join(other, F.concat(F.lit("="), near.group) == other.g)
    rest = left.where("not linked").withColumn("mine", F.pmod(F.xxhash64("k1"), F.col("other_blocks")).cast("int"))
    among = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    low, high = F.least("mine", "with"), F.greatest("mine", "with")
    columns = ["rep", "n", "spread", "tokens"]
    units = small.unionByName(among.select(F.xxhash64("group", low, high).alias("unit"), (low == high).alias("alone"), (F.col("mine") == low).alias("side"), *columns))
    across = F.xxhash64("group", F.col("mine"), F.col("with"), F.lit("across")).alias("unit")
    units = units.unionByName(rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(across, F.lit(False).alias("alone"), F.lit(True).alias("side"), *columns))
    known = left.where("linked").withColumn("with", F.pmod(F.xxhash64("k1"), F.col("blocks")).cast("int")).withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)))
    units = units.unionByName(known.select(across, F.lit(False).alias("alone"), F.lit(False).alias("side"), *columns))
    pivots = near.where("linked and rep <> pivot").select("rep", F.col("pivot").alias("other"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(["unit"])

        def work(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if table is None or not len(table):
                return
            unit = table.column("unit").to_numpy()
            begin = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
            for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                part = table.slice(a, b - a)
                rep, n = part.column("rep").to_numpy(), part.column("n").to_numpy()
                alone, side = part.column("alone").to_numpy()[0], part.column("side").to_numpy().astype(bool)
                own = np.frombuffer(b"".join(part.column("spread").to_pylist()), np.uint32).reshape(-1, _SPREAD).astype(np.int64)
                bound = np.zeros((len(n), len(n)), np.int64)
                for c in range(_SPREAD):
                    bound += np.minimum(own[:, c][:, None], own[:, c][None, :])
                may = _may_link(n[:, None], n[None, :], bound, percent)
                np.fill_diagonal(may, False)
                if not alone:
                    may &= side[:, None] != side[None, :]
                live = np.flatnonzero(may.any(1))
                if not len(live):
                    continue
                tokens = [np.frombuffer(part.column("tokens")[i].as_py(), np.int64) for i in live.tolist()]
                common = common_counts(tokens)
                m = n[live]
                linked = may[np.ix_(live, live)] & (100 * common >= percent * (m[:, None] + m[None, :] - common))
                root = forest(linked)
                moved = root != np.arange(len(live))
                if moved.any():
                    yield pa.RecordBatch.from_arrays([pa.array(rep[live][moved]), pa.array(rep[live][root[moved]])], names=["rep", "other"])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield from work(runs.take(batch.slice(at, 256)))
        yield from work(runs.rest())

    return pivots.unionByName(units.repartition("unit").sortWithinPartitions("unit").transform(map_arrow, run, "rep long, other long"))


def common_counts(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices of bounded width."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(column)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(tokens), -1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    out = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, len(shared), wide):
        i, j = np.searchsorted(column, [at, at + wide])
        matrix = np.zeros((len(sets), wide), np.float32)
        matrix[owner[i:j], column[i:j] - at] = 1
        out += matrix @ matrix.T
    return np.rint(out).astype(np.int64)


def components_of(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, cells: int | None = None, few: int = FEW, block: int = BLOCK, hot: int = HOT, bucket_size: int = BUCKET, fanout: int = FANOUT) -> DataFrame:
    """doc_id, n_shingles, component_id (long) for every row of docs."""
    spark = docs.sparkSession
    stash, slim = Stash(spark, "ngramjoin"), docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stash.keep(_first_pass(slim, words), "first")
    classes = stash.keep(rows.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    live = _live(slim, classes, words, percent, bucket_size, fanout)
    wanted = stash.keep(classes.join(live, "k1", "left_semi").select("rep", "k1"), "wanted")
    sets = stash.keep(_sets(slim, wanted, words), "sets")
    cells = cells or min(MAX_CELLS, max(CELLS, 1 << int(np.log2((sets.agg(F.sum("n")).first()[0] or 1)))))
    counters = spark.sparkContext.broadcast(_counters(_strips(sets, cells), cells))
    found = stash.keep(_candidates(_prefixes(sets, counters, percent, hot), few, percent), "candidates")
    pairs = found.where("kind = 0").select("a", "b").distinct()
    grouped = components(found.where("kind > 0").select(F.when(F.col("kind") == 2, F.xxhash64(F.lit("token"), "a")).otherwise(F.col("a")).alias("a"), "b"), stash, "groups")
    groups = grouped.select(F.col("node").alias("k1"), F.col("component").alias("group"))
    links = _verified_pairs(pairs, sets, percent, stash).unionByName(_compared_blocks(groups, sets, percent, block, stash))
    links = stash.keep(links, "links")
    stash.drop("candidates", "sets", "suffix", "groups-named", "groups-least")
    where = components(links.select(F.col("rep").alias("a"), F.col("other").alias("b")), stash)
    known = classes.join(where.withColumnRenamed("node", "rep"), "rep", "left").select(F.xxhash64("k1", "k2", "n").alias("key"), F.col("k1").alias("c1"), F.col("k2").alias("c2"), F.col("n").alias("m"), F.coalesce("component", "rep").alias("component"))
    known = stash.keep(known, "known")
    same = (F.xxhash64("k1", "k2", "n") == F.col("key")) & (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")) & (F.col("n") == F.col("m"))
    out = rows.join(known, same, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
