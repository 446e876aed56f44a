"""Context-tree weighting over bytes, learnt from a corpus and frozen for scoring.

Each byte is decomposed into eight binary decisions, each with its own context tree over the
bytes before it, up to ``depth`` of them. A node of a tree counts the zeros and ones that training
texts had in its context, and its Krichevsky-Trofimov estimate gives both their probability P_e
and the next bit's. Bottom up, a node's weighted probability is half its own P_e and half the
product of its children's, which mixes all ways to prune the tree; top down, the posterior share
of "the context ends here", 1/2 P_e / P_w, mixes the estimates of all depths on a path into one
prediction. A path ends at the deepest context that training has seen.

A text's score is the log10 probability of its lower-cased (A-Z) bytes and of one end symbol,
0xFF, which UTF-8 does not use; contexts before its first byte are zero bytes.

Counts are gathered from all training texts: each task sums its byte n-grams, the sums are added
up by n-gram, and every shallower context is summed from the deeper. No context is left out. The
distinct n-grams of all texts, those of held-out texts with a count of 0, are dealt out by the last
two bytes of their contexts, so that a task has whole subtrees: it weighs them and mixes each
n-gram's path down to that depth. The contexts of one byte and of none, at most 257 x 255 nodes,
are weighed on the driver from sums and end the mix. So each distinct n-gram has one score in a
table; those of the most frequent are broadcast, for the others a text's distinct n-grams are
joined with it.

The unigram base is exact as well. Counts of the at most ``max_head`` most frequent words are
broadcast; other words are joined with the table of counts. Words are known by 64-bit hashes.

Defined results: a null text is the empty text, with one token, the end; a null doc_id counts as
the empty text for the split; repeated rows count each time; texts of any length are scored whole;
without training texts every bit has probability 1/2 and the counts are 0; an empty table gives an empty
one; only id and text are read, so columns of other names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.llm import bytewords as bw
from glotspark.llm.batches import Runs, map_arrow
from glotspark.llm.store import Stash

#: Bytes of context.
DEPTH = 5

#: Bytes of context by which the tree is dealt out.
SPLIT = 2

#: Ends of paths (n-grams) whose scores are broadcast, 12 bytes each; the others are joined.
MAX_NODES = 1 << 22

#: Words whose counts are broadcast, 16 bytes each.
MAX_HEAD = 1 << 20

#: Bytes of text whose n-grams are sorted at once.
PIECE = 1 << 20

#: Distinct n-grams that a task sums before it sends them on.
HELD = 2 << 20

END_WORD = -1
_END = 255


def lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for positive x, by Stirling's series after shifting small ones up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] -= np.log(y[small])
        y[small] += 1
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)


_FEW = 1 << 12
_HALVES, _WHOLES = lgamma(np.arange(_FEW) + 0.5), lgamma(np.arange(_FEW) + 1.0)


def _lgamma_of(n: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    out = table[np.minimum(n, _FEW - 1)]
    many = n >= _FEW
    out[many] = lgamma(n[many] + plus)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these (whole) counts."""
    return _lgamma_of(zeros, _HALVES, 0.5) + _lgamma_of(ones, _HALVES, 0.5) - np.log(np.pi) - _lgamma_of(zeros + ones, _WHOLES, 1.0)


def ngrams(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, and its end: the byte behind its context, as one integer; its text."""
    n, texts = len(data), len(at) - 1
    owner = np.repeat(np.arange(texts), np.diff(at))
    out = np.zeros(n + texts * (depth + 1), np.uint8)
    real = np.zeros(len(out), bool)
    place = np.arange(n) + (depth + 1) * owner + depth
    out[place] = data
    real[place] = True
    ends = at[1:] + (depth + 1) * np.arange(texts) + depth
    out[ends] = _END
    real[ends] = True
    gram = np.zeros(len(out), np.uint64)
    for k in range(depth + 1):
        gram[k:] |= out[: len(out) - k].astype(np.uint64) << np.uint64(8 * k)
    block = np.repeat(np.arange(texts), np.diff(at) + depth + 1)
    return gram[real], block[real]


class Sums:
    """Counts by key. What is added is sorted at once; sorted parts are merged when they are many."""

    def __init__(self, held: int = HELD):
        self.held, self.parts, self.size = held, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys.view(np.int64), return_counts=True)
        self.parts.append((keys, counts))
        self.size += len(keys)

    def merge(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1])
        self.parts, self.size = [(keys[first], np.add.reduceat(counts, first))], len(first)

    def take(self, all_: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """The sums, once they are more than half of what is held, or at the end."""
        if not self.parts or not all_ and self.size <= self.held:
            return None
        self.merge()
        if not all_ and self.size <= self.held // 2:
            return None
        (out,), self.parts, self.size = self.parts, [], 0
        return out


def _lowered(texts: pa.Array, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = bw.raw(bw.arrow_texts(texts))
    for i, j in bw.cut(at, size):
        yield i, j, bw.LOWER[data[at[i] : at[j]]], at[i : j + 1] - at[i]


def gather(docs: DataFrame, depth: int) -> DataFrame:
    """kind ('gram' or 'word'), key, n over the texts that are not held out; n-grams of the others too, counted 0 times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {"gram": Sums(), "word": Sums()}

        def out(all_: bool) -> Iterator[pa.RecordBatch]:
            for kind, s in sums.items():
                if (found := s.take(all_)) is not None:
                    for a in range(0, len(found[0]), 1 << 16):
                        keys, n = (x[a : a + (1 << 16)] for x in found)
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for i, j, data, at in _lowered(bw.arrow_texts(batch.column("text"))):
                gram, owner = ngrams(data, at, depth)
                apart = held[i:j][owner]
                sums["gram"].add(gram[~apart])
                other = np.unique(gram[apart].view(np.int64))
                sums["gram"].add(other, np.zeros(len(other), np.int64))
                sums["word"].add(np.array([END_WORD]), np.array([int((~held[i:j]).sum())]))
                yield from out(False)
            batch = batch.filter(pa.compute.invert(batch.column("held_out")))
            for p in bw.pieces(bw.arrow_texts(batch.column("text")), bw.NOT_SPACE, size=PIECE):
                sums["word"].add(p.hashes())
                yield from out(False)
        yield from out(True)

    summed = docs.transform(map_arrow, run, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    return summed.where("kind = 'gram' or n > 0")


@dataclass
class Tree:
    """By depth: sorted keys (context, then place in the byte's decision tree), P(one) and the share of ending there."""

    depth: int
    keys: list[np.ndarray]
    one: list[np.ndarray]
    share: list[np.ndarray]

    def log2(self, grams: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """The code length, negated, of the last byte of each n-gram.

        below has, for each bit and n-gram, the probability that deeper contexts give; nan where none was seen.
        """
        byte, total = (grams & np.uint64(255)).astype(np.int64), np.zeros(len(grams))
        context = grams >> np.uint64(8)
        masks = [np.uint64((1 << (8 * d)) - 1) for d in range(self.depth + 1)]
        for b in range(8):
            node = ((1 << b) | (byte >> (8 - b))).astype(np.uint64)
            bit = ((byte >> (7 - b)) & 1).astype(bool)
            deeper = np.zeros(len(grams), bool) if below is None else ~np.isnan(below[b])
            p = np.full(len(grams), 0.5) if below is None else np.where(deeper, below[b], 0.5)
            for d in range(self.depth, -1, -1):
                keys = self.keys[d]
                if not len(keys):
                    continue
                key = ((context & masks[d]) << np.uint64(8)) | node
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = keys[at] == key
                own = self.one[d][at].astype(float)
                own = np.where(bit, own, 1 - own)
                share = np.where(deeper, self.share[d][at], 1.0)
                p = np.where(hit, share * own + (1 - share) * p, p)
                deeper |= hit
            total += np.log2(p)
        return total


def mixed(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P_w of nodes, from log P_e and the sums of their children's log P_w, and the share of ending there."""
    both = np.logaddexp(own, split) - np.log(2)
    return both, np.exp(own - np.log(2) - both)


def weigh(grams: np.ndarray, n: np.ndarray, depth: int, low: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """For all n-grams with some contexts of low bytes: their bits' probabilities, and the nodes of those contexts.

    The first (8 rows, nan where no context was seen) mixes the depths from low on. The nodes are
    given as node, context, zeros, ones and log P_w.
    """
    byte, back = (grams & np.uint64(255)).astype(np.int64), np.zeros(len(grams), np.uint64)
    for k in range(1, depth + 1):  # the byte nearest to the decision first: contexts of all depths are ranges
        back |= ((grams >> np.uint64(8 * k)) & np.uint64(255)) << np.uint64(8 * (depth - k))
    chance, nodes = np.empty((8, len(grams)), np.float32), []
    for b in range(8):
        key = (((1 << b) | (byte >> (8 - b))).astype(np.uint64) << np.uint64(8 * depth)) | back
        order = np.argsort(key)
        key, bit = key[order], ((byte[order] >> (7 - b)) & 1).astype(bool)
        zeros, ones = np.where(bit, 0, n[order]), np.where(bit, n[order], 0)
        p, begin, weighted = np.full(len(key), np.nan), np.arange(len(key)), None
        for d in range(depth, low - 1, -1):
            here = key >> np.uint64(8 * (depth - d))
            new = np.concatenate([[True], here[1:] != here[:-1]])
            first, at = np.flatnonzero(new), np.cumsum(new) - 1
            children = np.searchsorted(begin, first)
            zeros, ones = np.add.reduceat(zeros, children), np.add.reduceat(ones, children)
            weighted, share = (kt(zeros, ones), np.ones(len(first))) if weighted is None else mixed(kt(zeros, ones), np.add.reduceat(weighted, children))
            one = ((ones + 0.5) / (zeros + ones + 1.0))[at]
            own, part = np.where(bit, one, 1 - one), share[at]
            p = np.where((zeros + ones > 0)[at], np.where(np.isnan(p), own, part * own + (1 - part) * p), p)
            begin = first
        chance[b, order] = p
        seen = zeros + ones > 0
        context = (grams[order[begin]] >> np.uint64(8)) & np.uint64((1 << (8 * low)) - 1)
        nodes.append([x[seen] for x in ((key[begin] >> np.uint64(8 * depth)).astype(np.int32), context.view(np.int64), zeros, ones, weighted)])
    return chance, [np.concatenate(x) for x in zip(*nodes, strict=True)]


def top(nodes: DataFrame, low: int) -> Tree:
    """The contexts of less than low bytes, from the nodes of those of low bytes."""
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if low:
        mask = (1 << (8 * (low - 1))) - 1
        sums = nodes.groupBy("node", F.col("context").bitwiseAND(F.lit(mask)).alias("context")).agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("split"))
        found = sums.toArrow()  # at most 255 nodes for each context of low - 1 bytes
        node, context, zeros, ones, split = (found.column(c).to_numpy() for c in ("node", "context", "zeros", "ones", "split"))
        for d in range(low - 1, -1, -1):
            key = ((context & ((1 << (8 * d)) - 1)) << 8) | node
            key, at = np.unique(key, return_inverse=True)
            zeros, ones, split = (np.bincount(at, x, len(key)) for x in (zeros, ones, split))
            zeros, ones = zeros.astype(np.int64), ones.astype(np.int64)
            split, share = mixed(kt(zeros, ones), split)
            levels.insert(0, (key.view(np.uint64), (ones + 0.5) / (zeros + ones + 1.0), share))
            context, node = key >> 8, key & 255
    return Tree(low - 1, [x[0] for x in levels], [x[1] for x in levels], [x[2] for x in levels])


def scores(grams: DataFrame, depth: int, stash: Stash) -> DataFrame:
    """key, n and log2, the negated code length, of each n-gram (key, n)."""
    low = min(depth, SPLIT)
    bits = [f"p{b}" for b in range(8)]
    named = ["node", "context", "zeros", "ones", "weighted"]
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64()), *[(b, pa.float32()) for b in bits], ("node", pa.int32()), ("context", pa.int64()), ("zeros", pa.int64()), ("ones", pa.int64()), ("weighted", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(["suffix"])

        def work(table: pa.Table | None) -> Iterator[pa.RecordBatch]:
            if table is None or not len(table):
                return
            key, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            chance, nodes = weigh(key.view(np.uint64), n, depth, low)
            for of, columns in (([*schema.names[:2], *bits], [key, n, *chance]), (named, nodes)):
                for a in range(0, len(columns[0]), 1 << 16):
                    part = [pa.array(x[a : a + (1 << 16)]) for x in columns]
                    given = dict(zip(of, part, strict=True))
                    yield pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(len(part[0]), f.type) for f in schema], schema=schema)

        for batch in batches:
            yield from work(runs.take(batch))
        yield from work(runs.rest())

    suffix = F.shiftrightunsigned("key", 8).bitwiseAND(F.lit((1 << (8 * low)) - 1)).alias("suffix")
    dealt = grams.select("key", "n", suffix).repartition("suffix").sortWithinPartitions("suffix")
    kind = "key long, n long, " + ", ".join(f"{b} float" for b in bits) + ", node int, context long, zeros long, ones long, weighted double"
    weighed = stash.keep(dealt.transform(map_arrow, run, kind), "tree")
    tree = grams.sparkSession.sparkContext.broadcast(top(weighed.where("node is not null").select(*named), low))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            below = np.stack([batch.column(b).to_numpy() for b in bits]).astype(float)
            value = tree.value.log2(batch.column("key").to_numpy().view(np.uint64), below)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("n"), pa.array(value)], names=["key", "n", "log2"])

    return stash.keep(weighed.where("node is null").select("key", "n", *bits).transform(map_arrow, end, "key long, n long, log2 double"), "scores")


def hot(counts: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the at most bound greatest n, and all others."""
    # how many rows have each n, up to 2^16: the least n of the first follows
    kept, least = 0, None
    for row in sorted(counts.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().collect(), key=lambda r: -r.n):
        kept += row["count"]
        if kept > bound:
            break
        least = row.n
    return (counts.limit(0), counts) if least is None else (counts.where(F.col("n") >= least), counts.where(F.col("n") < least))


def score(docs: DataFrame, doc: str = "doc_id", text: str = "text", folds: int = 7, fold: int = 2, depth: int = DEPTH, max_nodes: int = MAX_NODES, max_head: int = MAX_HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for each row of docs."""
    spark = docs.sparkSession
    stash = Stash(spark, "ctw")
    held = F.pmod(F.crc32(F.coalesce(F.col(doc).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), held.alias("held_out"))
    counts = stash.keep(gather(slim, depth), "counts")
    frequent, others = hot(scores(counts.where("kind = 'gram'").select("key", "n"), depth, stash), max_nodes)
    table = frequent.select("key", F.col("log2").cast("float").alias("log2")).toArrow()  # max_nodes rows
    order = np.argsort(table.column("key").to_numpy().view(np.uint64))
    scored_grams = spark.sparkContext.broadcast((table.column("key").to_numpy().view(np.uint64)[order], table.column("log2").to_numpy()[order]))
    words = counts.where("kind = 'word'").select("key", "n")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    train, distinct = total["n"] or 0, total["v"]
    head, tail = hot(words, max_head)
    head = head.toArrow()  # max_head rows
    order = np.argsort(head.column("key").to_numpy())
    known = spark.sparkContext.broadcast((head.column("key").to_numpy()[order], head.column("n").to_numpy()[order]))
    floor = float(np.log10(train + distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = known.value
        gram_keys, gram_log2 = scored_grams.value
        for batch in batches:
            texts = bw.arrow_texts(batch.column("text"))
            rows = batch.num_rows
            value, size, rare = np.zeros(rows), np.zeros(rows, np.int64), [np.zeros((0, 3), np.int64)]
            for i, j, data, at in _lowered(texts):
                gram, owner = ngrams(data, at, depth)
                distinct_grams, inverse = np.unique(gram, return_inverse=True)
                place = np.searchsorted(gram_keys, distinct_grams)
                place[place == len(gram_keys)] = 0
                hit = gram_keys[place] == distinct_grams if len(gram_keys) else np.zeros(len(distinct_grams), bool)
                own = np.zeros(len(distinct_grams))
                own[hit] = gram_log2[place[hit]]
                value[i:j] = np.bincount(owner, own[inverse], j - i)
                size[i:j] = np.diff(at) + 1
                if not hit.all():
                    lacks = np.flatnonzero(~hit[inverse])
                    pair, times = np.unique(owner[lacks] * len(distinct_grams) + inverse[lacks], return_counts=True)
                    whose, which = np.divmod(pair, len(distinct_grams))
                    rare.append(np.stack([whose + i, distinct_grams[which].view(np.int64), times], 1))
            whose, which, times = np.concatenate(rare).T
            rare_at = pa.array(np.searchsorted(whose, np.arange(rows + 1)).astype(np.int32))
            rare_keys, rare_n = (pa.ListArray.from_arrays(rare_at, pa.array(np.ascontiguousarray(x))) for x in (which, times))
            tokens, seen, base = np.ones(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            rest: list[list[int]] = []
            end = np.searchsorted(keys, END_WORD)
            end_n = int(n[end]) if end < len(keys) and keys[end] == END_WORD else None
            for p in bw.pieces(texts, bw.NOT_SPACE):
                h, owner = p.hashes().view(np.int64), p.owner()
                at = np.searchsorted(keys, h)
                at[at == len(keys)] = 0
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                here = slice(p.first, p.first + len(p))
                tokens[here] += np.diff(p.word_at)
                seen[here] = np.bincount(owner[hit], minlength=len(p))
                base[here] = np.bincount(owner[hit], np.log10(n[at[hit]] + 1.0), len(p))
                other, whose = h[~hit], owner[~hit]
                cut = np.searchsorted(whose, np.arange(len(p) + 1))
                rest += [other[cut[k] : cut[k + 1]] for k in range(len(p))]
            if end_n is None:
                rest = [np.append(r, END_WORD) for r in rest]
            else:
                base += np.log10(end_n + 1.0)
                seen += end_n > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens), pa.array(seen), pa.array(base), pa.array(value), pa.array(size), pa.array(rest, pa.list_(pa.int64())), rare_keys, rare_n],
                names=["doc_id", "held_out", "n_tokens", "seen", "base", "log2", "size", "rest", "rare", "rare_n"],
            )

    kind = slim.schema["doc_id"].dataType.simpleString()
    scored = slim.transform(map_arrow, run, f"doc_id {kind}, held_out boolean, n_tokens long, seen long, base double, log2 double, size long, rest array<long>, rare array<long>, rare_n array<long>")
    scored = stash.keep(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("key")).join(tail, "key").groupBy("row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1.0)).alias("more_base"))
    rare = scored.select("row", F.explode(F.arrays_zip(F.col("rare").alias("key"), F.col("rare_n").alias("times"))).alias("g")).select("row", "g.key", "g.times")
    rare = rare.join(others.select("key", F.col("log2").alias("each")), "key").groupBy("row").agg(F.sum(F.col("each") * F.col("times")).alias("more_log2"))
    out = scored.drop("rest", "rare", "rare_n").join(rest, "row", "left").join(rare, "row", "left")
    log2 = F.col("log2") + F.coalesce("more_log2", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("seen") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        (log2 * float(np.log10(2))).alias("score"), (-log2 / F.col("size")).alias("bits_per_byte"),
    )
