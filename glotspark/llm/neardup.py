"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosines and components.

Vectors that are equal in label and all numbers form a class and are handled once. Each class is
put into one bucket of each of several tables by the signs of its products with random planes. What
goes to the buckets are signs alone, a bit for each plane of all tables. A bucket of more than
``block`` classes is dealt out as pairs of blocks, so that no task holds more than two blocks at once.

In a bucket the classes are compared by their signs first: those that differ in so few as vectors
beyond the threshold do (all but one pair in 10^12) are close, and only classes with a close one go
on, with their vectors. Then every cosine among them is computed in double precision. A pair that two
tables bring together counts in the first only, which the signs tell. A unit sends out the sum of
links of each member and a spanning forest of the links, never the pairs.

The number of planes grows with the logarithm of the table, and the number of tables is what finds
a pair at the threshold with probability 1 - ``miss``.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, or has
a null label or id, links with nothing; vectors of different lengths never link; vectors of any length
are taken whole; each repeated row is a vector of its own, and rows that share a vec_id share its
component; a cosine of exactly the threshold links; an empty table gives an empty one; columns of
other names are kept, those named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, exp, lgamma, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.llm.batches import Runs, map_arrow, numbered
from glotspark.llm.components import components
from glotspark.llm.store import Stash

#: Cosine from which two vectors are linked.
THRESHOLD = 0.98

#: Probability that a pair at the threshold is in no common bucket.
MISS = 1e-4

#: Classes in a block.
BLOCK = 512

#: Probability that a pair at the threshold differs in more signs than close pairs may.
UNLIKE = 1e-12

_EDGES = "rep long, links long, other long"
_EDGE_SCHEMA = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def shape(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Planes in a table and number of tables, for n vectors."""
    planes = min(30, max(12, ceil(log2(max(n, 1) / 64))))
    together = (1 - acos(threshold) / pi) ** planes
    return planes, ceil(log(miss) / log(1 - together))


def most_unlike(bits: int, threshold: float = THRESHOLD, unlike: float = UNLIKE) -> int:
    """How many of the signs of a pair at the threshold differ at most, but for a chance of ``unlike``."""
    p, left = acos(threshold) / pi, 1.0
    for k in range(bits):
        left -= exp(lgamma(bits + 1) - lgamma(k + 1) - lgamma(bits - k + 1) + k * log(p) + (bits - k) * log(1 - p))
        if left < unlike:
            return k
    return bits


def signs_of(x: np.ndarray, planes: int, tables: int, seed: int = 11) -> np.ndarray:
    """The signs of each row's products with the planes of all tables."""
    normal = np.random.Generator(np.random.PCG64([seed, x.shape[1]])).standard_normal((x.shape[1], planes * tables))
    return x @ normal > 0


def bucket_numbers(signs: np.ndarray, planes: int) -> np.ndarray:
    """For each row the number of its bucket in each table."""
    return (signs.reshape(len(signs), -1, planes) << np.arange(planes)).sum(2).astype(np.int32)


def first_met(numbers: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray | int) -> np.ndarray:
    """Which of the pairs (i, j) share no bucket of a table before t; numbers: each row's buckets."""
    earlier = np.arange(numbers.shape[1])[None, :] < np.reshape(t, (-1, 1))
    return ~((numbers[i] == numbers[j]) & earlier).any(1)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each member of a symmetric link matrix the first member that its links reach."""
    g = len(linked)
    root = np.arange(g)
    own = linked | np.eye(g, dtype=bool)
    while True:
        new = np.where(own, root[None, :], g).min(1)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _close(signs: np.ndarray, numbers: np.ndarray, begin: np.ndarray, size: np.ndarray, t: np.ndarray, alone: np.ndarray, side: np.ndarray, most: int) -> np.ndarray:
    """Rows of units (each size rows from begin) that some other of the unit, met here first, is close to by signs.

    Units of one size are handled together.
    """
    own, out = np.where(signs, np.float32(1), np.float32(-1)), []
    for m in np.unique(size[size > 1]).tolist():
        first = begin[size == m]
        for at in range(0, len(first), max(1, (1 << 21) // (m * m))):
            rows = first[at : at + max(1, (1 << 21) // (m * m)), None] + np.arange(m)
            x = own[rows]
            near = (signs.shape[1] - x @ x.transpose(0, 2, 1)) / 2 <= most
            near &= ~np.eye(m, dtype=bool)
            near &= alone[rows[:, 0]][:, None, None] | (side[rows][:, :, None] != side[rows][:, None, :])
            unit, i, j = np.nonzero(near)
            i, j = rows[unit, i], rows[unit, j]
            out.append(i[first_met(numbers, i, j, t[i])])
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


def _unit(x: np.ndarray, n: np.ndarray, reps: np.ndarray, numbers: np.ndarray, t: int, side: np.ndarray | None, threshold: float) -> list[np.ndarray]:
    """Links within one unit: of all members, or (side) only between its two blocks."""
    length = np.sqrt((x * x).sum(1))
    linked = (x @ x.T) / (length[:, None] * length[None, :]) >= threshold
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    if t and linked.any():
        i, j = np.nonzero(linked)
        linked[i, j] = first_met(numbers, i, j, t)
    some = linked.any(1)
    if not some.any():
        return []
    root = forest(linked)
    return [reps[some], (linked @ n)[some], reps[root[some]]]


def _unpacked(column: pa.ChunkedArray, bits: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.unpackbits(packed.reshape(-1, -(-bits // 8)), axis=1, count=bits).astype(bool)


def _units(batches: Iterator[pa.RecordBatch], size: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole units, sorted by unit, with where each unit begins and its size."""
    runs = Runs(["unit"])

    def ranges(table: pa.Table | None) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
        if table is not None and len(table):
            begin = np.concatenate([[0], np.flatnonzero(np.diff(table.column("unit").to_numpy())) + 1])
            yield table, begin, np.diff(np.concatenate([begin, [len(table)]]))

    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from ranges(runs.take(batch.slice(at, size)))
    yield from ranges(runs.rest())


def link_vectors(df: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """df with n_links, component_id (long) and kept (boolean)."""
    spark = df.sparkSession
    stash = Stash(spark, "neardup")
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = F.coalesce(F.col(label).isNotNull() & F.col(vec).isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda x: x != 0), F.lit(False))
    valid = df.where(good).select(F.col(vec).cast("long").alias("vec"), F.col(label).alias("label"), e.alias("x"))
    classes = stash.keep(valid.groupBy("label", "x").agg(F.min("vec").alias("rep"), F.count("*").alias("n")).withColumn("class", F.xxhash64("label", "x")), "classes")
    planes, tables = shape(classes.count(), threshold, miss)
    bits, most = planes * tables, most_unlike(planes * tables, threshold)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                lists = batch.column("x")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                begin = np.concatenate([[0], np.cumsum(sizes)])
                for dim in np.unique(sizes):
                    own = np.flatnonzero(sizes == dim)
                    x = flat[(begin[own][:, None] + np.arange(dim)).ravel()].reshape(len(own), dim)
                    signs = signs_of(x.astype(np.float64), planes, tables)
                    numbers, packed = bucket_numbers(signs, planes), pa.array([r.tobytes() for r in np.packbits(signs, axis=1)], pa.binary())
                    part = batch.take(pa.array(own))
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays(
                            [part.column("label"), pa.array(np.full(len(own), dim, np.int32)), pa.array(np.full(len(own), t, np.int32)), pa.array(numbers[:, t]), part.column("rep"), part.column("class"), packed],
                            names=["label", "dim", "t", "number", "rep", "class", "signs"],
                        )

    kind = classes.schema["label"].dataType.simpleString()
    rows = classes.select("label", "x", "rep", "class").transform(map_arrow, signed, f"label {kind}, dim int, t int, number int, rep long, class long, signs binary")
    rows = stash.keep(rows.select(F.xxhash64("label", "dim", "t", "number").alias("bucket"), "t", "rep", "class", "signs"), "signs")
    large = rows.groupBy("bucket").agg(F.count("*").alias("size")).where(F.col("size") > block)
    large = stash.keep(large.select("bucket", F.ceil(F.col("size") / block).cast("int").alias("blocks")), "large")
    rows = rows.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    units = rows.select(F.xxhash64("bucket", low, high).alias("unit"), "t", (low == high).alias("alone"), (F.col("mine") == low).alias("side"), "rep", "class", "signs")
    kind_of_close = "unit long, t int, alone boolean, side boolean, rep long, class long, signs binary"

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin, size in _units(batches):
            if (size > 1).any():
                signs = _unpacked(table.column("signs"), bits)
                t, alone, side = table.column("t").to_numpy(), table.column("alone").to_numpy().astype(bool), table.column("side").to_numpy().astype(bool)
                found = _close(signs, bucket_numbers(signs, planes), begin, size, t, alone, side, most)
                yield from table.take(pa.array(found)).select([c.split()[0] for c in kind_of_close.split(", ")]).to_batches()

    near = units.repartition("unit").sortWithinPartitions("unit").transform(map_arrow, close, kind_of_close)
    near = stash.keep(near, "near")
    own = classes.select(F.col("class").alias("_class"), F.col("rep").alias("_rep"), "label", "n", "x")
    met = near.join(own, (F.col("class") == F.col("_class")) & (F.col("rep") == F.col("_rep")))
    met = met.select("unit", "t", "alone", "side", "rep", "signs", "label", "n", "x")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin, size in _units(batches, 1024):
            out = []
            label, alone, side = table.column("label").to_pylist(), table.column("alone").to_numpy().astype(bool), table.column("side").to_numpy().astype(bool)
            t, n, rep, vectors = table.column("t").to_numpy(), table.column("n").to_numpy(), table.column("rep").to_numpy(), table.column("x").combine_chunks()
            numbers, dims = bucket_numbers(_unpacked(table.column("signs"), bits), planes), pa.compute.list_value_length(vectors).to_numpy()
            for a, m in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                # rows that only share a hash of their bucket are told apart here
                groups: dict[tuple, list[int]] = {}
                for i in range(a, a + m):
                    groups.setdefault((label[i], dims[i], int(t[i]), bool(alone[i])), []).append(i)
                for (_, dim, table_number, single), own in groups.items():
                    if len(own) > 1:
                        x = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), dim)
                        out.append(_unit(x, n[own], rep[own], numbers[own], table_number, None if single else side[own], threshold))
            out = [o for o in out if o]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_EDGE_SCHEMA)

    found = stash.keep(met.repartition("unit").sortWithinPartitions("unit").transform(map_arrow, linked, _EDGES), "links")
    sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
    where = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), stash).select(F.col("node").alias("rep"), "component")
    known = classes.join(sums, "rep", "left").join(where, "rep", "left")
    known = known.select(F.xxhash64("label", "x").alias("_h"), F.col("label").alias("_label"), F.col("x").alias("_x"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("_links"), F.coalesce("component", "rep").alias("_component"))
    known = stash.keep(known, "known")
    stash.drop("signs", "large", "near", "classes")
    rest, name_of = numbered(df.withColumn("_own_class", F.when(good, F.xxhash64(label, embedding))), [*[c for c in df.columns if c not in ("n_links", "component_id", "kept") or c in (vec, embedding, label)], "_own_class"])
    at = {c: F.col(n) for c, n in name_of.items()}
    out = rest.join(known, (at["_own_class"] == F.col("_h")) & (at[label] == F.col("_label")) & (at[embedding] == F.col("_x")), "left")
    component = F.coalesce("_component", at[vec].cast("long"))
    kept = [n.alias(c) for c, n in at.items() if c not in ("n_links", "component_id", "kept", "_own_class")]
    return out.select(*kept, F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (at[vec] == component).alias("kept"))
