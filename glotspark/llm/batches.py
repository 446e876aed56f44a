"""Arrow batches of bounded size, for mapInArrow."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.llm.bytewords import arrow_texts, raw

#: Bytes of text in a batch that a worker handles at once.
BATCH_BYTES = 4 << 20

_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def bound_batches(spark: SparkSession) -> None:
    """Batches that go to Python workers have about BATCH_BYTES. A session that has set its own size keeps it.

    Spark's default, 64 MB for each task, stands several times in an executor: in the JVM's own
    buffers, in the worker's, and in what the worker makes of it.
    """
    if spark.conf.get(_BATCH_CONF, None) in (f"{_BATCH_DEFAULT}b", str(_BATCH_DEFAULT), "64MB", "64m"):
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def _give_back() -> None:
    """What Arrow and the allocator hold unused goes back to the system; idle workers stay beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_arrow(df: DataFrame, run: Run, schema) -> DataFrame:
    """mapInArrow over batches of bounded size, by workers that give back memory when a task ends."""
    bound_batches(df.sparkSession)
    names = df.columns
    odd = any("." in c or "`" in c for c in names)  # mapInArrow does not find such columns

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run((b.rename_columns(names) for b in batches) if odd else batches)
        finally:
            _give_back()

    return (df.toDF(*[f"c{i}" for i in range(len(names))]) if odd else df).mapInArrow(freed, schema)


def text_slices(batch: pa.RecordBatch, column: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about size bytes; at least one row each."""
    from glotspark.llm.bytewords import cut

    _, at = raw(arrow_texts(batch.column(column)))
    for i, j in cut(at, size):
        yield batch.slice(i, j - i)


def add_columns(
    batches: Iterator[pa.RecordBatch], column: str, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], size: int = BATCH_BYTES, without: tuple[str, ...] = ()
) -> Iterator[pa.RecordBatch]:
    """Each slice with the columns that make() gives for it put behind or over its own; some of its own left out."""
    for batch in batches:
        for part in text_slices(batch, column, size):
            new = make(part)
            kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in new and n not in without]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + list(new.values()), names=[n for n, _ in kept] + list(new))


def numbered(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """Some columns of df under names that no operator uses, and those names: whatever a caller's columns are called, nothing clashes."""
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    return df.select(*[quoted(c).alias(n) for c, n in names.items()]), names


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


class Runs:
    """Rows sorted by a key, cut into runs of equal keys across batch borders.

    ``take(batch)`` gives the columns of all runs known to be complete, and keeps the last run,
    which may go on; ``rest()`` gives what is left. Runs are assumed to fit in memory.
    """

    def __init__(self, key: list[str]):
        self.key, self.held = key, []

    def take(self, batch: pa.RecordBatch) -> pa.Table | None:
        if not batch.num_rows:
            return None
        table = pa.Table.from_batches([*self.held, batch])
        columns = [table.column(k).to_numpy() for k in self.key]
        last = np.ones(len(table), bool)
        for c in columns:
            last &= c == c[-1]
        begin = len(table) - int(np.argmin(last[::-1])) if not last.all() else 0
        self.held = table.slice(begin).to_batches()
        return table.slice(0, begin) if begin else None

    def rest(self) -> pa.Table | None:
        return pa.Table.from_batches(self.held) if self.held else None
