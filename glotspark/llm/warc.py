"""WARC archives written from and read back into a chunked record table.

A record is one or more chunk rows (record_id, chunk_no). A payload beyond ``chunk`` bytes is
written as WARC segments: the record itself with WARC-Segment-Number 1, then `continuation`
records that name their origin. No row written or read holds more than a chunk, and each carries
the digest of the payload so far, so that a reader can resume and verify at any chunk. The writer
streams: it looks at a payload through its Arrow buffer, copies a chunk at a time, and takes the
whole payload's digest and length from the expressions that Spark has computed already.

Files go through Spark's own text writer and reader, so any store that Spark knows will do. The
record separator of the format is the line separator of the writer; the reader splits files at
the separator followed by the version line. The writer cuts a block inside any such sequence that
the block itself holds, so the reader finds exactly the records written.

Equal payloads of at least ``least`` bytes are stored once: the record with the smallest page_id
is the response, the others revisit it; on reading, each revisit must find a response of that page
with its digest and length.

Defined results: a null payload is empty; a null page_id stays null and is the response only
where its payload has no other page_id; repeated rows are records of their own, of the same type;
payloads of any length are written whole; an empty table gives an empty one; only the id, the
address and the payload are read, so columns of other names do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.llm.batches import map_arrow, text_slices
from glotspark.llm.store import Stash

#: Bytes of a block in one chunk.
CHUNK = 1 << 20

#: Bytes from which equal payloads are stored once.
LEAST = 100

VERSION = "WARC/1.1"
END = "\r\n\r\n"
BETWEEN = f"{END}{VERSION}\r\n"

RECORDS = (
    "record_id string, chunk_no int, n_chunks int, page_id long, url string, record_type string, refers_to long,"
    " payload_bytes long, payload_digest string, digest_so_far string, payload binary"
)
_ARROW = pa.schema(
    [("record_id", pa.string()), ("chunk_no", pa.int32()), ("n_chunks", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_so_far", pa.string()), ("payload", pa.binary())]
)


class Block:
    """An HTTP head and the payload behind it, of which pieces are copied on demand."""

    def __init__(self, head: bytes, payload: memoryview):
        self.head, self.payload = head, payload

    def __len__(self) -> int:
        return len(self.head) + len(self.payload)

    def __getitem__(self, part: slice) -> bytes:
        n = len(self.head)
        return self.head[part.start : part.stop] + self.payload[max(part.start - n, 0) : max(part.stop - n, 0)].tobytes()


def cuts(block: Block | bytes, chunk: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of the block of at most chunk bytes, in none of which the reader sees its separator.

    That may stand inside the range, or begin at its end and go on in the separator written
    behind it; either way the range ends within the first line break pair's next letter.
    """
    between, tail, at = BETWEEN.encode(), f"{END}{VERSION}".encode(), 0
    while True:
        end = min(at + chunk, len(block))
        piece = block[at:end]
        found = piece.find(between)
        if found < 0 and piece.endswith(tail):
            found = len(piece) - len(tail)
        if found >= 0:
            end = at + found + len(END) + 1
        yield at, end
        if end >= len(block):
            return
        at = end


def _header(fields: dict[str, object]) -> bytes:
    """Line breaks in a value become %0D and %0A."""
    value = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    return f"{VERSION}\r\n{''.join(f'{k}: {value(v)}\r\n' for k, v in fields.items() if v is not None)}\r\n".encode()


def records(page_id: int | None, url: str | None, payload: memoryview, digest: str, refers_to: int | None, refers_url: str | None, serial: str, date: str, chunk: int = CHUNK) -> Iterator[bytes]:
    """The WARC records of one page, each without the separator behind it; one chunk of the payload is held at a time."""
    name = f"<urn:uuid:{hashlib.md5(serial.encode()).hexdigest()}>"
    about = {"WARC-Date": date, "WARC-Target-URI": url, "X-Page-ID": page_id, "X-Payload-Length": len(payload), "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is not None:
        about |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Target-URI": refers_url, "X-Refers-To-Page-ID": refers_to}
        yield _header({"WARC-Type": "revisit", "WARC-Record-ID": name} | about | {"Content-Length": 0})
        return
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block, so_far = Block(http, payload), hashlib.sha256()
    chunk = max(chunk, len(http))
    segments = sum(1 for _ in cuts(block, chunk))
    for k, (a, b) in enumerate(cuts(block, chunk)):
        piece = block[a:b]
        so_far.update(memoryview(piece)[max(len(http) - a, 0) :])
        own = {"WARC-Type": "continuation" if k else "response", "WARC-Record-ID": name if not k else f"<urn:uuid:{hashlib.md5(f'{serial}/{k}'.encode()).hexdigest()}>"}
        if segments > 1:
            own |= {"WARC-Segment-Number": k + 1, "X-Segments": segments}
            if k:
                own["WARC-Segment-Origin-ID"] = name
            if k == segments - 1:
                own["WARC-Segment-Total-Length"] = len(block)
        yield _header(own | about | {"Content-Type": "application/http;msgtype=response", "X-Digest-So-Far": so_far.hexdigest(), "Content-Length": b - a}) + piece


def parse(record: bytes) -> tuple:
    """A chunk row (see RECORDS) of what the reader found between two separators."""
    head, _, block = record.partition(END.encode())
    if head.startswith(f"{VERSION}\r\n".encode()):
        head = head[len(VERSION) + 2 :]
    get = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n"))}
    length = int(get["content-length"])
    if block[length:].strip(b"\r\n") or len(block) < length:
        raise ValueError(f"the block of {get.get('warc-record-id')} has not the length that its header says")
    block, number = block[:length], int(get.get("warc-segment-number", 1))
    if number == 1 and get["warc-type"] == "response":
        block = block[block.index(END.encode()) + len(END) :]
    whole = lambda name: int(get[name]) if name in get else None
    return (
        get.get("warc-segment-origin-id", get["warc-record-id"]), number, int(get.get("x-segments", 1)), whole("x-page-id"), get.get("warc-target-uri"), get["warc-type"],
        whole("x-refers-to-page-id"), int(get["x-payload-length"]), re.sub("^sha256:", "", get["warc-payload-digest"]), get.get("x-digest-so-far"), block,
    )


def repeated(pages: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Digests of payloads that occur more than once, with the page that stands for each."""
    slim = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    first = slim.where(F.col("n") >= least).groupBy("digest").agg(F.count("*").alias("n"), F.min("page").alias("first_page"), F.min_by("url", "page").alias("first_url"))
    return first.where("n > 1 and first_page is not null").drop("n")


def write(pages: DataFrame, path: str, known: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK, date: datetime | None = None) -> None:
    """Writes a record per row of pages; known: what repeated() gave for them, as a table; date: of the records, else now.

    Both sides of the join are keyed by a value computed from the digest, so neither counts as
    already dealt out by it, and a hot digest can be split between tasks.
    """
    when = (date or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(page).alias("page"), F.col(url).alias("url"), body.alias("payload"), F.sha2(body, 256).alias("own"))
    rows = rows.join(known, F.concat(F.lit("k"), rows.own) == F.concat(F.lit("k"), known.digest), "left")
    revisit = F.col("first_page").isNotNull() & ~F.col("page").eqNullSafe(F.col("first_page"))
    rows = rows.select("page", "url", F.when(revisit, F.col("first_page")).alias("to"), F.when(revisit, F.col("first_url")).alias("to_url"), "payload", "own", F.monotonically_increasing_id().alias("serial"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "payload"):
                held, size = [], 0
                about = zip(*(part.column(c).to_pylist() for c in ("page", "url", "to", "to_url", "own", "serial")), strict=True)
                for body, (p, u, to, to_url, own, serial) in zip(part.column("payload"), about, strict=True):
                    for record in records(p, u, memoryview(body.as_buffer()), own, to, to_url, f"{p}/{serial}", when, chunk):
                        held.append(record)
                        size += len(record)
                        if size >= 2 * CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                            held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    rows.transform(map_arrow, run, "record binary").select(F.col("record").cast("string")).write.mode("overwrite").option("lineSep", END).text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table of the archives at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "record"):
                rows = [parse(r.as_py()) for r in part.column("record")]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    lines = spark.read.option("lineSep", BETWEEN).text(path)
    return lines.where("length(value) > 0").select(F.col("value").cast("binary").alias("record")).transform(map_arrow, run, RECORDS)


def verified(chunks: DataFrame, stash: Stash) -> DataFrame:
    """One row per record, its payload's length and digest recomputed from what was read.

    The archives are read once: what is known of a record of one chunk is kept, and the chunks of
    longer ones. Those are dealt out by record, sorted by number and streamed through one running
    digest; no record is put together. Each revisit is held against the response that it names.
    """
    plain = ["record_id", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]
    revisit, alone = F.col("record_type") == "revisit", F.col("n_chunks") == 1
    size = F.when(revisit, F.col("payload_bytes")).when(alone, F.octet_length("payload").cast("long"))
    digest = F.when(revisit, F.col("payload_digest")).when(alone, F.sha2("payload", 256))
    found = stash.keep(chunks.select(*plain, "chunk_no", "n_chunks", "digest_so_far", size.alias("read_bytes"), digest.alias("read_digest"), F.when(~alone, F.col("payload")).alias("payload")), "chunks")
    fields = [f for f in _ARROW if f.name in plain] + [pa.field("read_bytes", pa.int64()), pa.field("read_digest", pa.string())]
    single = found.where(alone).select(*[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, so_far, n, seen = None, None, 0, 0
        for batch in batches:
            for at in range(batch.num_rows):
                payload = memoryview(batch.column("payload")[at].as_buffer())
                row = batch.slice(at, 1).drop_columns(["payload"]).to_pylist()[0]
                if row["record_id"] != name:
                    name, so_far, n, seen = row["record_id"], hashlib.sha256(), 0, 0
                so_far.update(payload)
                n, seen = n + len(payload), seen + 1
                if row["chunk_no"] != seen or so_far.hexdigest() != row["digest_so_far"]:
                    raise ValueError(f"chunk {row['chunk_no']} of {name} is not what was written")
                if seen == row["n_chunks"]:
                    yield pa.RecordBatch.from_pylist([row | {"record_type": "response", "read_bytes": n, "read_digest": so_far.hexdigest()}], schema=pa.schema(fields))

    longer = found.where(~alone).repartition("record_id").sortWithinPartitions("record_id", "chunk_no").transform(map_arrow, run, single.schema)
    bad = F.raise_error(F.concat(F.lit("record "), F.col("record_id"), F.lit(" was not read as written")))
    right = (F.col("read_digest") == F.col("payload_digest")) & (F.col("read_bytes") == F.col("payload_bytes"))
    done = single.unionByName(longer).withColumn("payload_digest", F.when(right, F.col("read_digest")).otherwise(bad.cast("string")))
    done = stash.keep(done.drop("read_bytes", "read_digest"), "records")
    named = done.where(revisit).select(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest").distinct()
    if lost := named.join(done.where(~revisit), ["page_id", "payload_bytes", "payload_digest"], "left_anti").limit(3).collect():
        raise ValueError(f"revisits of pages {[r.page_id for r in lost]} find no response with their payload")
    return done
