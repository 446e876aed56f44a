"""Byte-level BPE encoding and decoding with a local rank file.

``encode`` adds the token ids of each text as packed little-endian unsigned 32-bit integers, the
form in which training shards store them; ``decode`` turns such ids back into raw bytes; ``round_trip``
does both in one pass over the texts. Texts are split by a pattern and each match is merged on its own,
without special tokens.

Long texts are cut at safe boundaries first, in spans of bounded size. For the pattern of the public
rank files (``public_tokenizers.PATTERN``) these are safe:

* before white space that follows something else: no match goes from anything else to white space;
* where no such place is near, any end of a match, as matches look ahead only past white space and
  never back. They are found by the same pattern in the regex package, which needs no stack.

A single match longer than a span (blanks, letters, signs by the million) is merged on its own and
does not go through tiktoken's pattern matching, which runs out of stack on such runs of white space.

Defined results: a null text has the ids of the empty text, none; texts of any length are encoded
whole; each repeated row is encoded; an empty table gives an empty one; columns of other names are
kept, those of the outputs' names are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glotspark.llm.batches import add_columns, map_arrow

#: Characters of a text that are encoded at once.
SPAN = 1 << 16

#: Bytes of text in a slice; ids and decoded bytes come on top.
SLICE = 1 << 20

_SAFE = re.compile(r"(?<=\S)(?=[\t\n\r ])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _matcher(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def spans(text: str, pattern: str, size: int = SPAN) -> Iterator[tuple[str, bool]]:
    """The text cut at safe boundaries, in spans of size to two times size; with True: one match, of any length."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size, at + 2 * size)
        if found:
            yield text[at : found.end()], False
            at = found.end()
            continue
        end = at
        for match in _matcher(pattern).finditer(text, at):
            if match.end() - match.start() > size:
                if match.start() > at:
                    yield text[at : match.start()], False
                yield match[0], True
                at = match.end()
                break
            end = match.end()
            if end - at >= size:
                yield text[at:end], False
                at = end
                break
        else:
            break
    if at < len(text) or not at:
        yield text[at:], False


def encode_text(text: str | None, enc: tiktoken.Encoding, size: int = SPAN) -> np.ndarray:
    if not text:
        return np.zeros(0, "<u4")
    if len(text) <= size:
        return enc.encode_to_numpy(text, disallowed_special=()).astype("<u4")
    parts = [np.array(enc._encode_single_piece(s.encode()), "<u4") if alone else enc.encode_to_numpy(s, disallowed_special=()).astype("<u4") for s, alone in spans(text, enc._pat_str, size)]
    return np.concatenate(parts)


def decode_ids(ids: bytes, enc: tiktoken.Encoding) -> bytes:
    return enc.decode_bytes(np.frombuffer(ids, "<u4").tolist())


def _with(df: DataFrame, without: tuple[str, ...] = (), **new: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in new and f.name not in without] + [T.StructField(n, t) for n, t in new.items()])


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Adds ids (binary, little-endian unsigned 32-bit integers) and their number (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)

        def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
            packed = [encode_text(t.as_py(), enc).tobytes() for t in part.column(text)]
            return {ids: pa.array(packed, pa.binary()), n_tokens: pa.array([len(p) // 4 for p in packed], pa.int64())}

        yield from add_columns(batches, text, make, size=SLICE)

    return map_arrow(df, run, _with(df, **{ids: T.BinaryType(), n_tokens: T.LongType()}))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the raw bytes that the ids stand for (binary); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)

        def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = (r.as_py() for r in part.column(ids))
            return {decoded: pa.array([None if r is None else decode_ids(r, enc) for r in rows], pa.binary())}

        yield from add_columns(batches, ids, make, size=SLICE)

    return map_arrow(df, run, _with(df, **{decoded: T.BinaryType()}))


def round_trip(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens", decoded: str = "decoded", keep_text: bool = True) -> DataFrame:
    """What decode() of encode() gives, in one pass: ids, n_tokens and decoded; without the text on request."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)

        def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
            packed = [encode_text(t.as_py(), enc).tobytes() for t in part.column(text)]
            back = pa.array([decode_ids(p, enc) for p in packed], pa.binary())
            return {ids: pa.array(packed, pa.binary()), n_tokens: pa.array([len(p) // 4 for p in packed], pa.int64()), decoded: back}

        yield from add_columns(batches, text, make, size=SLICE, without=() if keep_text else (text,))

    gone = () if keep_text else (text,)
    return map_arrow(df, run, _with(df, gone, **{ids: T.BinaryType(), n_tokens: T.LongType(), decoded: T.BinaryType()}))
