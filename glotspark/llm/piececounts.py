"""Token counts under a unigram model by dynamic programming over a trie of pre-tokens.

A text is cut into pre-tokens (runs that are no white space, with the sign for a word's begin in
front). The distinct pre-tokens of a batch are inserted in a trie: sorted, two neighbours share
the nodes of their common prefix. The unigram forward score of a node - the best sum of piece
scores over the ways to cut the prefix that it stands for - is computed once, for all pre-tokens
below it; level by level, for all nodes of a level at once. The node where a pre-token ends
stores its token count, and a text's count is the sum over its pre-tokens. A long pre-token goes by
the same scores on its own, stretch by stretch, with the scores that reach into the next stretch
carried over; none is cut.

Pieces and their scores come from a vocabulary file; pieces are kept in its order of use, so
their scores follow Zipf's law: piece r of V has the probability 1/(r H_V). A byte that no piece
covers costs one token of the lowest score minus ten.

No shuffle: each task has its own tries, of bounded size. Defined results: a null or empty text
has no pre-tokens and no tokens; ties between cuts go to fewer tokens; repeated rows are counted
each; texts and pre-tokens of any length are counted whole; an empty table gives an empty one; columns of
other names are kept, those named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glotspark.llm import bytewords as bw
from glotspark.llm.batches import add_columns, map_arrow

#: The sign for a word's begin.
BEGIN = "▁".encode()

#: Bytes of a pre-token that goes into the trie; longer ones are counted one by one.
LONGEST = 256

#: A byte without a piece costs this much more than the rarest piece.
UNKNOWN_COST = 10.0

#: Bytes of text whose pre-tokens share a trie.
PIECE = 4 << 20

#: Bytes of a long pre-token in which pieces are looked up at once.
STRETCH = 1 << 16

_RADIX = np.uint64(0x100000001B3)


@dataclass
class Pieces:
    """Hashes of the pieces of each length, sorted, and their scores; and of their beginnings, -inf for those that are no piece."""

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    unknown: float
    begins: dict[int, tuple[np.ndarray, np.ndarray]]

    @property
    def longest(self) -> int:
        return max(self.by_length, default=1)


def _hashes(raw: bytes) -> list[int]:
    """The hash of each beginning of raw; the last is its own."""
    h, out = 0, []
    for b in raw:
        h = (h * 0x100000001B3 + b + 1) & 0xFFFFFFFFFFFFFFFF
        out.append(h)
    return out


def pieces_of(ranked: list[bytes]) -> Pieces:
    """Pieces in their order of use."""
    harmonic = float(np.sum(1.0 / np.arange(1, len(ranked) + 1)))
    found: dict[int, dict[int, float]] = {}
    begins: dict[int, dict[int, float]] = {}
    for r, piece in enumerate(ranked, 1):
        if piece:
            hashes = _hashes(piece)
            found.setdefault(len(piece), {}).setdefault(hashes[-1], -np.log(r * harmonic))
            for n, h in enumerate(hashes, 1):
                begins.setdefault(n, {}).setdefault(h, -np.inf)
    for n, d in found.items():
        begins[n] |= d
    by, before = ({n: (np.array(sorted(d), np.uint64), np.array([d[k] for k in sorted(d)])) for n, d in x.items()} for x in (found, begins))
    return Pieces(by, -np.log(max(len(ranked), 1) * max(harmonic, 1.0)) - UNKNOWN_COST, before)


def load_pieces(path: str) -> Pieces:
    """The pieces of a sentencepiece file that are text, in the order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return pieces_of([model.id_to_piece(i).encode() for i in ids])


def forward_counts(words: list[bytes], pieces: Pieces) -> tuple[np.ndarray, int]:
    """Token counts of sorted distinct pre-tokens, and the number of trie nodes that it took."""
    n, out, nodes = len(words), np.zeros(len(words), np.int64), 0
    if not n:
        return out, 0
    length = np.fromiter(map(len, words), np.int64, n)
    deep = int(length.max())
    chars = np.zeros((n, deep), np.uint8)
    chars[np.arange(deep) < length[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    differs = chars[1:] != chars[:-1]
    common = np.where(differs.any(1), differs.argmax(1), deep)
    common = np.concatenate([[-1], np.minimum(common, np.minimum(length[1:], length[:-1]))])
    longest = pieces.longest
    #: For each of the last levels: the node of each word, the nodes' scores, counts and hashes of their prefixes.
    node_of = [np.zeros(n, np.int64)]
    score, count, prefix, up = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)]
    radix = np.ones(longest + 1, np.uint64)
    radix[1:] = np.multiply.accumulate(np.full(longest, _RADIX, np.uint64))
    live = np.arange(n)
    for level in range(1, deep + 1):
        live = live[length[live] >= level]
        # sorted words that share a node stand together, so each need only look at the one before
        new = common[live] < level
        first = live[new]
        ids = np.cumsum(new) - 1
        parent = node_of[-1][first]
        here = prefix[-1][parent] * _RADIX + chars[first, level - 1].astype(np.uint64) + np.uint64(1)
        best, tokens = score[-1][parent] + pieces.unknown, count[-1][parent] + 1
        above = parent
        for k in range(1, min(level, longest) + 1):
            if k > 1:
                above = up[-k + 1][above]
            if k in pieces.by_length:
                keys, scores = pieces.by_length[k]
                own = here - prefix[-k][above] * radix[k]
                at = np.searchsorted(keys, own)
                at[at == len(keys)] = 0
                hit = keys[at] == own
                s, c = score[-k][above] + scores[at], count[-k][above] + 1
                better = hit & ((s > best + 1e-12) | ((np.abs(s - best) <= 1e-12) & (c < tokens)))
                best, tokens = np.where(better, s, best), np.where(better, c, tokens)
        mine = np.zeros(n, np.int64)
        mine[live] = ids
        node_of.append(mine)
        score.append(best)
        count.append(tokens)
        prefix.append(here)
        up.append(parent)
        nodes += len(first)
        ends = live[length[live] == level]
        out[ends] = tokens[mine[ends]]
        if len(score) > longest:
            del node_of[0], score[0], count[0], prefix[0], up[0]
    return out, nodes


def _pieces_in(data: np.ndarray, size: int, pieces: Pieces) -> tuple[list[int], list[int], list[float]]:
    """The pieces that begin in the first size bytes: for each byte the number of its first, and one more; ends; scores."""
    alive, own = np.arange(size), np.zeros(size, np.uint64)
    begin, end, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for k in range(1, (pieces.longest if pieces.begins else 0) + 1):
        inside = alive + k <= len(data)
        alive, own = alive[inside], own[inside]
        if not len(alive):
            break
        own = own * _RADIX + data[alive + k - 1].astype(np.uint64) + np.uint64(1)
        keys, scores = pieces.begins[k]
        at = np.searchsorted(keys, own)
        at[at == len(keys)] = 0
        hit = keys[at] == own
        alive, own, value = alive[hit], own[hit], scores[at[hit]]
        whole = value > -np.inf
        begin.append(alive[whole]), end.append(alive[whole] + k), score.append(value[whole])
    first = np.concatenate(begin)
    order = np.argsort(first, kind="stable")
    return np.searchsorted(first[order], np.arange(size + 1)).tolist(), np.concatenate(end)[order].tolist(), np.concatenate(score)[order].tolist()


def long_count(word: bytes, pieces: Pieces, stretch: int = STRETCH) -> int:
    """The token count of one pre-token of any length."""
    best, count, unknown = [0.0], [0], pieces.unknown
    for a in range(0, len(word), stretch):
        size = min(stretch, len(word) - a)
        first, end, value = _pieces_in(np.frombuffer(word[a : a + size + pieces.longest - 1], np.uint8), size, pieces)
        best += [-np.inf] * (size + pieces.longest + 1 - len(best))
        count += [0] * (len(best) - len(count))
        for i in range(size):
            s, c = best[i], count[i] + 1
            for j in range(first[i], first[i + 1]):
                e, v = end[j], s + value[j]
                if v > best[e] + 1e-12 or v >= best[e] - 1e-12 and c < count[e]:
                    best[e], count[e] = v, c
            v = s + unknown
            if v > best[i + 1] + 1e-12 or v >= best[i + 1] - 1e-12 and c < count[i + 1]:
                best[i + 1], count[i + 1] = v, c
        best, count = [x - best[size] for x in best[size:]], count[size:]
    return count[0]


def piece_counts(p: bw.Piece, pieces: Pieces) -> np.ndarray:
    """The token count of each pre-token of a piece of texts; distinct ones are told by a 64-bit hash and the length."""
    length = (p.end - p.start).astype(np.uint64)
    _, first, inverse = np.unique(p.hashes() ^ bw.mix(length), return_index=True, return_inverse=True)
    raw = p.data.tobytes()
    words = [BEGIN + raw[a:b] for a, b in zip(p.start[first].tolist(), p.end[first].tolist(), strict=True)]
    short = sorted({x for x in words if len(x) <= LONGEST})
    counts = dict(zip(short, forward_counts(short, pieces)[0].tolist(), strict=True))
    counts |= {x: long_count(x, pieces) for x in words if len(x) > LONGEST}
    return np.fromiter((counts[x] for x in words), np.int64, len(words))[inverse]


def token_counts(df: DataFrame, pieces: Pieces, text: str = "text", n_tokens: str = "n_tokens", n_words: str = "n_words") -> DataFrame:
    """df with the number of tokens and of white-space words of each text (long)."""
    bound = df.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
            total, number = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64)
            for p in bw.pieces(bw.arrow_texts(part.column(text)), bw.NOT_SPACE, lower=False, size=PIECE):
                total[p.first : p.first + len(p)] = np.bincount(p.owner(), piece_counts(p, bound.value), minlength=len(p)).astype(np.int64)
                number[p.first : p.first + len(p)] = np.diff(p.word_at)
            return {n_tokens: pa.array(total), n_words: pa.array(number)}

        yield from add_columns(batches, text, make)

    kept = [f for f in df.schema.fields if f.name not in (n_tokens, n_words)]
    return df.transform(map_arrow, run, T.StructType([*kept, T.StructField(n_tokens, T.LongType()), T.StructField(n_words, T.LongType())]))
