"""Licence scans by conditional compression.

A candidate block reaches from each sign of a licence (a word or two of the licence vocabulary) as
many words before and behind as the longest template has, across line ends, blank lines and comment
marks; blocks that meet are one, and are cut into overlapping parts of bounded size. Around each
sign the stretch that a template with this sign would fill is compressed on its own and once with the
template as a zstandard raw dictionary; the templates are ranked by the size that they save. Winners, in that
order, are confirmed by the exact differences in wording: all of the template's words must stand in
the block in their order, but for at most a share ``slack`` of them, and none of those may be a
number, a version or a name in capitals. Words of the template that a winner has matched are
taken out, with word-for-word repeats of them, and the rest of the block is looked at again, so that a
block can hold several notices.

Defined results: null and empty texts have no blocks; texts of any length are scanned whole, part by
part; of several templates the one with most words matched, less its differences, is taken, then the
longer, then the one that saves more, then the first in the list; repeated rows and repeated notices are
scanned alike; an empty table gives an empty one; columns of other names are kept, those named like the
outputs are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import accumulate, pairwise

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from glotspark.llm.batches import add_columns, map_arrow
from glotspark.llm.license_templates import TEMPLATES

#: Size that a template must save, as a share of what the template's own compression takes.
LEAST_SAVED = 0.3

#: Share of a template's words that may be missing or different.
SLACK = 0.1

#: Words in a part of a block; parts overlap by what the longest template needs.
PART_WORDS = 400

_SIGN = re.compile(r"licen|copyright|spdx|permission|redistribut|public[\W_]+domain|rights[\W_]+reserved|free[\W_]+software", re.I)
#: One of these stands in every text with a sign.
_HINTS = ("licen", "copyright", "spdx", "permission", "redistribut", "domain", "reserved", "software")
#: Comment marks that are letters; others are no words anyway.
_MARK = re.compile(r"^[ \t]*(?:rem|dnl)\b", re.I | re.M)
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*|\S")
_STRICT = re.compile(r"\d|^[A-Z]{2,}")


def words(text: str) -> list[str]:
    return [w for w in _WORD.findall(text) if w[0].isalnum()]


@lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[tuple[str, list[str], zstandard.ZstdCompressor, int]]]:
    plain, out = zstandard.ZstdCompressor(level=3), []
    for name, text in TEMPLATES:
        raw = " ".join(words(text)).lower().encode()
        dictionary = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((name, words(text), zstandard.ZstdCompressor(level=3, dict_data=dictionary), len(plain.compress(raw))))
    return plain, out


def reach() -> int:
    """Words to each side of a sign that belong to its block: those of the longest template, with what may stand between."""
    return int(max(len(t) for _, t, _, _ in _compressors()[1]) * (1 + SLACK)) + 1


def signs(text: str, at: list[int]) -> list[tuple[int, str]]:
    """The words of a text, given where each begins, in which a sign begins, and the sign's first letters."""
    return sorted({(max(bisect_right(at, m.start()) - 1, 0), m[0][:5].lower()) for m in _SIGN.finditer(text)})


def _signs_of(block: list[str]) -> list[tuple[int, str]]:
    return signs(" ".join(block), list(accumulate((len(w) + 1 for w in block), initial=0))[:-1])


@lru_cache(maxsize=1)
def _template_signs() -> list[list[tuple[int, str]]]:
    return [_signs_of(template) for _, template, _, _ in _compressors()[1]]


def rank(block: list[str]) -> list[tuple[int, int]]:
    """Templates that save enough of the compressed size around a sign: (bytes saved, template), best first."""
    plain, known = _compressors()
    here, alone, most = _signs_of(block), {}, [0] * len(known)
    for i, (_, template, c, _) in enumerate(known):
        # where the template would stand if one of its signs is this one
        begins = {p - o for p, sign in here for o, own in _template_signs()[i] if sign == own}
        for first, last in {(max(0, b), b + len(template)) for b in begins}:
            raw = " ".join(block[first:last]).lower().encode()
            if (first, last) not in alone:
                alone[first, last] = len(plain.compress(raw))
            most[i] = max(most[i], alone[first, last] - len(c.compress(raw)))
    return sorted(((s, i) for i, s in enumerate(most) if s >= LEAST_SAVED * known[i][3]), key=lambda x: (-x[0], x[1]))


def _worth(runs: list, gap: Callable) -> list:
    """As many of the runs, going away from the longest one, as match more words than they leave between."""
    gain = list(accumulate((m.size - gap(before, m) for before, m in pairwise(runs)), initial=0))
    return runs[1 : gain.index(max(gain)) + 1]


def differences(template: list[str], block: list[str]) -> tuple[list[str], list[int]]:
    """Words of the template that the block lacks, and the places in the block that match.

    What stands in the block between matched words counts as a difference too, marked with +.
    """
    low = [w.lower() for w in block]
    match = SequenceMatcher(None, [w.lower() for w in template], low, autojunk=False)
    runs = [m for m in match.get_matching_blocks() if m.size]
    if not runs:
        return list(template), []
    # the stretch around the longest run, as far to both sides as differences are fewest
    main = max(runs, key=lambda m: m.size)
    place = runs.index(main)
    before = _worth(runs[place::-1], lambda late, early: late.b - early.b - early.size)
    near = [*before[::-1], main, *_worth(runs[place:], lambda early, late: late.b - early.b - early.size)]
    covered = {i for m in near for i in range(m.a, m.a + m.size)}
    places = [j for m in near for j in range(m.b, m.b + m.size)]
    missing = [w for i, w in enumerate(template) if i not in covered]
    between = sorted(set(range(places[0], places[-1] + 1)) - set(places))
    return missing + [f"+{block[j]}" for j in between], places


def _repeats(block: list[str], places: list[int]) -> set[int]:
    """Where the words at some places, if they stand together, stand in the block again: the same notice, over and over."""
    first, last = places[0], places[-1] + 1
    if last - first != len(places):
        return set()
    low = [w.lower() for w in block]
    said, out, at = low[first:last], set(), 0
    while at <= len(low) - len(said):
        if low[at] == said[0] and low[at : at + len(said)] == said:
            out.update(range(at, at + len(said)))
            at += len(said)
        else:
            at += 1
    return out


def _confirmed(block: list[str]) -> Iterator[tuple[str, list[str]]]:
    _, known = _compressors()
    left = list(block)
    while left:
        best = None
        ranked = rank(left)
        for saved, i in ranked:
            name, template, _, _ = known[i]
            lacks, places = differences(template, left)
            strict = any(_STRICT.search(w) for w in lacks if not w.startswith("+"))
            if places and not strict and len(lacks) <= SLACK * len(template):
                key = (len(lacks) - len(places), -len(template), -saved, i)
                if best is None or key < best[0]:
                    best = (key, name, lacks, places)
        if best is None:
            return
        yield best[1], best[2]
        gone = set(best[3]) | _repeats(left, best[3])
        left = [w for j, w in enumerate(left) if j not in gone]


#: Characters of a block whose result a worker keeps, with 4096 of them at most.
KEPT_BLOCK = 1 << 12


def scan_block(block: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """The notices confirmed in a block, with their differences in wording."""
    return _scan_again(block) if len(block) <= KEPT_BLOCK else _scan_block(block)


def _scan_block(block: str) -> tuple[tuple[str, tuple[str, ...]], ...]:
    found, all_words, step = {}, words(block), PART_WORDS
    for at in range(0, max(1, len(all_words)), step):
        for name, lacks in _confirmed(all_words[at : at + step + reach()]):
            if name not in found or len(lacks) < len(found[name]):
                found[name] = tuple(lacks)
    return tuple(sorted(found.items()))


_scan_again = lru_cache(maxsize=4096)(_scan_block)


def blocks(text: str) -> list[str]:
    """The candidate blocks of a text, as words with one space between."""
    low = text.lower()
    if not any(s in low for s in _HINTS) or not _SIGN.search(text):
        return []
    text = _MARK.sub("", text)
    found = [m for m in _WORD.finditer(text) if m[0][0].isalnum()]
    out: list[list[int]] = []
    for p, _ in signs(text, [m.start() for m in found]):
        first, last = max(0, p - reach()), min(len(found), p + reach() + 1)
        if out and first <= out[-1][1]:
            out[-1][1] = last
        else:
            out.append([first, last])
    return [" ".join(m[0] for m in found[i:j]) for i, j in out]


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_blocks (candidates), n_confirmed, licenses and differences (arrays, by licence)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
            rows = []
            for t in part.column(text).to_pylist():
                found: dict[str, tuple[str, ...]] = {}
                own = blocks(t) if t else []
                hits = 0
                for block in own:
                    notices = scan_block(block)
                    hits += bool(notices)
                    for name, lacks in notices:
                        if name not in found or len(lacks) < len(found[name]):
                            found[name] = lacks
                names = sorted(found)
                rows.append((len(own), hits, names, [" ".join(found[n]) for n in names]))
            n, hit, names, lacks = zip(*rows, strict=True)
            return {"n_blocks": pa.array(n, pa.int64()), "n_confirmed": pa.array(hit, pa.int64()), "licenses": pa.array(names, pa.list_(pa.string())), "differences": pa.array(lacks, pa.list_(pa.string()))}

        yield from add_columns(batches, text, make)

    new = {"n_blocks": T.LongType(), "n_confirmed": T.LongType(), "licenses": T.ArrayType(T.StringType()), "differences": T.ArrayType(T.StringType())}
    return docs.transform(map_arrow, run, T.StructType([f for f in docs.schema.fields if f.name not in new] + [T.StructField(k, v) for k, v in new.items()]))
