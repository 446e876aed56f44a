"""ICU placeholders: how often each variable occurs in a message, and whether a translation keeps them.

Flat, balanced messages are counted by built-in functions. Others (nested blocks, plural and
select forms, unbalanced braces) go to a Pandas UDF, which gets only those messages' rows to work on.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glotspark import schemas
from glotspark.functions.text import JS_SPACE, js_trim

#: Braces that hold no brace and no comma.
FLAT = "^[^{}]*(?:\\{[^{},]*\\}[^{}]*)*\\z"
_NAME = re.compile(r"(?:[_A-Za-z][_A-Za-z0-9]*|[0-9]+)\Z")
_SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
_BRANCHING = {"select", "plural", "selectordinal"}


def _closing(s: str, at: int) -> int:
    """Where the brace that opens at ``at`` closes; -1 if it does not."""
    depth = 0
    for m in re.compile("[{}]").finditer(s, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return -1


def _at_comma(s: str) -> tuple[str, str | None]:
    """s before and behind its first comma outside braces."""
    depth = 0
    for m in re.compile("[{},]").finditer(s):
        if m[0] == ",":
            if depth == 0:
                return s[: m.start()], s[m.start() + 1 :]
        else:
            depth = max(0, depth + (1 if m[0] == "{" else -1))
    return s, None


def placeholder_counts(message: str | None) -> dict[str, int]:
    """How often each variable occurs, in every branch of plural and select forms."""
    found: Counter[str] = Counter()

    def blocks(s: str, work) -> None:
        """work on what stands in each outermost pair of braces; stop at one that does not close."""
        at = s.find("{")
        while at >= 0:
            end = _closing(s, at)
            if end < 0:
                return
            work(s[at + 1 : end])
            at = s.find("{", end + 1)

    def block(body: str) -> None:
        if not body.strip(_SPACE):
            return
        name, rest = _at_comma(body)
        named = bool(_NAME.match(name.strip(_SPACE)))
        found.update([name.strip(_SPACE)] if named else [])
        if rest is None:
            if not named:
                blocks(body, block)
            return
        if not rest.strip(_SPACE):
            return
        kind, options = _at_comma(rest)
        if kind.strip(_SPACE) in _BRANCHING:
            blocks(options or "", lambda inner: blocks(inner, block))
        else:
            blocks(options if options is not None and options.strip(_SPACE) else kind, block)

    if isinstance(message, str):
        blocks(message, block)
    return dict(found)


def _parsed(message: Column) -> Column:
    def count(messages: pd.Series) -> pd.Series:
        return messages.map(lambda m: [{"name": n, "cnt": c} for n, c in sorted(placeholder_counts(m).items())])

    return F.pandas_udf(count, schemas.PLACEHOLDERS)(message)


def placeholders(message: Column) -> Column:
    """array<struct<name, cnt>> sorted by name; empty for a null message."""
    names = F.regexp_extract_all(message, F.lit(f"\\{{[{JS_SPACE}]*([_A-Za-z][_A-Za-z0-9]*|[0-9]+)[{JS_SPACE}]*\\}}"), F.lit(1))
    flat = F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.struct(n.alias("name"), F.size(F.filter(names, lambda x: x == n)).cast("long").alias("cnt")))
    hard = F.when(message.rlike(FLAT), F.lit(None)).otherwise(message)
    none = F.array().cast(schemas.PLACEHOLDERS)
    return F.when(message.isNull() | ~F.contains(message, F.lit("{")), none).when(message.rlike(FLAT), flat).otherwise(_parsed(hard))


def flat_placeholders(message: Column) -> Column:
    """placeholders() for messages known to be flat: built-in functions only."""
    names = F.regexp_extract_all(message, F.lit(f"\\{{[{JS_SPACE}]*([_A-Za-z][_A-Za-z0-9]*|[0-9]+)[{JS_SPACE}]*\\}}"), F.lit(1))
    return F.transform(F.array_sort(F.array_distinct(names)), lambda n: F.struct(n.alias("name"), F.size(F.filter(names, lambda x: x == n)).cast("long").alias("cnt")))


def violation(a: Column, b: Column, translated: Column, is_string: Column | None = None) -> Column:
    """Null for a translation that keeps the placeholders (a: the original's, b: its own), else the first
    reason against it: not_string, blank, kinds (number of variables), missing:<name>, count:<name>."""
    lacking = F.filter(a, lambda x: ~F.exists(b, lambda y: y["name"] == x["name"]))
    unequal = F.filter(a, lambda x: F.exists(b, lambda y: (y["name"] == x["name"]) & (y["cnt"] != x["cnt"])))
    out = F.when(translated.isNull() if is_string is None else ~is_string, F.lit("not_string")).when(js_trim(translated) == "", F.lit("blank")).when(F.size(a) != F.size(b), F.lit("kinds"))
    return out.when(F.size(lacking) > 0, F.concat(F.lit("missing:"), lacking[0]["name"])).when(F.size(unequal) > 0, F.concat(F.lit("count:"), unequal[0]["name"]))


def judged(rows: DataFrame, original: str, translated: str, counts=placeholders, is_string: Column | None = None) -> DataFrame:
    """rows with reason. Both sides' placeholders are columns before they are compared: a Python
    function cannot stand inside a lambda."""
    counted = rows.withColumns({"_a": counts(F.col(original)), "_b": counts(F.col(translated))})
    return counted.withColumn("reason", violation(F.col("_a"), F.col("_b"), F.col(translated), is_string)).drop("_a", "_b")
