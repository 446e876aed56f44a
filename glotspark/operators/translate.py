"""Translating what is missing: batches, a pluggable translator, reconciliation, quarantine.

The calls run where the rows are, a batch at a time, and yield one reply row per batch; all that
follows - parsing, checking, falling back, failing a batch - are joins and expressions over all
languages at once. Nothing stops at the first failing language: results of the others are kept.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.functions import icu
from glotspark.functions.text import without_fence
from glotspark.operators.catalog import batches

BATCH_SIZE = 10
REQUESTS_PER_MINUTE = 20
RETRIES = 3


class Translator(Protocol):
    """Turns a batch into the text of a reply: a JSON object by key, perhaps in a Markdown fence."""

    def __call__(self, lang: str, entries: dict[str, str]) -> str: ...


class RateLimited(Exception):
    """Raised by a translator that was told to wait; seconds is how long."""

    def __init__(self, seconds: float = 60.0):
        super().__init__(f"asked to wait {seconds} s")
        self.seconds = seconds


@dataclass
class Limiter:
    """Spaces calls and repeats failing ones: 2^i seconds apart, or as long as the provider asks.

    When the attempts are used up the last error is raised. delay: seconds between calls at least.
    """

    requests_per_minute: float = REQUESTS_PER_MINUTE
    retries: int = RETRIES
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    delay: float = 0.0
    last: float = float("-inf")

    def call(self, f: Callable[[], str]) -> str:
        for attempt in range(self.retries):
            wait = self.last + max(60.0 / self.requests_per_minute, self.delay) - self.clock()
            if wait > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return f()
            except RateLimited as e:
                if attempt == self.retries - 1:
                    raise
                self.sleep(e.seconds)
            except Exception:
                if attempt == self.retries - 1:
                    raise
                self.sleep(2.0**attempt)
        raise RuntimeError("no attempts allowed")


def limiter_of(provider: dict, delay: float = 0.0, providers: int = 1) -> Callable[[], Limiter]:
    """A limiter for each of some tasks that share the provider's rate."""
    return lambda: Limiter(provider["requests_per_minute"] / providers, provider["max_retries"], delay=delay * providers)


def prompt(source: str, target: str, entries: dict[str, str]) -> list[dict[str, str]]:
    """Messages for a chat endpoint."""
    rules = "Keep {placeholders}, tone and keys. Answer with one JSON object: the given keys, translated values."
    return [{"role": "system", "content": f"Translate interface texts from {source} to {target}. {rules}"}, {"role": "user", "content": json.dumps(entries, ensure_ascii=False)}]


def requests(rows: DataFrame) -> DataFrame:
    """lang, batch_id, entries (array of key, text in order): one row per call."""
    entry = F.array_sort(F.collect_list(F.struct("ord", "key", "text")))
    return rows.groupBy("lang", "batch_id").agg(F.transform(entry, lambda e: F.struct(e["key"].alias("key"), e["text"].alias("text"))).alias("entries"))


def call(batched: DataFrame, translator: Translator, providers: int = 1, limiter: Callable[[], Limiter] | None = None) -> DataFrame:
    """lang, batch_id, raw, error. As many calls run at once as there are providers' slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = limiter() if limiter else None
        for frame in frames:
            out = []
            for lang, batch, entries in zip(frame["lang"], frame["batch_id"], frame["entries"], strict=True):
                asked = {e["key"]: e["text"] for e in entries}
                try:
                    raw = limit.call(lambda: translator(lang, asked)) if limit else translator(lang, asked)  # noqa: B023
                    out.append((lang, batch, raw, None))
                except Exception as e:
                    out.append((lang, batch, None, str(e)))
            yield pd.DataFrame(out, columns=["lang", "batch_id", "raw", "error"])

    return batched.repartition(providers, "lang", "batch_id").mapInPandas(run, "lang string, batch_id long, raw string, error string")


def responses(replies: DataFrame) -> DataFrame:
    """lang, batch_id, key, value, is_string: the entries of readable replies; an unreadable reply gives none."""
    parsed = replies.select("lang", "batch_id", F.from_json(without_fence(F.col("raw")), "map<string,string>").alias("m"), F.try_parse_json(without_fence(F.col("raw"))).alias("v"))
    rows = parsed.select("lang", "batch_id", "v", F.explode("m").alias("key", "value"))
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), F.regexp_replace("key", "'", "\\\\'"), F.lit("']")), "variant"))
    return rows.select("lang", "batch_id", "key", "value", F.coalesce(kind == "STRING", F.lit(True)).alias("is_string"))


def reconcile(requested: DataFrame, answered: DataFrame, counts=icu.placeholders) -> DataFrame:
    """requested (lang, batch_id, key, text, existing) with value, reason, source and batch_failed.

    A missing or invalid answer falls back to a non-empty existing value; without one its whole
    batch fails, and every key of the batch keeps what it had. Answers to keys not asked are ignored.
    """
    reply = answered.select("lang", "batch_id", "key", F.col("value").alias("answer"), "is_string" if "is_string" in answered.columns else F.lit(True).alias("is_string"), F.lit(True).alias("present"))
    rows = requested.join(reply, ["lang", "batch_id", "key"], "left")
    rows = icu.judged(rows, "text", "answer", counts, F.col("is_string") & F.col("answer").isNotNull())
    rows = rows.withColumn("reason", F.when(F.col("present").isNull(), "absent").otherwise(F.col("reason")))
    fatal = F.col("reason").isNotNull() & (F.coalesce("existing", F.lit("")) == "")
    failed = rows.where(fatal).select("lang", "batch_id", F.lit(True).alias("batch_failed")).distinct()
    rows = rows.join(failed, ["lang", "batch_id"], "left").withColumn("batch_failed", F.coalesce("batch_failed", F.lit(False)))
    good = ~F.col("batch_failed") & F.col("reason").isNull()
    return rows.select(*requested.columns, "reason", "batch_failed", F.when(good, F.col("answer")).otherwise(F.col("existing")).alias("value"), F.when(good, "translated").when(F.col("batch_failed"), "failed").otherwise("existing").alias("source"))


def quarantine(reconciled: DataFrame, replies: DataFrame) -> DataFrame:
    """Every key of a failed batch with its reason and the raw reply."""
    raw = replies.select("lang", "batch_id", F.col("raw").alias("raw_response"), "error")
    rows = reconciled.where("batch_failed").join(raw, ["lang", "batch_id"], "left")
    return rows.select("lang", "batch_id", "key", "text", F.coalesce("error", "reason").alias("reason"), "raw_response")


def failure_log(reconciled: DataFrame) -> DataFrame:
    """lang, attempted, failed, failure_rate, reasons (distinct, sorted)."""
    from glotspark.operators.report import failure_rate

    failed = F.count_if("batch_failed")
    return reconciled.groupBy("lang").agg(F.count("*").alias("attempted"), failed.alias("failed"), failure_rate(failed, F.count("*")).alias("failure_rate"), F.array_sort(F.collect_set(F.when(F.col("batch_failed"), F.col("reason")))).alias("reasons"))


@dataclass
class Translated:
    results: DataFrame
    reconciled: DataFrame
    quarantine: DataFrame
    incomplete: DataFrame


def translate(source: DataFrame, existing: DataFrame, languages: DataFrame, translator: Translator, keep: Callable[[DataFrame, str], DataFrame], force: bool = False, size: int = BATCH_SIZE, providers: int = 1, limiter=None) -> Translated:
    """source (key, text, ord), existing (lang, key, value), languages (lang): all languages in one job.

    keep(df, name) stores a table once; replies are stored before anything reads them, so that a
    lost executor never makes a paid call twice.
    """
    from glotspark.functions.text import needs_translation

    wanted = source.crossJoin(F.broadcast(languages)).join(existing.select("lang", "key", F.col("value").alias("existing")), ["lang", "key"], "left")
    missing = keep(batches(wanted.where(needs_translation(F.col("existing"), force)), size, ["ord", "key"], ["lang"], keep), "missing")
    replies = keep(call(requests(missing), translator, providers, limiter), "replies")
    done = keep(reconcile(missing.select("lang", "batch_id", "key", "text", "existing"), responses(replies)), "reconciled")
    results = wanted.join(done.select("lang", "key", "value", "source"), ["lang", "key"], "left")
    results = results.select("lang", "key", "text", "ord", F.coalesce("value", "existing", F.lit("")).alias("value"), F.coalesce("source", F.lit("kept")).alias("source"))
    return Translated(results, done, quarantine(done, replies), results.where("value = ''"))
