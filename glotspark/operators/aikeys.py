"""Keys from a generator behind a cache: lookup, time to live, requests, normalisation, fallback.

A generator turns a list of {text, context} into the text of a reply: a JSON array of as many keys,
or for a single text the key alone. Replies are stored before anything reads them, so no paid call
is made twice; a key is matched by the place of its text among those that were sent.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glotspark.functions import paths, text
from glotspark.functions.text import fallback_key, sanitize_ai_key, valid_ai_key, without_fence

TTL_DAYS = 30
BATCH_SIZE = 10

Generator = Callable[[list[dict]], str]
Keep = Callable[[DataFrame, str], DataFrame]


def live(cache: DataFrame, now: Column, ttl_days: int = TTL_DAYS) -> DataFrame:
    """Cache rows younger than ttl_days (0: all); rows without a time count as new."""
    if not ttl_days:
        return cache
    return cache.where(F.unix_micros(now) - F.unix_micros(F.coalesce("ts", now)) < ttl_days * 86_400_000_000)


def usable(cache: DataFrame) -> DataFrame:
    """Cache rows with their key normalised; rows whose key is not valid then go."""
    return cache.withColumn("key", sanitize_ai_key(F.col("key"))).where(valid_ai_key(F.col("key")))


def request_context(file: Column, given_type: Column | None = None, said: Column | None = None) -> Column:
    """What a request tells of a text: its type, its file, and the area and component that the path names."""
    info = paths.context_info(file)
    kind = text.text_type(F.col("text") if said is None else said)
    return F.struct((kind if given_type is None else F.coalesce(given_type, kind)).alias("textType"), file.alias("filePath"), paths.file_type(file).alias("fileType"), info["area"].alias("area"), info["component"].alias("componentName"))


def with_requests(rows: DataFrame) -> DataFrame:
    """rows (text, file) with request (the context sent) and cache_key."""
    return rows.withColumn("request", request_context(F.col("file"))).withColumn("cache_key", text.cache_key(F.col("text"), F.col("request")))


def split(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """asked with cached (the key found, or null)."""
    return asked.join(usable(cache).select("cache_key", F.col("key").alias("cached")), "cache_key", "left")


def requests(asked: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """file, batch_id, items (place, cache_key, text, context in order): a row per call.

    asked: cache_key, text, file, ord, request, cached. The uncached texts of one file go together, size
    at a time; a text that several files ask for alike goes with the first. A file's texts are few.
    """
    fresh = asked.where("cached is null").groupBy("cache_key").agg(F.min(F.struct("file", "ord", "text", F.to_json("request").alias("context"))).alias("first"))
    placed = fresh.select("cache_key", "first.*").withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("ord", "cache_key")) - 1)
    rows = placed.withColumn("batch_id", F.floor(F.col("place") / size).cast("long"))
    return rows.groupBy("file", "batch_id").agg(F.array_sort(F.collect_list(F.struct("place", "cache_key", "text", "context"))).alias("items"))


def call(batched: DataFrame, generator: Generator, providers: int = 1, limiter: Callable | None = None) -> DataFrame:
    """file, batch_id, raw, error. As many calls run at once as there are providers' slots."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limit = limiter() if limiter else None
        for frame in frames:
            out = []
            for file, batch, items in zip(frame["file"], frame["batch_id"], frame["items"], strict=True):
                asked = [{"text": x["text"], "context": json.loads(x["context"])} for x in items]
                try:
                    out.append((file, batch, limit.call(lambda: generator(asked)) if limit else generator(asked), None))  # noqa: B023
                except Exception as e:
                    out.append((file, batch, None, str(e)))
            yield pd.DataFrame(out, columns=["file", "batch_id", "raw", "error"])

    return batched.repartition(providers, "file", "batch_id").mapInPandas(run, "file string, batch_id long, raw string, error string")


def answers(batched: DataFrame, replies: DataFrame) -> DataFrame:
    """cache_key, raw: the reply's key for each text sent; null where the reply cannot be read or is too short."""
    body = without_fence(F.col("raw"))
    listed = F.from_json(body, "array<string>")
    several = F.startswith(body, F.lit("["))
    keys = F.when(several, listed).when(F.size("items") == 1, F.array(body))
    rows = batched.join(replies.select("file", "batch_id", "raw"), ["file", "batch_id"], "left").select(keys.alias("keys"), F.posexplode("items").alias("at", "item"))
    return rows.select("item.cache_key", F.get("keys", F.col("at")).alias("raw"))


def generate(asked: DataFrame, generator: Generator, keep: Keep, size: int = BATCH_SIZE, key_fallback: bool = True, providers: int = 1, limiter: Callable | None = None, **how) -> DataFrame:
    """asked (see requests) with key and origin: cache rows are kept, others are asked for.

    A reply that cannot be read, or a key that is not valid, falls back to a key made from the
    text, or to null.
    """
    batched = keep(requests(asked, size), "key-requests")
    replies = keep(call(batched, generator, providers, limiter), "key-replies")
    clean = sanitize_ai_key(F.col("raw"))
    made = answers(batched, replies).select("cache_key", F.when(valid_ai_key(clean), clean).alias("made"))
    rows = asked.join(made, "cache_key", "left")
    fallback = fallback_key(F.col("text"), **how) if key_fallback else F.lit(None).cast("string")
    origin = F.when(F.col("cached").isNotNull(), "cache").when(F.col("made").isNotNull(), "generated").otherwise("fallback" if key_fallback else "failed")
    return rows.select(*asked.columns, F.coalesce("cached", "made", fallback).alias("key"), origin.alias("origin"))


def updated(cache: DataFrame, generated: DataFrame, now: Column) -> DataFrame:
    """The cache to store: what is still live and was not made anew, and what was generated or fell back."""
    new = generated.where("origin in ('generated', 'fallback')").groupBy("cache_key").agg(F.min("key").alias("key")).select("cache_key", "key", now.alias("ts"))
    return cache.join(new.select("cache_key"), "cache_key", "left_anti").unionByName(new)


def stats(cache: DataFrame) -> DataFrame:
    return cache.agg(F.count("*").alias("total"))


#: Words that tell a chat model what a key is.
RULES = "Give each interface text a short semantic key of English words in camelCase, of 3 to 60 letters and digits, beginning with a small letter. No explanations."


def prompt(items: list[dict]) -> list[dict[str, str]]:
    """Messages for a chat endpoint: of one text, or of several, which are answered with a JSON array of as many keys."""
    if len(items) == 1:
        about = [f"{k}: {v}" for k, v in items[0].get("context", {}).items() if v]
        return [{"role": "system", "content": f"{RULES} Answer with the key alone."}, {"role": "user", "content": "\n".join([f"text: {items[0]['text']}", *about])}]
    return [{"role": "system", "content": f"{RULES} Answer with a JSON array, a key for each text in the order given."}, {"role": "user", "content": json.dumps(items, ensure_ascii=False)}]
