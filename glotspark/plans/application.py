"""The two commands: extract texts from sources into locale files, and translate what is missing."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark import schemas
from glotspark.config import Config, get_config
from glotspark.functions import text
from glotspark.operators import aikeys, catalog, locales, report, translate
from glotspark.sources import chat, files, tsx
from glotspark.sources.shared import keeper


def _entries(spark: SparkSession, config: Config, locale: str) -> DataFrame:
    """A locale's entries; none where there is no file or it cannot be read."""
    path = str(config.output_path(locale))
    try:
        return files.locale_entries(spark, path, locale)
    except AnalysisException:
        return spark.createDataFrame([], schemas.LOCALE_ENTRIES + ", is_string boolean")


@dataclass
class Extracted:
    """What extract() found; files_processed is 0 and nothing was written where no source matched."""

    files_processed: int
    catalog: DataFrame | None = None
    collisions: DataFrame | None = None
    errors: list[tuple[str, str]] = field(default_factory=list)
    key_report: dict[str, Any] | None = None
    #: file, code, n_replaced, error: the sources with intl calls, as a table; see write_sources().
    rewritten: DataFrame | None = None
    summary: dict[str, Any] | None = None


def _generated(spark: SparkSession, config: Config, texts: DataFrame, generator: aikeys.Generator, limiter: Callable | None, keep: Callable, context: Column | None = None) -> DataFrame:
    """text, vars, key of each text, from the generator or its cache, which is written anew. Raises where a text gets no key."""
    ai, keys = config["key_generation"]["ai"], config["key_generation"]
    now, path = F.lit(datetime.now(timezone.utc)), str(config.root / ai["cache"]["file_path"])
    cache = spark.createDataFrame([], schemas.AI_CACHE)
    if ai["cache"]["enabled"]:
        try:
            cache = files.ai_cache(spark, path)
        except AnalysisException:
            pass  # no cache yet
    cache = keep(aikeys.live(cache, now, ai["cache"]["ttl"]), "key-cache")
    asked = keep(aikeys.split(aikeys.with_requests(catalog.owners(texts, context)), cache), "key-asked")
    how = {"hash_length": keys["hash_length"], "max_semantic": keys["max_semantic_length"]}
    limit = limiter or translate.limiter_of(config["ai_provider"], providers=config["translation"]["parallel_requests"])
    done = keep(aikeys.generate(asked, generator, keep, ai["batch_size"], ai["fallback_to_semantic"], config["translation"]["parallel_requests"], limit, **how), "key-made")
    if ai["cache"]["enabled"]:
        files.write_ai_cache(aikeys.updated(cache, done, now), path)
    if lost := done.where("key is null").limit(5).collect():
        raise ValueError(f"no valid key was generated for {', '.join(r.text for r in lost)}")
    return done.select("text", "vars", F.concat("context", F.lit("."), "key").alias("key"))


def generate_keys_batch(items: DataFrame, context: str = "common", config: Config | None = None, generator: aikeys.Generator | None = None, limiter: Callable[[], translate.Limiter] | None = None) -> DataFrame:
    """items (text, and perhaps file and ord) with key, by the configuration's strategy.

    A null text is no item and raises; without a file the context of a request has the text's type alone.
    """
    config, spark = config or get_config(), items.sparkSession
    keys, columns = config["key_generation"], items.columns
    rows = items if "file" in columns else items.withColumn("file", F.lit(""))
    rows = rows if "ord" in columns else rows.withColumn("ord", F.xxhash64("text"))
    rows = rows.withColumn("text", F.when(F.col("text").isNull(), F.raise_error(F.lit("an item needs a text")).cast("string")).otherwise(F.col("text")))
    if keys["strategy"] != "ai" or not keys["ai"]["enabled"]:
        how = {"hash_length": keys["hash_length"], "max_semantic": keys["max_semantic_length"], "type_prefix": keys["use_type_prefix"]}
        return rows.select(*columns, text.context_key(F.col("text"), F.lit(context), "hash" if keys["strategy"] == "hash" else "semantic", **how).alias("key"))
    none = F.array().cast("array<string>")
    made = _generated(spark, config, rows.withColumn("vars", none), generator or chat.generator_of(config), limiter, keeper(spark, "keys"), F.lit(context))
    return catalog.joined_keys(rows.withColumn("vars", none), made).select(*columns, "key")


def extract(
    spark: SparkSession, config: Config, keep_existing_source: bool = False, hooks: tuple[Callable[[Extracted], None], ...] = (),
    generator: aikeys.Generator | None = None, limiter: Callable[[], translate.Limiter] | None = None, logger: Callable[[str], None] | None = None,
) -> Extracted:
    """Texts of the sources to the catalogue, locale files, detail and report files and the page of warnings.

    Sources are read only. The catalogue's order is by file name and place, so the first file's
    context owns a text's key. With the strategy "ai", if enabled, keys come from the generator, by default
    the configured provider. hooks, and post_commands that are callables, run at the end; one that
    fails is a warning.
    """
    said = logger or (lambda line: None)
    keep, keys = keeper(spark, "extract"), config["key_generation"]
    sources = files.source_files(spark, str(config.root), config["input"], config["ignore"], script=None)
    total = sources.count()
    if not total:
        return Extracted(0)
    skip = tuple(config["skip_function_calls"])
    found = keep(tsx.occurrences(sources.where(F.col("content").rlike(files.CJK))), "occurrences")
    texts = found.where("text is not null and kind <> 'top-level'").select("file", "ord", "text", "kind", "start", "end", "line", "vars")
    how = {"hash_length": keys["hash_length"], "max_semantic": keys["max_semantic_length"], "type_prefix": keys["use_type_prefix"]}
    if keys["strategy"] == "ai" and keys["ai"]["enabled"]:
        keyed = catalog.joined_keys(texts, _generated(spark, config, texts, generator or chat.generator_of(config), limiter, keep))
    else:
        keyed = catalog.with_keys(texts, "hash" if keys["strategy"] == "hash" else "semantic", **how)
    keyed = keep(keyed, "keyed")
    rows = keep(catalog.catalogue(keyed), "catalog")
    source, target_list = config["languages"]["source"], config["languages"]["targets"]
    for locale in target_list:
        old = _entries(spark, config, locale)
        path = str(config.output_path(locale))
        if locale == source:
            entries = locales.merge_source(rows, locale, old, keep_existing_source)
            files.write_locale(keep(entries.select("key", "value", "ord"), f"locale-{locale}"), path, ["ord"])
        else:
            merged = locales.merge_target(rows, old, locale)
            files.write_locale(keep(merged.select("key", "value", "part", "ord"), f"locale-{locale}"), path, ["part", "ord"])
    files.write_detail(rows, str(config.output_path(source, "detail")))
    stats = keep(report.file_stats(tsx.facts(sources.where(F.col("content").rlike(files.CJK)), skip)), "stats")
    errors = [(r.file, r.error) for r in stats.where("error is not null").select("file", "error").orderBy("file").toLocalIterator()]
    whole = report.summary(stats).first().asDict() | {"total_files": total, "collisions": catalog.collisions(keyed).count(), "languages": target_list}
    key_report = report.key_report(rows).first().asDict()
    key_report |= {"by_context": {r.context: r.n for r in report.by_context(rows).collect()}, "by_type": {r.type: r.n for r in report.by_type(rows).collect()}}
    per_file = {r.file: {"extracted": r.extracted, "dataConstants": r.data_constants, "skipped": r.skipped} for r in stats.orderBy("file").toLocalIterator()}
    about = {"summary": whole, "keyReport": key_report, "fileStats": per_file} | ({"errors": [{"file": f, "message": m} for f, m in errors]} if errors else {})
    files.write_text(spark, str(config.output_path(source, "report")), json.dumps(about, ensure_ascii=False, indent=2))
    said(f"{whole['changed_files']} of {total} files hold texts, {key_report['total']} keys")
    if page := config["reporting"].get("top_level_warnings_path"):
        tops = found.where("kind = 'top-level'").select("file", "name", "line", "text", "intl_key")
        named = tops.join(keyed.groupBy("text").agg(F.min("key").alias("key")), "text", "left").select("file", "name", "line", F.coalesce("intl_key", "key").alias("intl_key"))
        files.write_text(spark, str(config.root / page), report.warnings_markdown(named))
    code = tsx.rewritten(sources, keyed.select("file", "text", "key"), skip)
    out = Extracted(total, rows, catalog.collisions(keyed), errors, key_report, code, whole)
    for hook in [*hooks, *config["post_commands"]]:
        if not callable(hook):
            warnings.warn(f"post command {hook!r} is not run: only callables are", stacklevel=2)
            continue
        try:
            hook(out)
        except Exception as e:
            warnings.warn(f"post command {getattr(hook, '__name__', hook)} failed: {e}", stacklevel=2)
    return out


def write_sources(extracted: Extracted, root: str) -> int:
    """Writes the sources in which something was replaced below root; nothing calls this by itself."""
    rows = extracted.rewritten.where("n_replaced > 0")
    n = 0
    for r in rows.toLocalIterator(prefetchPartitions=True):
        files.write_text(rows.sparkSession, f"{root.rstrip('/')}/{r.file}", r.code)
        n += 1
    return n


def translate_missing(spark: SparkSession, config: Config, translator: translate.Translator | None = None, languages: list[str] | None = None, force: bool = False, limiter=None) -> translate.Translated:
    """Fills the target locales' missing entries. Writes every locale's file, then raises if entries are still empty.

    The translator is by default the configured provider, and calls are spaced and repeated as configured.
    """
    source = config["languages"]["source"]
    wanted = languages or [t for t in config["languages"]["targets"] if t != source]
    if unknown := [x for x in wanted if x not in config["languages"]["map"]]:
        raise ValueError(f"unknown languages: {', '.join(unknown)}")
    if not config.output_path(source).exists():
        raise FileNotFoundError(config.output_path(source))
    keep = keeper(spark, "translate")
    rows = files.locale_entries(spark, str(config.output_path(source)), source, strict=True).select("key", F.col("value").alias("text"), "ord")
    existing = None
    for locale in wanted:
        own = _entries(spark, config, locale).select(F.lit(locale).alias("lang"), "key", "value", "ord")
        existing = own if existing is None else existing.unionByName(own)
    existing = keep(existing, "existing")
    langs = spark.createDataFrame([(x,) for x in wanted], "lang string")
    settings, parallel = config["translation"], config["translation"]["parallel_requests"]
    limit = limiter or translate.limiter_of(config["ai_provider"], settings["batch_delay"] / 1000, parallel)
    done = translate.translate(rows, existing, langs, translator or chat.translator_of(config), keep, force, settings["batch_size"], parallel, limit)
    results = keep(done.results, "results")
    for locale in wanted:
        old = existing.where(F.col("lang") == locale)
        orphans = old.join(rows.select("key"), "key", "left_anti").select("key", "value", F.lit(0).alias("part"), "ord")
        mine = results.where(F.col("lang") == locale).select("key", "value", F.lit(1).alias("part"), "ord")
        files.write_locale(orphans.unionByName(mine), str(config.output_path(locale)), ["part", "ord"])
    failed = done.quarantine.limit(6).collect()
    if failed:
        raise RuntimeError(f"not translated: {', '.join(r.key for r in failed[:5])}{'...' if len(failed) > 5 else ''} ({failed[0].reason})")
    return done
