"""Catalogues and locale tables: merging, missing entries, completeness.

Locale tables are long: (locale, key, value, ord). A key that is present with a null value and an
absent key are told apart by a flag on the joined side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glotspark.functions.text import needs_translation, reusable


def merge_source(catalog: DataFrame, locale: str, existing: DataFrame | None = None, keep_existing: bool = False) -> DataFrame:
    """The source locale's entries: the current texts only, unless told to keep what exists."""
    current = catalog.select(F.lit(locale).alias("locale"), "key", F.col("text").alias("value"), "ord")
    if existing is None or not keep_existing:
        return current
    return current.unionByName(existing.join(catalog.select("key"), "key", "left_anti").select(F.lit(locale).alias("locale"), "key", "value", "ord"))


def merge_target(catalog: DataFrame, existing: DataFrame, locale: str) -> DataFrame:
    """A target locale's entries: every reusable existing value, orphans too; '' for other current keys.

    ord goes on behind the existing entries for keys that are new.
    """
    old = existing.select("key", "value", F.col("ord").alias("old_ord"))
    new = catalog.select("key", F.col("ord").alias("new_ord"), F.lit(True).alias("current"))
    merged = old.join(new, "key", "full_outer")
    kept = reusable(F.col("value"))
    place = F.when(kept, F.struct(F.lit(0).alias("part"), F.col("old_ord").alias("place"))).otherwise(F.struct(F.lit(1).alias("part"), F.col("new_ord").alias("place")))
    rows = merged.where(kept | F.col("current"))
    return rows.select(F.lit(locale).alias("locale"), "key", F.when(kept, F.col("value")).otherwise("").alias("value"), place["part"].alias("part"), place["place"].alias("ord"))


def new_keys(catalog: DataFrame, existing: DataFrame) -> DataFrame:
    """Current keys that are not in the locale, whatever their value there."""
    return catalog.join(existing.select("key"), "key", "left_anti")


def missing_entries(source: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Source rows (key, text, ord) whose translation is absent, null or blank; all of them if forced."""
    joined = source.join(existing.select("key", F.col("value").alias("existing")), "key", "left")
    return joined.where(needs_translation(F.col("existing"), force))


def seeded(source: DataFrame, existing: DataFrame) -> DataFrame:
    """key, value: what exists, and '' for source keys without a value."""
    return existing.select("key", "value").join(source.select("key"), "key", "full_outer").select("key", F.coalesce("value", F.lit("")).alias("value"))


def fan_out(source: DataFrame, languages: DataFrame) -> DataFrame:
    """Every source row for every language; the languages are a configured list and are broadcast."""
    return source.crossJoin(F.broadcast(languages))


def incomplete(source: DataFrame, results: DataFrame) -> DataFrame:
    """Source keys without a result or with an empty one."""
    joined = source.join(results.select("key", F.col("value").alias("result")), "key", "left")
    return joined.where(F.coalesce("result", F.lit("")) == "").drop("result")


def unknown_languages(asked: DataFrame, known: DataFrame) -> DataFrame:
    return asked.join(known, "lang", "left_anti")
