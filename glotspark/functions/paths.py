"""What a source file's path tells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _found(path: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))


def context_info(path: Column) -> Column:
    """area: the folder below pages; component: the file if capitalised, else what is below components."""
    name = F.regexp_replace(base_name(path), "\\.(?:tsx?|jsx?)\\z", "")
    return F.struct(_found(path, "pages/([^/]+)").alias("area"), F.when(name.rlike("^[A-Z]"), name).otherwise(_found(path, "components/([^/]+)")).alias("component"))


def key_context(path: Column) -> Column:
    """The first part of a key."""
    common = F.lit("common")
    return (
        F.when(path.rlike("pages/[^/]+"), _found(path, "pages/([^/]+)")).when(F.contains(path, F.lit("components/")) | F.contains(path, F.lit("hooks/")), common)
        .when(path.rlike("constants/[^/]+"), _found(path, "constants/([^/]+)")).otherwise(common)
    )


def file_type(path: Column) -> Column:
    has = lambda s: F.contains(path, F.lit(s))
    return F.when(F.endswith(path, F.lit(".tsx")) & ~has("/data.ts"), "component").when(has("/data.ts"), "data").when(has("/router/config"), "router").when(has("/constants/"), "constants").otherwise("utils")


def data_config_file(path: Column) -> Column:
    return path.rlike("/(?:data|constants|.*Data)\\.tsx?\\z") | F.contains(path, F.lit("/router/config"))
