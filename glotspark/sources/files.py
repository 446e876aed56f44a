"""Source files, locale files and the key cache as tables, and tables as such files."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark import schemas
from glotspark.functions.text import CJK


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** over folders, * and ? within one, {a,b} alternatives."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}\\z"


def source_files(spark: SparkSession, root: str, include: list[str], ignore: list[str] = (), script: str | None = CJK) -> DataFrame:
    """file (relative to root), content: of the files whose path matches; with a script, only those that hold it.

    The name filter prunes the listing, and the look for the script comes before any parsing.
    """
    ends = {m.group(1) for g in include if (m := re.search(r"\.(\{[^}]*\}|\w+)$", g))}
    exts = sorted({e for x in ends for e in x.strip("{}").split(",")})
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", "*.{" + ",".join(exts) + "}") if exts else reader
    base = re.sub("^file:/*", "/", root.rstrip("/")) + "/"
    plain = F.regexp_replace("path", "^file:/+", "/")
    rows = reader.load(root).select(F.substr(plain, F.lit(len(base) + 1)).alias("file"), F.decode("content", "UTF-8").alias("content"))
    rows = rows.where(F.col("file").rlike("|".join(map(glob_pattern, include))))
    if ignore:
        rows = rows.where(~F.col("file").rlike("|".join(map(glob_pattern, ignore))))
    return rows.where(F.col("content").rlike(script)) if script else rows


def locale_entries(spark: SparkSession, path: str, locale: str, strict: bool = False) -> DataFrame:
    """locale, key, value, ord, is_string of a flat JSON file. A file that cannot be read is empty, or an error if strict."""
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.from_json("value", "map<string,string>").alias("m"), F.try_parse_json("value").alias("v"))
    if strict:
        parsed = parsed.where(F.when(F.col("m").isNull(), F.raise_error(F.lit(f"{path} holds no JSON object")).cast("boolean")).otherwise(True))
    rows = parsed.select("v", F.posexplode(F.map_entries(F.coalesce("m", F.create_map().cast("map<string,string>")))).alias("ord", "e"))
    kind = F.schema_of_variant(F.try_variant_get("v", F.concat(F.lit("$['"), F.regexp_replace("e.key", "'", "\\\\'"), F.lit("']")), "variant"))
    return rows.select(F.lit(locale).alias("locale"), F.col("e.key").alias("key"), F.col("e.value").alias("value"), F.col("ord").cast("long").alias("ord"), F.coalesce(kind == "STRING", F.lit(True)).alias("is_string"))


def detail_entries(spark: SparkSession, path: str) -> DataFrame:
    """key, text, context, interpolations, ord of a catalogue file, whose values are strings or details."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e"))
    detail = F.from_json("e.value", "text string, context string, interpolations array<string>")
    is_detail = F.startswith("e.value", F.lit("{"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("e.key").alias("key"), F.when(is_detail, detail["text"]).otherwise(F.col("e.value")).alias("text"), F.when(is_detail, detail["context"]).alias("context"),
        F.coalesce(F.when(is_detail, detail["interpolations"]), none).alias("interpolations"), F.col("ord").cast("long").alias("ord"),
    )


def ai_cache(spark: SparkSession, path: str) -> DataFrame:
    """The key cache; older caches hold bare keys without a time."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("cache_key", "v"))
    new = F.from_json("v", "key string, timestamp bigint")
    old = ~F.startswith("v", F.lit("{"))
    return rows.select("cache_key", F.when(old, F.col("v")).otherwise(new["key"]).alias("key"), F.when(~old, F.timestamp_millis(new["timestamp"])).alias("ts")).to(spark.createDataFrame([], schemas.AI_CACHE).schema)


def write_parts(spark: SparkSession, path: str, parts: Iterable[str]) -> None:
    """One file, through the file system that the path names, a part at a time."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.setWriteChecksum(False)  # people edit these files, and a stale checksum would lock readers out
    out = system.create(target, True)
    try:
        held, size = [], 0
        for part in parts:
            held.append(part)
            size += len(part)
            if size >= 1 << 16:
                out.write(bytearray("".join(held).encode()))
                held, size = [], 0
        out.write(bytearray("".join(held).encode()))
    finally:
        out.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_parts(spark, path, [text])


def _object(entries: Iterable[tuple[str, object]]) -> Iterator[str]:
    """A JSON object with two spaces of indent, as json.dumps writes it, entry by entry."""
    some = False
    for key, value in entries:
        said = json.dumps(value, ensure_ascii=False, indent=2).replace("\n", "\n  ")
        yield f"{',' if some else '{'}\n  {json.dumps(key, ensure_ascii=False)}: {said}"
        some = True
    yield "\n}" if some else "{}"


def write_locale(entries: DataFrame, path: str, order: list[str]) -> None:
    """A locale file: keys in order, two spaces of indent. Rows pass through the driver one after the other."""
    rows = entries.select("key", "value", *order).orderBy(*order, "key").toLocalIterator(prefetchPartitions=True)
    write_parts(entries.sparkSession, path, _object((r.key, r.value) for r in rows))


def write_detail(catalog: DataFrame, path: str) -> None:
    rows = catalog.orderBy("ord", "key").toLocalIterator()
    write_parts(catalog.sparkSession, path, _object((r.key, {"text": r.text, "context": r.context, "interpolations": list(r.interpolations)}) for r in rows))


def write_ai_cache(cache: DataFrame, path: str) -> None:
    rows = cache.select("cache_key", "key", F.unix_millis("ts").alias("ts")).orderBy("cache_key").toLocalIterator()
    write_parts(cache.sparkSession, path, _object((r.cache_key, {"key": r.key, "timestamp": r.ts}) for r in rows))


def write_bulk(entries: DataFrame, path: str) -> None:
    """Many locales as a table, a folder for each."""
    entries.write.mode("overwrite").partitionBy("locale").parquet(path)
