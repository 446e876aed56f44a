"""Queries that write files, read them back, call a translator or a generator of keys, or load configurations.

Files go to the folder that all executors share. Projects and configurations are those of the 25 nations;
translators and generators are deterministic functions instead of a provider.
"""

from __future__ import annotations

import hashlib
import json
import tempfile
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glotspark import config as cfg
from glotspark.functions import display, text
from glotspark.operators import aikeys, catalog, report, translate
from glotspark.plans import application
from glotspark.plans.basics import FACTS, SPACE, C, N, key_sql, query, semantic_sql, table, texts, trim_sql, type_sql
from glotspark.plans.phrases import PHRASES, phrases, phrases_sql
from glotspark.sources import chat, files
from glotspark.sources.shared import keeper, shared_folder
from glotspark.streaming import increments

_CUSTOMERS = f"said AS (SELECT c_custkey AS ord, 'c' || c_custkey AS key, phrase, translated FROM customer JOIN phrases ON pid = c_custkey % {N})"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, key, phrase, translated: a phrase for each customer."""
    rows = table(spark, sf_dir, "customer").select(C("c_custkey").alias("ord"), F.concat(F.lit("c"), "c_custkey").alias("key"), F.pmod("c_custkey", F.lit(N)).cast("int").alias("pid"))
    return rows.join(F.broadcast(phrases(spark)), "pid").drop("pid")


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, str]]:
    return sorted((r.n_nationkey, r.n_name) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").collect())  # 25 rows


# --- files

_PLACE = "row_number() OVER (ORDER BY ord) - 1"


@query(f"WITH {phrases_sql()}, {_CUSTOMERS} SELECT 'en-US' AS locale, key, translated AS value, ({_PLACE})::BIGINT AS ord, true AS is_string FROM said")
def locale_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "locale") + "/translation.json"
    files.write_locale(_customers(spark, sf_dir).select("key", C("translated").alias("value"), "ord"), path, ["ord"])
    return files.locale_entries(spark, path, "en-US")


@query(f"WITH {phrases_sql()}, {_CUSTOMERS} SELECT key, phrase AS text, ({_PLACE})::BIGINT AS ord FROM said")
def source_locale_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "source") + "/translation.json"
    files.write_locale(_customers(spark, sf_dir).select("key", C("phrase").alias("value"), "ord"), path, ["ord"])
    return files.locale_entries(spark, path, "zh-CN", strict=True).select("key", C("value").alias("text"), "ord")


@query(f"WITH {phrases_sql()}, {_CUSTOMERS} SELECT key, phrase AS text, 'src/p' || ord || '.tsx' AS context, CASE WHEN ord % 2 = 0 THEN 'a,b' ELSE '' END AS names, ({_PLACE})::BIGINT AS ord FROM said")
def detail_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, none = shared_folder(spark, "detail") + "/translation.detail.json", F.array().cast("array<string>")
    names = F.when(C("ord") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(none)
    files.write_detail(_customers(spark, sf_dir).select("key", C("phrase").alias("text"), F.concat(F.lit("src/p"), "ord", F.lit(".tsx")).alias("context"), names.alias("interpolations"), "ord"), path)
    return files.detail_entries(spark, path).select("key", "text", "context", F.array_join("interpolations", ",").alias("names"), "ord")


@query(f"WITH {phrases_sql()}, {_CUSTOMERS} SELECT phrase || '|' || ord AS cache_key, 'key' || ord AS key, 1700000000000 + ord AS ms FROM said")
def ai_cache_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "cache") + "/cache.json"
    rows = _customers(spark, sf_dir).select(F.concat("phrase", F.lit("|"), "ord").alias("cache_key"), F.concat(F.lit("key"), "ord").alias("key"), F.timestamp_millis(F.lit(1700000000000) + C("ord")).alias("ts"))
    files.write_ai_cache(rows, path)
    return files.ai_cache(spark, path).select("cache_key", "key", F.unix_millis("ts").alias("ms"))


@query("SELECT count(*)::BIGINT AS total FROM events")
def ai_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aikeys.stats(table(spark, sf_dir, "events").select(C("event_id").cast("string").alias("cache_key")))


@query("SELECT 'src/a' || n_nationkey || '/b/x.' || e AS file, 'f(''打开' || n_nationkey || ''')' AS content FROM nation, (VALUES ('ts'), ('tsx')) t(e)")
def source_globs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of eight files for each nation two match the patterns, hold the script and are not ignored."""
    root = shared_folder(spark, "globs")
    for n, _ in _nations(spark, sf_dir):
        for name in (f"src/a{n}/b/x.ts", f"src/a{n}/b/x.tsx", f"src/a{n}/b/x.css", f"lib/a{n}/x.ts", f"src/a{n}/x.test.ts", f"src/a{n}/x.d.ts", f"src/a{n}/node_modules/x.ts"):
            files.write_text(spark, f"{root}/{name}", f"f('打开{n}')")
        files.write_text(spark, f"{root}/src/a{n}/plain.ts", "f('open')")
    return files.source_files(spark, root, cfg.DEFAULTS["input"], cfg.DEFAULTS["ignore"])


# --- both commands over a project with a file for each nation

_PROJECT = (
    f"sources AS (SELECT n_nationkey AS n, 'src/pages/p' || (n_nationkey % 7) || '/n' || n_nationkey || '.tsx' AS file, a.phrase AS title, b.phrase AS said FROM nation"
    f" JOIN phrases a ON a.pid = n_nationkey % {N} JOIN phrases b ON b.pid = (n_nationkey + 5) % {N}),"
    " found AS (SELECT file, 0 AS ord, title AS text FROM sources UNION ALL SELECT file, 1, said FROM sources),"
    " firsts AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY file, ord) AS rn FROM found),"
    f" entries AS (SELECT {key_sql('text', 'regexp_extract(file, ' + chr(39) + 'pages/([^/]+)' + chr(39) + ', 1)')} AS key, text, file FROM firsts WHERE rn = 1)"
)


def _project(spark: SparkSession, sf_dir: str, settings: dict | None = None) -> cfg.Config:
    root = shared_folder(spark, "project").removeprefix("file://")
    for n, _ in _nations(spark, sf_dir):
        title, said = PHRASES[n % N][0], PHRASES[(n + 5) % N][0]
        code = f"export const TITLE = '{title}'\nexport function V({{ n }}) {{\n  return <p title='{said}'>{{n}}</p>\n}}\n"
        files.write_text(spark, f"{root}/src/pages/p{n % 7}/n{n}.tsx", code)
    return cfg.create_config(settings, root)


@query(
    f"WITH {phrases_sql()}, {_PROJECT} SELECT 'zh_CN' AS part, key, text AS value FROM entries UNION ALL SELECT 'en_US', key, '' FROM entries UNION ALL SELECT 'detail', key, text || '@' || file FROM entries"
    " UNION ALL SELECT 'report', k, v FROM (SELECT unnest(['total_files', 'changed_files', 'total_extracted', 'total_data_constants', 'errors', 'collisions']) AS k, unnest([count(*), count(*), 2 * count(*), 0, 0, 0])::VARCHAR AS v FROM sources)"
    " UNION ALL SELECT 'stats', file, '2,0,0' FROM sources UNION ALL SELECT 'hook', 'files', count(*)::VARCHAR FROM sources"
    " UNION ALL SELECT 'warning', s.file, '| ' || s.file || ' | TITLE | 1 | `' || e.key || '` |' FROM sources s JOIN entries e ON e.text = s.title"
)
def extracted_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that extract() writes, and a post command that is told of them."""
    told: list[tuple[str, str, str]] = []
    config = _project(spark, sf_dir, {"post_commands": [lambda out: told.append(("hook", "files", str(out.files_processed)))]})
    application.extract(spark, config)
    path = lambda locale, kind="": str(config.output_path(locale, kind))
    about = json.loads("".join(r.value for r in spark.read.text(path("zh_CN", "report"), wholetext=True).collect()))  # one file, a row per source file
    told += [("report", k, str(about["summary"][k])) for k in ("total_files", "changed_files", "total_extracted", "total_data_constants", "errors", "collisions")]
    told += [("stats", f, f"{x['extracted']},{x['dataConstants']},{x['skipped']}") for f, x in about["fileStats"].items()]
    lines = spark.read.text(str(config.root / config["reporting"]["top_level_warnings_path"])).where(C("value").startswith("| src"))
    rows = spark.createDataFrame(told, "part string, key string, value string")
    rows = rows.unionByName(lines.select(F.lit("warning").alias("part"), F.regexp_extract("value", r"^\| (\S+)", 1).alias("key"), "value"))
    for locale in ("zh_CN", "en_US"):
        rows = rows.unionByName(files.locale_entries(spark, path(locale), locale).select(C("locale").alias("part"), "key", "value"))
    detail = files.detail_entries(spark, path("zh_CN", "detail"))
    return rows.unionByName(detail.select(F.lit("detail").alias("part"), "key", F.concat("text", F.lit("@"), "context").alias("value")))


@query(
    f"WITH {phrases_sql()}, {_PROJECT} SELECT 'src/pages/p' || (n % 7) || '/n' || n || '.tsx' AS file, 'import intl from ''react-intl-universal'';' || chr(10) || 'export const TITLE = intl.get(''' || a.key || ''')' || chr(10) || 'export function V({{ n }}) {{' || chr(10) ||"
    " '  return <p title={intl.get(''' || b.key || ''')}>{n}</p>' || chr(10) || '}' || chr(10) AS code FROM sources JOIN entries a ON a.text = title JOIN entries b ON b.text = said".replace("{{", "{").replace("}}", "}")
)
def written_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = _project(spark, sf_dir)
    root = shared_folder(spark, "written").removeprefix("file://")
    application.write_sources(application.extract(spark, config), root)
    return files.source_files(spark, root, config["input"], script=None).select("file", C("content").alias("code"))


def _numbered_reply(lang: str, entries: dict[str, str]) -> str:
    return "```json\n" + json.dumps({k: f"{lang}: {t}" for k, t in entries.items()}, ensure_ascii=False) + "\n```"


@query(f"WITH {phrases_sql()}, {_PROJECT} SELECT lang, key, CASE WHEN lang = 'en_US' AND key = (SELECT min(key) FROM entries) THEN 'edited' ELSE lang || ': ' || text END AS value FROM entries, (VALUES ('en_US'), ('ja_JP')) l(lang)")
def translated_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """translate_missing() after extract(): what is translated already stays."""
    names = {"zh_CN": {"name": "Chinese"}, "en_US": {"name": "English"}, "ja_JP": {"name": "Japanese"}}
    config = _project(spark, sf_dir, {"languages": {"targets": ["en_US", "ja_JP"], "map": names}})
    application.extract(spark, config)
    path = str(config.output_path("en_US"))
    first = files.locale_entries(spark, path, "en_US")
    least = first.agg(F.min("key").alias("least"))
    edited = first.crossJoin(F.broadcast(least)).select("key", F.when(C("key") == C("least"), "edited").otherwise(C("value")).alias("value"), "ord")
    files.write_locale(keeper(spark, "edited")(edited, "rows"), path, ["ord"])
    application.translate_missing(spark, config, _numbered_reply, limiter=lambda: translate.Limiter(1e9))
    rows = None
    for lang in ("en_US", "ja_JP"):
        own = files.locale_entries(spark, str(config.output_path(lang)), lang).select(C("locale").alias("lang"), "key", "value")
        rows = own if rows is None else rows.unionByName(own)
    return rows


# --- translation

_LANGS = ["en", "ja", "fr"]


def _translated(spark: SparkSession, sf_dir: str, translator: translate.Translator) -> translate.Translated:
    """All orders' phrases to three languages; every seventh is there in en already."""
    said = texts(spark, sf_dir).select(F.concat(F.lit("k"), "ord").alias("key"), "text", "ord")
    existing = said.select(F.when(C("ord") % 7 == 0, "en").otherwise("xx").alias("lang"), "key", F.lit("there").alias("value"))
    return translate.translate(said, existing, spark.createDataFrame([(x,) for x in _LANGS], "lang string"), translator, keeper(spark, "translate"), providers=4)


_WANTED = f"wanted AS (SELECT ord, 'k' || ord AS key, text, lang FROM texts, (VALUES ('en'), ('ja'), ('fr')) l(lang))"


@query(f"WITH {phrases_sql()}, {FACTS}, {_WANTED} SELECT lang, key, ord, CASE WHEN lang = 'en' AND ord % 7 = 0 THEN 'there' ELSE lang || ': ' || text END AS value, CASE WHEN lang = 'en' AND ord % 7 = 0 THEN 'kept' ELSE 'translated' END AS source FROM wanted")
def translate_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _translated(spark, sf_dir, _numbered_reply).results.select("lang", "key", "ord", "value", "source")


def _unreadable_french(lang: str, entries: dict[str, str]) -> str:
    if lang == "ja":
        raise ValueError("no service")
    return f"sorry, {len(entries)}" if lang == "fr" else _numbered_reply(lang, entries)


@query(
    f"WITH {phrases_sql()}, {FACTS}, {_WANTED}, batched AS (SELECT *, ((row_number() OVER (PARTITION BY lang ORDER BY ord, key) - 1) // 10)::BIGINT AS batch_id FROM wanted WHERE lang <> 'en')"
    " SELECT lang, batch_id, key, CASE lang WHEN 'ja' THEN 'no service' ELSE 'absent' END AS reason, CASE lang WHEN 'fr' THEN 'sorry, ' || count(*) OVER (PARTITION BY lang, batch_id) END AS raw_response FROM batched"
)
def translation_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that cannot be read and calls that fail: all their keys, with the reply; other languages go on."""
    return _translated(spark, sf_dir, _unreadable_french).quarantine.select("lang", "batch_id", "key", "reason", "raw_response")


@query(
    "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 0.0 WHEN 1 THEN greatest(60.0 / (n_nationkey + 1), 1.0) ELSE greatest(60.0 / (n_nationkey + 1), 1.0) + greatest(60.0 / (n_nationkey + 1), 2.0) END::DECIMAL(9, 3)::VARCHAR AS waited,"
    " '{\"k' || n_nationkey || '\": \"' || n_name || '\"}' AS asked, 'text: ' || n_name || chr(10) || 'area: r' || n_regionkey AS key_asked FROM nation"
)
def calls_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that a limiter waits for calls that fail once or twice, at another rate for each nation; what is sent."""
    out = []
    for r in sorted(table(spark, sf_dir, "nation").collect()):  # 25 rows
        now, left = [0.0], [r.n_nationkey % 3]

        def sleep(seconds: float, now=now) -> None:
            now[0] += seconds

        def call(left=left) -> str:
            left[0] -= 1
            if left[0] >= 0:
                raise ValueError("not now")
            return "done"

        translate.Limiter(r.n_nationkey + 1, 3, sleep, lambda now=now: now[0]).call(call)
        asked = translate.prompt("zh", "en", {f"k{r.n_nationkey}": r.n_name})[1]["content"]
        out.append((r.n_nationkey, f"{now[0]:.3f}", asked, aikeys.prompt([{"text": r.n_name, "context": {"area": f"r{r.n_regionkey}", "textType": None}}])[1]["content"]))
    return spark.createDataFrame(out, "n_nationkey int, waited string, asked string, key_asked string")


@query(f"WITH {phrases_sql()}, {_PROJECT} SELECT count(*) || ' files, ' || count(*) || ' changed, ' || (SELECT count(*) FROM entries) || ' keys, 0 collisions, 0 errors' AS said, 0::INTEGER AS code FROM sources UNION ALL SELECT 'translate needs ai_provider.api_key in the configuration, or a translator passed to glotspark.cli.main', 2")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both commands, as they are called from a shell; without a provider translate says what it needs."""
    import contextlib
    import io

    from glotspark import cli

    root, out = str(_project(spark, sf_dir).root), []
    for args in (["extract", "--root", root], ["translate", "--root", root, "-l", "en_US"]):
        said = io.StringIO()
        with contextlib.redirect_stdout(said), contextlib.redirect_stderr(said):
            code = cli.main(args)
        out.append((said.getvalue().strip().splitlines()[-1], code))
    return spark.createDataFrame(out, "said string, code int")


@query("WITH e AS (SELECT 'k' || (o_orderkey % 500) AS key, CASE WHEN o_orderkey % 3 = 0 THEN ' ' ELSE o_orderpriority END AS value, o_orderkey AS ord FROM orders) SELECT 'en' AS locale, key, arg_max(value, CASE WHEN value = ' ' THEN 0 ELSE 1000000000 END + ord) AS value, min(ord)::BIGINT AS ord FROM e GROUP BY 2")
def streamed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that arrive as files, merged by a stream: the last value that is not blank stays."""
    folder, number = shared_folder(spark, "stream"), C("o_orderkey")
    value = F.when(number % 3 == 0, " ").otherwise(C("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(F.lit("en").alias("locale"), F.concat(F.lit("k"), F.pmod(number, F.lit(500))).alias("key"), value.alias("value"), number.cast("long").alias("ord"))
    rows.repartition(4, "key").write.parquet(f"{folder}/incoming")
    increments.merge_stream(spark, f"{folder}/incoming", f"{folder}/table", f"{folder}/checkpoint").awaitTermination()
    return increments.current(spark, f"{folder}/table")


# --- generated keys


def _named(items: list[dict]) -> str:
    """A key for each text from its digest; texts that ask or confirm get none that is valid."""
    keys = ["?" if x["context"]["textType"] == "confirm" else f"Key {hashlib.md5(x['text'].encode()).hexdigest()[:6]}" for x in items]
    return json.dumps(keys)


_H = "substr(md5(text), 1, 6)"
_FIRST_FILES = "asked AS (SELECT text, min(file) AS file FROM texts GROUP BY text)"
_GENERATED = f"CASE WHEN {type_sql('text')} = 'confirm' THEN 'auto' || substr(md5(text), 1, 4) ELSE 'key' || upper(substr({_H}, 1, 1)) || substr({_H}, 2) END"


@query(
    f"WITH {phrases_sql()}, {FACTS}, {_FIRST_FILES}, raws AS (SELECT text, file, {type_sql('text')} || '.' || {semantic_sql('text', 6)} || '_' || substr(md5(text), 1, 4) AS raw FROM asked)"
    f" SELECT text, 'common.' || CASE WHEN {type_sql('text')} = 'confirm' THEN 'confirm' || upper(substr(md5(text), 1, 1)) || substr(md5(text), 2, 3) ELSE {_GENERATED} END AS key, CASE WHEN {type_sql('text')} = 'confirm' THEN 'fallback' ELSE 'generated' END AS origin FROM raws"
)
def generated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all orders' texts from a generator, in batches by the first file that holds a text; invalid ones fall back."""
    rows = texts(spark, sf_dir).withColumn("vars", F.array().cast("array<string>"))
    none = spark.createDataFrame([], "cache_key string, key string")
    asked = aikeys.split(aikeys.with_requests(catalog.owners(rows, F.lit("common"))), none)
    done = aikeys.generate(asked, _named, keeper(spark, "keys"), size=4, providers=2)
    return done.select("text", F.concat("context", F.lit("."), "key").alias("key"), "origin")


@query(f"WITH {phrases_sql()}, {FACTS}, {_FIRST_FILES}, placed AS (SELECT text, file, row_number() OVER (PARTITION BY file ORDER BY (SELECT min(ord) FROM texts t WHERE t.text = asked.text AND t.file = asked.file)) - 1 AS place FROM asked) SELECT file, (place // 4)::BIGINT AS batch_id, count(*)::BIGINT AS n, string_agg(text, '|' ORDER BY place) AS said FROM placed GROUP BY 1, 2")
def key_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for keys: a file's texts, four at a time, each text once."""
    rows = texts(spark, sf_dir).withColumn("vars", F.array().cast("array<string>"))
    asked = aikeys.with_requests(catalog.owners(rows)).withColumn("cached", F.lit(None).cast("string"))
    batched = aikeys.requests(asked, 4)
    return batched.select("file", "batch_id", F.size("items").cast("long").alias("n"), F.array_join(F.transform("items", lambda x: x["text"]), "|").alias("said"))


@query(f"WITH {phrases_sql()} SELECT phrase AS text, 'common.' || CASE WHEN {type_sql('phrase')} = 'confirm' THEN 'confirm' || upper(substr(md5(phrase), 1, 1)) || substr(md5(phrase), 2, 3) ELSE {_GENERATED.replace('text', 'phrase')} END AS key, n::BIGINT AS asked FROM phrases, (SELECT count(*) AS n FROM phrases)")
def keys_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch interface twice over: the second time every key comes from the cache, and nothing is asked."""
    folder = shared_folder(spark, "batch").removeprefix("file://")
    ai = {"enabled": True, "batch_size": 50, "cache": {"file_path": "cache.json"}}
    config = cfg.create_config({"key_generation": {"strategy": "ai", "ai": ai}, "ai_provider": {"api_key": "none"}}, folder)
    items, fast = phrases(spark).select(C("phrase").alias("text")), lambda: translate.Limiter(1e9)
    first = keeper(spark, "first")(application.generate_keys_batch(items, config=config, generator=_named, limiter=fast), "keys")

    def never(items: list[dict]) -> str:
        raise AssertionError("asked again")

    config.settings["key_generation"]["ai"]["fallback_to_semantic"] = False
    again = application.generate_keys_batch(items, config=config, generator=never, limiter=fast)
    return first.join(again.withColumnRenamed("key", "same"), "text").where("key = same").select("text", "key", F.count("*").over(Window.partitionBy(F.lit(0))).alias("asked"))


@query("SELECT conv_id, turn, text || '|{\"role\":\"' || role || '\"}' AS cache_key FROM conversations")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.cache_key(C("text"), F.struct("role")).alias("cache_key"))


@query(f"WITH {phrases_sql()}, {FACTS} SELECT ord, text || '|' || file || '|' || CASE WHEN ord % 2 = 0 THEN 'given' ELSE {type_sql('text')} END || '|' || 'component' AS item FROM texts")
def key_batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = text.batch_item(C("text"), C("file"), F.lit("component"), F.when(C("ord") % 2 == 0, "given"))
    parts = [item["text"], item["context"]["filePath"], item["context"]["textType"], item["context"]["fileType"]]
    return texts(spark, sf_dir).select("ord", F.concat_ws("|", *parts).alias("item"))


# --- scalar functions that no other query reaches


@query(f"SELECT doc_id, regexp_replace(text, '\\r?\\n[{SPACE}]*', '', 'g') AS said FROM documents")
def jsx_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.jsx_text(C("text")).alias("said"))


@query(f"SELECT conv_id, turn, {trim_sql('text')} AS body FROM conversations")
def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in a Markdown fence, with and without a language, or bare."""
    body, kind = text.js_trim(C("text")), F.pmod("conv_id", F.lit(3))
    fenced = F.when(kind == 0, F.concat(F.lit(" ```json\n"), body, F.lit("\n```\n"))).when(kind == 1, F.concat(F.lit("```\n"), body, F.lit("\n``` "))).otherwise(body)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.without_fence(fenced).alias("body"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority ELSE '' END AS said FROM orders")
def simple_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue values that are a text, a detail with a text, or neither."""
    kind = F.pmod("o_orderkey", F.lit(3))
    detail = F.when(kind == 1, F.struct(C("o_orderpriority").alias("text")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.simple_text(detail, F.when(kind == 0, C("o_orderstatus"))).alias("said"))


@query("SELECT n_nationkey, n_name || ',' || n_regionkey || ',x y' AS langs FROM nation")
def language_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    option = F.concat(F.lit(" ,"), "n_name", F.lit(" ,, "), "n_regionkey", F.lit(",x y,\t"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(text.language_list(option), ",").alias("langs"))


@query("SELECT n_nationkey, '[' || repeat('█', 20 * n_nationkey // 24) || repeat('░', 20 - 20 * n_nationkey // 24) || '] ' || printf('%.1f', n_nationkey * 100.0 / 24) || '% (' || n_nationkey || '/24)' AS progress, CASE WHEN n_nationkey = 0 THEN '0s' WHEN n_nationkey < 6 THEN (n_nationkey * 11) || 's' WHEN n_nationkey * 11 < 3600 THEN (n_nationkey * 11 // 60) || 'm ' || (n_nationkey * 11 % 60) || 's' END AS duration FROM nation")
def progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, display.format_progress(n, 24), display.format_duration(n * 11_000)) for n, _ in _nations(spark, sf_dir)]
    return spark.createDataFrame(rows, "n_nationkey int, progress string, duration string")


# --- configuration

_TARGETS = "CASE WHEN k % 4 = 0 THEN 'zh_CN,en_US' ELSE 'zh_CN,en_US,ja_JP' END"


@query(
    "WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT k, CASE WHEN k % 5 = 4 THEN 'error' ELSE " + _TARGETS + " END AS targets, CASE WHEN k % 5 <> 4 THEN '/locales/n' || k || '/en-US/ns.detail.json' END AS path,"
    " CASE WHEN k % 5 <> 4 THEN (4 + k % 5)::VARCHAR || ',6,semantic,10' END AS settings, CASE WHEN k % 5 <> 4 THEN 'gpt-4o-mini,Bearer k' || k || ',n' || k || ',' || k END AS request FROM n"
)
def config_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A configuration file for each nation: found, read, merged with the defaults, checked, and what it tells a provider."""
    out = []
    for n, _ in _nations(spark, sf_dir):
        with tempfile.TemporaryDirectory() as folder:  # configurations are the driver's own files
            user = {
                "locales_dir": f"locales/n{n}", "namespace": "ns", "key_generation": {"hash_length": 4 + n % 5 * (5 if n % 5 == 4 else 1)}, "ai_provider": {"api_key": f"k{n}", "headers": {"X-N": f"n{n}"}, "body": {"top_p": n}},
                "languages": {"targets": [" en_US", "", "en_US"] + ([] if n % 4 == 0 else ["ja_JP "])},
            }
            Path(folder, "i18n.config.json").write_text(json.dumps(user))
            try:
                c = cfg.load_config(folder)
            except ValueError:
                out.append((n, "error", None, None, None))
                continue
            keys, client = c["key_generation"], chat.ChatClient(c["ai_provider"])
            body, headers = client.body([]), client.headers()
            path = str(c.output_path("en_US", "detail")).removeprefix(str(Path(folder).absolute()))
            out.append((n, ",".join(c["languages"]["targets"]), path, f"{keys['hash_length']},{keys['max_semantic_length']},{keys['strategy']},{c['translation']['batch_size']}", f"{body['model']},{headers['Authorization']},{headers['X-N']},{body['top_p']}"))
    return spark.createDataFrame(out, "k int, targets string, path string, settings string, request string")


@query("SELECT event_id, 'base=1,k=' || json_extract_string(props, '$.k') || ',kept=' || event_type || ',list=3' AS merged FROM events")
def config_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's settings merged over the same base, as configurations are."""
    @F.pandas_udf("string")
    def merged(props: pd.Series, kinds: pd.Series) -> pd.Series:
        base = {"base": 1, "k": None, "in": {"kept": 0, "list": [1, 2]}}
        rows = []
        for p, kind in zip(props, kinds, strict=True):
            m = cfg.deep_merge(base, json.loads(p) | {"in": {"kept": kind, "list": [3], "base": cfg.UNDEFINED}, "base": cfg.UNDEFINED})
            rows.append(f"base={m['base']},k={m['k']},kept={m['in']['kept']},list={','.join(map(str, m['in']['list']))}")
        return pd.Series(rows, dtype=str)

    return table(spark, sf_dir, "events").select("event_id", merged("props", "event_type").alias("merged"))


@query("SELECT n_nationkey, coalesce(n_regionkey, 0)::BIGINT AS extracted, 0::BIGINT AS data_constants FROM nation")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "nation").select(C("n_nationkey").alias("file"), F.nullif(C("n_regionkey"), F.lit(0)).alias("extracted"), F.lit(None).cast("long").alias("data_constants"), F.lit(0).alias("skipped"), F.lit(None).cast("string").alias("error"))
    return report.file_stats(facts).select(C("file").alias("n_nationkey"), "extracted", "data_constants")
