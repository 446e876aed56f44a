"""Queries over the driver's tables, and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.functions import icu, paths, text
from glotspark.operators import aikeys, catalog, locales, report, translate
from glotspark.plans import round_trips as round_trips
from glotspark.plans import statements as statements
from glotspark.plans.basics import FACTS, ORACLE_SQL, QUERIES, C, N, key_sql, query, semantic_sql, table, texts, trim_sql, type_sql
from glotspark.plans.phrases import PHRASES, phrases, phrases_sql
from glotspark.sources import tsx
from glotspark.sources.shared import keeper

def _catalogue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' catalogue: key, ord; the first document of a text defines its key."""
    docs = table(spark, sf_dir, "documents").select(C("source").alias("file"), C("doc_id").alias("ord"), "text")
    return catalog.first_keys(docs, text.context_key(C("text"), C("file")), ["ord"])


_CATALOGUE = f"catalogue AS (SELECT {key_sql('text', 'source')} AS key, text, doc_id AS ord FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1)"
_KEYS = _CATALOGUE + ", parts AS (SELECT key, ord, string_split(key, '.') AS p FROM catalogue)"

# --- scalar functions -------------------------------------------------------------------------


@query(f"WITH {_CATALOGUE} SELECT split_part(key, '.', 1) AS context, count(*)::BIGINT AS n_keys, count(DISTINCT key)::BIGINT AS n_distinct, min(key) AS first_key FROM catalogue GROUP BY 1")
def key_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _catalogue_rows(spark, sf_dir)
    return rows.groupBy(report.key_context(C("key")).alias("context")).agg(F.count("*").alias("n_keys"), F.countDistinct("key").alias("n_distinct"), F.min("key").alias("first_key"))


@query("SELECT doc_id, regexp_matches(text, '[^\\x00-\\x7F]') AS non_ascii, regexp_matches(text, '[一-龥]') AS cjk FROM documents")
def script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.contains_cjk(C("text"), "[^\\x00-\\x7F]").alias("non_ascii"), text.contains_cjk(C("text")).alias("cjk"))


@query(f"WITH {phrases_sql()}, {FACTS} SELECT {type_sql('text')} AS type, count(*)::BIGINT AS n FROM texts GROUP BY 1")
def text_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).groupBy(text.text_type(C("text")).alias("type")).agg(F.count("*").alias("n"))


@query(f"WITH {phrases_sql()} SELECT doc_id AS id, {semantic_sql('text', 20)} AS semantic FROM documents UNION ALL SELECT -1 - pid, {semantic_sql('phrase', 6)} FROM phrases")
def semantic_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(C("doc_id").alias("id"), text.semantic(C("text"), 20).alias("semantic"))
    return docs.unionByName(phrases(spark).select((-1 - C("pid")).cast("long").alias("id"), text.semantic(C("phrase")).alias("semantic")))


@query("SELECT doc_id, source || '.' || substr(md5(text), 1, 4) AS key, substr(md5(text), 1, 8) AS long_hash FROM documents")
def hash_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.context_key(C("text"), C("source"), "hash").alias("key"), text.hash_prefix(C("text"), 8).alias("long_hash"))


@query(f"WITH {phrases_sql()}, {FACTS} SELECT ord, {key_sql('text', chr(39) + 'common' + chr(39))} AS key FROM texts")
def semantic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("ord", text.context_key(C("text"), F.lit("common")).alias("key"))


_PATHS = "paths AS (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*', 'src/pages') AS path FROM pages UNION ALL SELECT -1 - i, p FROM (VALUES (0, 'src/pages/orders/components/SummaryPanel.tsx'), (1, 'src/components/Header/index.tsx'), (2, 'a/data.tsx'), (3, 'a/router/config.ts'), (4, 'src/constants/status.ts'), (5, 'a/x.ts'), (6, 'src/hooks/useX.ts'), (7, 'a/data.ts'), (8, 'x/menuData.ts')) t(i, p))"
_MORE_PATHS = ["src/pages/orders/components/SummaryPanel.tsx", "src/components/Header/index.tsx", "a/data.tsx", "a/router/config.ts", "src/constants/status.ts", "a/x.ts", "src/hooks/useX.ts", "a/data.ts", "x/menuData.ts"]


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://[^/]*", "src/pages").alias("path"))
    return pages.unionByName(spark.createDataFrame([(-1 - i, p) for i, p in enumerate(_MORE_PATHS)], "page_id long, path string"))


@query(
    f"WITH {_PATHS}, named AS (SELECT *, regexp_replace(list_extract(string_split(path, '/'), -1), '\\.(tsx?|jsx?)$', '') AS name FROM paths) SELECT page_id, nullif(regexp_extract(path, 'pages/([^/]+)', 1), '') AS area,"
    " CASE WHEN regexp_matches(name, '^[A-Z]') THEN name ELSE nullif(regexp_extract(path, 'components/([^/]+)', 1), '') END AS component,"
    " CASE WHEN regexp_matches(path, 'pages/[^/]+') THEN regexp_extract(path, 'pages/([^/]+)', 1) WHEN contains(path, 'components/') OR contains(path, 'hooks/') THEN 'common'"
    " WHEN regexp_matches(path, 'constants/[^/]+') THEN regexp_extract(path, 'constants/([^/]+)', 1) ELSE 'common' END AS context FROM named"
)
def path_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = paths.context_info(C("path"))
    return _paths(spark, sf_dir).select("page_id", info["area"].alias("area"), info["component"].alias("component"), paths.key_context(C("path")).alias("context"))


@query(
    f"WITH {_PATHS} SELECT page_id, CASE WHEN ends_with(path, '.tsx') AND NOT contains(path, '/data.ts') THEN 'component' WHEN contains(path, '/data.ts') THEN 'data' WHEN contains(path, '/router/config') THEN 'router'"
    " WHEN contains(path, '/constants/') THEN 'constants' ELSE 'utils' END AS file_type, regexp_matches(path, '/(data|constants|.*Data)\\.tsx?$') OR contains(path, '/router/config') AS is_data FROM paths"
)
def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("page_id", paths.file_type(C("path")).alias("file_type"), paths.data_config_file(C("path")).alias("is_data"))


_CODES = ["zh_CN", "en_US", "ja-JP", "pt_BR", "", "zh_Hant_TW", " fr_FR"]


@query(
    f"WITH codes AS (SELECT doc_id, list_extract({_CODES!r}, 1 + doc_id % {len(_CODES)}) AS code FROM documents), first AS (SELECT *, regexp_replace(code, '_', '-') AS once FROM codes)"
    f" SELECT doc_id, CASE WHEN code = '' THEN 'zh-CN' ELSE {trim_sql('once')} END AS locale, CASE WHEN contains(code, '-') THEN code ELSE once END AS normal,"
    f" regexp_replace(CASE WHEN code = '' THEN 'zh-CN' ELSE {trim_sql('once')} END, '_', '-') AS default_code FROM first"
)
def locale_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (1 + F.pmod("doc_id", F.lit(len(_CODES)))).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    return docs.select("doc_id", text.to_locale(C("code")).alias("locale"), text.normalize_locale(C("code")).alias("normal"), text.default_locale_code(C("code")).alias("default_code"))


# --- catalogue --------------------------------------------------------------------------------


@query(
    "WITH said AS (SELECT text, 'documents' AS file, doc_id AS ord FROM documents UNION ALL SELECT text, 'conversations', conv_id * 1000 + turn FROM conversations),"
    " placed AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY file, ord) AS rn FROM said)"
    " SELECT file, ord, md5(text) AS digest FROM placed WHERE rn = 1"
)
def key_reuse_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", F.lit("documents").alias("file"), C("doc_id").alias("ord"))
    said = docs.unionByName(table(spark, sf_dir, "conversations").select("text", F.lit("conversations").alias("file"), (C("conv_id") * 1000 + C("turn")).alias("ord")))
    return catalog.first_wins(said, ["text"], ["file", "ord"]).select("file", "ord", F.md5("text").alias("digest"))


@query(f"WITH {phrases_sql()}, {FACTS}, placed AS (SELECT *, first_value(file) OVER (PARTITION BY text ORDER BY file, ord) AS owner FROM texts) SELECT ord, {key_sql('text', 'regexp_extract(owner, ' + chr(39) + 'pages/([^/]+)' + chr(39) + ', 1)')} AS key FROM placed")
def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = texts(spark, sf_dir).withColumn("vars", F.array().cast("array<string>"))
    return catalog.with_keys(rows).select("ord", "key")


@query("WITH placed AS (SELECT doc_id, substr(md5(text), 1, 3) AS key, row_number() OVER (PARTITION BY substr(md5(text), 1, 3) ORDER BY doc_id DESC) AS rn FROM documents) SELECT key, doc_id AS ord FROM placed WHERE rn = 1")
def key_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(text.hash_prefix(C("text"), 3).alias("key"), C("doc_id").alias("ord"))
    return catalog.last_wins(rows, ["key"], ["ord"])


@query("SELECT substr(md5(text), 1, 4) AS key, array_to_string(list_sort(list(DISTINCT md5(text))), ',') AS digests FROM documents GROUP BY 1 HAVING count(DISTINCT text) > 1")
def key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(text.hash_prefix(C("text")).alias("key"), F.md5("text").alias("text"))
    return catalog.collisions(rows).select("key", F.array_join("texts", ",").alias("digests"))


@query("SELECT key, count(*)::BIGINT AS n FROM (SELECT DISTINCT substr(md5(text), 1, 4) AS key FROM documents) GROUP BY 1 HAVING count(*) > 1")
def catalogue_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(text.hash_prefix(C("text")).alias("key"), F.md5("text").alias("text"), C("doc_id").alias("ord"))
    return catalog.collisions(catalog.last_wins(rows, ["key"], ["ord"])).select("key", F.size("texts").cast("long").alias("n"))


@query("WITH a AS (SELECT l_orderkey AS file, l_linenumber AS start, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT b.l_orderkey AS file, b.l_linenumber AS start, b.l_partkey AS part, a.file * 10 + a.start AS key FROM a JOIN lineitem b ON a.file = b.l_orderkey AND a.start = b.l_linenumber")
def position_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = [F.lit(0).alias("end"), F.lit("string").alias("kind")]
    lines = table(spark, sf_dir, "lineitem")
    a = lines.select(C("l_orderkey").alias("file"), C("l_linenumber").alias("start")).distinct().select("file", "start", *same, (C("file") * 10 + C("start")).alias("key"))
    b = lines.select(C("l_orderkey").alias("file"), C("l_linenumber").alias("start"), C("l_partkey").alias("part"), *same)
    return catalog.position_join(a, b).select("file", "start", "part", "key")


# --- reports ----------------------------------------------------------------------------------


@query(f"WITH {_CATALOGUE} SELECT count(*)::BIGINT AS total, floor(sum(length(key)) / count(*) + 0.5)::BIGINT AS avg_key_length, arg_max(key, length(key) * 1000000000 - ord) AS longest_key, arg_min(key, length(key) * 1000000000 + ord) AS shortest_key FROM catalogue")
def key_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.key_report(_catalogue_rows(spark, sf_dir))


@query(f"WITH {_CATALOGUE} SELECT split_part(key, '.', 1) AS context, count(*)::BIGINT AS n FROM catalogue GROUP BY 1")
def keys_by_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_context(_catalogue_rows(spark, sf_dir))


@query(f"WITH {_KEYS} SELECT split_part(p[2], '_', 1) AS type, count(*)::BIGINT AS n FROM parts WHERE len(p) >= 2 GROUP BY 1")
def keys_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.by_type(_catalogue_rows(spark, sf_dir))


@query(
    f"WITH {_KEYS}, r AS (SELECT p[1] AS context, CASE WHEN len(p) >= 2 THEN split_part(p[2], '_', 1) END AS type FROM parts)"
    " SELECT CASE grouping(context, type) WHEN 1 THEN 'context' WHEN 2 THEN 'type' ELSE 'total' END AS grain, context, type, count(*)::BIGINT AS n FROM r GROUP BY GROUPING SETS ((context), (type), ())"
)
def report_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.grouping_report(_catalogue_rows(spark, sf_dir))


@query(
    "WITH f AS (SELECT l_orderkey AS file, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS x, sum(CASE WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 1 ELSE 0 END) AS d, max(CASE WHEN l_quantity = 50 THEN 'bad' END) AS e FROM lineitem GROUP BY 1)"
    " SELECT count(*)::BIGINT AS total_files, count(*) FILTER (x > 0 OR d > 0)::BIGINT AS changed_files, sum(x)::BIGINT AS total_extracted, sum(d)::BIGINT AS total_data_constants, count(e)::BIGINT AS errors FROM f"
)
def extraction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = table(spark, sf_dir, "lineitem").groupBy(C("l_orderkey").alias("file")).agg(
        F.count_if(C("l_returnflag") == "R").alias("extracted"), F.count_if((C("l_linestatus") == "O") & (C("l_returnflag") == "A")).alias("data_constants"), F.max(F.when(C("l_quantity") == 50, "bad")).alias("error")
    )
    return report.summary(stats)


@query("SELECT 'f' || lpad((l_orderkey % 100)::VARCHAR, 3, '0') AS file, l_linenumber AS line, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 ORDER BY 1, 2")
def warnings_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("f"), F.lpad(F.pmod("l_orderkey", F.lit(100)).cast("string"), 3, "0")).alias("file"), C("l_linenumber").alias("line"))
    return report.warnings(rows.agg(F.count("*").alias("n")))


@query("SELECT event_type, printf('%.1f', count(*) FILTER (value < 20) * 100.0 / count(*)) || '%' AS failure_rate FROM events GROUP BY 1")
def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(report.failure_rate(F.count_if(C("value") < 20), F.count("*")).alias("failure_rate"))


@query("WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, n::BIGINT AS n, string_agg('e' || event_id, ', ' ORDER BY event_id) || CASE WHEN max(n) > 5 THEN '...' ELSE '' END AS preview FROM r WHERE rn <= 5 GROUP BY event_type, n")
def missing_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat(F.lit("e"), "event_id").alias("key"))
    return report.preview(rows, "key", ["event_type"], "event_id")


# --- locales ----------------------------------------------------------------------------------

# current keys: all orders; existing entries: all orders, numbered 1000 further on, every third blank, every seventh null
_LOCALE = (
    "current AS (SELECT 'k' || ord AS key, text, ord FROM texts),"
    " existing AS (SELECT 'k' || (ord + 1000) AS key, CASE WHEN ord % 7 = 0 THEN NULL WHEN ord % 3 = 0 THEN ' ' ELSE translated END AS value, ord FROM texts)"
)
_REUSABLE = f"coalesce({trim_sql('e.value')} <> '', false)"


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select(F.concat(F.lit("k"), "ord").alias("key"), "text", "ord")


def _existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(C("ord") % 7 == 0, F.lit(None)).when(C("ord") % 3 == 0, F.lit(" ")).otherwise(C("translated"))
    return texts(spark, sf_dir).select(F.concat(F.lit("k"), C("ord") + 1000).alias("key"), value.alias("value"), "ord")


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT 'zh-CN' AS locale, key, text AS value, ord FROM current")
def locale_merge_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.merge_source(_current(spark, sf_dir), "zh-CN")


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT 'en-US' AS locale, coalesce(c.key, e.key) AS key, CASE WHEN {_REUSABLE} THEN e.value ELSE '' END AS value, CASE WHEN {_REUSABLE} THEN 0 ELSE 1 END AS part, CASE WHEN {_REUSABLE} THEN e.ord ELSE c.ord END AS ord FROM existing e FULL JOIN current c ON c.key = e.key WHERE c.key IS NOT NULL OR {_REUSABLE}")
def locale_merge_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.merge_target(_current(spark, sf_dir), _existing(spark, sf_dir), "en-US")


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT count(*)::BIGINT AS n FROM current c ANTI JOIN existing e ON c.key = e.key")
def new_key_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.new_keys(_current(spark, sf_dir), _existing(spark, sf_dir)).agg(F.count("*").alias("n"))


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT c.key, c.text, c.ord, e.value AS existing FROM current c LEFT JOIN existing e ON c.key = e.key WHERE NOT {_REUSABLE}")
def missing_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.missing_entries(_current(spark, sf_dir), _existing(spark, sf_dir))


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT c.key, c.text, c.ord, e.value AS existing FROM current c LEFT JOIN existing e ON c.key = e.key")
def missing_entries_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.missing_entries(_current(spark, sf_dir), _existing(spark, sf_dir), force=True)


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT coalesce(c.key, e.key) AS key, coalesce(e.value, '') AS value FROM existing e FULL JOIN current c ON c.key = e.key")
def result_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.seeded(_current(spark, sf_dir), _existing(spark, sf_dir))


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT c.key, c.text, c.ord FROM current c LEFT JOIN existing e ON c.key = e.key WHERE coalesce(e.value, '') = ''")
def completeness_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.incomplete(_current(spark, sf_dir), _existing(spark, sf_dir))


@query(f"WITH {phrases_sql()}, {FACTS}, {_LOCALE} SELECT key, text, ord, lang FROM current, (VALUES ('en-US'), ('ja-JP'), ('fr-FR')) l(lang)")
def language_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = spark.createDataFrame([("en-US",), ("ja-JP",), ("fr-FR",)], "lang string")
    return locales.fan_out(_current(spark, sf_dir), langs)


@query("WITH asked AS (SELECT DISTINCT lang FROM documents) SELECT lang FROM asked WHERE lang NOT IN ('en', 'de')")
def unknown_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locales.unknown_languages(table(spark, sf_dir, "documents").select("lang").distinct(), spark.createDataFrame([("en",), ("de",)], "lang string"))


# --- translation ------------------------------------------------------------------------------


@query("SELECT doc_id, lang, ((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 10)::BIGINT AS batch_id FROM documents")
def translation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.batches(table(spark, sf_dir, "documents").select("doc_id", "lang"), 10, ["doc_id"], ["lang"], keeper(spark, "batches"))


_VARS = "list_sort(list_transform(list_distinct(regexp_extract_all({0}, '\\{{\\s*([_A-Za-z][_A-Za-z0-9]*|[0-9]+)\\s*\\}}', 1)), lambda n: n || '=' || len(list_filter(regexp_extract_all({0}, '\\{{\\s*([_A-Za-z][_A-Za-z0-9]*|[0-9]+)\\s*\\}}', 1), lambda x: x = n))))"


@query(f"WITH {phrases_sql()}, said AS (SELECT event_id, phrase || ' ' || props || ' {{' || event_type || '}}' AS m FROM events JOIN phrases ON pid = event_id % {N}) SELECT event_id, array_to_string({_VARS.format('m')}, ',') AS counts FROM said")
def placeholder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.pmod("event_id", F.lit(N)).cast("int").alias("pid")).join(F.broadcast(phrases(spark)), "pid")
    message = F.concat("phrase", F.lit(" "), "props", F.lit(" {"), "event_type", F.lit("}"))
    said = rows.select("event_id", icu.placeholders(message).alias("c"))
    return said.select("event_id", F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("="), x["cnt"].cast("string"))), ",").alias("counts"))


_ANSWER = "CASE WHEN ord % 11 = 0 THEN NULL WHEN ord % 13 = 0 THEN '' ELSE translated END"
_REQUESTS = (
    f"asked AS (SELECT 'k' || ord AS key, text, CASE WHEN ord % 2 = 0 THEN 'old' END AS existing, ((row_number() OVER (ORDER BY ord) - 1) // 10)::BIGINT AS batch_id, ord % 17 = 0 AS lost, {_ANSWER} AS answer FROM texts),"
    f" judged AS (SELECT *, CASE WHEN lost THEN 'absent' WHEN answer IS NULL THEN 'not_string' WHEN {trim_sql('answer')} = '' THEN 'blank'"
    f" WHEN len({_VARS.format('text')}) <> len({_VARS.format('answer')}) THEN 'kinds' WHEN {_VARS.format('text')} <> {_VARS.format('answer')} THEN 'other' END AS reason FROM asked),"
    " marked AS (SELECT *, bool_or(reason IS NOT NULL AND coalesce(existing, '') = '') OVER (PARTITION BY batch_id) AS failed FROM judged)"
)


@query(f"WITH {phrases_sql()}, {FACTS}, {_REQUESTS} SELECT key, batch_id, reason, failed AS batch_failed, CASE WHEN NOT failed AND reason IS NULL THEN answer ELSE existing END AS value, CASE WHEN NOT failed AND reason IS NULL THEN 'translated' WHEN failed THEN 'failed' ELSE 'existing' END AS source FROM marked")
def reconcile_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir).select("key", "batch_id", "reason", "batch_failed", "value", "source")


def _reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = texts(spark, sf_dir).withColumn("lang", F.lit("en-US"))
    rows = catalog.batches(said, 10, ["ord"], ["lang"], keeper(spark, "reconcile")).withColumn("key", F.concat(F.lit("k"), "ord"))
    asked = rows.select("lang", "batch_id", "key", "text", F.when(C("ord") % 2 == 0, "old").alias("existing"))
    answer = F.when(C("ord") % 11 == 0, F.lit(None)).when(C("ord") % 13 == 0, F.lit("")).otherwise(C("translated"))
    answers = rows.where("ord % 17 <> 0").select("lang", "batch_id", "key", answer.alias("value"))
    return translate.reconcile(asked, answers, counts=icu.flat_placeholders)


@query(
    f"WITH {phrases_sql()}, {FACTS} SELECT ord, CASE WHEN {trim_sql('translated')} = '' THEN 'blank' WHEN len({_VARS.format('text')}) <> len({_VARS.format('translated')}) THEN 'kinds' WHEN {_VARS.format('text')} <> {_VARS.format('translated')} THEN 'other' END AS reason FROM texts"
)
def placeholder_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return icu.judged(texts(spark, sf_dir), "text", "translated").select("ord", "reason")


#: Messages in which @ stands for a name, and the variables that they hold: counted over all branches.
_MESSAGES = [
    ("{@} and {b}, {@}", "@=2,b=1"),
    ("{n, plural, one {# {@}} other {{count} items}}", "@=1,count=1,n=1"),
    ("{g, select, male {x} female {{@}} other {{n}}}", "@=1,g=1,n=1"),
    ("{n, plural, offset:1 =0 {none} one {{@, number}} other {{g, select, a {{@}} other {b}}}}", "@=2,g=1,n=1"),
    ("{d, date, short} {t, time} {@, number, integer}", "@=1,d=1,t=1"),
    ("one name, ({@}) and text", "@=1"),
    ("{@", ""),
]


@query(
    "WITH forms(i, counts) AS (VALUES {}) SELECT event_id, array_to_string(list_sort(string_split(replace(counts, '@', event_type), ',')), ',') AS counts FROM events JOIN forms ON i = event_id % {}".format(
        ", ".join(f"({i}, '{c}')" for i, (_, c) in enumerate(_MESSAGES)), len(_MESSAGES)
    )
)
def icu_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plural, select and typed forms around each event's type."""
    forms = F.array(*[F.lit(m) for m, _ in _MESSAGES])
    message = F.replace(F.element_at(forms, (F.pmod("event_id", F.lit(len(_MESSAGES))) + 1).cast("int")), F.lit("@"), C("event_type"))
    counts = F.transform(icu.placeholders(message), lambda x: F.concat(x["name"], F.lit("="), x["cnt"].cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.array_sort(counts), ",").alias("counts"))


# --- keys from a generator ---------------------------------------------------------------------

_CAMEL = (
    "cleaned AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace({trim}, '[`''\"“”‘’]', '', 'g'), '\\{{\\{{|\\}}\\}}', ' ', 'g'), '[\\[\\]()]', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g') AS c FROM raws),"
    " cut AS (SELECT *, list_filter(regexp_split_to_array(c, '[^a-zA-Z0-9]+'), lambda x: x <> '') AS p FROM cleaned),"
    " joined AS (SELECT *, regexp_replace(coalesce(array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN lower(x) ELSE upper(substr(x, 1, 1)) || lower(substr(x, 2)) END), ''), ''), '^[^a-zA-Z]+', '') AS j FROM cut),"
    " keys AS (SELECT *, lower(substr(j, 1, 1)) || substr(j, 2) AS key FROM joined)"
).format(trim=trim_sql("raw"))
_VALID = "(regexp_matches(key, '^[a-z][a-zA-Z0-9]*(_[a-zA-Z0-9]+)*$') AND length(key) BETWEEN 3 AND 60)"


@query(f"WITH raws AS (SELECT conv_id, turn, text AS raw FROM conversations), {_CAMEL} SELECT conv_id, turn, key, {_VALID} AS valid FROM keys")
def sanitized_ai_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.normalized_ai_key(C("text")).alias("k"))
    return rows.select("conv_id", "turn", C("k.sanitized").alias("key"), C("k.valid").alias("valid"))


_FALLBACK = f"raws AS (SELECT ord, text, {type_sql('text')} || '.' || {semantic_sql('text', 6)} || '_' || substr(md5(text), 1, 4) AS raw FROM texts), {_CAMEL}, named AS (SELECT ord, text, CASE WHEN {_VALID} THEN key ELSE 'auto' || substr(md5(text), 1, 4) END AS key FROM keys)"


@query(f"WITH {phrases_sql()}, {FACTS}, {_FALLBACK} SELECT ord, key FROM named")
def fallback_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).select("ord", text.fallback_key(C("text")).alias("key"))


@query("SELECT event_id AS cache_id, 'Key' || event_id AS key FROM events WHERE (SELECT max(ts) FROM events) - ts < INTERVAL 5 DAY")
def cache_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").cast("timestamp").alias("now"))
    cache = events.select(C("event_id").alias("cache_id"), F.concat(F.lit("Key"), "event_id").alias("key"), C("ts").cast("timestamp").alias("ts")).crossJoin(F.broadcast(now))
    return aikeys.live(cache, C("now"), 5).select("cache_id", "key")


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN 'key' || d.doc_id END AS cached FROM documents d")
def cache_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "documents").select("doc_id", C("doc_id").cast("string").alias("cache_key"))
    cache = asked.where("doc_id % 2 = 0").select("cache_key", F.concat(F.lit("Key "), "cache_key").alias("key"))
    return aikeys.split(asked, cache).select("doc_id", "cached")


@query("SELECT event_id, event_type IS NULL OR event_type IN ('click', 'view') OR starts_with(event_type || '.x', 'error.') AS skipped FROM events")
def skip_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(C("event_type") == "error", "error.x").otherwise(C("event_type"))
    skip = F.array(F.lit("click"), F.lit("view"), F.lit("error"))
    return table(spark, sf_dir, "events").select("event_id", text.skipped_call(name, skip).alias("skipped"))


# --- sources ----------------------------------------------------------------------------------

_SOURCES = f"lines AS (SELECT c_custkey, k, phrase FROM customer, (VALUES (0), (1), (2)) t(k) JOIN phrases ON pid = (c_custkey + k) % {N})"


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small source file for each customer, with three of the phrases."""
    names = F.array(*[F.lit(p) for p, _ in PHRASES])
    said = lambda k: F.element_at(names, (F.pmod(C("c_custkey") + k, F.lit(N)) + 1).cast("int"))
    content = F.concat(F.lit("export const TITLE = '"), said(0), F.lit("'\nconsole.log('"), said(1), F.lit("')\nf(a < b ? '"), said(2), F.lit("' : 'x')\n"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit(".ts")).alias("file"), content.alias("content"))


@query(f"WITH {phrases_sql()}, {_SOURCES} SELECT 'c' || c_custkey || '.ts' AS file, k::BIGINT AS ord, phrase AS text, 'string' AS kind, (k + 1)::INTEGER AS line FROM lines")
def tsx_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsx.occurrences(_sources(spark, sf_dir)).where("kind <> 'top-level'").select("file", "ord", "text", "kind", "line")


@query(f"WITH {phrases_sql()}, {_SOURCES} SELECT 'c' || c_custkey || '.ts' AS file, 'TITLE' AS name, phrase AS text, 1::INTEGER AS line FROM lines WHERE k = 0")
def tsx_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsx.occurrences(_sources(spark, sf_dir)).where("kind = 'top-level'").select("file", "name", "text", "line")


@query(
    f"WITH {phrases_sql()}, {_SOURCES}, hashed AS (SELECT *, substr(md5(phrase), 1, 4) AS h FROM lines) SELECT 'c' || c_custkey || '.ts' AS file, 2::BIGINT AS n_replaced,"
    " 'import intl from ''react-intl-universal'';' || chr(10) || 'export const TITLE = intl.get(''common.' || max(h) FILTER (k = 0) || ''')' || chr(10) || 'console.log(''' || max(phrase) FILTER (k = 1) || ''')' || chr(10)"
    " || 'f(a < b ? intl.get(''common.' || max(h) FILTER (k = 2) || ''') : ''x'')' || chr(10) AS code FROM hashed GROUP BY c_custkey"
)
def tsx_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _sources(spark, sf_dir)
    found = tsx.occurrences(files).where("kind <> 'top-level'")
    keyed = catalog.with_keys(found, "hash", F.lit("common"))
    return tsx.rewritten(files, keyed.select("file", "text", "key")).select("file", "code", "n_replaced")


@query(
    f"WITH {phrases_sql()}, {FACTS}, {_REQUESTS} SELECT 'en-US' AS lang, count(*)::BIGINT AS attempted, count(*) FILTER (failed)::BIGINT AS failed, printf('%.1f', count(*) FILTER (failed) * 100.0 / count(*)) || '%' AS failure_rate,"
    " array_to_string(list_sort(list(DISTINCT reason) FILTER (failed AND reason IS NOT NULL)), ',') AS reasons FROM marked"
)
def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return translate.failure_log(_reconciled(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


__all__ = ["ORACLE_SQL", "QUERIES"]
