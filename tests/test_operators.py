import datetime

import pytest
from pyspark.sql import functions as F

from glotspark.operators import aikeys, catalog, locales, report, translate

OCC = "file string, ord long, text string, vars array<string>"


@pytest.fixture(scope="module")
def keyed(spark):
    rows = [("src/pages/b/x.tsx", 0, "保存", []), ("src/pages/a/x.tsx", 1, "保存", []), ("src/pages/b/x.tsx", 1, "{a}好", ["a"]), ("src/pages/b/x.tsx", 2, "保存", None)]
    return catalog.with_keys(spark.createDataFrame(rows, OCC))


def test_first_file_owns_the_key(keyed):
    assert {r.key for r in keyed.where("text = '保存'").collect()} == {"a.action.保存_be5f"}


def test_catalogue_is_unique_and_without_collisions(keyed):
    rows = catalog.catalogue(keyed).collect()
    assert len({r.key for r in rows}) == len(rows) == 2
    assert not catalog.collisions(catalog.catalogue(keyed)).collect()


def test_collisions_over_occurrences(spark):
    df = spark.createDataFrame([("k", "x"), ("k", "y"), ("k", "x"), ("l", "x")], "key string, text string")
    assert [(r.key, r.texts) for r in catalog.collisions(df).collect()] == [("k", ["x", "y"])]


def test_reports(spark):
    df = spark.createDataFrame([("a.text.xx_1", 0), ("a.error.y_2", 1), ("b", 2), ("a.text.zz_3", 3)], "key string, ord long")
    assert report.key_report(df).first().asDict() == {"total": 4, "avg_key_length": 9, "longest_key": "a.text.xx_1", "shortest_key": "b"}
    assert report.key_report(df.limit(0)).first().asDict() == {"total": 0, "avg_key_length": 0, "longest_key": "", "shortest_key": ""}
    assert {r.context: r.n for r in report.by_context(df).collect()} == {"a": 3, "b": 1}
    assert {r.type: r.n for r in report.by_type(df).collect()} == {"text": 2, "error": 1}
    assert {(r.grain, r.context, r.type): r.n for r in report.grouping_report(df).collect()}[("total", None, None)] == 4


def test_warnings_page(spark):
    df = spark.createDataFrame([("b", "X", 2, None), ("a", "Y", None, "k")], "file string, name string, line int, intl_key string")
    page = report.warnings_markdown(df).splitlines()
    assert page[4:] == ["| a | Y | - | `k` |", "| b | X | 2 | - |"]
    assert "None found." in report.warnings_markdown(df.limit(0))


def test_merge_target(spark):
    new = spark.createDataFrame([("a", "甲", 0), ("b", "乙", 1), ("c", "丙", 2)], "key string, text string, ord long")
    old = spark.createDataFrame([("orphan", "o", 0), ("blank", " ", 1), ("b", "B", 2), ("c", "", 3)], "key string, value string, ord long")
    rows = locales.merge_target(new, old, "en").orderBy("part", "ord").collect()
    assert [(r.key, r.value) for r in rows] == [("orphan", "o"), ("b", "B"), ("a", ""), ("c", "")]
    assert [r.key for r in locales.new_keys(new, old).collect()] == ["a"]
    assert {r.key for r in locales.missing_entries(new, old).collect()} == {"a", "c"}
    assert locales.missing_entries(new, old, force=True).count() == 3
    assert [r.key for r in locales.merge_source(new, "zh", old, keep_existing=True).orderBy("key").collect()] == ["a", "b", "blank", "c", "orphan"]


def test_merge_is_idempotent(spark):
    new = spark.createDataFrame([("a", "甲", 0), ("b", "乙", 1)], "key string, text string, ord long")
    once = locales.merge_target(new, spark.createDataFrame([("b", "B", 0)], "key string, value string, ord long"), "en")
    twice = locales.merge_target(new, once.select("key", "value", "ord"), "en")
    assert sorted((r.key, r.value) for r in once.collect()) == sorted((r.key, r.value) for r in twice.collect())


SOURCE = [("greeting", "你好，{value0}", 0), ("ok", "好", 1), ("bye", "再见", 2)]


def run(spark, tmp_path, existing, translator, **how):
    source = spark.createDataFrame(SOURCE, "key string, text string, ord long")
    old = spark.createDataFrame(existing, "lang string, key string, value string")

    def keep(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    done = translate.translate(source, old, spark.createDataFrame([("en",)], "lang string"), translator, keep, **how)
    return {r.key: (r.value, r.source) for r in done.results.collect()}, done


def good(lang, entries):
    import json

    return "```json\n" + json.dumps({k: f"{lang}:{t}" for k, t in entries.items()}) + "\n```"


def test_only_missing_is_translated(spark, tmp_path):
    got, done = run(spark, tmp_path, [("en", "ok", "fine"), ("en", "bye", "")], good)
    assert got == {"greeting": ("en:你好，{value0}", "translated"), "ok": ("fine", "kept"), "bye": ("en:再见", "translated")}
    assert done.incomplete.count() == 0


def test_lost_placeholder_fails_the_batch(spark, tmp_path):
    got, done = run(spark, tmp_path, [], lambda lang, e: '{"greeting": "hi", "ok": "fine", "bye": "bye"}')
    assert set(got.values()) == {("", "failed")}
    assert {r.key: r.reason for r in done.quarantine.collect()}["greeting"] == "kinds"
    assert translate.failure_log(done.reconciled).first().failure_rate == "100.0%"


def test_lost_placeholder_falls_back(spark, tmp_path):
    old = [("en", "greeting", "Hi {value0}"), ("en", "ok", "o"), ("en", "bye", "b")]
    got, _ = run(spark, tmp_path, old, lambda lang, e: '{"greeting": "hi", "ok": "fine"}', force=True)
    assert got == {"greeting": ("Hi {value0}", "existing"), "ok": ("fine", "translated"), "bye": ("b", "existing")}


def test_unreadable_reply_is_quarantined(spark, tmp_path):
    got, done = run(spark, tmp_path, [], lambda lang, e: "no json", size=2)
    assert set(got.values()) == {("", "failed")}
    assert {r.raw_response for r in done.quarantine.collect()} == {"no json"}


def test_limiter():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    calls = iter([ValueError(), translate.RateLimited(7), "done"])

    def f():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    limit = translate.Limiter(20, 3, sleep, lambda: now[0])
    assert limit.call(f) == "done"
    assert waits == [1.0, 2.0, 7.0]
    with pytest.raises(ZeroDivisionError):
        translate.Limiter(1e9, 2, sleep, lambda: now[0]).call(lambda: 1 / 0)


def test_batches_are_the_same_however_they_are_numbered(spark, tmp_path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    df = spark.createDataFrame([(i, ["en", "de", None][i % 5 % 3]) for i in range(97)], "id long, lang string").repartition(7)
    want = sorted(map(str, catalog.batches(df, 10, ["id"], ["lang"]).collect()))
    assert sorted(map(str, catalog.batches(df, 10, ["id"], ["lang"], keep).collect())) == want


def test_preview(spark):
    df = spark.createDataFrame([(i, f"k{i}", "ab"[i % 2] if i < 30 else None) for i in range(32)], "i int, k string, g string")
    got = {r.g: (r.n, r.preview) for r in report.preview(df, "k", ["g"], "i", 3).collect()}
    assert got == {"a": (15, "k0, k2, k4..."), "b": (15, "k1, k3, k5..."), None: (2, "k30, k31")}


def test_keys_from_a_generator(spark, tmp_path):
    def keep(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    said = [("保存", "c1"), ("删除", "c2"), ("提交", "c3"), ("删除", "c2")]
    asked = spark.createDataFrame([(t, c, f"src/{i}.tsx", i) for i, (t, c) in enumerate(said)], "text string, cache_key string, file string, ord long").withColumn("request", aikeys.request_context(F.col("file")))
    cache = spark.createDataFrame([("c1", "save it"), ("c2", "?")], "cache_key string, key string")
    ask = lambda items: '["Delete Now"]' if items[0]["text"] == "删除" else "`submit form`"
    rows = aikeys.generate(aikeys.split(asked, cache), ask, keep, size=1)
    assert {(r.cache_key, r.key, r.origin) for r in rows.collect()} == {("c1", "saveIt", "cache"), ("c2", "deleteNow", "generated"), ("c3", "submitForm", "generated")}
    lost = aikeys.generate(aikeys.split(asked, cache), lambda items: "oops", keep, key_fallback=False)
    assert {(r.cache_key, r.key, r.origin) for r in lost.collect()} >= {("c1", "saveIt", "cache")}


def test_prompts():
    one = aikeys.prompt([{"text": "甲", "context": {"textType": "text", "area": None}}])
    assert one[1]["content"] == "text: 甲\ntextType: text"
    assert "JSON array" in aikeys.prompt([{"text": "甲"}, {"text": "乙"}])[0]["content"]
    assert "from zh to en" in translate.prompt("zh", "en", {})[0]["content"]


def test_cache_ttl(spark):
    now = datetime.datetime(2024, 1, 31)
    rows = [("a", "k", now), ("b", "k", datetime.datetime(2023, 12, 31)), ("c", "k", None)]
    cache = spark.createDataFrame(rows, "cache_key string, key string, ts timestamp")
    assert {r.cache_key for r in aikeys.live(cache, F.lit(now)).collect()} == {"a", "c"}
    assert aikeys.live(cache, F.lit(now), 0).count() == 3
