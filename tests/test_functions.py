import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glotspark.functions import icu, paths, text
from glotspark.functions.display import format_duration, format_progress
from glotspark.plans.phrases import phrases

# type, hash, semantic key and fallback key of each phrase
EXPECTED = """confirm 0947 确认删除吗_0947 confirm0947
confirm f5b5 是否保存修改_f5b5 confirmF5b5
success 3b10 保存成功_3b10 success3b10
success 23b6 提交成功_23b6 success23b6
success fad5 已完成_fad5 successFad5
error acf0 删除失败_acf0 errorAcf0
error 56e1 发生未知错误_56e1 error56e1
error 281b 不能为空_281b error281b
error d824 服务器错误_d824 errorD824
action be5f 保存_be5f actionBe5f
action 2f4a 删除_2f4a action2f4a
action 4e34 提交表单_4e34 action4e34
action 5b48 查看详情_5b48 action5b48
input 08b1 请输入用户名_08b1 input08b1
input e0a1 请选择日期_e0a1 inputE0a1
label 1409 系统设置_1409 label1409
label c104 用户名输入框_c104 labelC104
text a5e7 用户权限管理_a5e7 textA5e7
text b808 欢迎回来{v_b808 textVB808
text dcc6 列{col__dcc6 textColDcc6
text 7eb2 {a}与{a_7eb2 textAA7eb2
text 7ca4 VIP用户专_7ca4 textVip7ca4
text af4b 重量(g)_af4b textGAf4b
text 745e 很好_745e text745e""".splitlines()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_phrases(spark):
    c = F.col("phrase")
    rows = phrases(spark).orderBy("pid").select(text.text_type(c), text.hash_prefix(c), text.context_key(c, F.lit("common")), text.fallback_key(c)).collect()
    for row, said in zip(rows, EXPECTED, strict=True):
        kind, h, semantic, fallback = said.split(" ")
        assert tuple(row) == (kind, h, f"common.{kind}.{semantic}", fallback)


def test_hash_strategy(spark):
    assert one(spark, text.context_key(F.lit("保存成功"), F.lit("tips"), "hash", 6)).startswith("tips.3b10")


@pytest.mark.parametrize("raw,key", [('"save_success"', "saveSuccess"), ("{{input}} user-name", "inputUserName"), ("1st place", "stPlace"), ("ABCKey", "abckey"), ("saveHTMLFile", "saveHtmlfile"), ("保存", ""), ("", "")])
def test_sanitize(spark, raw, key):
    assert one(spark, text.sanitize_ai_key(F.lit(raw))) == key


def test_valid_keys(spark):
    keys = ["ok", "abc", "a" * 61, "", "save_success", "Save"]
    assert [one(spark, text.valid_ai_key(F.lit(k))) for k in keys] == [False, True, False, False, True, False]


@pytest.mark.parametrize("path,area,component,context,kind", [
    ("src/pages/orders/components/SummaryPanel.tsx", "orders", "SummaryPanel", "orders", "component"),
    ("src/components/Header/index.tsx", None, "Header", "common", "component"),
    ("src/pages/index.tsx", "index.tsx", None, "index.tsx", "component"),
    ("src/constants/status.ts", None, None, "status.ts", "constants"),
    ("a/data.tsx", None, None, "common", "data"), ("a/data.ts", None, None, "common", "data"), ("a/router/config.ts", None, None, "common", "router"), ("a/x.ts", None, None, "common", "utils"),
])
def test_paths(spark, path, area, component, context, kind):
    p = F.lit(path)
    row = spark.range(1).select(paths.context_info(p).alias("i"), paths.key_context(p).alias("c"), paths.file_type(p).alias("t")).first()
    assert (row.i.area, row.i.component, row.c, row.t) == (area, component, context, kind)


def test_lengths_and_trim(spark):
    assert one(spark, text.utf16_length(F.lit("😀a"))) == 3
    assert one(spark, text.js_trim(F.lit("　﻿ x  "))) == "x"
    assert one(spark, text.without_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, text.language_list(F.lit(" en, ,ja ,"))) == ["en", "ja"]
    assert one(spark, text.jsx_text(F.lit("a\r\n   b\n c"))) == "abc"


def test_reuse(spark):
    values = [None, "", "  ", "x"]
    assert [one(spark, text.reusable(F.lit(v).cast("string"))) for v in values] == [False, False, False, True]
    assert [one(spark, text.needs_translation(F.lit(v).cast("string"))) for v in values] == [True, True, True, False]
    assert one(spark, text.needs_translation(F.lit("x"), force=True))


def test_skip(spark):
    skip = F.array(F.lit("console"), F.lit("a.b"))
    named = [None, "console", "console.log", "consoles", "a.b", "a.b.c"]
    assert [one(spark, text.skipped_call(F.lit(n).cast("string"), skip)) for n in named] == [True, True, True, False, True, False]


ICU = [
    ("欢迎回来，{value0}", {"value0": 1}), ("{a}{a}", {"a": 2}), ("{{x}}", {"x": 1}), ("{ name }", {"name": 1}), ("{中文}", {}), ("{}", {}), ("{a", {}), ("{ok} {bad", {"ok": 1}), ("} {a}", {"a": 1}),
    ("{0}", {"0": 1}), ("{1a}", {}), ('{"k": 69}', {}), ("{d, date, short}", {"d": 1}), ("{g, select, male {他} other {她}}", {"g": 1}),
    ("{n, plural, offset:1 one {# {item}} other {{count} items}}", {"count": 1, "item": 1, "n": 1}), ("{n, plural, one {{n} x} other {{n} xs}}", {"n": 3}), ("{a, }", {"a": 1}),
]


def test_icu(spark):
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(ICU)] + [(99, None)], "i int, m string")
    rows = {r.i: {x.name: x.cnt for x in r.c} for r in df.select("i", icu.placeholders(F.col("m")).alias("c")).collect()}
    assert rows == {i: c for i, (_, c) in enumerate(ICU)} | {99: {}}


@given(st.lists(st.sampled_from(["{", "}", "a", "b1", "0", " ", ",", "文"]), max_size=12).map("".join))
@settings(max_examples=300, deadline=None)
def test_flat_messages_agree(message):
    import re

    if re.match(r"^[^{}]*(?:\{[^{},]*\}[^{}]*)*\Z", message):
        flat = re.findall(r"\{\s*([_A-Za-z][_A-Za-z0-9]*|[0-9]+)\s*\}", message)
        assert icu.placeholder_counts(message) == {n: flat.count(n) for n in flat}


def test_violations(spark):
    rows = [(1, "{a}", "{a}"), (2, "{a}", None), (3, "{a}", " "), (4, "{a}", "x"), (5, "{a}", "{b}"), (6, "{a}{a}", "{a}"), (7, "x", "y")]
    df = icu.judged(spark.createDataFrame(rows, "i int, o string, t string"), "o", "t")
    assert {r.i: r.reason for r in df.collect()} == {1: None, 2: "not_string", 3: "blank", 4: "kinds", 5: "missing:a", 6: "count:a", 7: None}


def test_display():
    assert [format_duration(x) for x in (0, 900, 61_000, 3_600_000)] == ["0s", "1s", "1m 1s", "1h 0m 0s"]
    assert format_progress(1, 4, 4) == "[█░░░] 25.0% (1/4)"
    assert format_progress(0, 0, 2) == "[██] 100.0% (0/0)"
