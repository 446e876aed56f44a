import json
import re

import pytest

from glotspark import config as cfg
from glotspark.operators import translate
from glotspark.plans import application
from glotspark.sources import chat, files, tsx

ORDERS = """import { Table } from './ui';

const stages = ['待付款', 'paid', 7];

export const OrderList = ({ order, rows }) => {
  const fields = useMemo(() => rows.map((r) => ({ label: `金额：${r.total}`, hint: r.late ? '已逾期' : '准时' })), [rows]);
  const send = () => notify.open('已发货');
  return (
    <section>
      <h2 title='订单标题'>{'我的订单'}</h2>
      <em>共 {rows.length} 笔</em>
      <button onClick={send}>立即发货</button>
      {/* 不显示 */}
      {fields.map((f) => <i key={f.label}>{f.hint + '（' + order.code + '）号'}</i>)}
    </section>
  );
};
"""
ORDER_TEXTS = ["待付款", "金额：{r_total}", "已逾期", "准时", "已发货", "订单标题", "我的订单", "共 {rows_length} 笔", "立即发货", "{f_hint}（{order_code}）号"]


def texts(source, **how):
    return [x[0] for x in tsx.extract(source, **how)[0]]


def test_a_component():
    assert texts(ORDERS) == ORDER_TEXTS


@pytest.mark.parametrize("source,expected", [
    ("const a = '前' + name + '后'", ["前{name}后"]),
    ("f('甲' + '乙')", []),
    ("f(a.b + '文' + g(1) + c[0])", ["{a_b}文{value1}{c_0_}"]),
    ("x = ('前' + a) + '后'", ["前{a}后"]),
    ("intl.get('中文', {a}) + b; intl.getHTML('中文')", []),
    ("a < b && '是'", ["是"]),
    ("const r = /中文'/g; f('在')", ["在"]),
    ("const f = <T,>(x: T) => '泛型'", ["泛型"]),
    ("<a title='题' {...p}>文&amp;本</a>", ["题", "文&本"]),
    ("'\\u4e2d\\x41'", ["中A"]),
    ("// '注释'\n/* '注释' */ 1", []),
    ("`外${`内${x}`}`", ["外{value0}", "内{x}"]),
])
def test_rules(source, expected):
    assert texts(source) == expected


REWRITES = [
    ("f('甲')", "f(intl.get('k'))"),
    ("console.log('甲'); g()('甲')", None),
    ("const a = '甲' + n + '乙'", "const a = intl.get('k', { n })"),
    ("const o = { title: '甲', '甲': 1 }", "const o = { get title() { return intl.get('k') }, '甲': 1 }"),
    ("() => { return { t: '甲' } }", "() => { return { t: intl.get('k') } }"),
    ("<a b='甲'>  甲\n</a>", "<a b={intl.get('k')}>  {intl.get('k')}\n</a>"),
    ("`甲${a.b}`", "intl.get('k', { a_b: a.b })"),
    ("switch (x) { case '甲': y }", None),
    ("f(t('甲'), import('甲'))", None),
    ("enum E { A = '甲' }", None),
    ("const f = () => [{ t: '甲' }], o = { t: '甲' }", "const f = () => [{ t: intl.get('k') }], o = { get t() { return intl.get('k') } }"),
]


@pytest.mark.parametrize("source,expected", REWRITES)
def test_rewrite(source, expected):
    keys = {x[0]: "k" for x in tsx.extract(source)[0]}
    new, n, _ = tsx.rewrite(source, keys)
    assert new == (source if expected is None else "import intl from 'react-intl-universal';\n" + expected)
    assert tsx.rewrite(new, keys) == (new, 0, 0)


def test_rewrite_imports():
    assert tsx.rewrite("import intl from 'x'\nf('甲')", {"甲": "k"})[0] == "import intl from 'x'\nf(intl.get('k'))"
    assert "const intl = i18n;" in tsx.rewrite("import i18n from 'react-intl-universal';\nf('甲')", {"甲": "k"})[0]


def test_top_level_constants():
    tops = tsx.extract("import a from 'b'\nexport const TITLE = '标题'\nconst X = intl.get('k.v')\nfunction f() { const Y = '内' }")[1]
    assert [(t[4], t[3], t[0], t[5]) for t in tops] == [("TITLE", 2, "标题", None), ("X", 3, None, "k.v")]


def test_broken_file_gives_an_error_row(spark):
    df = spark.createDataFrame([("a.tsx", "const a = '好"), ("b.tsx", "f('好')"), ("c.tsx", None)], "file string, content string")
    rows = {r.file: (r.kind, r.text) for r in tsx.occurrences(df).collect()}
    assert rows == {"a.tsx": ("error", None), "b.tsx": ("string", "好")}


def test_globs():
    match = lambda g, p: bool(re.match(files.glob_pattern(g).replace(r"\z", r"\Z"), p))
    assert match("src/**/*.{ts,tsx}", "src/a.ts") and match("src/**/*.{ts,tsx}", "src/b/c/a.tsx")
    assert not match("src/**/*.{ts,tsx}", "src/a.js") and not match("src/*.ts", "src/b/a.ts")
    assert match("**/*.d.ts", "x/y.d.ts") and match("**/node_modules/**", "a/node_modules/b/c.ts")


@pytest.fixture
def project(tmp_path):
    (tmp_path / "src/pages/home").mkdir(parents=True)
    (tmp_path / "src/pages/home/Main.tsx").write_text(ORDERS)
    (tmp_path / "src/head.ts").write_text("export const TITLE = '标题'\n")
    (tmp_path / "src/bad.ts").write_text("const a = '坏")
    (tmp_path / "src/x.test.ts").write_text("f('测试')")
    return tmp_path


def test_extract_and_translate(spark, project):
    config = cfg.create_config({"input": ["src/**/*.{ts,tsx}"]}, project)
    out = application.extract(spark, config)
    assert out.files_processed == 3 and [f for f, _ in out.errors] == ["src/bad.ts"]
    source = json.loads((project / "locales/zh-CN/translation.json").read_text())
    assert "标题" in source.values() and "测试" not in source.values() and len(source) == 11
    target = project / "locales/en-US/translation.json"
    assert set(json.loads(target.read_text()).values()) == {""}
    detail = json.loads((project / "locales/zh-CN/translation.detail.json").read_text())
    assert {d["text"] for d in detail.values()} == set(source.values())
    assert json.loads((project / "locales/zh-CN/translation.report.json").read_text())["summary"]["total_files"] == 3
    assert "| src/head.ts | TITLE | 1 |" in (project / "docs/i18n-top-level-warnings.md").read_text()
    assert application.write_sources(out, str(project / "new")) == 2
    key = next(k for k, v in source.items() if v == "立即发货")
    assert f"intl.get('{key}')" in (project / "new/src/pages/home/Main.tsx").read_text()
    application.translate_missing(spark, config, lambda lang, e: json.dumps({k: "en " + t for k, t in e.items()}), limiter=lambda: translate.Limiter(1e9))
    done = json.loads(target.read_text())
    assert set(done) == set(source) and "en 标题" in done.values()
    target.write_text(json.dumps(done | {next(iter(done)): "edited"}))
    application.extract(spark, config)
    assert "edited" in json.loads(target.read_text()).values()


def test_settings_reach_the_commands(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("track('甲'); f('乙')\nconst o = { t: '丙' }\n")
    told = []

    def broken(out):
        raise RuntimeError("no")

    config = cfg.create_config({"skip_function_calls": ["track"], "post_commands": [lambda out: told.append(out.summary["total_extracted"]), broken, "make"]}, tmp_path)
    with pytest.warns(UserWarning):
        out = application.extract(spark, config)
    assert told == [3] and out.summary["total_data_constants"] == 1
    assert json.loads((tmp_path / "locales/zh-CN/translation.report.json").read_text())["fileStats"] == {"src/a.ts": {"extracted": 3, "dataConstants": 1, "skipped": 1}}
    code = out.rewritten.first().code
    assert "track('甲')" in code and "f(intl.get(" in code and "get t()" in code


def named(items):
    return json.dumps([f"Key of {len(x['text'])} {x['context']['filePath'][-4]}" for x in items])


def test_generated_keys_from_end_to_end(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("f('甲'); f('乙二')")
    (tmp_path / "src/b.ts").write_text("f('甲'); f('三个字')")
    ai = {"enabled": True, "cache": {"file_path": "cache/keys.json"}}
    config = cfg.create_config({"key_generation": {"strategy": "ai", "ai": ai}, "ai_provider": {"api_key": "x"}}, tmp_path)
    out = application.extract(spark, config, generator=named, limiter=lambda: translate.Limiter(1e9))
    assert {(r.key, r.text) for r in out.catalog.collect()} == {("common.keyOf1A", "甲"), ("common.keyOf2A", "乙二"), ("common.keyOf3B", "三个字")}
    cache = json.loads((tmp_path / "cache/keys.json").read_text())
    assert sorted(x["key"] for x in cache.values()) == ["keyOf1A", "keyOf2A", "keyOf3B"] and all(x["timestamp"] for x in cache.values())

    def never(items):
        raise AssertionError("asked again")

    config.settings["key_generation"]["ai"]["fallback_to_semantic"] = False
    assert application.extract(spark, config, generator=never).catalog.count() == 3
    (tmp_path / "cache/keys.json").unlink()
    with pytest.raises(ValueError):
        application.extract(spark, config, generator=lambda items: "[]", limiter=lambda: translate.Limiter(1e9))
    config.settings["key_generation"]["ai"]["enabled"] = False
    assert any(r.key.startswith("common.text.") for r in application.extract(spark, config).catalog.collect())


@pytest.fixture
def endpoint():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen, answers = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code, head, body = answers.pop(0)
            self.send_response(code)
            for k, v in head.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/chat", seen, answers
    server.shutdown()


def test_the_provider(endpoint):
    url, seen, answers = endpoint
    config = cfg.create_config({"ai_provider": {"api_key": "secret", "api_url": url, "headers": {"X-A": "1"}, "body": {"top_p": 0.5}}}, "/tmp/x")
    good = json.dumps({"choices": [{"message": {"content": "hello"}}]})
    answers += [(200, {}, good), (429, {"Retry-After": "7"}, ""), (429, {}, ""), (500, {}, "broken"), (200, {}, '{"error": {"message": "no"}}'), (200, {}, '{"choices": []}'), (200, {}, good)]
    assert chat.translator_of(config)("en_US", {"k": "甲"}) == "hello"
    headers, body = seen[0]
    assert headers["Authorization"] == "Bearer secret" and headers["X-A"] == "1"
    assert (body["model"], body["top_p"], body["max_tokens"]) == ("gpt-4o-mini", 0.5, 1000)
    assert "English" in body["messages"][0]["content"] and body["messages"][1]["content"] == '{"k": "甲"}'
    client = chat.ChatClient(config["ai_provider"])
    for seconds in (7.0, 60.0):
        with pytest.raises(translate.RateLimited) as e:
            client.chat([])
        assert e.value.seconds == seconds
    for _ in range(3):
        with pytest.raises(RuntimeError):
            client.chat([])
    assert chat.generator_of(config)([{"text": "甲", "context": {"textType": "text"}}]) == "hello"
    assert "textType: text" in seen[-1][1]["messages"][1]["content"]


def test_public_names():
    import glotspark

    assert all(hasattr(glotspark, x) for x in glotspark.__all__)
    assert glotspark.get_config()["namespace"] == "translation"
    assert glotspark.set_active_config(cfg.create_config({"namespace": "n"}, "/tmp/x")) is glotspark.get_config()
    assert glotspark.reset_config()["namespace"] == "translation" and glotspark.define_config({"a": 1}) == {"a": 1}


def test_nothing_found(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    assert application.extract(spark, cfg.create_config({}, tmp_path)).files_processed == 0
    assert not (tmp_path / "locales").exists()


def test_corrupt_locale_is_empty_or_an_error(spark, tmp_path):
    path = tmp_path / "x.json"
    path.write_text("{oops")
    assert files.locale_entries(spark, str(path), "en").count() == 0
    with pytest.raises(Exception, match="no JSON object"):
        files.locale_entries(spark, str(path), "en", strict=True).count()
    path.write_text('{"a": "x", "b": 3, "c": null}')
    assert [(r.key, r.value, r.is_string) for r in files.locale_entries(spark, str(path), "en").orderBy("ord").collect()][:2] == [("a", "x", True), ("b", "3", False)]


def test_written_objects_are_those_of_json():
    for entries in ({}, {"a": "x\ny", "b": None}, {"k\"": {"text": "甲", "interpolations": ["a", "b"], "n": 1}, "l": {}}):
        assert "".join(files._object(entries.items())) == json.dumps(entries, ensure_ascii=False, indent=2)


def test_ai_cache(spark, tmp_path):
    path = tmp_path / "cache.json"
    path.write_text('{"old": "keyOne", "new": {"key": "keyTwo", "timestamp": 1700000000000}}')
    rows = {r.cache_key: (r.key, r.ts) for r in files.ai_cache(spark, str(path)).collect()}
    assert rows["old"] == ("keyOne", None) and rows["new"][0] == "keyTwo"


def test_deep_merge():
    base = {"a": {"b": 1, "c": [1, 2]}, "d": 1}
    assert cfg.deep_merge(base, {"a": {"c": [3], "b": cfg.UNDEFINED}, "d": None}) == {"a": {"b": 1, "c": [3]}, "d": None}
    assert base == {"a": {"b": 1, "c": [1, 2]}, "d": 1}


def test_config():
    c = cfg.create_config({"languages": {"targets": ["en_US", " ja_JP ", "en_US", ""]}}, "/tmp/x")
    assert c["languages"]["targets"] == ["zh_CN", "en_US", "ja_JP"]
    assert str(c.output_path("en_US", "detail")) == "/tmp/x/locales/en-US/translation.detail.json"
    for bad in ({"key_generation": {"hash_length": 3}}, {"key_generation": {"strategy": "x"}}, {"input": []}, {"languages": {"targets": ["english"]}}, {"key_generation": {"strategy": "ai", "ai": {"enabled": True}}}):
        with pytest.raises(ValueError):
            cfg.create_config(bad, "/tmp/x")


def test_config_files(tmp_path):
    assert cfg.find_config(tmp_path) is None
    (tmp_path / "i18n.config.json").write_text('{"namespace": "n"}')
    assert cfg.load_config(tmp_path)["namespace"] == "n"
    (tmp_path / "i18n.config.py").write_text("def config(about):\n    return {'namespace': about['command']}\n")
    assert cfg.load_config(tmp_path, command="translate")["namespace"] == "translate"
    with pytest.raises(FileNotFoundError):
        cfg.find_config(tmp_path, "none.json")
