"""Queries over source files, one statement for each customer.

Every rule for finding and replacing texts has a statement, a phrase stands for @ in it, and what must
be found and written is stated beside it. # is the key of the text found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.operators import catalog
from glotspark.plans.basics import C, query, table
from glotspark.plans.phrases import PHRASES
from glotspark.sources import tsx

#: Statement, kind and text found (or None), what it becomes (None: it stays), JSX, getters.
STATEMENTS: list[tuple[str, str | None, str | None, str | None, bool, int]] = [
    ("f('@')", "string", "@", "f(intl.get('#'))", False, 0),
    ("const a = `@ ${n}`", "template", "@ {n}", "const a = intl.get('#', { n })", False, 0),
    ("const a = `@ ${o.p[0]} ${f(1)}`", "template", "@ {o_p_0_} {value1}", "const a = intl.get('#', { o_p_0_: o.p[0], value1: f(1) })", False, 0),
    ("const a = '@' + n + '!'", "binary", "@{n}!", "const a = intl.get('#', { n })", False, 0),
    ("const a = n + ('@' + m)", "binary", "{n}@{m}", "const a = intl.get('#', { n, m })", False, 0),
    ("const v = () => <p>  @  </p>", "jsx-text", "@", "const v = () => <p>  {intl.get('#')}  </p>", True, 0),
    ("const v = () => <p>@ {n} !</p>", "template", "@ {n} !", "const v = () => <p>{intl.get('#', { n })}</p>", True, 0),
    ("const v = () => <><b>@</b>{n}</>", "jsx-text", "@", "const v = () => <><b>{intl.get('#')}</b>{n}</>", True, 0),
    ("const v = () => <a title='@' {...p} />", "string", "@", "const v = () => <a title={intl.get('#')} {...p} />", True, 0),
    ("const v = () => <a>{ok && '@'}</a>", "string", "@", "const v = () => <a>{ok && intl.get('#')}</a>", True, 0),
    ("const v = () => <a>{/* @ */}</a>", None, None, None, True, 0),
    ("f(a ? '@' : 'x')", "string", "@", "f(a ? intl.get('#') : 'x')", False, 0),
    ("f(a ?? '@', b || 'x')", "string", "@", "f(a ?? intl.get('#'), b || 'x')", False, 0),
    ("const a = ['x', '@', 1]", "string", "@", "const a = ['x', intl.get('#'), 1]", False, 0),
    ("const o = { title: '@', n: 1 }", "string", "@", "const o = { get title() { return intl.get('#') }, n: 1 }", False, 1),
    ("const o = () => { return { title: '@' } }", "string", "@", "const o = () => { return { title: intl.get('#') } }", False, 0),
    ("const o = { list: [{ label: '@' }] }", "string", "@", "const o = { list: [{ get label() { return intl.get('#') } }] }", False, 1),
    ("const o = { '@': 1 }", "string", "@", None, False, 0),
    ("const g = () => '@'", "string", "@", "const g = () => intl.get('#')", False, 0),
    ("function g(a = '@') { return a }", "string", "@", "function g(a = intl.get('#')) { return a }", False, 0),
    ("function g() { return '@' }", "string", "@", "function g() { return intl.get('#') }", False, 0),
    ("function g() { throw new Error('@') }", "string", "@", "function g() { throw new Error(intl.get('#')) }", False, 0),
    ("function g() { x.y = '@' }", "string", "@", "function g() { x.y = intl.get('#') }", False, 0),
    ("function g() { api?.show('@') }", "string", "@", "function g() { api?.show(intl.get('#')) }", False, 0),
    ("function g() { notification.show({ title: '@', body: n }) }", "string", "@", "function g() { notification.show({ title: intl.get('#'), body: n }) }", False, 0),
    ("function g(s) { return s === '@' }", "string", "@", "function g(s) { return s === intl.get('#') }", False, 0),
    ("function g(s) { switch (s) { case '@': return 1 } }", "string", "@", None, False, 0),
    ("Promise.reject('@')", "string", "@", "Promise.reject(intl.get('#'))", False, 0),
    ("const m = useMemo(() => [{ title: '@' }], [])", "string", "@", "const m = useMemo(() => [{ title: intl.get('#') }], [])", False, 0),
    ("const m = '@' as string", "string", "@", "const m = intl.get('#') as string", False, 0),
    ("console.log('@')", "string", "@", None, False, 0),
    ("const m = require('@')", "string", "@", None, False, 0),
    ("const m = import('@')", "string", "@", None, False, 0),
    ("import x from '@'", "string", "@", None, False, 0),
    ("enum E { A = '@' }", "string", "@", None, False, 0),
    ("f(t('@'))", "string", "@", None, False, 0),
    ("f(intl.get('@'), intl.getHTML('@'))", None, None, None, False, 0),
    ("// '@'", None, None, None, False, 0),
    ("f(/@'/g.test(s))", None, None, None, False, 0),
    ("track('@')", "string", "@", None, False, 0),
]
#: Calls that the configuration of these queries skips.
SKIP = ("console", "require", "import", "track")
_SAFE = [p for p, _ in PHRASES if "{" not in p]  # braces would open an expression in JSX
_S, _P = len(STATEMENTS), len(_SAFE)


def _quoted(s: str) -> str:
    return s.replace("'", "''")


def _rows_sql() -> str:
    """files: one per customer, with what must be found in it and what it becomes."""
    key = "'common.' || substr(md5(replace(found, '@', phrase)), 1, 4)"
    text = lambda x: "NULL::VARCHAR" if x is None else f"'{_quoted(x)}'"
    values = ", ".join(f"({i}, '{_quoted(c)}', {text(k)}, {text(t)}, {text(n)}, {j}, {g})" for i, (c, k, t, n, j, g) in enumerate(STATEMENTS))
    said = ", ".join(f"({i}, '{_quoted(p)}')" for i, p in enumerate(_SAFE))
    return (
        f"statements(i, code, kind, found, becomes, jsx, getters) AS (VALUES {values}), said(j, phrase) AS (VALUES {said}),"
        f" files AS (SELECT c_custkey, 'src/pages/p/c' || c_custkey || '.tsx' AS file, s.*, phrase, replace(code, '@', phrase) || chr(10) AS content, {key} AS key"
        f" FROM customer JOIN statements s ON s.i = c_custkey % {_S} JOIN said ON j = c_custkey // {_S} % {_P})"
    )


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, said = (F.array(*[F.lit(x) for x in xs]) for xs in ([c for c, *_ in STATEMENTS], _SAFE))
    at = lambda xs, n: F.element_at(xs, (n + 1).cast("int"))
    number = C("c_custkey")
    phrase: Column = at(said, F.pmod(F.floor(number / _S), F.lit(_P)))
    content = F.concat(F.replace(at(codes, F.pmod(number, F.lit(_S))), F.lit("@"), phrase), F.lit("\n"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("src/pages/p/c"), number, F.lit(".tsx")).alias("file"), content.alias("content"))


@query(f"WITH {_rows_sql()} SELECT file, kind, replace(found, '@', phrase) AS text, 1::INTEGER AS line FROM files WHERE found IS NOT NULL")
def tsx_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsx.occurrences(_files(spark, sf_dir)).where("kind <> 'top-level'").select("file", "kind", "text", "line")


@query(
    f"WITH {_rows_sql()} SELECT file, CASE WHEN becomes IS NULL THEN content ELSE 'import intl from ''react-intl-universal'';' || chr(10) || replace(becomes, '#', key) || chr(10) END AS code,"
    " CASE WHEN becomes IS NULL THEN 0 ELSE 1 END::BIGINT AS n_replaced, getters::BIGINT AS n_getters FROM files"
)
def tsx_statements_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    keyed = catalog.with_keys(tsx.occurrences(files).where("kind <> 'top-level'"), "hash", F.lit("common"))
    return tsx.rewritten(files, keyed.select("file", "text", "key"), SKIP).select("file", "code", "n_replaced", "n_getters")


@query(f"WITH {_rows_sql()} SELECT file, jsx AS has_jsx, count(found)::BIGINT AS extracted, sum(getters)::BIGINT AS data_constants, count(*) FILTER (found IS NOT NULL AND becomes IS NULL)::BIGINT AS skipped FROM files GROUP BY file, jsx")
def tsx_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tsx.facts(_files(spark, sf_dir), SKIP).select("file", "has_jsx", "extracted", "data_constants", "skipped")


@query("SELECT 'src/pages/p' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '/data.tsx' WHEN 1 THEN '/menuData.ts' ELSE '/x.ts' END AS file, c_custkey % 3 = 0 AND c_custkey % 2 = 0 AS has_jsx, CASE c_custkey % 3 WHEN 0 THEN 'data' ELSE 'utils' END AS file_type, c_custkey % 3 = 1 OR c_custkey % 3 = 0 AND c_custkey % 2 = 1 AS is_data FROM customer")
def tsx_data_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A data file that holds JSX is a component's file."""
    number = C("c_custkey")
    name = F.when(number % 3 == 0, "/data.tsx").when(number % 3 == 1, "/menuData.ts").otherwise("/x.ts")
    content = F.when((number % 2 == 0) & (number % 3 == 0), "export const a = () => <b/>").otherwise("export const a = 1")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("src/pages/p"), number, name).alias("file"), content.alias("content"))
    return tsx.facts(files).select("file", "has_jsx", "file_type", "is_data")


@query("SELECT 'c' || c_custkey || '.tsx' AS file, c_custkey % 2 = 0 AS failed FROM customer")
def tsx_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that cannot be scanned is a row with an error, and stops nothing else."""
    content = F.when(C("c_custkey") % 2 == 0, "f('打开").otherwise("f('打开')")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey", F.lit(".tsx")).alias("file"), content.alias("content"))
    return tsx.occurrences(files).select("file", (C("kind") == "error").alias("failed"))
