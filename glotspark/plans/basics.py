"""What the queries share: their registry, the phrase facts, and the text rules in SQL.

The tables hold no Chinese text, so queries about texts and locales join facts with the phrase
dimension on id modulo its size; the dimension is fixed and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.functions import text
from glotspark.plans.phrases import PHRASES, phrases

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

N = len(PHRASES)
C = F.col


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the same rules in SQL -------------------------------------------------------------------

SPACE = r"\t\n\x0b\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
PUNCT = text.PUNCTUATION.replace("'", "''")


def type_sql(t: str) -> str:
    whens = []
    for name, pattern in text.TYPE_RULES:
        hit = f"regexp_matches({t}, '{pattern.replace(chr(92) + 'z', '$')}')"
        whens.append(f"WHEN {hit}" + (f" AND length({t}) <= {text.LABEL_LENGTH}" if name == "label" else "") + f" THEN '{name}'")
    return f"CASE {' '.join(whens)} ELSE 'text' END"


def semantic_sql(t: str, n: int) -> str:
    return f"substr(regexp_replace({t}, '[{PUNCT}{SPACE}]', '', 'g'), 1, {n})"


def key_sql(t: str, context: str, n: int = 6) -> str:
    return f"{context} || '.' || {type_sql(t)} || '.' || {semantic_sql(t, n)} || '_' || substr(md5({t}), 1, 4)"


def trim_sql(t: str) -> str:
    return f"regexp_replace({t}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


FACTS = f"facts AS (SELECT o_orderkey AS ord, o_orderkey % {N} AS pid, 'src/pages/p' || (o_orderkey % 7) || '/x.tsx' AS file FROM orders), texts AS (SELECT ord, file, phrase AS text, translated FROM facts JOIN phrases USING (pid))"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, file, text, translated: a phrase for each order."""
    facts = table(spark, sf_dir, "orders").select(C("o_orderkey").alias("ord"), F.pmod("o_orderkey", F.lit(N)).cast("int").alias("pid"), F.concat(F.lit("src/pages/p"), F.pmod("o_orderkey", F.lit(7)), F.lit("/x.tsx")).alias("file"))
    return facts.join(F.broadcast(phrases(spark)), "pid").select("ord", "file", C("phrase").alias("text"), "translated")
