"""From raw documents to token ids: the stages of a training corpus, each an operator of glotspark.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the next one's docs. All but the last return the columns of documents.

Defined results: a document that is null, empty or without letters is rejected as of no language;
of linked documents the one with the smallest doc_id stays, of repeated rows one; a document with a
null doc_id is linked only to equal texts that have one. Texts of any length go through whole. Extra
columns are carried along to the last stage. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.llm import bpe, decontaminate, langid, ngramjoin, pii
from glotspark.llm.queries import surrogate_key
from glotspark.llm.store import Stash, table


def _key(docs: DataFrame) -> list:
    """Two hashes that tell rows apart, whatever their ids are."""
    return [F.xxhash64(docs.doc_id, docs.text), F.xxhash64(F.lit(1), docs.text, docs.doc_id)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not told (random signs, no letters) go. The rejected are few and leave by an anti-join."""
    none = F.lit(None).cast("string")  # lang is what the text model is fitted on
    rows = docs.select(*[k.alias(n) for k, n in zip(_key(docs), ("_k1", "_k2"), strict=True)], "text", none.alias("declared"), F.col("source").alias("host"), none.alias("suffix"))
    found = langid.identify(rows, langid.fit(docs))
    rejected = Stash(spark, "pipeline").keep(found.where("not accepted").select("_k1", "_k2").distinct(), "rejected")
    first, second = _key(docs)
    return docs.alias("d").join(rejected.alias("r"), (first == F.col("r._k1")) & (second == F.col("r._k2")), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays."""
    stash = Stash(spark, "pipeline")
    groups = ngramjoin.components_of(docs)
    gone = stash.keep(groups.where("component_id <> doc_id").select("doc_id").distinct(), "copies")
    repeated = stash.keep(docs.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    left = docs.join(gone, "doc_id", "left_anti")
    once = left.join(repeated, left.doc_id.eqNullSafe(repeated.doc_id), "left_anti")
    more = left.join(repeated, left.doc_id.eqNullSafe(repeated.doc_id), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.select(docs.columns).unionByName(more.select(docs.columns))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), mode="document")


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the text."""
    clash = {c: f"_own_{c}" for c in docs.columns if c in ("n_entities", "kinds")}
    done = pii.surrogate(docs.withColumnsRenamed(clash), surrogate_key(spark))
    done = done.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select([F.col(clash.get(c, c)).alias(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids; lossless tells that they decode to the text's own bytes."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    done = bpe.round_trip(docs.select("doc_id", "lang", "source", "text", own.alias("_own")), ranks, pattern, keep_text=False)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), (F.sha2("decoded", 256) == F.col("_own")).alias("lossless"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("benchmark_free", benchmark_free),
    ("surrogates", surrogates),
    ("tokens", tokens),
]

#: Components, surrogates and merges are beyond SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stash, docs = Stash(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stash.keep(stage(spark, docs, sf_dir), name)
        if k:
            stash.drop(STAGES[k - 1][0])
    return docs
