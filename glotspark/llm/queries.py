"""One query for each operator, over its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glotspark.llm import bpe, ctw, decontaminate, langid, licenses, neardup, ngramjoin, pii, piececounts, warc
from glotspark.llm.oracles import ORACLE_SQL as ORACLE_SQL
from glotspark.llm.store import Stash, table

#: The session's setting that holds the key of the surrogates.
SURROGATE_KEY = "spark.glotspark.surrogate.secret"


@cache
def _drawn_key() -> str:
    return secrets.token_hex(16)


def surrogate_key(spark: SparkSession) -> str:
    """The session's key; where none is set one is drawn, so that nobody can undo the surrogates of this run."""
    return spark.conf.get(SURROGATE_KEY, None) or _drawn_key()


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.surrogate(docs, surrogate_key(spark))


def op4_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, ranks, pattern, keep_text=False)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: source) and pages (by their address and html), in one corpus.

    A document's lang is what the text model is fitted on, so it is no evidence for the document itself.
    """
    documents, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None)
    host = langid.address_host(F.col("url"))
    rows = documents.select("doc_id", none.cast("long").alias("page_id"), "text", none.cast("string").alias("declared"), F.col("source").alias("host"), none.cast("string").alias("suffix")).unionByName(
        pages.select(none.cast("long").alias("doc_id"), "page_id", langid.visible_text(F.col("html")).alias("text"), langid.declared_language(F.col("html")).alias("declared"), host.alias("host"), langid.address_suffix(host).alias("suffix"))
    )
    return langid.identify(rows, langid.fit(documents))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, stash = table(spark, sf_dir, "pages"), Stash(spark, "warc")
    warc.write(pages, stash.path("archives"), stash.keep(warc.repeated(pages), "repeated"))
    found = warc.verified(warc.read(spark, stash.path("archives")), stash)
    stash.drop("archives", "repeated", "chunks")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_blocks", "n_confirmed", F.array_join("licenses", ",").alias("licenses"), F.array_join("differences", ";").alias("differences"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.components_of(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return piececounts.token_counts(docs, piececounts.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))).drop("text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_vectors": op1_near_vectors,
    "op2_decontamination": op2_decontamination,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_context_tree": op4_context_tree,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_language_id": op6_language_id,
    "op7_warc": op7_warc,
    "op8_licenses": op8_licenses,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_counts": op10_token_counts,
}

