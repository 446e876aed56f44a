"""Language identification by Bayesian evidence fusion.

Three kinds of evidence are multiplied and normalised to a posterior over languages:

* the text: naive Bayes over byte trigrams, fitted on a bounded sample of the rows of each label, with
  one more class, ``und``, that draws trigrams at random; whole texts are scored;
* the language that the markup declares: how often rows of each language (by their text) declare
  each language, from a grouped count over all rows;
* where the text stands: priors by host, smoothed towards the address suffix, which is smoothed
  towards all rows; grouped sums of the text posteriors, each row without its own share.

A row whose best class is ``und``, or whose best posterior is under ``least``, is rejected.

Defined results: a null or empty text, or one without a trigram of letters, is ``und`` and rejected; a null
declared language or host is no evidence (a host of null falls back to the suffix, then to all
rows); rows are scored one by one, so repeated rows get the same result but count in the priors; texts
of any length are scored whole; of equal posteriors the first language by name is taken; an empty table
gives an empty one; columns of other names are kept, those named like the outputs are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glotspark.llm import bytewords as bw
from glotspark.llm.batches import add_columns, map_arrow, numbered
from glotspark.llm.store import Stash

#: Rows of each label that the text model is fitted on (about; all of a label with no more).
SAMPLE_ROWS = 4000

#: Languages at most; more labels are refused.
MAX_LANGUAGES = 256

#: Trigrams overlap, so each counts as so much independent evidence.
WEIGHT = 1 / 3

#: Rows that a prior's parent counts for.
SMOOTH = 10.0

#: Posterior under which a row is rejected.
LEAST = 0.5

UNKNOWN = "und"
_CELLS = 1 << 16
_NOT_LETTER = np.zeros(256, bool)
_NOT_LETTER[:0x41] = _NOT_LETTER[0x5B:0x61] = _NOT_LETTER[0x7B:0x80] = True


def _trigrams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams, every run of bytes that are no letters taken as one space; their texts."""
    d = bw.LOWER[data]
    space = _NOT_LETTER[d]
    d = np.where(space, np.uint8(32), d)
    keep = np.ones(len(d), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1][np.diff(at) > 0]] = True
    d, owner = d[keep].astype(np.uint32), np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))[keep]
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    cell = ((d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]) * np.uint32(2654435761) >> np.uint32(16)
    one = (owner[:-2] == owner[2:]) & ~((d[1:-1] == 32) & (d[:-2] == 32))
    return cell[one].astype(np.int64), owner[:-2][one]


@dataclass
class TextModel:
    languages: list[str]
    #: log probabilities, a row for each cell; the last column is of UNKNOWN.
    table: np.ndarray

    def log_likelihoods(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages) + 1))
        data, at = bw.raw(bw.arrow_texts(texts))
        for i, j in bw.cut(at):
            cell, owner = _trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
            for k in range(out.shape[1]):
                out[i:j, k] = np.bincount(owner, self.table[cell, k], minlength=j - i)
        return out * WEIGHT


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> TextModel:
    """A text model of each label's rows with the smallest hashed keys. Counts are summed by the executors.

    The labels are counted over all rows. Hashed keys are spread evenly, so a label's count gives
    the edge under which about so many of its rows lie; the smallest is always taken.
    """
    told = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.lit(7), key).alias("h"))
    labels = told.groupBy("label").agg(F.count("*").alias("n"), F.min("h").alias("least")).limit(MAX_LANGUAGES + 1).collect()
    if len(labels) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not labels:
        return TextModel([], np.full((_CELLS, 1), -np.log(_CELLS)))
    edges = [(r.label, max(r.least, (1 << 63) - 1 if r.n <= rows else (rows << 64) // r.n - (1 << 63))) for r in labels]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column("label").to_pylist())
            data, at = bw.raw(bw.arrow_texts(batch.column("text")))
            for i, j in bw.cut(at):
                cell, owner = _trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                for name in set(names[i:j]):
                    sums[name] = sums.get(name, 0) + np.bincount(cell[(names[i:j] == name)[owner]], minlength=_CELLS)
        for name, n in sums.items():
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(full)), pa.array(full), pa.array(n[full])], names=["label", "cell", "n"])

    edge = F.create_map(*[F.lit(x) for pair in edges for x in pair])
    sample = told.where(F.col("h") <= F.element_at(edge, F.col("label")))
    counts = sample.transform(map_arrow, run, "label string, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most languages x cells
    own = pa.compute.dictionary_encode(found.column("label").combine_chunks())
    languages = sorted(own.dictionary.to_pylist())
    table = np.full((_CELLS, len(languages) + 1), 0.05)
    place = {x: i for i, x in enumerate(languages)}
    np.add.at(table, (found.column("cell").to_numpy(), np.array([place[x] for x in own.dictionary.to_pylist()], np.int64)[own.indices.to_numpy()]), found.column("n").to_numpy())
    table /= table.sum(0)
    table[:, -1] = 1 / _CELLS
    return TextModel(languages, np.log(table))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: lambdas would compute it anew for each element."""
    return F.transform(F.array(value), body)[0]


def _posterior(logs: Column) -> Column:
    """exp of an array of logarithms, normalised."""

    def scaled(x: Column) -> Column:
        return _let(F.array_max(x), lambda top: _let(F.transform(x, lambda y: F.exp(y - top)), lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda y: y / total))))

    return _let(logs, scaled)


def address_host(url: Column) -> Column:
    """The host of an address in lower case, without user, port and a final dot."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+?)\.?(?:[:/?#]|$)", 1), F.lit(""))


def address_suffix(host: Column) -> Column:
    """What stands behind the host's last dot; null for a host without one."""
    return F.nullif(F.regexp_extract(host, r"\.([^.]+)$", 1), F.lit(""))


def declared_language(html: Column) -> Column:
    """The primary language that the html element declares, in lower case."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)), F.lit(""))


def visible_text(html: Column) -> Column:
    """The text of a page without scripts, styles, comments and tags."""
    return F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", " ")


def identify(rows: DataFrame, model: TextModel, text: str = "text", declared: str = "declared", host: str = "host", suffix: str = "suffix", least: float = LEAST) -> DataFrame:
    """rows, without text, with language, posterior and accepted.

    The text is read once; what follows handles a short array of numbers for each row.
    """
    spark, n = rows.sparkSession, len(model.languages) + 1
    wanted = [c for c in rows.columns if c == text or c in (declared, host, suffix) or c not in ("language", "posterior", "accepted")]
    rows, name_of = numbered(rows, wanted)
    text, declared, host, suffix = (name_of[c] for c in (text, declared, host, suffix))
    stash, names = Stash(spark, "langid"), [*model.languages, UNKNOWN]
    bound = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(part: pa.RecordBatch) -> dict[str, pa.Array]:
            logs = bound.value.log_likelihoods(part.column(text))
            share = np.exp(logs - logs.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            lists = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), n).cast(pa.list_(pa.float64()))
            return {"_logs": lists(logs), "_share": lists(share), "_empty": pa.array(~logs.any(1))}

        yield from add_columns(batches, text, make, without=(text,))

    new = {"_logs": T.ArrayType(T.DoubleType()), "_share": T.ArrayType(T.DoubleType()), "_empty": T.BooleanType()}
    fields = [f for f in rows.schema.fields if f.name != text and f.name not in new]
    logs = rows.select(text, *[f.name for f in fields]).transform(map_arrow, run, T.StructType([*fields, *[T.StructField(k, v) for k, v in new.items()]]))
    base = stash.keep(logs, "logs")

    def sums(by: list[str]) -> DataFrame:
        return base.groupBy(*by).agg(F.array(*[F.sum(F.col("_share")[k]) for k in range(n)]).alias("sums"), F.count("*").alias("n"))

    total = sums([]).first()
    flat = np.full(n, 1.0 / n)
    top = ((np.array([x or 0.0 for x in total["sums"]]) + flat) / (total["n"] + 1)).tolist()
    told = base.where(F.col(declared).isNotNull()).groupBy(F.col(declared).alias("_said")).agg(F.array(*[F.sum(F.col("_share")[k]) for k in range(n)]).alias("_said_sums"))
    said_total = told.agg(F.count("*").alias("kinds"), *[F.sum(F.col("_said_sums")[k]).alias(f"s{k}") for k in range(n)]).first()
    kinds, said_sums = said_total["kinds"] or 0, [said_total[f"s{k}"] or 0.0 for k in range(n)]

    #: Joined by a computed key, so that a hot host can be split between tasks.
    def with_sums(left: DataFrame, right: DataFrame, key: str, name: str) -> DataFrame:
        right = stash.keep(right.select(F.concat(F.lit("="), F.col(key)).alias(f"_k{name}"), F.col("sums").alias(f"_s{name}"), F.col("n").alias(f"_n{name}")), name)
        return left.join(right, F.concat(F.lit("="), F.col(key)) == F.col(f"_k{name}"), "left").drop(f"_k{name}")

    full = with_sums(base, sums([suffix]), suffix, "suffix")
    full = with_sums(full, sums([host]), host, "host")
    told = stash.keep(told.select(F.concat(F.lit("="), "_said").alias("_said"), "_said_sums"), "said")
    full = full.join(told, F.concat(F.lit("="), F.col(declared)) == F.col("_said"), "left")

    own = F.col("_share")

    def less(sums: str, count: str, parent: Column) -> Column:
        """A place's shares without the row's own, smoothed towards its parent's."""
        others = F.zip_with(sums, own, lambda s, o: F.greatest(s - o, F.lit(0.0)))
        return F.when(F.col(sums).isNull(), parent).otherwise(F.zip_with(others, parent, lambda s, p: (s + SMOOTH * p) / (F.col(count) - 1 + SMOOTH)))

    totals = F.array(*[F.lit(float(x) + max(kinds, 1)) for x in said_sums])
    others = F.zip_with("_said_sums", own, lambda s, o: F.greatest(s - o, F.lit(0.0)) + 1.0)
    spoken = F.when(F.col("_said_sums").isNull(), F.array(*[F.lit(0.0)] * n)).otherwise(F.zip_with(others, totals, lambda s, t: F.log(s / t)))
    prior = less("_shost", "_nhost", less("_ssuffix", "_nsuffix", F.array(*[F.lit(float(x)) for x in top])))
    evidence = F.zip_with(F.zip_with("_logs", prior, lambda a, p: a + F.log(p)), spoken, lambda a, q: a + q)
    full = full.withColumn("_best", _let(_posterior(evidence), lambda p: F.struct(F.array_position(p, F.array_max(p)).cast("int").alias("at"), F.array_max(p).alias("share"))))
    best = F.col("_best.at")
    language = F.when(F.col("_empty"), F.lit(UNKNOWN)).otherwise(F.element_at(F.array(*[F.lit(x) for x in names]), best))
    kept = {c: m for c, m in name_of.items() if m != text and c not in ("language", "posterior", "accepted")}
    return full.select(
        *[full[m].alias(c) for c, m in kept.items()], language.alias("language"), F.col("_best.share").alias("posterior"), ((language != UNKNOWN) & (F.col("_best.share") >= least)).alias("accepted")
    )
