"""Language ID: Bayesian evidence fusion.

log posterior = tempered text likelihood + declared language + address suffix + host prior.

* Text: character trigrams of the whole lower-cased text in TABLE hashed cells, one smoothed
  multinomial a language, fitted on a bounded sample of labelled rows (SAMPLE rows a language).
  Neighbouring trigrams overlap, so the sum is tempered by TEMPER.
* Declared: the markup's language attribute (or a metadata column) is right with
  probability TRUST, else any other language.
* Suffix: a country suffix of the address is right with probability SUFFIX_TRUST.
* Host: one grouped aggregation sums the text posteriors by host; each level of the hierarchy
  whole table > suffix > host is smoothed towards the one above with KAPPA pseudo-documents.

One more class, of prior NEITHER, stands for junk and other languages: its trigrams fall into any
cell alike.  A row is rejected when the posterior of the best language is below ``least``, or when
its text has no letters at all.

Defined results: null and empty texts have no letters, so they are rejected whatever is declared;
unknown declarations and suffixes are no evidence; a null host is a host of its own; an empty
table gives no rows; without labelled rows every language is equally likely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import drop_rows, needed, salted_lookup, tune
from graphloom.store import Scratch

LANGUAGES = ("de", "en", "es", "fr")
#: Labelled rows a language that the text model is fitted on, at most; the rows with the smallest hash.
SAMPLE = 1500
TABLE = 1 << 15
TEMPER = 1 / 3
TRUST, SUFFIX_TRUST, KAPPA = 0.9, 0.8, 20.0
#: Prior of texts in none of the languages, whose trigrams fall into any cell alike.
NEITHER = 0.01
#: Country suffixes that speak for a language.
SUFFIXES = {"de": "de", "at": "de", "es": "es", "mx": "es", "fr": "fr", "uk": "en", "us": "en", "au": "en"}


def trigram_cells(text: str) -> np.ndarray:
    """Cells of the character trigrams of a text, its letters lower-cased and all else one space."""
    points = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xDF) & (points != 0xF7))
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = points[keep].astype(np.uint64)
    if len(points) < 3:
        return np.empty(0, np.int64)
    h = (points[:-2] * np.uint64(1000003) + points[1:-1]) * np.uint64(1000033) + points[2:]
    return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(49)).astype(np.int64)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """Log likelihoods, TABLE x languages, of at most SAMPLE labelled rows a language."""
    rows = needed(labelled, id=id_col, text=text_col, lang=lang_col).filter(F.col("lang").isin(*languages))
    scratch = Scratch(rows.sparkSession, "language-fit")
    there = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    # a hash limit leaves little more than SAMPLE rows a language before any row moves
    least = {x: min(2**63 - 1, int(-(2**63) + min(1.0, 1.2 * SAMPLE / max(1, there.get(x, 0))) * 2**64)) for x in languages}
    low = F.create_map(*[F.lit(y) for x in languages for y in (x, least[x])])[F.col("lang")]
    near = scratch.table(rows.filter(F.xxhash64("id") <= low), "near")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")
    chosen = near.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= SAMPLE).select("lang", "text")
    counts = np.zeros((TABLE, len(languages)))
    for row in chosen.mapInArrow(_count_cells, "lang string, cells binary").collect():  # one row a language
        counts[:, languages.index(row.lang)] += np.frombuffer(row.cells, np.int64)
    smooth = counts + 0.5
    return np.log(smooth / smooth.sum(axis=0)).astype(np.float32)


def _count_cells(batches):
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen = np.bincount(trigram_cells(text or ""), minlength=TABLE)
            total[lang] = total[lang] + seen if lang in total else seen
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([x.astype(np.int64).tobytes() for x in total.values()], pa.binary())], ["lang", "cells"])


def _score(model, languages):
    def run(batches):
        table = model.value
        for batch in batches:
            sums, letters = [], []
            for text in batch.column(0).to_pylist():
                cells = trigram_cells(text or "")
                letters.append(len(cells))
                sums.append((table[cells].sum(axis=0, dtype=np.float64) * TEMPER).tolist() if len(cells) else [0.0] * len(languages))
            rest = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sums, pa.list_(pa.float64())), pa.array(letters, pa.int64())], [*batch.schema.names[1:], "text_ll", "n_letters"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.transform(powers, lambda x: x / total)


def _evidence(value: Column, languages, trust: float) -> Column:
    """Log likelihood of a declared language under each language; unknown or null: none."""
    short = F.lower(F.substring_index(F.substring_index(F.trim(value), "-", 1), "_", 1))
    others = max(1, len(languages) - 1)
    known = F.array(*[F.when(short == x, F.lit(float(np.log(trust)))).otherwise(F.lit(float(np.log((1 - trust) / others)))) for x in languages])
    return F.when(short.isin(*languages), known).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def identify(
    df: DataFrame,
    model: np.ndarray,
    id_col: str,
    text_col: str,
    declared: Column | None = None,
    host: Column | None = None,
    suffix: Column | None = None,
    languages: tuple[str, ...] = LANGUAGES,
    least: float = 0.5,
) -> DataFrame:
    """id, lang, posterior, text_lang, declared_lang, n_letters, rejected: one row per row of ``df``."""
    spark = df.sparkSession
    tune(spark)
    scratch = Scratch(spark, "language")
    none = F.lit(None).cast("string")
    rows = df.select(
        F.col(text_col).alias("text"), F.col(id_col).alias("id"), (none if declared is None else declared).alias("declared"),
        F.coalesce(none if host is None else host, F.lit("")).alias("host"), F.coalesce(none if suffix is None else suffix, F.lit("")).alias("suffix"),
    )
    kinds = dict(rows.dtypes)
    shared = spark.sparkContext.broadcast(model)
    scored = rows.mapInArrow(_score(shared, languages), f"id {kinds['id']}, declared string, host string, suffix string, text_ll array<double>, n_letters long")
    scored = scratch.table(scored.withColumn("text_post", _softmax(F.col("text_ll"))), "scored")

    # hierarchy of priors: everything > suffix > host
    # whole millionths, so that the order of rows can't change a sum
    k = len(languages)
    parts = [F.sum(F.when(F.col("n_letters") > 0, F.round(F.col("text_post")[i] * 1e6).cast("long")).otherwise(0)).alias(f"s{i}") for i in range(k)]
    hosts = scratch.table(scored.groupBy("host", "suffix").agg(*parts), "hosts")
    again = [F.sum(f"s{i}").alias(f"s{i}") for i in range(k)]

    def smooth(sums: DataFrame, above: list[Column], name: str) -> DataFrame:
        total = sum((F.col(f"s{i}") for i in range(k)), F.lit(0.0))
        return sums.withColumn(name, F.array(*[(F.col(f"s{i}") / 1e6 + KAPPA * above[i]) / (total / 1e6 + KAPPA) for i in range(k)])).drop(*[f"s{i}" for i in range(k)])

    whole = smooth(hosts.agg(*[F.coalesce(F.sum(f"s{i}"), F.lit(0)).alias(f"s{i}") for i in range(k)]), [F.lit(1.0 / k)] * k, "p").first()["p"]
    suffixes = smooth(hosts.groupBy("suffix").agg(*again), [F.lit(float(x)) for x in whole], "suffix_prior")
    priors = smooth(hosts.join(suffixes, "suffix"), [F.col("suffix_prior")[i] for i in range(k)], "prior")
    priors = scratch.table(priors.groupBy("host").agg(F.max_by("prior", "suffix").alias("prior")), "priors")

    # the suffix speaks for itself; its prior speaks for hosts that are rare
    found = salted_lookup(scored, priors, "host", F.xxhash64("id", "declared"))
    names = F.array(*[F.lit(x) for x in languages])
    place = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])[F.col("suffix")]
    told, at = _evidence(F.col("declared"), languages, TRUST), _evidence(place, languages, SUFFIX_TRUST)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("text_ll"), told), add(at, F.transform("prior", lambda x: F.log(x) + float(np.log(1 - NEITHER)))))
    # text of no known language: cells at random, and any declaration or suffix is as likely as another
    blind = F.when(told[0] != 0, float(-np.log(k))).otherwise(0.0) + F.when(at[0] != 0, float(-np.log(k))).otherwise(0.0)
    neither = F.col("n_letters") * (TEMPER * -float(np.log(TABLE))) + float(np.log(NEITHER)) + blind
    found = found.withColumn("post", F.slice(_softmax(F.concat(logs, F.array(neither))), 1, k))
    best = lambda c: F.element_at(names, F.array_position(F.col(c), F.array_max(c)).cast("int"))
    return found.select(
        "id", best("post").alias("lang"), F.array_max("post").alias("posterior"), best("text_post").alias("text_lang"),
        F.col("declared").alias("declared_lang"), "n_letters", ((F.array_max("post") < least) | (F.col("n_letters") == 0)).alias("rejected"),
    )


def markup_language(html: Column) -> Column:
    """The language attribute of the html tag, null if there is none."""
    lang = F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", 1)
    return F.when(lang != "", lang)


def identify_documents(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", least: float = 0.5) -> DataFrame:
    """Documents: the source stands for the host.  Their metadata language is no evidence, the model is fitted on it."""
    return identify(docs, model, id_col, text_col, host=F.col(source_col), least=least).withColumnRenamed("id", "doc_id")


def accepted_rows(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns.  An id stays if one of its rows does."""
    scratch = Scratch(docs.sparkSession, "language-kept")
    verdict = scratch.table(identify_documents(docs, model, id_col, text_col, source_col, least).select(F.col("doc_id").alias("_id"), "rejected"), "verdict")
    gone = verdict.filter("rejected").select("_id").distinct()
    kept = verdict.filter("not rejected").select("_id").distinct()
    gone = scratch.table(gone.join(kept, gone["_id"].eqNullSafe(kept["_id"]), "left_anti"), "gone")
    return drop_rows(docs, docs[id_col], gone)
