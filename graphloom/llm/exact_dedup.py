"""Exact dedup: tree merge of sorted digest runs.

Every row gets the SHA-256 of its normalised text, and a home partition by its id.  A home's
rows, sorted by digest, are its first run.  Then partitions exchange runs in binomial rounds:
in round r the ``fan_in`` partitions whose numbers differ in digit r alone swap runs, each
keeping the digests whose own digit r is its number's, and merge what they receive (Spark's
external sort does the multiway merge and spills; a fold over the merged stream keeps the
smallest id and adds up counts).  After ``rounds`` rounds every partition owns its share of the
digest space.  A run has one entry a digest, so copies shrink at every level and a text with a
third of all rows is never gathered anywhere.

Digests are verified at every level: entries merge only if the full SHA-256, the length and an
independent 64-bit hash of the text agree.

Defined results: null text counts as empty, empty texts are equal to each other; a null id is
larger than any other; of rows that tie in id and text the operator keeps one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_rows, needed
from graphloom.store import Scratch

SPACES = r"[\x20\x09-\x0D]+"
_RUN = "home int, sha binary, length int, check long, keep_id long, rows long"


def _merge(batches):
    """Fold a stream sorted by (home, sha, length, check, keep_id): one entry a digest, the first id, all rows."""
    names = ("home", "sha", "length", "check", "keep_id", "rows")
    types = (pa.int32(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    open_key, keep, rows = None, None, 0
    for batch in batches:
        done = []
        for home, sha, length, check, first, count in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if (key := (home, sha, length, check)) != open_key:
                if open_key is not None:
                    done.append((*open_key, keep, rows))
                open_key, keep, rows = key, first, 0
            rows += count
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if open_key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*open_key, keep, rows), types, strict=True)], names)


def _rounds(partitions: int, fan_in: int) -> int:
    rounds = 1
    while fan_in**rounds < partitions:
        rounds += 1
    return rounds


def _level(runs: DataFrame, homes: int) -> DataFrame:
    merged = runs.repartition(homes, "home").sortWithinPartitions("home", "sha", "length", "check", F.col("keep_id").asc_nulls_last())
    return merged.mapInArrow(_merge, _RUN)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sha, length, check of every row's normalised text."""
    text = needed(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ").alias("norm")
    )
    return text.select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.length("norm").alias("length"), F.xxhash64("norm").alias("check"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup")
    rounds = _rounds(int(spark.conf.get("spark.sql.shuffle.partitions")), fan_in)
    homes = fan_in**rounds
    # rows that tie in id and text are one entry with a multiplicity
    first = digests(docs, id_col, text_col).withColumn("home", F.pmod(F.xxhash64("doc_id"), F.lit(homes)).cast("int"))
    first = first.groupBy("home", "sha", "length", "check", "doc_id").agg(F.count("*").alias("rows"))
    first = scratch.table(first, "rows")
    level = scratch.table(_level(first.withColumnRenamed("doc_id", "keep_id").select("home", "sha", "length", "check", "keep_id", "rows"), homes), "runs")
    runs, digit = level, F.conv(F.substring(F.hex("sha"), 1, 12), 16, 10).cast("long")
    for r in range(rounds):
        step = fan_in**r
        mine, wanted = F.floor(F.col("home") / step) % fan_in, F.floor(digit / step) % fan_in
        runs = _level(runs.withColumn("home", (F.col("home") + (wanted - mine) * step).cast("int")), homes)
    groups = runs.filter("rows > 1").select("sha", "length", "check", "keep_id", F.col("rows").alias("group_size"))
    # answers go back to the homes that hold the digest, at most one entry a home and digest
    answers = level.select("home", "sha", "length", "check").join(groups, ["sha", "length", "check"])
    answers = scratch.table(answers, "answers")
    found = first.join(answers, ["home", "sha", "length", "check"], "left")
    sole = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(sole, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    ).select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that exact dedup keeps, with all their columns.

    Rows that share an id are told apart by their digest.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "dedup-kept")
    # an id that rows share says nothing about one of them
    verdict = scratch.table(exact_dedup(docs, id_col, text_col), "verdict")
    dropped = verdict.filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    if not dropped.join(verdict.filter("kept").select("doc_id"), F.col("_id").eqNullSafe(F.col("doc_id"))).isEmpty():
        text = F.regexp_replace(F.coalesce(docs[text_col], F.lit("")), SPACES, " ")
        marked = docs.withColumn("_mark", F.struct(docs[id_col].cast("long").alias("id"), F.sha2(text, 256).alias("sha")))
        keep = verdict.filter("kept").select(F.struct(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).alias("_mark")).distinct()
        return marked.join(keep, "_mark", "left_semi").dropDuplicates(["_mark"]).drop("_mark")
    return drop_rows(docs, docs[id_col].cast("long"), scratch.table(dropped.select("_id"), "dropped"))
