"""Token counts by separator scan.

``write_tokens`` turns texts into flat unindexed files of little-endian 16-bit token ids, each
text closed by an end-of-document id.  ``scan_tokens`` counts documents in such files with no
other knowledge: files are cut into blocks of BLOCK_TOKENS ids, each block is read on its own
and searched for the end id as one vector; a prefix scan over a file's blocks carries the place
of the last separator and the number of documents across block borders, so a document that
spans many blocks comes out whole.

Files are written under names that no other task attempt uses and count only if their row is in
the writer's table, so lost executors and repeated attempts leave no documents behind.

Defined results: null and empty texts have 0 tokens; ids after the last separator of a file are
an unclosed document, reported with ``closed`` false; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import bytes_of, needed, tune
from graphloom.store import Scratch

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
END = 50256
BLOCK_TOKENS = 1 << 20
#: Ids in one file, after which a writer starts another.
FILE_TOKENS = 1 << 26


def pattern(folder: str) -> str:
    """The word pattern that comes with the vocabulary files."""
    import importlib.util

    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


def encoding(folder: str = TOKENIZERS, vocabulary: str = VOCABULARY):
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
    if max(ranks.values()) >= END:
        raise ValueError(f"ids of the vocabulary must lie below {END}, the end of a document")
    return tiktoken.Encoding("flat", pat_str=pattern(folder), mergeable_ranks=ranks, special_tokens={})


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Writes token files below ``folder``; file, first (number of its first document here), ids, end (tokens so far)."""
    tune(docs.sparkSession)
    docs = needed(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches):
        coder = encoding(tokenizers, vocabulary)
        store, root = open_fs(folder)
        store.create_dir(root, recursive=True)
        out, name, count, tokens = None, "", 0, 0
        for batch in batches:
            if out is None or tokens >= file_tokens:
                if out is not None:
                    out.close()
                name, count, tokens = f"{uuid.uuid4().hex}.bin", 0, 0
                out = store.open_output_stream(f"{root}/{name}")
            flat = []
            for raw in bytes_of(batch.column(1)):
                flat += coder.encode_ordinary(raw.decode("utf-8", "replace"))
                flat.append(END)
            out.write(np.array(flat, "<u2").tobytes())
            ids, tokens = batch.column(0).to_pylist(), tokens + len(flat)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([tokens], pa.int64())], ["file", "first", "ids", "end"])
            count += len(ids)
        if out is not None:
            out.close()

    return docs.mapInArrow(run, "file string, first long, ids array<long>, end long")


def scan_tokens(spark: SparkSession, folder: str, files: DataFrame, end_id: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """file, ordinal, n_tokens, closed for each document in flat files; ``files``: file, tokens."""
    blocks = files.filter("tokens > 0").select("file", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / block_tokens))).alias("block"))
    blocks = blocks.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file", "block")

    def run(batches):
        store, root = open_fs(folder)
        for batch in batches:
            for name, tokens, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = block * block_tokens
                with store.open_input_file(f"{root}/{name}") as file:
                    ids = np.frombuffer(file.read_at(2 * min(block_tokens, tokens - start), 2 * start), "<u2")
                ends = (np.flatnonzero(ids == end_id) + start).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([start + len(ids)], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "stop", "ends"])

    found = blocks.mapInArrow(run, "file string, block long, stop long, ends array<long>")
    # prefix scan over the blocks of a file: documents closed and last separator before each
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("done", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    found = found.withColumn("last", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1).cast("long")))
    found = found.withColumn("tail", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull())
    each = found.select("file", "done", "last", "ends", F.posexplode("ends").alias("nth", "at"))
    each = each.select(
        "file", (F.col("done") + F.col("nth")).alias("ordinal"),
        (F.col("at") - F.when(F.col("nth") > 0, F.element_at("ends", F.greatest(F.col("nth"), F.lit(1)))).otherwise(F.col("last")) - 1).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    closing = F.coalesce(F.array_max("ends"), F.col("last"))
    rest = found.filter("tail").select("file", (F.col("done") + F.size("ends")).alias("ordinal"), (F.col("stop") - closing - 1).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return each.unionByName(rest)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS, vocabulary: str = VOCABULARY, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens: writes the token files, then counts by scanning them."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    folder = scratch.path("flat")
    written = scratch.table(write_tokens(docs, folder, id_col, text_col, tokenizers, vocabulary), "written")
    files = written.groupBy("file").agg(F.max("end").alias("tokens"))
    counts = scratch.table(scan_tokens(spark, folder, files, END, block_tokens), "counts")
    scratch.drop("flat")
    names = written.select("file", "first", F.posexplode("ids").alias("nth", "doc_id")).select("file", (F.col("first") + F.col("nth")).alias("ordinal"), "doc_id")
    return names.join(counts.filter("closed"), ["file", "ordinal"]).select("doc_id", "n_tokens")
