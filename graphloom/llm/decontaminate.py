"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside long documents.  An item's MinHash sketch is its
bottom-m shingles under one hash permutation; sketches are partitioned by the items' sizes,
and m grows with the size class so that a document with ``percent`` of the item's q shingles
must hold a sketch member: m = q - ceil(percent q) + 1, so no containment is missed (the usual
banded index can't promise that when a document is a thousand times longer than the item).
A document's sketch has a depth of its own for each size class: of n shingles that the items know,
the bottom n - a + 1, where a is the least that an item of that class needs; a class that the
document is too small for isn't looked at.  Sketches of both sides meet wherever the containment
holds, and candidates are verified by the exact share of the item's shingles in the text, compared
as word tuples.

The item set is a stated query set, read in blocks of BLOCK items or BLOCK_BYTES of text; the
driver indexes a block once and broadcasts it.  Each block reads the documents once.
Documents are never shuffled, so a hot passage costs its own rows only.

Words are lower-cased (A-Z) and cut at [\\x20\\x09-\\x0D].  Defined results: null and empty texts
or items contain nothing and are contained nowhere; an item with fewer words than a shingle is
one shingle; repeated items and documents each get their own rows; null ids are kept as null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bytes_of, drop_rows, mix, needed, tune
from graphloom.store import Scratch

#: Items and bytes of text in one block: the bounds on what a task and the driver hold of the items (one longer item is a block).
BLOCK, BLOCK_BYTES = 20_000, 16 << 20


def shingle_tuples(text: bytes, k: int) -> list[tuple[bytes, ...]]:
    return _tuples(text.lower().split(), k)


def _tuples(words: list[bytes], k: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    width = min(k, len(words))
    return [tuple(words[i : i + width]) for i in range(len(words) - width + 1)]


class ItemIndex:
    """One block of items: sketches by size class, and the shingles to verify against."""

    def __init__(self, items: list[tuple[int | None, bytes]], k: int, percent: int):
        self.k, self.percent = k, percent
        texts = [(i, words) for i, t in items if (words := t.lower().split())]
        self.vocabulary: dict[bytes, int] = {}
        for _, words in texts:
            for w in words:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.items = [(i, set(_tuples(words, k))) for i, words in texts]
        self.widths = sorted({min(k, len(words)) for _, words in texts})
        #: size class (bit length of the item's set) to sketch member to items
        self.sketches: dict[int, dict[int, list[int]]] = {}
        for at, (_, words) in enumerate(texts):
            ids = np.array([self.vocabulary[w] for w in words], np.uint64)
            hashes = np.unique(self._hashes(ids, min(k, len(words))))
            q = len(self.items[at][1])
            members = self.sketches.setdefault(q.bit_length(), {})
            for h in hashes[: q - self.least(q) + 1].tolist():
                members.setdefault(h, []).append(at)
        self.sorted = {c: np.array(sorted(m), np.uint64) for c, m in self.sketches.items()}

    def least(self, q: int) -> int:
        return -(-self.percent * q // 100)

    @staticmethod
    def _hashes(ids: np.ndarray, width: int) -> np.ndarray:
        acc = mix(ids[: len(ids) - width + 1])
        for i in range(1, width):
            acc = mix(acc ^ ids[i : len(ids) - width + 1 + i] * np.uint64(0x9E3779B97F4A7C15))
        return acc + np.uint64(width)

    def search(self, text: bytes):
        """(item id, shared shingles, item's shingles) for each item that the text contains."""
        words = text.lower().split()
        if not words or not self.items:
            return
        ids = np.fromiter(map(self.vocabulary.get, words, (0,) * len(words)), np.uint64, len(words))
        seen: set[int] = set()
        for width in self.widths:
            if width > len(words):
                continue
            known = np.convolve(ids > 0, np.ones(width, int), "valid") == width
            if not known.any():
                continue
            hashes = np.unique(self._hashes(ids, width)[known])
            for size, members in self.sorted.items():
                depth = len(hashes) - self.least(1 << (size - 1)) + 1
                if depth < 1:
                    continue  # too few known shingles for any item of this class
                hit = members[np.isin(members, hashes[:depth], assume_unique=True)]
                for h in hit.tolist():
                    seen.update(self.sketches[size][h])
        if seen:
            for at in sorted(seen):
                item, wanted = self.items[at]
                width = len(next(iter(wanted)))
                there = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
                both = len(wanted & there)
                if 100 * both >= self.percent * len(wanted):
                    yield item, both, len(wanted)


def _probe(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            rows = [(doc, *found) for doc, text in zip(batch.column(0).to_pylist(), bytes_of(batch.column(1)), strict=True) for found in index.search(text)]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "shared", "item_shingles"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, item_id, shared, item_shingles, containment: one row per document row and item it contains."""
    spark = docs.sparkSession
    tune(spark)
    docs = needed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = needed(items, item_id=item_id, text=item_text).select(F.col("item_id").cast("long").alias("item_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("text"))
    found, block = [], []
    size = 0

    def probe() -> None:
        shared = spark.sparkContext.broadcast(ItemIndex(block, words, percent))
        found.append(docs.mapInArrow(_probe(shared), "doc_id long, item_id long, shared long, item_shingles long"))
        block.clear()

    for row in items.toLocalIterator():
        block.append((row.item_id, bytes(row.text)))
        size += len(row.text)
        if len(block) == BLOCK or size > BLOCK_BYTES:
            probe()
            size = 0
    if block or not found:
        probe()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.withColumn("containment", F.col("shared") / F.col("item_shingles"))


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; rows that share an id go together."""
    scratch = Scratch(docs.sparkSession, "leaks")
    leaks = scratch.table(contained_items(docs, items, id_col, text_col, item_text=item_text, words=words, percent=percent).select(F.col("doc_id").alias("_id")).distinct(), "leaks")
    return drop_rows(docs, docs[id_col].cast("long"), leaks)
