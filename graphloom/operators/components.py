"""Connected components of an undirected edge table by min labels with pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.store import Scratch


#: Edges that a task takes up before it replaces them by stars.
CHUNK = 1_000_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every end of the edges and the smallest id that these edges connect it to."""
    ids, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, label = places[: len(a)], places[len(a) :], np.arange(len(ids))
    while True:
        a, b = label[a], label[b]
        open_ = a != b
        if not open_.any():
            return ids, ids[label]
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # roots join smaller roots
        while ((up := label[label]) != label).any():
            label = up


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v): edges with the same ends and the same components as the first two columns of ``edges``, one an end
    and task: each task replaces its edges by stars around the smallest ids."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, ids, least = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            n += batch.num_rows
            if n >= max(CHUNK, len(ids)):
                ids, least = _stars(*(np.concatenate(x) for x in zip(*held, (ids, least), strict=True)))
                held, n = [], 0
        if held:
            ids, least = _stars(*(np.concatenate(x) for x in zip(*held, (ids, least), strict=True)))
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], ["u", "v"])

    a, b = edges.columns[:2]
    return edges.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(task, "u long, v long")


def min_labels(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(id, label) for every end of ``edges``: label is the smallest id that can be reached.

    The first two columns of ``edges`` are the ends; direction and order don't matter.
    Each round takes the smallest label among neighbours, then jumps to the label's label,
    so long paths take a logarithmic number of rounds.  State is cut to the shared folder.
    """
    a, b = edges.columns[:2]
    scratch = Scratch(edges.sparkSession, "labels")
    ends = edges.select(F.explode(F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))).alias("e"))
    arcs = scratch.table(ends.select("e.u", "e.v").distinct(), "arcs")
    state = scratch.table(arcs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "r0")
    for i in range(1, max_rounds + 1):
        offers = arcs.join(state.select(F.col("id").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("offer"))
        near = state.join(offers, state.id == offers.u, "left").select("id", "label", F.least("label", F.coalesce("offer", "label")).alias("near"))
        jump = state.select(F.col("id").alias("near"), F.col("label").alias("far"))
        new = near.join(jump, "near", "left").select("id", F.least("near", F.coalesce("far", "near")).alias("new"), F.col("label").alias("old"))
        new = scratch.table(new.select("id", F.col("new").alias("label"), (F.col("new") < F.col("old")).alias("moved")), f"r{i}")
        moved = not new.filter("moved").isEmpty()
        state = new.select("id", "label")
        if i > 1:
            scratch.drop(f"r{i - 2}")
        if not moved:
            return state
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
