"""Difference-coded adjacency: byte, byte with run lengths, and nibble codes.

A row's first neighbour is coded as its signed distance to the vertex, the others as gaps to
the neighbour before; rows must be strictly increasing, so loops and repeats are dropped first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit lengths of numbers below 2**53."""
    return np.frexp(values.astype(np.float64))[1]


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of ``counts`` items."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _groups(values: np.ndarray, bits: int, first: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Groups of ``bits`` data bits of all values, low ones first, each with a continue bit above, and each
    value's number of groups; the first group of a row's first value holds a sign bit in place of a data bit."""
    width = np.where(first, bits - 1, bits)
    counts = 1 + np.maximum(0, -(-(_bits(values) - width) // bits))
    owner, place = np.repeat(np.arange(len(values)), counts), _within(counts)
    shift = np.where(place == 0, 0, width[owner] + (place - 1) * bits)
    out = (values[owner] >> shift) & ((1 << np.where(place == 0, width[owner], bits)) - 1)
    out |= (place < counts[owner] - 1).astype(np.int64) << bits
    out |= ((place == 0) & first[owner] & minus[owner]).astype(np.int64) << (bits - 1)
    return out.astype(np.uint8), counts


def _sums(counts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` over rows of the given lengths."""
    total = np.concatenate([[0], np.cumsum(counts)])
    end = np.cumsum(lengths)
    return total[end] - total[end - lengths]


def encode_rows(ids, nbrs, code: str = "byte") -> list[bytes]:
    """Coded rows of sorted neighbours, all rows of a batch at once."""
    lengths = np.array([len(x) for x in nbrs], np.int64)
    if not lengths.sum():
        return [b""] * len(lengths)
    flat = np.concatenate([np.asarray(x, np.int64) for x in nbrs])
    first = _within(lengths) == 0
    last = np.concatenate([[0], flat[:-1]])
    diff = flat - np.where(first, np.repeat(np.asarray(ids, np.int64), lengths), last)
    values, minus = np.abs(diff), diff < 0
    if code == "rle":
        # runs of at most 64 gaps of the same number of bytes: (bytes - 1) * 64 + (run - 1), then the bytes
        size = np.maximum(1, -(-_bits(values) // 8))
        new = first | np.concatenate([[True], first[:-1]]) | (size != np.concatenate([[0], size[:-1]]))
        begin = np.flatnonzero(new)
        place = _within(np.diff(np.append(begin, len(values))))
        begin = np.flatnonzero(place % 64 == 0)
        run = np.diff(np.append(begin, len(values)))
        heads = np.where(first[begin], values[begin], (size[begin] - 1) * 64 + run - 1)
        head, head_n = _groups(heads, 7, first[begin], minus[begin])
        body = np.where(first[begin], 0, run * size[begin])
        out = np.empty(head_n.sum() + body.sum(), np.uint8)
        starts = np.cumsum(head_n + body) - head_n - body
        out[np.repeat(starts, head_n) + _within(head_n)] = head
        n_bytes = np.where(first, 0, size)
        owner, at = np.repeat(np.arange(len(values)), n_bytes), _within(n_bytes)
        out[np.repeat(starts + head_n, body) + _within(body)] = (values[owner] >> (8 * at)) & 255
        per_value = n_bytes.copy()
        per_value[begin] += head_n
        row_bytes = _sums(per_value, lengths)
    else:
        out, counts = _groups(values, 3 if code == "nibble" else 7, first, minus)
        row_bytes = _sums(counts, lengths)
        if code == "nibble":
            whole = row_bytes + row_bytes % 2
            halves = np.zeros(whole.sum(), np.uint8)
            halves[np.repeat(np.cumsum(whole) - whole, row_bytes) + _within(row_bytes)] = out
            out, row_bytes = halves[::2] | halves[1::2] << 4, whole // 2
    data, end = out.tobytes(), np.cumsum(row_bytes)
    return [data[b - n : b] for b, n in zip(end.tolist(), row_bytes.tolist(), strict=True)]


def _decode_runs(vertex: int, degree: int, data: bytes) -> np.ndarray:
    """A row of the code with run lengths: a step for each run."""
    raw, at, gaps = np.frombuffer(data, np.uint8), 0, []

    def take(width: int) -> tuple[int, int]:
        nonlocal at
        head = int(raw[at])
        value, shift, more = head & ((1 << width) - 1), width, head >> 7
        at += 1
        while more:
            value, shift, more = value | (int(raw[at]) & 127) << shift, shift + 7, raw[at] >> 7
            at += 1
        return value, head >> width & 1

    value, minus = take(6)
    left = degree - 1
    while left:
        head, _ = take(7)
        size, run = head // 64 + 1, head % 64 + 1
        cells = raw[at : at + size * run].reshape(run, size).astype(np.int64)
        gaps.append((cells << (8 * np.arange(size))).sum(axis=1))
        at, left = at + size * run, left - run
    return np.cumsum(np.concatenate([[vertex - value if minus else vertex + value], *gaps]))


def decode_rows(ids, degrees, data, code: str = "byte") -> list[np.ndarray]:
    """Neighbours of each coded row, all rows of a batch at once."""
    ids, degrees = np.asarray(ids, np.int64), np.asarray(degrees, np.int64)
    if code == "rle":
        return [_decode_runs(i, d, b) if d else np.array([], np.int64) for i, d, b in zip(ids.tolist(), degrees.tolist(), data, strict=True)]
    sizes = np.where(degrees > 0, [len(b) for b in data], 0)
    raw = np.frombuffer(b"".join(b for b, d in zip(data, degrees.tolist(), strict=True) if d), np.uint8)
    bits = 3 if code == "nibble" else 7
    if code == "nibble":
        raw, sizes = np.stack([raw & 15, raw >> 4], axis=1).ravel(), 2 * sizes
    if not len(raw):
        return [np.array([], np.int64)] * len(ids)
    starts = np.flatnonzero(np.concatenate([[True], raw[:-1] >> bits == 0]))
    row = np.searchsorted(np.cumsum(sizes) - sizes, starts, side="right") - 1
    place = np.arange(len(starts)) - np.searchsorted(row, row)
    first = place == 0
    counts = np.diff(np.append(starts, len(raw)))
    width, at = np.repeat(np.where(first, bits - 1, bits), counts), _within(counts)
    shift = np.where(at == 0, 0, width + (at - 1) * bits)
    values = np.add.reduceat((raw.astype(np.int64) & ((1 << np.where(at == 0, width, bits)) - 1)) << shift, starts)
    minus = first & (raw[starts] >> (bits - 1) & 1 == 1)
    kept = place < degrees[row]  # a row of nibbles may end in an empty half
    steps = np.where(first, ids[row] + np.where(minus, -values, values), values)[kept]
    total = np.concatenate([[0], np.cumsum(steps)])
    begin = np.cumsum(degrees) - degrees
    flat = total[1:] - np.repeat(total[begin], degrees)
    return np.split(flat, begin[1:])


def encode_row(vertex: int, nbrs, code: str = "byte") -> bytes:
    return encode_rows([vertex], [nbrs], code)[0]


def decode_row(vertex: int, degree: int, data: bytes, code: str = "byte") -> list[int]:
    return decode_rows([vertex], [degree], [data], code)[0].tolist()


def _encode_side(pairs: DataFrame, ids: DataFrame, code: str, chunk: int | None) -> DataFrame:
    """id, [part,] degree, data of different (id, nbr) pairs."""

    @F.pandas_udf("binary")
    def code_rows(i: pd.Series, nbrs: pd.Series) -> pd.Series:
        return pd.Series(encode_rows(i, nbrs, code))

    key = ["id"]
    if chunk:
        pairs = pairs.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("id").orderBy("nbr")) - 1) / chunk))
        key = ["id", "part"]
    rows = pairs.groupBy(*key).agg(F.sort_array(F.collect_list("nbr")).alias("nbrs"))
    out = rows.select(*key, F.size("nbrs").alias("degree"), code_rows("id", "nbrs").alias("data"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.select("id").join(out, "id", "left").select("id", *map(zero, key[1:]), zero("degree"), F.coalesce("data", F.lit(b"")).alias("data"))


def encode(g: PropertyGraph, code: str = "byte", chunk: int | None = None) -> DataFrame:
    """id, degree, data: one coded row a vertex, loops and repeats dropped.

    With ``chunk`` id, part, degree, data: a row for each ``chunk`` neighbours, coded apart, so that a
    hub is many rows.
    """
    edges = PropertyGraph(g.vertices, g.edges.select("src", "dst")).simplify().edges
    return _encode_side(edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr")), g.vertices, code, chunk)


def decode(coded: DataFrame, code: str = "byte") -> PropertyGraph:
    """The graph of coded rows, whole ones or chunks."""

    @F.pandas_udf("array<long>")
    def rows(ids: pd.Series, degrees: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series(decode_rows(ids, degrees, data, code))

    edges = coded.filter("degree > 0").select(F.col("id").alias("src"), F.explode(rows("id", "degree", "data")).alias("dst"))
    return PropertyGraph(coded.select("id").distinct() if "part" in coded.columns else coded.select("id"), edges)


def coded_bytes(value: Column, first: bool = False) -> Column:
    """Bytes that the byte code needs, from the bit length alone."""
    bits = F.length(F.bin(value))
    return (F.lit(1) + F.greatest(F.lit(0), F.ceil((bits - (6 if first else 7)) / 7))).cast("long")


def decode_hyper(coded: tuple[DataFrame, DataFrame], code: str = "byte") -> tuple[DataFrame, DataFrame]:
    """v2h and h2v of two coded sides."""
    v2h = decode(coded[0], code).edges.select(F.col("src").alias("v"), F.col("dst").alias("h"))
    h2v = decode(coded[1], code).edges.select(F.col("src").alias("h"), F.col("dst").alias("v"))
    return v2h, h2v


def encode_hyper(h, code: str = "byte", chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a hypergraph; a member equal to its hyperedge's number is kept, unlike a loop."""

    def side(pairs: DataFrame, a: str, b: str, ids: DataFrame) -> DataFrame:
        return _encode_side(pairs.select(F.col(a).alias("id"), F.col(b).alias("nbr")).distinct(), ids, code, chunk)

    return side(h.v2h, "v", "h", h.vertices), side(h.h2v, "h", "v", h.hyperedges)
