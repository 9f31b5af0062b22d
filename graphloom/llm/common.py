"""Helpers that the training-data operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch. Texts may be long, so batches are far smaller than Spark's default.
ARROW_ROWS = 256
#: Entries of a worker's word cache; it starts anew when full, so memory is bounded.
WORD_CACHE = 400_000
#: A lookup table with at most so many rows is broadcast; a larger one is joined by salted keys.
BROADCAST_ROWS = 50_000
#: A list of ids with at most so many rows is broadcast (some 40 MB); a longer one as a bit map.
BROADCAST_IDS = 500_000
#: Bits of that map, as a power of two: 16 MB whatever the length of the list.
FILTER_LOG = 27
#: Pieces that a bit map is built in.
MAP_CHUNKS = 64


def tune(spark: SparkSession) -> None:
    """Small Arrow batches for this session: whole texts travel in them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def needed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own: other columns can't clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def salted_lookup(big: DataFrame, small: DataFrame, key: str, salt: Column, salts: int = 32) -> DataFrame:
    """Left join of a table with hot keys to a table with one row a key.

    A lookup table of at most BROADCAST_ROWS rows (counted here) is broadcast.  A larger one
    is copied once a salt, so a key with a third of all rows is spread over ``salts`` tasks.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, "left")
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int")).join(spread, [key, "_salt"], "left").drop("_salt")


def _mark(size: int):
    """Pieces of a bit map of 64-bit values, at most one a chunk and partition."""

    def run(batches):
        chunks: dict[int, np.ndarray] = {}
        width = size // MAP_CHUNKS
        for batch in batches:
            cells = (batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) & np.uint64(size - 1)).astype(np.int64)
            for c in np.unique(cells // width).tolist():
                part = chunks.setdefault(c, np.zeros(width // 8, np.uint8))
                mine = cells[cells // width == c] - c * width
                np.bitwise_or.at(part, mine >> 3, (1 << (mine & 7)).astype(np.uint8))
        for c, part in chunks.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["chunk", "body"])

    return run


def bit_map(values: DataFrame, size: int) -> bytes:
    """Bit map of ``size`` bits over the low bits of a column of longs that are spread well.

    Values meet at their chunk's task, so the driver gets MAP_CHUNKS pieces, size / 8 bytes in all,
    however many partitions there are.
    """
    name = values.columns[0]
    cell = F.floor(F.col(name).bitwiseAND(F.lit(size - 1)) / (size // MAP_CHUNKS)).cast("int").alias("chunk")
    parts = values.filter(F.col(name).isNotNull()).select(cell, name).repartition(MAP_CHUNKS, "chunk").mapInArrow(_mark(size), "chunk int, body binary")
    marks = np.zeros((MAP_CHUNKS, size // MAP_CHUNKS // 8), np.uint8)
    for row in parts.collect():  # MAP_CHUNKS rows, size / 8 bytes in all
        marks[row.chunk] |= np.frombuffer(row.body, np.uint8)
    return marks.tobytes()


def map_holds(bits: np.ndarray, size: int, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``values`` a bit map may hold."""
    cells = values & np.uint64(size - 1)
    return ((bits[(cells >> np.uint64(3)).astype(np.int64)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _may_hold(spark: SparkSession, ids: DataFrame, count: int):
    """A condition on an id column: false only for ids that aren't listed.  Ids alone travel to Python."""
    size = 1 << min(FILTER_LOG, max(16, (16 * count).bit_length()))
    shared = spark.sparkContext.broadcast(bit_map(ids.select(F.xxhash64(ids.columns[0]).alias("h")), size))

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        return pd.Series(map_holds(np.frombuffer(shared.value, np.uint8), size, h.to_numpy(np.int64).view(np.uint64)))

    return lambda key: held(F.xxhash64(key))


def drop_rows(rows: DataFrame, key: Column, gone: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """The rows whose key (null equals null) isn't in ``gone``, a table with one column of distinct keys.

    Whole rows don't move: a list of at most ``limit`` keys (counted here) is broadcast; of a longer
    one a bit map of bounded size is, and only rows that it may hold meet the list in a shuffle.
    """
    gone = gone.select(F.col(gone.columns[0]).alias("_gone"))
    if (count := gone.count()) <= limit:
        return rows.join(F.broadcast(gone), key.eqNullSafe(F.col("_gone")), "left_anti")
    may = _may_hold(rows.sparkSession, gone, count)
    marked = rows.withColumn("_may", may(key))
    stay, look = marked.filter("not _may").drop("_may"), marked.filter("_may").drop("_may")
    return stay.unionByName(look.join(gone, key.eqNullSafe(F.col("_gone")), "left_anti"))


def pick_rows(rows: DataFrame, key: str, table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Inner join of ``rows`` to a table with one row a key, moving few other rows than those that match."""
    if (count := table.count()) <= limit:
        return rows.join(F.broadcast(table), key)
    may = _may_hold(rows.sparkSession, table.select(key), count)
    return rows.filter(may(F.col(key))).join(table, key)


class WordHashes(dict):
    """Word (bytes) to a 64-bit hash that is the same in every process."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(values: np.ndarray) -> np.ndarray:
    """Full-avalanche 64-bit finaliser."""
    z = values + _M1
    z = (z ^ (z >> np.uint64(30))) * _M2
    z = (z ^ (z >> np.uint64(27))) * _M3
    return z ^ (z >> np.uint64(31))


#: Bytes of text that are hashed as one vector; a longer text is a vector of its own.
VECTOR_BYTES = 1 << 20
_STEP = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Shingler:
    """Sorted distinct 64-bit hashes of the ``k``-word shingles of whole texts.

    A-Z are lower-cased and words are cut at [\\x20\\x09-\\x0D].  Fewer than ``k`` words count as
    one shingle, no words as none.  Many texts are hashed as one vector: a word's hash is the
    difference of two prefix sums of a polynomial over its bytes, shifted back to power zero.
    """

    def __init__(self, k: int):
        self.k = k
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, factor in (("up", _STEP), ("down", _BACK)):
                powers = np.full(n, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))

    def sets(self, texts: list[bytes], seen=None, weigh=None):
        """One array a text, in order.

        ``seen`` gets the hashes of all words of some texts at a time.  With ``weigh``, numbers for
        an array of words, each text gives (set, smallest number among the words of each shingle).
        """
        some, size = [], 0
        for text in texts:
            if some and size + len(text) > VECTOR_BYTES:
                yield from self._vector(some, seen, weigh)
                some, size = [], 0
            some.append(text)
            size += len(text) + 1
        if some:
            yield from self._vector(some, seen, weigh)

    def _vector(self, texts: list[bytes], seen, weigh):
        joined = b" ".join(texts).lower() + b" "
        ends = np.cumsum([len(t) + 1 for t in texts])
        raw = np.frombuffer(joined, np.uint8)
        self._powers(max(len(raw), VECTOR_BYTES + 1))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_LETTERS[raw] * self.up[: len(raw)], out=sums[1:])
        gap = _SPACE[raw]
        change = np.diff(gap.astype(np.int8), prepend=1)
        start, stop = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
        words = mix((sums[stop] - sums[start]) * self.down[start])
        first = np.searchsorted(start, np.concatenate([[0], ends]))  # first word of each text
        if seen:
            seen(words)
        acc, weights = words, weigh(words) if weigh else None
        least = weights
        for i in range(1, self.k):
            acc = mix(acc[:-1]) + words[i:] if len(acc) else acc
            if weigh and len(least):
                least = np.minimum(least[:-1], weights[i:])
        acc = mix(acc + np.uint64(self.k))
        for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
            if b - a >= self.k:
                mine = acc[a : b - self.k + 1]
                if weigh:
                    tokens, at = np.unique(mine, return_index=True)
                    yield tokens, least[a : b - self.k + 1][at]
                else:
                    yield np.unique(mine)
                continue
            one = words[a : a + (b > a)]
            for i in range(a + 1, b):
                one = mix(one) + words[i : i + 1]
            one = mix(one + np.uint64(b - a))
            yield (one, weights[a:b].min(keepdims=True) if b > a else one) if weigh else one


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
