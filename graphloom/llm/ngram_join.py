"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds the distinct hashed k-word shingles of its whole text.  Documents with
the same set form a class and its smallest id stands for it, so copies are never paired.  All
classes order their shingles by one global order, rarest first; two sets with Jaccard
similarity t or more then share a shingle among their first n - ceil(t n) + 1.  Classes are
joined on those prefix shingles, candidates pass the length and positional filters, each
remaining pair is verified once, after the suffix filter, on the whole sets.

The order uses frequencies from count sketches of fixed size (two rows of SKETCH_WIDTH counters,
the smaller one counts), one of shingles and one of words: a shingle is as rare as its sketch or
its rarest word says.  Any order that all documents share gives the same result; the sketches
only push frequent shingles out of the prefixes.

Candidates come in rounds.  In each of the first ones every prefix shingle and length band
compares its members with one hub only, and links found merge classes into components; rounds
go on while they merge.  Then shingles that still lie in two or more components are joined, and
only pairs from different components count.  No link that could join two components is skipped,
so components are exact, while a tight group of m near copies costs a few times m verifications,
not m squared.

The steps that move most bytes (counts of prefix shingles, joins on them, sets that meet for
verification) run in up to SLICES parts by a hash of their key, one after the other, and each
part's shuffle files go before the next one starts.  Keys never meet across parts, so nothing is
left out.

Defined results: null and empty texts have an empty set, link with nothing and are components
of their own; rows with a null id link with nothing and get a null component; rows that share an
id are one document, whose text is the smallest of theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BROADCAST_IDS, Shingler, bit_map, bytes_of, drop_rows, map_holds, needed, pick_rows, tune
from graphloom.operators.components import min_labels
from graphloom.store import Scratch, free_shuffles

#: Counters in each of the two rows of each frequency sketch, whatever the input's size: 8 MB in all.
SKETCH_WIDTH = 1 << 19
SKETCH_CHUNKS = 64
#: The bit map of shared prefix shingles has 64 bits a shingle, but 2 to this power at most (16 MB).
MAP_BITS_LOG = 27
#: Rounds of hubs before all remaining pairs of different components are looked at, at most; the last one is the
#: first whose links are fewer than one in STAR_YIELD of its pairs.
STAR_ROUNDS, STAR_YIELD = 3, 5
HUB_PAIRS = 500
#: Parts of a step that moves many rows, at most, and the rows that make another part worth its job:
#: prefix shingles, candidate pairs (each moves a whole set or two).
SLICES, SLICE_ROWS, SLICE_PAIRS = 4, 500_000, 8_000
#: Documents in candidate pairs up to which their ids are broadcast to the texts.
BROADCAST_TARGETS = 200_000
#: Longs of a set's parity: the number of its shingles, modulo 2, in each of 64 times as many hash places.
PARITY_WORDS = 8


def _cells(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = np.uint64(SKETCH_WIDTH - 1)
    return (tokens & w).astype(np.int64), ((tokens >> np.uint64(32)) & w).astype(np.int64)


def _measure(k: int):
    """One row a document (size and digest of its set), and the partition's share of the sketch."""

    def run(batches):
        shingler, sketch = Shingler(k), np.zeros((2, 2, SKETCH_WIDTH), np.int32)

        def count(kind: int, values: np.ndarray) -> None:
            for row, cells in enumerate(_cells(values)):
                sketch[kind, row] += np.bincount(cells, minlength=SKETCH_WIDTH).astype(np.int32)

        for batch in batches:
            ids, sizes, digests, seen = batch.column(0).to_pylist(), [], [], []
            for tokens in shingler.sets(bytes_of(batch.column(1)), seen=lambda words: count(1, words)):
                sizes.append(len(tokens))
                digests.append(xxhash.xxh3_128_digest(tokens.tobytes()))
                seen.append(tokens)
            if seen:
                count(0, np.concatenate(seen))
            m = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(m, pa.int32())], ["doc_id", "n", "body", "chunk"])
        if sketch.any():
            parts = sketch.reshape(SKETCH_CHUNKS, -1)
            for c in range(SKETCH_CHUNKS):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([parts[c].tobytes()], pa.binary()), pa.array([c], pa.int32())], ["doc_id", "n", "body", "chunk"])

    return run


def _add_up(batches):
    """Sum of the sketch chunks that meet in a partition: memory is the sketch, however many rows come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(body, np.int32)
            sums[c] = sums[c] + part if c in sums else part.astype(np.int64)
    for c, part in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([np.minimum(part, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())], ["chunk", "body"])


def _prefixes(k: int, percent: int, sketch):
    """The rarest shingles of each set, as many as the prefix filter needs."""

    def run(batches):
        shingler, counts = Shingler(k), np.frombuffer(sketch.value, np.int32).reshape(2, 2, SKETCH_WIDTH)

        def often_of(kind: int, values: np.ndarray) -> np.ndarray:
            a, b = _cells(values)
            return np.minimum(counts[kind, 0][a], counts[kind, 1][b])

        for batch in batches:
            ids, sizes, heads, odd = [], [], [], []
            found = shingler.sets(bytes_of(batch.column(1)), weigh=lambda words: often_of(1, words))
            for doc, (tokens, rarest) in zip(batch.column(0).to_pylist(), found, strict=True):
                n = len(tokens)
                if not n or doc is None:
                    continue
                often = np.minimum(often_of(0, tokens), rarest)
                take = n - -(-percent * n // 100) + 1
                ids.append(doc)
                sizes.append(n)
                odd.append(np.packbits(np.bincount((tokens >> np.uint64(40)).astype(np.int64) & (64 * PARITY_WORDS - 1), minlength=64 * PARITY_WORDS) & 1).view(np.int64))
                at = np.lexsort((tokens, often))[:take]
                heads.append(tokens[at].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "n", "odd", "head"])

    return run


def _chosen(bits, size: int):
    """The prefix shingles that a bit map may hold, with their places: those of column 4, else the order in column 3."""

    def run(batches):
        marks = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            kept, places, tokens = [], [], []
            for row, head in enumerate(batch.column(3)):
                head = head.values.to_numpy()
                at = np.flatnonzero(map_holds(marks, size, head.view(np.uint64)))
                if len(at):
                    kept.append(row)
                    places.append(batch.column(4)[row].values.to_numpy()[at] if batch.num_columns > 4 else at.astype(np.int32))
                    tokens.append(head[at])
            rows = [batch.column(c).take(pa.array(kept, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(places, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int64()))], ["rep", "n", "odd", "pos", "tok"])

    return run


def _spread(k: int):
    """A document's set for each hub it meets: hub, salt, doc_id, tokens."""

    def run(batches):
        shingler = Shingler(k)
        for batch in batches:
            for doc, tokens, targets in zip(batch.column(0).to_pylist(), shingler.sets(bytes_of(batch.column(1))), batch.column(2).to_pylist(), strict=True):
                body, m = tokens.tobytes(), len(targets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t["hub"] for t in targets], pa.int64()), pa.array([t["salt"] for t in targets], pa.int32()), pa.array([doc] * m, pa.int64()), pa.array([body] * m, pa.binary())],
                    ["hub", "salt", "doc_id", "tokens"],
                )

    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int, parts: int = 16) -> bool:
    """Whether 100 |x & y| >= percent |x | y|, for sorted distinct hashes.

    Suffix filter: cut both at the same values; the parts' lengths bound how far the sets differ.
    """
    total = len(x) + len(y)
    least = -(-percent * total // (100 + percent))
    if min(len(x), len(y)) < least:
        return False
    if len(x) > 2 * parts:
        cut = np.linspace(0, len(x), parts + 1).astype(int)[1:-1]
        in_y = np.searchsorted(y, x[cut])
        if np.abs(np.diff(cut, prepend=0, append=len(x)) - np.diff(in_y, prepend=0, append=len(y))).sum() > total - 2 * least:
            return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (total - both)


def _verify(percent: int):
    """Rows sorted by (hub, salt), the hub's own set first: only that one is held."""

    def run(batches):
        key, own = None, None
        for batch in batches:
            a, b = [], []
            for hub, salt, doc, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(body, np.uint64)
                if (hub, salt) != key:
                    key, own = (hub, salt), None
                if doc == hub:
                    own = tokens
                elif own is not None and similar(own, tokens, percent):
                    a.append(hub)
                    b.append(doc)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class JaccardJoin:
    """One run of the join over ``docs``; results are tables in the shared folder.

    ``sets``: doc_id, n, body (digest of the set); ``labels``: class representative to component,
    for the classes that link with others.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80):
        self.spark = docs.sparkSession
        tune(self.spark)
        self.scratch = Scratch(self.spark, "jaccard")
        self.docs = needed(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.words, self.percent = words, percent
        self.ids = self.docs.select("doc_id")
        self.repeated = not self.ids.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty()
        if self.repeated:
            named = self.docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
            self.docs = self.scratch.table(named.unionByName(self.docs.filter("doc_id is null")), "docs")
        self._run()

    def _run(self) -> None:
        put = self.scratch.table
        measured = put(self.docs.mapInArrow(_measure(self.words), "doc_id long, n long, body binary, chunk int"), "measured")
        self.sets = put(measured.filter("chunk is null").drop("chunk"), "sets")
        self.classes = put(
            self.sets.filter("n > 0 and doc_id is not null").groupBy("n", "body").agg(F.min("doc_id").alias("rep")), "classes"
        )
        sketch = self._sketch(measured.filter("chunk is not null").select("chunk", "body"))
        self.scratch.drop("measured")
        copies = self.sets.filter("n > 0 and doc_id is not null").select("doc_id").join(self.classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti")
        copies = put(copies, "copies")
        free_shuffles(self.spark)
        own = drop_rows(self.docs, F.col("doc_id"), copies)  # copies go before their prefixes are made: those don't move
        heads = put(own.mapInArrow(_prefixes(self.words, self.percent, sketch), "doc_id long, n int, odd array<long>, head array<long>"), "heads")
        live = put(self._live(heads), "live")
        self.scratch.drop("heads")
        free_shuffles(self.spark)
        self.labels = self.spark.createDataFrame([], "id long, label long")
        self.tested: list[DataFrame] = []
        for r in range(STAR_ROUNDS):
            found = self._near(self._stars(live, r), f"star{r}")
            links = found.count()
            self.scratch.drop(f"hubs{r}")
            if links:
                self._join_up(found, f"labels{r}")
            if STAR_YIELD * links < self.scratch.read(f"star{r}", "a long, b long").count():
                break
        found = self._near(self._across(live), "across")
        if not found.isEmpty():
            self._join_up(found, "labels")

    def _slices(self, count: int, each: int) -> int:
        return max(1, min(SLICES, -(-count // each)))

    def _parts(self, make: Callable[[int], DataFrame], slices: int, name: str) -> DataFrame:
        """Writes each slice's table; the shuffle files of one slice at a time are on disk."""
        tables = []
        for i in range(slices):
            tables.append(self.scratch.table(make(i), f"{name}/{i}"))
            free_shuffles(self.spark)
        return reduce(DataFrame.unionByName, tables)

    def _live(self, heads: DataFrame) -> DataFrame:
        """rep, n, odd and the places and hashes of prefix shingles that other classes may share.

        Most prefix shingles are sole; a bit map drops them before rows move.  Those that it lets
        through by mistake meet nothing in the joins.
        """
        shingles = self.classes.agg(F.sum("n")).first()[0] or 0
        slices = self._slices(shingles * (100 - self.percent) // 100, SLICE_ROWS)

        def shared(i: int) -> DataFrame:
            mine = F.filter("head", lambda tok: F.pmod(tok, F.lit(slices)) == i) if slices > 1 else F.col("head")
            return heads.select(F.explode(mine).alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).filter("n > 1").select("tok")

        return self._holding(heads, self._parts(shared, slices, "shared"), "shared")

    def _holding(self, rows: DataFrame, toks: DataFrame, name: str) -> DataFrame:
        """``rows`` with those of their shingles that a bit map of ``toks``, the table ``name``, may hold."""
        size = 1 << min(MAP_BITS_LOG, max(16, (64 * toks.count()).bit_length()))
        bits = self.spark.sparkContext.broadcast(bit_map(toks, size))
        self.scratch.drop(name)
        free_shuffles(self.spark)
        return rows.mapInArrow(_chosen(bits, size), "rep long, n int, odd array<long>, pos array<int>, tok array<long>")

    def _sketch(self, chunks: DataFrame):
        sums = chunks.repartition(SKETCH_CHUNKS, "chunk").mapInArrow(_add_up, "chunk int, body binary")
        whole = np.zeros((SKETCH_CHUNKS, 4 * SKETCH_WIDTH // SKETCH_CHUNKS), np.int32)
        for row in sums.collect():  # SKETCH_CHUNKS rows of fixed size, 8 MB in all
            whole[row.chunk] = np.frombuffer(row.body, np.int32)
        return self.spark.sparkContext.broadcast(whole.tobytes())

    def _posts(self, live: DataFrame, i: int = 0, slices: int = 1) -> DataFrame:
        """One row a document and prefix shingle of slice ``i``, with the component so far."""
        known = self.labels.select(F.col("id").alias("rep"), "label")
        small = known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # counted, else a shuffled join
        live = live.join(F.broadcast(known) if small else known, "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")
        places = F.arrays_zip("pos", "tok")
        if slices > 1:  # before rows are made: no slice makes those of the others
            places = F.filter(places, lambda p: F.pmod(p.tok, F.lit(slices)) == i)
        posts = live.select("rep", "n", "odd", "comp", F.explode(places).alias("p"))
        return posts.select("rep", "n", "odd", "comp", F.col("p.pos").alias("pos"), F.col("p.tok").alias("tok"))

    def _stars(self, live: DataFrame, r: int) -> DataFrame:
        """Each member of a shingle and length band against one hub, if it isn't in the hub's component yet.

        The hub is the smallest set first, then one by a hash that changes with the round; bands
        shift too.
        """
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(-np.log(self.percent / 100)) + F.lit(r / 2)).cast("int")
        whole, live = live, self._posts(live).withColumn("band", band)
        first = F.col("n").cast("long") if r == 0 else F.xxhash64("rep", F.lit(r))
        live = live.select("tok", "band", "rep", "n", "comp", first.alias("first"))
        hub = live.groupBy("tok", "band").agg(F.min(F.struct("first", "rep", "n", "comp")).alias("hub"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        # as a table, so that a frequent shingle's side of the join below may be split
        hub = self.scratch.table(hub.filter("lo < hi").select("tok", "band", F.col("hub.rep").alias("a"), F.col("hub.n").alias("an"), F.col("hub.comp").alias("ac")), f"hubs{r}")
        pairs = live.join(hub, ["tok", "band"]).filter((F.col("comp") != F.col("ac")) & (100 * F.least("n", "an") >= self.percent * F.greatest("n", "an")))
        pairs = pairs.select("a", F.col("rep").alias("b")).distinct()
        docs = whole.select("rep", F.struct("n", *[F.col("odd")[i].alias(f"odd{i}") for i in range(PARITY_WORDS)]).alias("d"))
        pairs = pairs.join(docs.select(F.col("rep").alias("a"), F.col("d").alias("x")), "a").join(docs.select(F.col("rep").alias("b"), F.col("d").alias("y")), "b")
        return pairs.filter(self._alike()).select("a", "b")

    @staticmethod
    def _doc():
        return F.struct("rep", "n", "pos", "comp", *[F.col("odd")[i].alias(f"odd{i}") for i in range(PARITY_WORDS)])

    def _alike(self):
        """Length filter, and parities that differ in no more places than similar sets may differ in
        shingles: an odd place needs a shingle that one set lacks."""
        x, y, p = F.col("x"), F.col("y"), self.percent
        differ = sum((F.bit_count(x[f"odd{i}"].bitwiseXOR(y[f"odd{i}"])) for i in range(PARITY_WORDS)), F.lit(0))
        most = x.n + y.n - 2 * F.ceil(F.lit(p) * (x.n + y.n) / F.lit(100 + p))
        return (100 * F.least(x.n, y.n) >= p * F.greatest(x.n, y.n)) & (differ <= most)

    def _across(self, live: DataFrame) -> DataFrame:
        """All pairs of different components that share a shingle and pass the filters.

        A bit map of the shingles that lie in two or more components drops the others before rows
        move; those that it lets through by mistake meet only their own component.
        """
        split = self._posts(live).groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("posts"))
        split = self.scratch.table(split.filter("lo < hi").select("tok", "posts"), "split")
        slices = self._slices(split.agg(F.sum("posts")).first()[0] or 0, SLICE_ROWS)
        open_ = live.select("rep", "n", "odd", "tok", "pos")
        open_ = self.scratch.table(self._holding(open_, split.select("tok"), "split"), "open")

        def pairs(i: int) -> DataFrame:
            return self._meet(self._posts(open_, i, slices).select("tok", self._doc().alias("x")))

        found = self._parts(pairs, slices, "met")
        self.scratch.drop("open")
        return found.distinct() if slices > 1 else found

    def _meet(self, posts: DataFrame) -> DataFrame:
        x, y, p = F.col("x"), F.col("y"), self.percent
        # the smaller set's index prefix meets the larger one's whole prefix
        index = posts.filter(x.pos < x.n - F.ceil(F.lit(2 * p) * x.n / F.lit(100 + p)) + 1)
        pairs = index.join(posts.withColumnRenamed("x", "y"), "tok")
        smaller = F.struct(x.n, x.rep) < F.struct(y.n, y.rep)
        # positional filter: from this shared shingle on, enough must be left in both, or an earlier one is shared too
        left = F.least(x.n - x.pos, y.n - y.pos) >= F.ceil(F.lit(p) * (x.n + y.n) / F.lit(100 + p))
        return pairs.filter(smaller & (x.comp != y.comp) & left & self._alike()).select(x.rep.alias("a"), y.rep.alias("b")).distinct()

    def _near(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the candidate pairs that are similar, as a table.

        Pairs of earlier rounds aren't verified again.  Both sets of a pair meet at its first end,
        the hub; a hub with many pairs is copied, one
        copy for each HUB_PAIRS of them, so no task gets more than those.
        """
        ends = F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")
        fresh = pairs.select("a", "b", *ends)
        for done in self.tested:
            fresh = fresh.join(done, ["lo", "hi"], "left_anti")
        pairs = self.scratch.table(fresh.select("a", "b"), name)
        free_shuffles(self.spark)
        self.tested.append(pairs.select(*ends))
        slices = self._slices(pairs.count(), SLICE_PAIRS)
        return self._parts(lambda i: self._similar(pairs.filter(F.pmod(F.xxhash64("a"), F.lit(slices)) == i), f"{name}-{i}"), slices, f"{name}-links")

    def _similar(self, pairs: DataFrame, name: str) -> DataFrame:
        hubs = self.scratch.table(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("salts")), f"{name}-hubs")
        member = pairs.join(hubs, "a").select(F.col("b").alias("doc_id"), F.struct(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt")).alias("t"))
        own = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        own = own.select(F.col("a").alias("doc_id"), F.struct(F.col("a").alias("hub"), "salt").alias("t"))
        targets = self.scratch.table(member.unionByName(own).groupBy("doc_id").agg(F.collect_list("t").alias("targets")), f"{name}-targets")
        met = pick_rows(self.docs, "doc_id", targets, BROADCAST_TARGETS).select("doc_id", "text", "targets")
        met = met.mapInArrow(_spread(self.words), "hub long, salt int, doc_id long, tokens binary")
        met = met.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("doc_id") != F.col("hub"))
        return met.mapInArrow(_verify(self.percent), "a long, b long")

    def _join_up(self, found: DataFrame, name: str) -> None:
        """Components after new links: links between components, each once, are labelled, not links between documents."""
        known = self.labels
        a = found.join(known.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left")
        both = a.join(known.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
        ends = both.select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
        steps = min_labels(ends.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct())
        old = known.join(steps.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
        self.labels = self.scratch.table(old.unionByName(steps.join(known.select("id"), "id", "left_anti")), name)

    def components(self) -> DataFrame:
        """doc_id, n_shingles, component_id: one row per row of the input."""
        classes = self.classes.join(self.labels, self.classes.rep == self.labels.id, "left")
        classes = classes.select("n", "body", F.coalesce("label", "rep").alias("component"))
        rows = self.sets.join(classes, ["n", "body"], "left")
        own = F.col("doc_id").isNull() | F.col("component").isNull()
        out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(own, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))
        if not self.repeated:
            return out
        more = self.ids.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("times"))
        again = out.join(more, "doc_id", "left").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1)))))
        return again.select("doc_id", "n_shingles", "component_id")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    return JaccardJoin(docs, id_col, text_col, words, percent).components()


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component; null ids stay."""
    join = JaccardJoin(docs, id_col, text_col, words, percent)
    parts = join.scratch.table(join.components(), "components")
    gone = join.scratch.table(parts.filter("doc_id <> component_id").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    return drop_rows(docs, docs[id_col].cast("long"), gone)
