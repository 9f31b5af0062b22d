"""Personal data: fixed patterns, then information-theoretic sanitisation.

Base spans are the matches of four patterns (email, ip, card, phone).  Their values are the
protected entities.  Terms that stand beside an entity may give it away: over the distinct
texts of the corpus, with N texts, the pointwise mutual information of term t and entity e,
log2(N co(e, t) / (df(e) df(t))), is the part of e's information log2(N / df(e)) that t reveals.
In texts that hold e, a term that reveals the share GENERALISE or more is generalised (to its
shape), from REMOVE on it is removed.  Every entity and pair is scored, those of one text too:
co is taken less DISCOUNT (absolute discounting), so that the chance of small counts weighs
against them by degrees.

Entities that stand in the same texts have the same counts, so they are counted as one class: a
long text with many entities of its own gives each of its terms once, not once an entity.

Counts cover the whole corpus: co-occurrences come from the texts that hold entities; df(t)
from all texts, where a bit map of fixed size first drops terms that can't be candidates and a
join then keeps the exact ones.

Equal texts (by a 128-bit hash) count once and get equal spans.  Defined results: null and empty texts have no
spans; null ids keep their row; repeated rows each get one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import WordHashes, bit_map, bytes_of, map_holds, needed, salted_lookup, tune
from graphloom.store import Scratch

KINDS = ("email", "ip", "card", "phone")
ACTIONS = ("generalise", "remove")
GENERALISE, REMOVE = 0.75, 0.95
#: Church and Gale's: what a count of a pair is above its expectation in another sample.
DISCOUNT = 0.75
#: Bits of the candidate map, whatever the corpus size: 2 MB.
MAP_BITS = 1 << 24
#: Sums that a task of the counting pass holds before it sends them on.
SUMS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
# possessive runs: a failing run of digits isn't tried again from each of its digits
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_CUT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def _emails(text: str):
    """Leftmost matches: the run of local characters before an @, then the domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and not _NOT_LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then by kind as in KINDS."""
    spans = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _find(batches):
    """Base spans of every row; entities and terms of those that have any."""
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    terms_type = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        keys, spans, entities, terms = [], [], [], []
        for raw in bytes_of(batch.column(1)):
            text = raw.decode("utf-8", "replace")
            found = base_spans(text)
            keys.append(xxhash.xxh3_128_digest(raw))
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            if not found:
                entities.append([])
                terms.append([])
                continue
            entities.append(sorted({_signed(xxhash.xxh3_64_intdigest(f"{k}:{text[a:b].lower()}".encode())) for k, a, b in found}))
            inside, near, end = [], iter(found), -1
            nxt = next(near)
            for m in _TERM.finditer(text):
                a, b = m.span()
                while nxt is not None and nxt[1] < b:
                    end, nxt = max(end, nxt[2]), next(near, None)
                term = m[0].encode().lower()
                if a >= end:
                    inside.append({"term": _signed(xxhash.xxh3_64_intdigest(term)), "start": a, "end": b})
            terms.append(inside)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array([_low(k) for k in keys], pa.int64()), pa.array(spans, spans_type), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, terms_type)],
            ["doc_id", "text_key", "low", "base", "entities", "terms"],
        )


def _low(key: bytes) -> int:
    """A text key's part that bit maps go by."""
    return int.from_bytes(key[:8], "little", signed=True)


def _candidates(marks, copied):
    """term, text_key, n: how many texts of a partition hold a term that the map may hold.

    Texts that may have copies come one by one with their key, all others as sums.
    """

    def rows(terms: list[int], keys: list[bytes | None], counts: list[int]):
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.int64())], ["term", "text_key", "n"])

    def run(batches):
        hashes, bits, copies = WordHashes(), np.frombuffer(marks.value, np.uint8), np.frombuffer(copied.value, np.uint8)
        sums: Counter[int] = Counter()
        for batch in batches:
            out, keys = [], []
            for raw in bytes_of(batch.column(0)):
                terms = np.array([hashes[t] for t in set(raw.translate(_CUT).lower().split())], np.uint64)
                terms = terms[map_holds(bits, MAP_BITS, terms)].view(np.int64).tolist()
                key = xxhash.xxh3_128_digest(raw)
                if map_holds(copies, MAP_BITS, np.array([_low(key)], np.int64).view(np.uint64))[0]:
                    keys += [key] * len(terms)
                    out += terms
                else:
                    sums.update(terms)
            if out:
                yield rows(out, keys, [1] * len(out))
            if len(sums) > SUMS:
                yield rows(list(sums), [None] * len(sums), list(sums.values()))
                sums.clear()
        yield rows(list(sums), [None] * len(sums), list(sums.values()))

    return run


_ACTION = "array<struct<kind:string,start:int,end:int>>"


def _holding(found: DataFrame) -> DataFrame:
    """text_key, terms of the distinct texts that hold entities."""
    return found.filter(F.size("entities") > 0).select("text_key", F.array_distinct(F.transform("terms", lambda t: t.term)).alias("terms")).dropDuplicates(["text_key"])


def _classes(scratch: Scratch, found: DataFrame) -> DataFrame:
    """text_key, class, df_e: the classes of entities in each text, and in how many texts a class is."""
    pairs = scratch.table(found.filter(F.size("entities") > 0).select("text_key", F.explode("entities").alias("entity")).distinct(), "pairs")
    texts = [F.bit_xor(F.xxhash64("text_key", F.lit(i))).alias(f"x{i}") for i in range(2)]
    known = pairs.groupBy("entity").agg(F.count("*").alias("df_e"), *texts).select("entity", "df_e", F.xxhash64("df_e", "x0", "x1").alias("class"))
    # a hot entity stands in many texts; AQE splits its side of this join
    return scratch.table(pairs.join(known, "entity").select("text_key", "class", "df_e").distinct(), "classes")


def _disclosing(scratch: Scratch, found: DataFrame, classes: DataFrame, docs: DataFrame, generalise: float, remove: float) -> DataFrame:
    """class, term, action: the terms that reveal enough of a class of entities."""
    spark = scratch.spark
    texts, holding = found.select("text_key").distinct().count(), _holding(found)
    known = classes.select("class", "df_e").distinct()
    together = classes.join(holding, "text_key").select("class", F.explode("terms").alias("term"))
    together = together.groupBy("class", "term").agg(F.count("*").alias("co"))
    # a term is as frequent at least as in the texts that hold entities; that rules out common words
    rare = holding.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df_least"))
    most = (F.col("co") - DISCOUNT) * F.pow(F.lit(float(texts)) / F.col("df_e"), F.lit(1 - generalise)) * (1 + 1e-9)
    together = scratch.table(together.join(rare, "term").join(known, "class").filter(F.col("df_least") <= most).select("class", "df_e", "term", "co"), "rare")
    if together.isEmpty():
        return together.select("class", "term", F.lit("").alias("action"))
    copied = found.groupBy("text_key", "low").count().filter("count > 1").select("low")
    marks = [spark.sparkContext.broadcast(bit_map(values, MAP_BITS)) for values in (together.select("term").distinct(), copied)]
    seen = docs.select("text").mapInArrow(_candidates(*marks), "term long, text_key binary, n long")
    seen = seen.join(together.select("term").distinct(), "term", "left_semi").groupBy("term", "text_key").agg(F.sum("n").alias("n"))
    often = seen.groupBy("term").agg(F.sum(F.when(F.col("text_key").isNull(), F.col("n")).otherwise(1)).alias("df_t"))
    n = F.lit(float(texts))
    measured = together.join(often, "term")
    measured = measured.withColumn("pmi", F.log2(n * (F.col("co") - DISCOUNT) / (F.col("df_e") * F.col("df_t")))).withColumn("whole", F.log2(n / F.col("df_e")))
    share = F.when(F.col("whole") > 0, F.col("pmi") / F.col("whole")).otherwise(F.lit(0.0))
    action = F.when(share >= remove, F.lit("remove")).when(share >= generalise, F.lit("generalise"))
    return measured.select("class", "term", action.alias("action")).filter("action is not null")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """doc_id, text_key, base, terms: one row per row of ``docs``.

    ``base``: array of (kind, start, end); ``terms``: array of (kind, start, end) whose kind is the action.
    """
    tune(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "pii")
    docs = needed(docs, doc_id=id_col, text=text_col)
    kinds = dict(docs.dtypes)
    found = docs.mapInArrow(
        _find,
        f"doc_id {kinds['doc_id']}, text_key binary, low long, base array<struct<kind:string,start:int,end:int>>, entities array<long>, terms array<struct<term:long,start:int,end:int>>",
    )
    found = scratch.table(found, "found")
    classes = _classes(scratch, found)
    reveal = scratch.table(_disclosing(scratch, found, classes, docs, generalise, remove), "disclosing")
    # only terms that stand in the text itself meet the lists of its classes
    there = classes.join(reveal.select("class").distinct(), "class", "left_semi").join(_holding(found), "text_key").select("text_key", "class", F.explode("terms").alias("term"))
    hits = there.join(reveal, ["class", "term"]).groupBy("text_key", "term").agg(F.max("action").alias("action"))  # remove outranks generalise
    places = found.filter(F.size("entities") > 0).select("text_key", "terms").dropDuplicates(["text_key"]).select("text_key", F.explode("terms").alias("t")).select("text_key", "t.*")
    spans = places.join(hits, ["text_key", "term"]).select("text_key", F.struct(F.col("action").alias("kind"), "start", "end").alias("s"))
    spans = scratch.table(spans.groupBy("text_key").agg(F.array_sort(F.collect_list("s")).alias("terms")), "spans")
    rows = salted_lookup(found.select("doc_id", "text_key", "base"), spans, "text_key", F.xxhash64("doc_id"))
    return rows.select("doc_id", "text_key", "base", F.coalesce("terms", F.array().cast(_ACTION)).alias("terms"))


def _shape(word: str) -> str:
    return "[number]" if word.isdigit() else "[name]" if word[:1].isupper() else "[word]"


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """doc_id, text: base spans become their kind's mark, terms are generalised to their shape or removed."""
    spans = find_spans(docs, id_col, text_col, **limits)
    spans = spans.select("text_key", F.concat("base", "terms").alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["text_key"])
    spans = Scratch(docs.sparkSession, "sanitise").table(spans, "spans")

    def keyed(batches):
        for batch in batches:
            keys = [xxhash.xxh3_128_digest(raw) for raw in bytes_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], ["doc_id", "text", "text_key"])

    def rewrite(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                done, at = [], 0
                for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] < at:
                        at = max(at, s["end"])  # overlapping spans: the first one's mark covers them
                        continue
                    word = text[s["start"] : s["end"]]
                    done += [text[at : s["start"]], "" if s["kind"] == "remove" else _shape(word) if s["kind"] == "generalise" else f"[{s['kind']}]"]
                    at = s["end"]
                out.append(text if text is None else "".join(done) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = needed(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.mapInArrow(keyed, f"doc_id {kind}, text string, text_key binary")
    return salted_lookup(rows, spans, "text_key", F.xxhash64("doc_id")).select("doc_id", "text", "spans").mapInArrow(rewrite, f"doc_id {kind}, text string")


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans from ``find_spans``' rows."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate((*KINDS, *ACTIONS)) for x in (k, i)])
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    every = F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("rank"), s.kind.alias("kind"), s.end.alias("end"))))
    of = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in KINDS]
    return spans.select("doc_id", *counts, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(every).alias("spans"))
