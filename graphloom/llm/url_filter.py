"""URL filters: sort-merge range join on reversed-host keys.

A URL's key is its host's labels reversed, each closed by a dot, then path and a row hash.  A
rule's host, written likewise, is a prefix of the keys of that host and all its subdomains, so
it is the interval [prefix, prefix + highest character).  Keys and intervals are cut into
shards at quantiles of a bounded hash sample of keys (a hot host has many keys and so spans
many shards); an interval goes to every shard it overlaps.  In a shard one sorted sweep reads
rules and URLs together and keeps the stack of the rules' hosts that are open: intervals nest,
so those that end before the next key are popped and what is left applies.  Of the open hosts'
rules whose path starts the URL's path the longest wins (ties: the longer host).

Defined results: null urls and urls without ``://`` have empty host and path and match no rule;
repeated urls each get a row; urls of any length are read whole; without rules everything gets the default verdict.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import needed
from graphloom.store import Scratch

#: Keys, about, in the hash sample that places shard borders; it bounds what the driver sees, not what is joined.
SAMPLE = 20_000
#: Characters of a sampled key that go to the driver: a prefix of a key is as good a border.
BORDER = 2_000
TOP = "\U0010ffff"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    tail = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), tail


def reversed_host(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _sweep(batches):
    """Rows sorted by (shard, key, kind): rules open before the URLs at or after their prefix."""
    shard, stack = None, []
    for batch in batches:
        out = []
        for s, key, kind, row, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != shard:
                shard, stack = s, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:  # a rule: its interval opens, and holds a path table
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                if path not in stack[-1][1] or (rule, verdict) < stack[-1][1][path]:
                    stack[-1][1][path] = (rule, verdict)
                continue
            best = None
            for prefix, table in stack:
                for p, (r, v) in table.items() if len(table) < 8 else _starts(table, path):
                    if path.startswith(p) and (best is None or (len(r), len(prefix)) > best[0]):
                        best = ((len(r), len(prefix)), r, v)
            out.append((row, host, path, best and best[1], best and best[2]))
        if out:
            types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["page_id", "host", "path", "rule", "verdict"])


def _starts(table: dict, path: str):
    """Entries of a large path table that start ``path``: one look-up a character."""
    for i in range(len(path) + 1):
        if path[:i] in table:
            yield path[:i], table[path[:i]]


def apply_rules(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row.  ``rules``: host, path, verdict (path starts with /)."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.coalesce(F.col("url"), F.lit("")))
    urls = needed(pages, row=id_col, url=url_col).select(F.col("row").cast("long").alias("row"), host.alias("host"), path.alias("path"), F.xxhash64("row", "url").alias("h"))
    urls = urls.withColumn("key", F.concat(reversed_host(F.col("host")), "path", F.lit("\x01"), F.hex("h")))
    urls = scratch.table(urls, "urls")
    ruled = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").distinct()
    ruled = ruled.select(reversed_host(F.col("host")).alias("key"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")

    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = min(1.0, SAMPLE / max(1, urls.count()))
    sample = sorted(r.key for r in urls.filter(F.hash("h") <= F.lit(min(2**31 - 1, int(-(2**31) + part * 2**32)))).select(F.substring("key", 1, BORDER).alias("key")).collect())
    borders = sorted({sample[len(sample) * i // shards] for i in range(1, shards)}) if sample else []
    shared = spark.sparkContext.broadcast(borders)  # at most one key a shard

    @F.pandas_udf("int")
    def shard_of(keys):
        return keys.map(lambda k: bisect_right(shared.value, k)).astype("int32")

    urls = urls.select(shard_of("key").alias("shard"), "key", F.lit(1).alias("kind"), "row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    spans = ruled.withColumn("shard", F.explode(F.sequence(shard_of("key"), shard_of(F.concat("key", F.lit(TOP))))))
    spans = spans.select("shard", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("row"), "host", "path", "rule", "verdict")
    merged = urls.unionByName(spans).repartition(shards, "shard").sortWithinPartitions("shard", "key", "kind")
    out = merged.mapInArrow(_sweep, "page_id long, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
