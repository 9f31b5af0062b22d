"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size gives the whole copies that every document gets for certain.  The
rest of the target, what the source lacks, is sampled with unequal odds, in proportion to size:
document i is included with probability p_i = min(1, rate x size_i), and the rate is the one for
which the expected words are what is lacking.  Documents with p_i = 1 are certain and get one
more whole copy.  All others are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the first ones are taken until their words reach the rest, so
the sample's size is fixed in words.  u comes from an MD5 of seed and id, so reruns agree and an
SQL engine can repeat it.

Ranks are never computed by sorting a source in one task.  The rank's place in [0, 1) is cut
into BINS bins, the one that holds the cut point is cut into BINS again, and only the rows in
that sub-bin are sorted; all else follows from sums over bins.  Targets and rates come from
windows over tables with one row a source, or one a source and size.

Defined results: null text has size 0; a null source is a source of its own, last in order;
documents of size 0 take part with no words; rows that tie in id are ordered by size, and rows
equal in both are taken together; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import needed, salted_lookup
from graphloom.store import Scratch

BINS = 1024


def word_count(text) -> F.Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """name, k, source_size, target: shares of the budget by weight, in code point order.

    None is above ``most`` times its size, the excess is reshared by weight.  By size over weight, the
    first sources are capped: as many as it takes until the next one's share isn't above its cap.
    """
    sums = sizes.groupBy("name").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    # the null source's name is the only empty one
    k = F.row_number().over(Window.orderBy(F.col("name") == "", "name"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("k") - 1) % len(weights) + 1)
    sums = sums.withColumn("k", k).withColumn("w", w).withColumn("ratio", most * F.col("source_size") / F.col("w"))
    by, all_ = Window.orderBy("ratio", "k"), Window.partitionBy()
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    capped, from_here = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0)), F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    sums = sums.withColumn("level", (share * F.sum("source_size").over(all_) - capped) / from_here)
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(all_)
    sums = sums.withColumn("c", first)
    over = F.col("c").isNull() | (F.col("ratio") < F.col("c.ratio"))
    return sums.select("name", "k", "source_size", F.when(over, most * F.col("source_size")).otherwise(F.col("w") * F.col("c.level")).alias("target"))


def _rates(targets: DataFrame, sizes: DataFrame, most: float) -> DataFrame:
    """name, k, source_size, target, whole, lacks, largest, rate: what sampling needs of each source.

    Documents above ``largest`` words are certain, ``lacks`` is what remains after them.
    """
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(int(most)), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size"))
    down = Window.partitionBy("name").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("name").orderBy("size")
    steps = sizes.filter("size > 0").withColumn("above", F.coalesce(F.sum(F.col("size") * F.col("rows")).over(down), F.lit(0)))
    steps = steps.withColumn("square", F.sum(F.col("size").cast("double") * F.col("size") * F.col("rows")).over(up))
    steps = steps.join(plan.select("name", "need"), "name").withColumn("rest", F.col("need") - F.col("above"))
    fits = steps.filter(F.col("rest") * F.col("size") < F.col("square"))
    best = fits.groupBy("name").agg(F.max(F.struct("size", "rest", "square")).alias("b"))
    out = plan.join(best, "name", "left")
    # no size fits when all documents are certain
    return out.select(
        "name", "k", "source_size", "target", "whole", F.coalesce(F.col("b.rest"), F.lit(0.0)).alias("lacks"),
        F.coalesce(F.col("b.size"), F.lit(0)).alias("largest"), F.greatest(F.coalesce(F.col("b.rest") / F.col("b.square"), F.lit(0.0)), F.lit(0.0)).alias("rate"),
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = needed(docs, doc_id=id_col, text=text_col, source=source_col)
    # the source as a key that may be null
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("name")
    rows = scratch.table(rows.select(F.col("doc_id").cast("long").alias("doc_id"), name, word_count(F.col("text")).alias("size")), "sizes")
    sizes = scratch.table(rows.groupBy("name", "size").agg(F.count("*").alias("rows")), "by-size")
    plan = scratch.table(_rates(_targets(sizes, weights, share, most), sizes, most), "plan")

    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    ranked = salted_lookup(rows, plan, "name", F.xxhash64("doc_id")).drop("name")
    certain = F.col("size") > F.col("largest")
    ranked = ranked.withColumn("whole", F.col("whole") + certain.cast("long")).withColumn("part", F.when(certain, 0.0).otherwise(F.col("rate") * F.col("size")))
    # without a chance: last of all
    ranked = ranked.withColumn("rank", F.when(F.col("part") > 0, (u / (1 - u)) / (F.col("part") / (1 - F.col("part")))).otherwise(F.lit(1e300)))
    ranked = ranked.withColumn("mass", F.when(certain, 0).otherwise(F.col("size"))).withColumn("place", F.col("rank") / (1 + F.col("rank")))
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("place") * BINS), F.lit(BINS - 1)))
    ranked = ranked.withColumn("sub", F.least(F.floor((F.col("place") * BINS - F.col("bin")) * BINS), F.lit(BINS - 1)))

    def cut(table: DataFrame, by: str, before) -> DataFrame:
        """The bin of each source in which the words taken so far reach what it lacks."""
        sums = table.groupBy("k", by).agg(F.sum("mass").alias("words"), F.first("lacks").alias("lacks"), F.first(before).alias("start"))
        run = sums.withColumn("upto", F.col("start") + F.sum("words").over(Window.partitionBy("k").orderBy(by)))
        return run.filter(F.col("upto") >= F.col("lacks")).groupBy("k").agg(F.min(F.struct(F.col(by), (F.col("upto") - F.col("words")).alias("start"))).alias("c"))

    def lookup(table: DataFrame, small: DataFrame) -> DataFrame:
        return salted_lookup(table, small, "k", F.xxhash64("doc_id"))

    first = scratch.table(cut(ranked, "bin", F.lit(0).cast("long")).select("k", F.col("c.bin").alias("cut_bin"), F.col("c.start").alias("bin_start")), "cut1")
    inside = lookup(ranked, first).filter(F.col("bin") == F.col("cut_bin"))
    second = cut(inside, "sub", F.col("bin_start")).select("k", F.col("c.sub").alias("cut_sub"), F.col("c.start").alias("sub_start"))
    second = scratch.table(second, "cut2")
    last = lookup(inside, second).filter(F.col("sub") == F.col("cut_sub"))
    w = Window.partitionBy("k").orderBy("rank", F.col("doc_id").asc_nulls_last(), "size")
    last = last.withColumn("upto", F.col("sub_start") + F.sum("mass").over(w)).filter(F.col("upto") - F.col("mass") / 2 <= F.col("lacks"))
    here = F.struct("rank", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "size")
    last = scratch.table(last.groupBy("k").agg(F.max(here).alias("edge")), "edge")

    cuts = scratch.table(first.join(second, "k", "left").join(last, "k", "left").select("k", F.struct(F.col("cut_bin").alias("bin"), F.col("cut_sub").alias("sub")).alias("cut_at"), "edge"), "cuts")
    out, at = lookup(ranked, cuts), F.struct("bin", "sub")
    # a source without a cut takes everything that its whole copies leave over
    chosen = F.when(certain | (F.col("lacks") <= 0), F.lit(False)).when(F.col("cut_at").isNull(), F.lit(True)).when(at < F.col("cut_at"), F.lit(True)).when(at > F.col("cut_at"), F.lit(False))
    chosen = chosen.otherwise(F.coalesce(here <= F.col("edge"), F.lit(False)))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + chosen.cast("long"))).alias("taken"))
