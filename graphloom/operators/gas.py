"""Scatter-gather supersteps over vertex programs.

A program builds Columns, never rows: what a vertex sends, how messages combine, what a vertex
does with them, and whether it is active next.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph
from graphloom.operators import ranking
from graphloom.operators.primitives import COMBINE
from graphloom.plans.rounds import Rounds


@dataclass(frozen=True)
class Program:
    """``scatter`` may name the vertex's state; ``weigh`` gets (value, w) on edges; ``gather`` and
    ``activate`` may name the state and ``msg`` (null without messages); ``keep`` keeps a vertex
    active after it has sent; ``filter`` is a last test of activity."""

    scatter: Column
    combine: str
    gather: dict[str, Column]
    activate: Column
    weigh: object = None
    keep: Column | None = None
    filter: Column | None = None


def run(g: PropertyGraph, state: DataFrame, program: Program, max_iter: int | None = None) -> DataFrame:
    """State after the last superstep. ``state``: id, active and the program's columns."""
    rounds, arcs = Rounds(g.edges.sparkSession, "gas"), g.arcs(*(["w"] if program.weigh else []))
    state, seen = rounds.cut(state, active=F.col("active"))
    names = [c for c in state.columns if c not in ("id", "active")]
    step = 0
    while seen["active"] and (max_iter is None or step < max_iter):
        step += 1
        front = state.filter("active").select(F.col("id").alias("src"), program.scatter.alias("val"))
        sent = arcs.join(front, "src")
        value = program.weigh(F.col("val"), F.col("w")) if program.weigh else F.col("val")
        got = sent.groupBy(F.col("dst").alias("id")).agg(COMBINE[program.combine](value).alias("msg"))
        both = state.join(got, "id", "left")
        on = F.coalesce(F.col("msg").isNotNull() & program.activate, F.lit(False))
        if program.keep is not None:
            on = on | (F.col("active") & program.keep)
        new = both.select("id", *[program.gather.get(n, F.col(n)).alias(n) for n in names], on.alias("active"))
        if program.filter is not None:
            new = new.withColumn("active", F.col("active") & program.filter)
        state, seen = rounds.cut(new, active=F.col("active"))
    arcs.unpersist()
    return state.drop("active")


def gas_bfs(g: PropertyGraph, source: int) -> DataFrame:
    """id, level, parent."""
    at = F.col("id") == source
    state = g.vertices.select("id", F.when(at, F.col("id")).alias("parent"), F.when(at, F.lit(0)).alias("level"), at.alias("active"))
    new = F.col("level").isNull() & F.col("msg").isNotNull()
    program = Program(
        scatter=F.struct("id", "level"), combine="min", activate=F.col("level").isNull(),
        gather={"parent": F.when(new, F.col("msg.id")).otherwise(F.col("parent")), "level": F.when(new, F.col("msg.level") + 1).otherwise(F.col("level"))},
    )
    return run(g, state, program).select("id", "level", "parent")


def gas_sssp(g: PropertyGraph, source: int) -> DataFrame:
    """id, dist over edge weights w; stops after as many steps as vertices."""
    at = F.col("id") == source
    state = g.vertices.select("id", F.when(at, F.lit(0).cast("long")).alias("dist"), at.alias("active"))
    better = F.col("dist").isNull() | (F.col("msg") < F.col("dist"))
    program = Program(scatter=F.col("dist"), combine="min", weigh=lambda v, w: v + w, activate=better, gather={"dist": F.least("dist", "msg")})
    return run(g, state, program, g.vertices.count())


def gas_cc(g: PropertyGraph) -> DataFrame:
    """id, label: the smallest label over out-edges."""
    state = g.vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("active"))
    program = Program(scatter=F.col("label"), combine="min", activate=F.col("msg") < F.col("label"), gather={"label": F.least("label", F.coalesce("msg", "label"))})
    return run(g, state, program)


def gas_pagerank(g: PropertyGraph, iters: int = 10) -> DataFrame:
    return ranking.pagerank_unnormalised(g, iters)


def load_frontier(g: PropertyGraph, ids: list[int]) -> DataFrame:
    return g.vertices.filter(F.col("id").isin(ids))


def repeat_messages(front: DataFrame, times: str) -> DataFrame:
    """Each frontier row as often as its column says: several walkers on one vertex."""
    return front.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col(times)))).filter(F.col(times) > 0)
