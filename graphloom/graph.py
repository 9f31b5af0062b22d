"""Graphs and hypergraphs as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PropertyGraph:
    """vertices(id LONG), edges(src LONG, dst LONG[, w]); vertices hold the isolated ones too."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def of(edges: DataFrame, vertices: DataFrame | None = None) -> PropertyGraph:
        """Without a vertex table the ids are 0 to the largest one that an edge names."""
        if vertices is None:
            top = edges.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)).alias("m")).first()["m"]
            vertices = edges.sparkSession.range(top + 1)
        return PropertyGraph(vertices, edges)

    @property
    def weighted(self) -> bool:
        return "w" in self.edges.columns

    def transpose(self) -> PropertyGraph:
        more = [c for c in self.edges.columns if c not in ("src", "dst")]
        return PropertyGraph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))

    def simplify(self) -> PropertyGraph:
        """No loops, no repeated edges; the smallest weight of repeated ones stays."""
        edges = self.edges.filter("src <> dst")
        edges = edges.groupBy("src", "dst").agg(F.min("w").alias("w")) if self.weighted else edges.select("src", "dst").distinct()
        return PropertyGraph(self.vertices, edges)

    def symmetrize(self) -> PropertyGraph:
        both = self.edges.unionByName(self.transpose().edges)
        return PropertyGraph(self.vertices, both).simplify()

    def degrees(self) -> DataFrame:
        """id, out_deg, in_deg, with zeros: one aggregation over both ends of each edge."""
        ends = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o")))).alias("e")).select("e.*")
        sums = ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum(1 - F.col("o")).alias("in_deg"))
        return self.vertices.join(sums, "id", "left").select("id", F.coalesce("out_deg", F.lit(0)).alias("out_deg"), F.coalesce("in_deg", F.lit(0)).alias("in_deg"))

    def adjacency(self) -> DataFrame:
        """id, nbrs: sorted neighbour arrays, for export and bounded graphs."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))

    def relabel(self, perm: DataFrame) -> PropertyGraph:
        """``perm``: old_id, new_id. Weights stay with their edges."""
        a = perm.select(F.col("old_id").alias("src"), F.col("new_id").alias("_s"))
        b = perm.select(F.col("old_id").alias("dst"), F.col("new_id").alias("_d"))
        more = [c for c in self.edges.columns if c not in ("src", "dst")]
        edges = self.edges.join(a, "src").join(b, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *more)
        return PropertyGraph(self.vertices.join(perm, self.vertices.id == perm.old_id).select(F.col("new_id").alias("id")), edges)

    def arcs(self, *columns: str) -> DataFrame:
        """Edges for a loop: hashed by source once, so that rounds shuffle states only."""
        return self.edges.select("src", "dst", *columns).repartition("src").persist()


@dataclass(frozen=True)
class HyperGraph:
    """Incidences v2h(v, h[, w]) and h2v(h, v[, w]); ids of both sides start at 0."""

    v2h: DataFrame
    h2v: DataFrame
    vertices: DataFrame
    hyperedges: DataFrame

    @staticmethod
    def symmetric(incidence: DataFrame, vertices: DataFrame, hyperedges: DataFrame) -> HyperGraph:
        """``incidence``: v, h[, w]; in and out members are the same."""
        return HyperGraph(incidence, incidence, vertices, hyperedges)

    def expand(self) -> PropertyGraph:
        """Clique expansion: an edge for each ordered pair of different members, repeats kept."""
        a, b = self.v2h.alias("a"), self.h2v.alias("b")
        weight = [F.col("a.w").alias("w")] if "w" in self.v2h.columns else []
        pairs = a.join(b, F.col("a.h") == F.col("b.h")).filter(F.col("a.v") != F.col("b.v"))
        return PropertyGraph(self.vertices, pairs.select(F.col("a.v").alias("src"), F.col("b.v").alias("dst"), *weight))

    def bipartite(self) -> PropertyGraph:
        """Both sides as one graph: hyperedge h becomes id -1 - h."""
        other = -1 - F.col("h")
        edges = self.v2h.select(F.col("v").alias("src"), other.alias("dst")).unionByName(self.h2v.select(other.alias("src"), F.col("v").alias("dst")))
        return PropertyGraph(self.vertices.select("id").unionByName(self.hyperedges.select((-1 - F.col("id")).alias("id"))), edges)
