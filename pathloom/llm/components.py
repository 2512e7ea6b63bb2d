"""Connected components by alternating large and small stars, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import kept


def _stars(edges: DataFrame) -> DataFrame:
    """One large and one small star on edges (u, v), v < u. A node's least neighbour comes
    from partial aggregates, so a hub's edges never meet in one task."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u")
    moved = small.where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _joined(edges: DataFrame) -> bool:
    """Whether every component of edges (u, v) is a star around its least node: each u
    has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0] == 0


#: So many edges at most go to one task as they are; more take the stars.
FEW = 1 << 14


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) of all edges of one task to (node, cls) by union and find."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := top.setdefault(root, root)) != root:
            root = up
        while top[x] != root:
            top[x], x = root, top[x]
        return root

    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
            a, c = find(u), find(v)
            top[max(a, c)] = min(a, c)
    nodes = list(top)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "cls"])


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, cls) of the nodes of links (a, b): cls is the least node of the component.
    `labels`, the result for other links, stands for those. A few links, counted first, are
    united in one task; more go by stars: each round's edges are kept in the shared folder,
    until all components are stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if labels is not None:
        edges = edges.unionAll(labels.select("node", "cls"))
    edges = edges.where("u > v")
    if edges.limit(FEW + 1).count() <= FEW:
        return kept(edges.coalesce(1).mapInArrow(_united, "node long, cls long"))
    return by_stars(edges)


def by_stars(edges: DataFrame) -> DataFrame:
    edges = edges.distinct()
    while True:
        edges = kept(_stars(edges))
        if _joined(edges):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("cls")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("cls")).distinct())
