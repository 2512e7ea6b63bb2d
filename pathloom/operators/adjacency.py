"""Packed neighbour lists: the graph as a walk reads it.

Edges (h, r, t) of one graph for all questions, or (case_id, h, r, t) of one graph for each,
become rows (src, piece, r, out) with an array of (dst, out[, edge_id]): written once, bucketed
and sorted by what hops join on, so that a hop shuffles its states and never the graph. An
edge gets its name in the hop. A hub's lists are cut into numbered pieces by a hash of the
edge, `PIECE` edges each; a state at a hub goes to every piece of it, so its hop is spread over
as many tasks. Where there is no hub, pieces are no part of the buckets or the join: one that
is 0 everywhere would be taken out of the join, whose keys then are not the buckets'."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.operators.graph import clean, directed, edge_name
from pathloom.operators.lineage import folder, kept

#: Edges of one piece of a node's lists.
PIECE = 8192
#: Hubs that are broadcast at most; more of them are joined with a shuffle.
HUBS = 100_000


def key_of(df: DataFrame) -> list[str]:
    """What tells questions apart: case_id where there is one, and the anchor."""
    return [c for c in ("case_id", "anchor") if c in df.columns]


def last(nodes: str = "nodes") -> Column:
    return F.element_at(nodes, -1)


@dataclass
class Graph:
    """`lists` ([case_id,] src, piece, r, out) and `hubs` ([case_id,] src, pieces)."""

    lists: DataFrame
    hubs: DataFrame
    n_hubs: int

    @property
    def keyed(self) -> bool:
        return "case_id" in self.lists.columns

    def pieces(self, states: DataFrame) -> DataFrame:
        """States with the node and piece of the graph that they read next."""
        at = states.withColumn("_at", last())
        if not self.n_hubs:
            return at
        hubs = self.hubs.withColumnsRenamed({"src": "_hub", "case_id": "_case"})
        hubs = F.broadcast(hubs) if self.n_hubs <= HUBS else hubs
        on = F.col("_at") == F.col("_hub")
        on = on & (F.col("case_id") == F.col("_case")) if self.keyed else on
        many = at.join(hubs, on, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)))
        return many.drop("_hub", "_case", "pieces")

    def lookup(self, states: DataFrame, where: Column | None = None) -> DataFrame:
        """States beside the edges (r, dst, edge) at their ends. `where` is about r and the
        state, and is applied to lists, before they are unpacked."""
        lists = self.lists.withColumnsRenamed({"src": "_src", "piece": "_p", "case_id": "_case"})
        on = F.col("_at") == F.col("_src")
        on = on & (F.col("_piece") == F.col("_p")) if self.n_hubs else on
        on = (F.col("case_id") == F.col("_case")) & on if self.keyed else on
        met = self.pieces(states).join(lists, on)
        met = met if where is None else met.where(where)
        number = "_o.edge_id" if "edge_id" in self.lists.schema["out"].dataType.elementType.fieldNames() else None
        each = met.select(*states.columns, "_at", "r", F.explode("out").alias("_o"))
        return each.select(*states.columns, "r", "_o.dst", edge_name("_at", "r", "_o.dst", "_o.out", number).alias("edge"))

    def hop(self, states: DataFrame, where: Column | None = None, then: Column | None = None, node_simple: bool = False) -> DataFrame:
        """One hop. Edge-simple, or node-simple, which implies it; `then` is about dst as well.
        Other columns come along."""
        return grow(states, self.lookup(states, where), then, node_simple)


def grow(states: DataFrame, met: DataFrame, then: Column | None = None, node_simple: bool = False) -> DataFrame:
    """States one edge longer, from states beside edges (r, dst, edge)."""
    fresh = ~F.array_contains("nodes", F.col("dst")) if node_simple else ~F.array_contains("edges", F.col("edge"))
    met = met.where(fresh if then is None else fresh & then)
    grown = {"nodes": F.array_append("nodes", F.col("dst")), "rels": F.array_append("rels", F.col("r")), "edges": F.array_append("edges", F.col("edge"))}
    return met.select(*(grown[c].alias(c) if c in grown else F.col(c) for c in states.columns))


def pack(edges: DataFrame, piece: int = PIECE, buckets: int | None = None, noise: bool = False) -> Graph:
    """The graph of some edges, without noisy relations unless `noise`. `buckets` is the number
    of shuffle partitions by default."""
    spark = edges.sparkSession
    steps = directed(kept(edges if noise else clean(edges)))  # counted, then packed
    node = [c for c in ("case_id", "src") if c in steps.columns]
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"graph_{uuid.uuid4().hex}"
    path = f"{folder(spark)}/{name}"
    hubs = steps.groupBy(*node).agg(F.ceil(F.count("*") / piece).cast("int").alias("pieces")).where("pieces > 1")
    hubs.write.parquet(f"{path}-hubs")
    hubs = spark.read.schema(hubs.schema).parquet(f"{path}-hubs")
    n_hubs = hubs.count()
    edge = ["dst", "out", *(c for c in steps.columns if c == "edge_id")]
    if n_hubs:
        side = F.broadcast(hubs) if n_hubs <= HUBS else hubs
        steps = steps.join(side, node, "left").withColumn("piece", F.pmod(F.xxhash64("r", *edge), F.coalesce("pieces", F.lit(1))).cast("int"))
    else:
        steps = steps.withColumn("piece", F.lit(0))
    keys = [*node, "piece"] if n_hubs else node
    lists = steps.repartition(n, *keys).groupBy(*node, "piece", "r").agg(F.collect_list(F.struct(*edge)).alias("out"))
    lists.sortWithinPartitions(*keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(name)
    return Graph(spark.table(name), hubs, n_hubs)


def as_graph(edges: DataFrame | Graph) -> Graph:
    return edges if isinstance(edges, Graph) else pack(edges)
