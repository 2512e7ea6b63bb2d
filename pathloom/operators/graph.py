"""Edges and neighbourhoods: every operator takes edges (h, r, t) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import is_cvt, is_noisy


def clean(edges: DataFrame) -> DataFrame:
    """Without noisy relations; the filter is pushed below every hop."""
    return edges.where(~is_noisy(F.col("r")))


def owner(edges: DataFrame) -> list[str]:
    """Columns that say whose graph an edge belongs to, where each question has its own."""
    return [c for c in ("case_id", "anchor") if c in edges.columns]


def directed(edges: DataFrame, *carried: str) -> DataFrame:
    """(src, r, dst, out): each edge in both directions, a self-loop once; `out` where it leaves
    src. `owner`, edge_id and `carried` columns come along."""
    more = [*owner(edges), *(c for c in edges.columns if c == "edge_id"), *carried]
    side = lambda rows, a, b: rows.select(*more, F.col(a).alias("src"), "r", F.col(b).alias("dst"), F.lit(a == "h").alias("out"))
    return side(edges, "h", "t").unionByName(side(edges.where("h <> t"), "t", "h"))


def edge_name(src: str = "src", r: str = "r", dst: str = "dst", out: str = "out", number: str | None = None) -> Column:
    """An edge is named by its ends and relation; with edge_id its number comes first, so that edges
    sort in the order they came in."""
    first = [] if number is None else [F.lpad(F.col(number).cast("string"), 12, "0")]
    return F.concat_ws("|", *first, F.when(F.col(out), F.col(src)).otherwise(F.col(dst)), r, F.when(F.col(out), F.col(dst)).otherwise(F.col(src)))


def numbered(steps: DataFrame) -> str | None:
    return "edge_id" if "edge_id" in steps.columns else None


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, r, dst, edge): each edge in both directions, a self-loop once; with what says whose
    edges they are (`owner`), if anything."""
    steps = directed(edges)
    return steps.select(*owner(edges), "src", "r", "dst", edge_name(number=numbered(steps)).alias("edge"))


def expand(nodes: DataFrame, edges: DataFrame, relations: list[str], reverse: bool = False) -> DataFrame:
    """(node, r, next) by edges of some relations, forward or reverse."""
    a, b = ("t", "h") if reverse else ("h", "t")
    return nodes.join(edges.where(F.col("r").isin(*relations)), F.col("node") == F.col(a)).select("node", "r", F.col(b).alias("next"))


def through_cvt(edges: DataFrame) -> DataFrame:
    """(cvt, nb): the neighbours of every fact node, each once."""
    return both_ways(edges).where(is_cvt(F.col("src")) & (F.col("dst") != F.col("src"))).select(F.col("src").alias("cvt"), F.col("dst").alias("nb")).distinct()


def sibling_tails(edges: DataFrame, hops: DataFrame) -> DataFrame:
    """All (h, r, t) whose (h, r) is a hop of some path."""
    return edges.join(hops.select("h", "r").distinct(), ["h", "r"], "left_semi")


def sibling_cvts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, sibling): for asked fact nodes (node), the others under the same head and relation.
    Only heads of asked nodes are looked up, so a hub costs its tails times the asked ones."""
    own = edges.where(is_cvt(F.col("t")))
    asked = own.join(nodes.select(F.col("node").alias("t")).distinct(), "t", "left_semi").select("h", "r", F.col("t").alias("node"))
    return asked.join(own.select("h", "r", F.col("t").alias("sibling")), ["h", "r"]).where("node <> sibling").select("node", "sibling")


def named_neighbours(edges: DataFrame) -> DataFrame:
    """(cvt, r, name): named neighbours of fact nodes, from either end; an edge has one at most, so
    it is read once. Edges that say their fact node (`fact`) keep the parts they are dealt in."""
    one = edges.where("h is not null and t is not null").where(is_cvt(F.col("h")) != is_cvt(F.col("t")))
    down = is_cvt(F.col("h"))
    cvt = F.col("fact") if "fact" in edges.columns else F.when(down, F.col("h")).otherwise(F.col("t"))
    return one.select(cvt.alias("cvt"), "r", F.when(down, F.col("t")).otherwise(F.col("h")).alias("name"))


def cvt_attributes(edges: DataFrame) -> DataFrame:
    """(cvt, attributes): 'relation=name' of the named neighbours of a fact node, in order."""
    return named_neighbours(edges).groupBy("cvt").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws("=", "r", "name"))), "; ").alias("attributes"))


def degree(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def cvt_leaves(edges: DataFrame) -> DataFrame:
    return degree(edges).where(is_cvt(F.col("node")) & (F.col("degree") <= 1))


def sample_triple(edges: DataFrame) -> DataFrame:
    """The first triple of each relation."""
    return edges.groupBy("r").agg(F.min(F.struct("h", "t")).alias("e")).select("r", "e.h", "e.t")


def entity_context(edges: DataFrame, outgoing: int = 2, incoming: int = 1) -> DataFrame:
    """(node, context): a few 'r->t' and 'h->r' of each named node, by order."""
    named = edges.where(~is_cvt(F.col("h")) & ~is_cvt(F.col("t")) & (F.col("h") != F.col("t")))
    out = named.select(F.col("h").alias("node"), F.lit(0).alias("side"), F.concat_ws("->", "r", "t").alias("text"))
    back = named.select(F.col("t").alias("node"), F.lit(1).alias("side"), F.concat_ws("->", "h", "r").alias("text"))
    rank = F.row_number().over(Window.partitionBy("node", "side").orderBy("text"))
    few = out.unionByName(back).withColumn("k", rank).where((F.col("side") == 0) & (F.col("k") <= outgoing) | (F.col("side") == 1) & (F.col("k") <= incoming))
    return few.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("side", "k", "text"))).alias("x")).select("node", F.array_join(F.transform("x", lambda e: e["text"]), "; ").alias("context"))


def local_subgraph(edges: DataFrame, seeds: DataFrame, per_seed: int = 6, most: int = 120) -> DataFrame:
    """(seed, edge): at most `per_seed` edges around each seed, by order, and `most` in all (a
    seed's first edges before its second ones)."""
    near = both_ways(edges).join(seeds.select(F.col("node").alias("src")), "src")
    few = near.withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy("edge"))).where(F.col("k") <= per_seed)
    return few.orderBy("k", "src", "edge").limit(most).select(F.col("src").alias("seed"), "edge")


def fanout(edges: DataFrame) -> DataFrame:
    """Edges, heads, tails and the largest fan-out of each relation: tails are distinct targets.
    Both ends of an edge are counted in one shuffle."""
    head = F.col("head")
    ends = F.explode(F.array(F.struct(F.col("h").alias("node"), F.lit(True).alias("head")), F.struct(F.col("t").alias("node"), F.lit(False).alias("head"))))
    per = edges.select("r", ends.alias("e")).groupBy("r", "e.node", "e.head").agg(F.count("*").alias("n"))
    return per.groupBy("r").agg(F.sum(F.when(head, F.col("n"))).alias("n_edges"), F.count_if(head).alias("n_heads"), F.count_if(~head & F.col("node").isNotNull()).alias("n_tails"), F.max(F.when(head, F.col("n"))).alias("max_fanout"))


def grouped_triples(edges: DataFrame) -> DataFrame:
    """(h, r, tails): tails of a head and relation in one line."""
    return edges.groupBy("h", "r").agg(F.array_join(F.sort_array(F.collect_set("t")), " | ").alias("tails"), F.count("*").alias("n"))


def reachable(edges: DataFrame, anchors: DataFrame, hops: int) -> DataFrame:
    """(anchor, node, hop): nodes by the least number of hops, a distinct frontier a hop."""
    step = both_ways(edges).select("src", "dst").distinct()
    seen = anchors.select("anchor", F.col("anchor").alias("node"), F.lit(0).alias("hop"))
    front = seen
    for k in range(1, hops + 1):
        front = front.join(step, F.col("node") == F.col("src")).select("anchor", F.col("dst").alias("node")).distinct().join(seen, ["anchor", "node"], "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(front)
    return seen
