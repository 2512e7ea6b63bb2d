"""Relation-constrained walks. A state is a row: [case_id,] anchor, nodes, rels, edges (arrays),
covered, skipped (bit masks of layers), terminal. Layers are relation sets in order, one list
for all anchors or a plan for each question (`plan.Plans`); with case_id, states of different
questions never meet, whatever their names.

A graph is edges (h, r, t), one for all questions or with case_id one for each, or what
`adjacency.pack` made of them. Caps apply inside the loop, ranked by windows that Catalyst
limits per group. Ties break by the edge array, which is breadth-first order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import is_cvt, normalize
from pathloom.operators.adjacency import Graph, as_graph, grow, key_of, last, pack
from pathloom.operators.graph import both_ways, edge_name, numbered
from pathloom.operators.lineage import kept
from pathloom.operators.plan import PLAN, Plans, after, as_plans, bit, covered_in_order, has, holds, is_last, mask

STATE = ("anchor", "nodes", "rels", "edges", "covered", "skipped", "terminal")
#: What a bridge to an endpoint adds to the terminal relations, with the layer's number.
BRIDGE = "~bridge:"
#: What a state carries besides: its plan, and how many hops its question has where that differs.
CARRIED = (*PLAN, "n_hops")


def start(anchors: DataFrame, plans: Plans | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    own = anchors.select(*key_of(anchors), *(c for c in anchors.columns if c == "n_hops"))
    own = own if plans is None else plans.attach(own)
    return own.select(*key_of(own), F.array("anchor").alias("nodes"), none.alias("rels"), none.alias("edges"), F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("skipped"), none.alias("terminal"), *(c for c in CARRIED if c in own.columns))


def bare(df: DataFrame) -> DataFrame:
    """States without what they carry of their plan."""
    return df.drop(*CARRIED)


def hop(states: DataFrame, steps: DataFrame | Graph, where: Column | None = None, node_simple: bool = False) -> DataFrame:
    """One hop over flat steps (src, r, dst, edge), `directed` ones, whose edges are named after
    they met a state, or a packed graph. Edge-simple, or node-simple, which implies it. Other
    columns come along."""
    if isinstance(steps, Graph):
        return steps.hop(states, None, where, node_simple)
    met = states.join(steps, last() == F.col("src"))
    met = met if "edge" in steps.columns else met.withColumn("edge", edge_name(number=numbered(steps)))
    return grow(states, met, where, node_simple)


def through_facts(edges: DataFrame, into: str, out: str) -> DataFrame:
    """States two hops from every head of `into`, over its fact nodes, along `out`; with the `fact`
    of each. Edges say their fact node (`fact`): both hops meet where edges are dealt by it."""
    side = lambda r, c, name: edges.where(F.col("r") == r).where(F.col("fact") == F.col("t" if c == "h" else "h")).select("fact", F.col(c).alias(name))
    met = side(into, "h", "anchor").hint("merge").join(side(out, "t", "_end"), "fact")
    named = F.array(F.concat_ws("|", "anchor", F.lit(into), "fact"), F.concat_ws("|", "fact", F.lit(out), "_end"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    return met.select("anchor", F.array("anchor", "fact", "_end").alias("nodes"), F.array(F.lit(into), F.lit(out)).alias("rels"), named.alias("edges"), zero.alias("covered"), zero.alias("skipped"), none.alias("terminal"), "fact")


def at_ends(states: DataFrame, ends: DataFrame, how: str = "left_semi") -> DataFrame:
    """States that end at one of their question's endpoints ([case_id,] anchor, endpoint), or none."""
    return states.withColumn("endpoint", last()).join(ends.select(*key_of(states), "endpoint").distinct(), [*key_of(states), "endpoint"], how).select(*states.columns)


def with_ends(paths: DataFrame, endpoints: DataFrame, name: str = "_ends") -> DataFrame:
    """Paths with those of their question's endpoints that are on them, in the array `name`. Nodes
    meet endpoints as rows: no path carries its question's whole list. A path that is there
    twice stays twice."""
    key = key_of(paths)
    ends = endpoints.select(*key, F.col("endpoint").alias("_node")).distinct().withColumn("_end", F.lit(True))
    each = paths.select("*", F.posexplode(F.array_distinct("nodes")).alias("_pos", "_node"))
    met = each.join(ends, [*key, "_node"], "left").groupBy(*paths.columns).agg(F.collect_set(F.when(F.col("_end"), F.col("_node"))).alias(name), F.count_if(F.col("_pos") == 0).alias("_n"))
    return met.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")


def dominance(states: DataFrame, cap: int) -> DataFrame:
    """The best state for each (question, terminal relations, end, covered, skipped), then the
    `cap` best of a question."""
    key, order = key_of(states), [F.bit_count("covered").desc(), F.bit_count("skipped"), F.size("edges"), "terminal", last(), "edges"]
    one = states.withColumn("k", F.row_number().over(Window.partitionBy(*key, "terminal", last(), "covered", "skipped").orderBy(*order))).where("k = 1")
    return one.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("k") <= cap).drop("k")


def _bridge(rest: DataFrame, graph: Graph, ends: DataFrame, layer: int) -> DataFrame:
    """States that don't end at an endpoint of theirs, moved to one by the fewest of one or two
    edges. Edges into endpoints are looked up from the endpoints' side."""
    key, own = key_of(rest), [c for c in key_of(rest) if c == "case_id"]
    asked = ends.select(*key, "endpoint").distinct()
    doors = graph.lookup(asked.select(*own, F.array("endpoint").alias("nodes")).distinct()).select(*own, F.col("dst").alias("_door"), "r", last().alias("endpoint"), "edge")
    into = kept(asked.join(doors, [*own, "endpoint"]).select(*key, "_door", "r", F.col("endpoint").alias("dst"), "edge"))

    def arrive(states: DataFrame) -> DataFrame:
        met = states.withColumn("_door", last()).join(into, [*key, "_door"])
        return grow(states, met)

    open_ = at_ends(rest, ends, "left_anti")
    both = arrive(open_).withColumn("_n", F.lit(1)).unionByName(arrive(graph.hop(open_)).withColumn("_n", F.lit(2)))
    least = F.min("_n").over(Window.partitionBy(*key, "base"))
    near = both.withColumn("_m", least).where("_n = _m").drop("_n", "_m")
    return near.withColumn("covered", F.col("covered").bitwiseOR(bit(layer))).withColumn("terminal", F.array_append("terminal", F.lit(f"{BRIDGE}{layer}")))


def mode_walk(anchors: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, cap: int = 1200, endpoints: DataFrame | None = None) -> DataFrame:
    """Layer by layer: target edges in one hop and in two; a state without either is
    bridged to an endpoint on the last layer (`endpoints`: anchor, endpoint), else keeps its
    place with the layer skipped, once it has moved. All states after each layer are paths.

    A state and what became of it meet once, in a window over the state, which lets it stay
    only if nothing did."""
    graph, plans = as_graph(edges), as_plans(layers)
    states, out = start(anchors, plans), None
    key = key_of(states)

    def settle(moved: DataFrame) -> DataFrame:
        some = F.max("hit").over(Window.partitionBy(*key, "base"))
        return moved.withColumn("some", some).where("hit or not some").drop("some")

    for i in range(plans.n):
        idle, based = states.where(~has(i)), states.where(has(i)).withColumn("base", F.col("edges"))
        target = holds(F.col("r"), i)
        found = graph.hop(based, target).unionByName(graph.hop(graph.hop(based, ~target), target))
        hits = found.withColumn("covered", F.col("covered").bitwiseOR(bit(i))).withColumn("terminal", F.array_append("terminal", F.element_at("rels", -1)))
        moved = settle(hits.withColumn("hit", F.lit(True)).unionByName(based.withColumn("hit", F.lit(False))))
        if endpoints is not None:
            moved = kept(moved)
            bridged = _bridge(moved.where(~F.col("hit") & is_last(i)).drop("hit"), graph, endpoints, i)
            moved = settle(moved.unionByName(bridged.withColumn("hit", F.lit(True))))
        moved = moved.where(F.col("hit") | (F.size("edges") > 0)).withColumn("skipped", F.when(F.col("hit"), F.col("skipped")).otherwise(F.col("skipped").bitwiseOR(bit(i))))
        done = kept(dominance(moved.select(*states.columns), cap))
        out = done if out is None else out.unionByName(done)
        states = done if plans.layers is not None and plans.layers[i] else done.unionByName(idle)
    if out is None:
        return bare(states).limit(0)
    first = Window.partitionBy(*key, "nodes", "rels").orderBy(F.bit_count("covered").desc(), F.bit_count("skipped"), "edges")
    return bare(out).where(F.size("edges") > 0).withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")


def hit_beam(states: DataFrame, most: int) -> DataFrame:
    """The `most` states of a question that cover most layers, ties by edges."""
    order = Window.partitionBy(*key_of(states)).orderBy(F.bit_count("covered").desc(), "edges")
    return states.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")


def k_queue(anchors: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, hops: int = 2, beam: int = 80, most: int = 5000) -> DataFrame:
    """Node-simple breadth-first walk, `hops` hops for each layer of the plan; every path that
    ends in a target relation is a result, with the greedy in-order coverage of its relations.
    The frontier keeps the 2 * beam best; a question with more than `most` results goes no further."""
    graph, plans = as_graph(edges), as_plans(layers)
    front, out = start(anchors, plans), None
    key, columns = key_of(front), front.columns
    for h in range(hops * plans.n):
        due = front.where(F.lit(h) < hops * F.bit_count("live"))
        grown = kept(graph.hop(due, node_simple=True).withColumn("covered", covered_in_order(F.col("rels"), plans.n)))
        done = grown.where(mask(F.element_at("rels", -1)) != 0)
        out = done if out is None else out.unionByName(done)
        full = out.groupBy(*key).count().where(F.col("count") > most).select(*key)
        front = hit_beam(grown.join(full, key, "left_anti").select(*columns), 2 * beam)
    if out is None:
        return bare(front).withColumn("rank", F.lit(1)).limit(0)
    rank = Window.partitionBy(*key).orderBy((F.bit_count("covered") == F.bit_count("live")).desc(), F.bit_count("covered").desc(), F.col("covered").desc(), F.size("edges"), "edges")
    return bare(out.dropDuplicates([*key, "nodes", "rels"]).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most))


def diversity_beam(paths: DataFrame, limit: int = 80, per_group: int = 5) -> DataFrame:
    """The best `per_group` of each (last node, covered), then the others by rank, up to `limit`."""
    key, order = key_of(paths), [F.bit_count("covered").desc(), F.size("edges"), "edges"]
    ranked = paths.withColumn("g", F.row_number().over(Window.partitionBy(*key, last(), "covered").orderBy(*order)))
    return ranked.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy((F.col("g") <= per_group).desc(), *order))).where(F.col("k") <= limit).drop("g", "k")


def connect_targets(paths: DataFrame, steps: DataFrame | Graph, targets: DataFrame, hops: int = 3, per_base: int = 5, limit: int = 80) -> DataFrame:
    """Paths continued from their ends to targets (anchor, endpoint), at most `hops` hops:
    breadth-first, a node once for each base and length; a base that ends at a target has to
    reach another. The `per_base` best of a base; all paths of a question if none connects."""
    if not hops:
        return paths
    key, ends = key_of(paths), targets.where("endpoint <> anchor")
    front = paths.withColumn("_base", F.col("edges"))
    found = None
    for _ in range(hops):
        tail = F.slice("nodes", F.size("_base") + 1, F.lit(1 << 30))
        grown = hop(front, steps, ~F.array_contains(tail, F.col("dst")))
        one = Window.partitionBy(*key, "_base", last()).orderBy("edges")
        grown = kept(grown.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k"))
        done = at_ends(grown, ends)
        found = done if found is None else found.unionByName(done)
        front = at_ends(grown, ends, "left_anti")
    few = Window.partitionBy(*key, "_base").orderBy(F.bit_count("covered").desc(), F.size("edges"), "edges")
    found = found.withColumn("k", F.row_number().over(few)).where(F.col("k") <= per_base).drop("k", "_base")
    found = kept(diversity_beam(found.dropDuplicates([*key, "nodes", "rels"]), limit))
    return found.unionByName(paths.join(found.select(*key).distinct(), key, "left_anti").select(*found.columns))


def prior_expand(anchors: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, max_hops: int = 3, limit: int = 80, per_group: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """Layer by layer: node-simple segments that end at the first hit of the layer, at most
    `max_hops` hops in all, without repeating a relation twice in a row and without other
    layers' relations on the way. A missed layer is skipped and leaves the frontier as it is
    (so a second try of a missed last layer finds nothing new). With `targets` (anchor,
    endpoint) the ends are connected to them. Acyclic paths come before others. Anchors
    may have `n_hops`, hops of their own up to the number of layers, in place of `max_hops`."""
    graph, plans = as_graph(edges), as_plans(layers)
    front = start(anchors, plans)
    own = "n_hops" in front.columns
    key, rounds, most = key_of(front), plans.n if own else max_hops, F.col("n_hops") if own else F.lit(max_hops)
    for i in range(plans.n):
        if plans.layers is not None and not plans.layers[i]:
            continue
        aims, bridges = holds(F.col("r"), i), mask(F.col("r")) == 0
        turn = F.coalesce(F.try_element_at("rels", F.lit(-1)) != F.col("r"), F.lit(True))
        open_, matched = front.where(has(i)), None
        for h in range(rounds):
            growing = open_.where(F.size("edges") < most)
            hits = graph.hop(growing, aims & turn, node_simple=True)
            hits = hits.withColumn("covered", F.col("covered").bitwiseOR(bit(i)).bitwiseOR(mask(F.element_at("rels", -1))))
            matched = hits if matched is None else matched.unionByName(hits)
            if h + 1 < rounds:
                open_ = kept(diversity_beam(graph.hop(growing, bridges & turn, node_simple=True), limit, per_group))
        matched = kept(diversity_beam(matched, limit, per_group))
        missed = front.join(matched.select(*key).distinct(), key, "left_anti").select(*front.columns)
        front = matched.unionByName(missed)
    if targets is not None:
        front = connect_targets(front, graph, targets, rounds, per_group, limit)
    front = bare(front)
    paths = prefer(front.where(F.size("edges") > 0).dropDuplicates([*key, "nodes", "rels"]), F.size("nodes") == F.size(F.array_distinct("nodes")), key)
    return diversity_beam(paths, limit, per_group)


def materialize(anchors: DataFrame, edges: DataFrame, rels: list[str], keep: int = 200, most: int = 10_000) -> DataFrame:
    """(anchor, nodes, path_count): edge-simple paths along exact relations, the first `keep`."""
    steps, states = both_ways(edges), start(anchors)
    for r in rels:
        states = hop(states, steps, F.col("r") == r)
    n = F.least(F.count("*").over(Window.partitionBy("anchor")), F.lit(most))
    return states.withColumn("path_count", n).withColumn("k", F.row_number().over(Window.partitionBy("anchor").orderBy("nodes", "edges"))).where(F.col("k") <= keep).select("anchor", "nodes", "path_count")


def meet(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """Paths joined at a meeting node, disjoint elsewhere: (anchor, target, nodes)."""
    case = [c for c in forward.columns if c == "case_id"]
    f = forward.select(*case, "anchor", "nodes", last().alias("end"))
    b = backward.select(*case, F.col("anchor").alias("target"), F.col("nodes").alias("back"), last().alias("end"))
    both = f.join(b, [*case, "end"]).where(~F.arrays_overlap(F.slice("nodes", 1, F.size("nodes") - 1), "back"))
    return both.select(*case, "anchor", "target", F.concat("nodes", F.slice(F.reverse("back"), 2, F.size("back"))).alias("nodes"))


def prefer(paths: DataFrame, flag: Column, keys: list[str]) -> DataFrame:
    """Rows with the flag; all rows of a group in which none has it."""
    return paths.withColumn("_f", flag.cast("int")).withColumn("_m", F.max("_f").over(Window.partitionBy(*keys))).where("_f = _m").drop("_f", "_m")


def compress(paths: DataFrame) -> DataFrame:
    """Paths as patterns: (anchor, chain, witness, n_paths, candidates). The chain joins relations
    between named nodes by ' -> ' and segments by ' / '; the witness is the best path."""
    at = F.transform(F.slice("nodes", 2, 1 << 30), lambda n, i: F.concat(F.element_at("rels", i + 1), F.when(is_cvt(n), F.lit(" -> ")).otherwise(F.lit(" / "))))
    named = F.filter(F.slice("nodes", 2, 1 << 30), lambda n: ~is_cvt(n))
    rows = paths.select("anchor", F.regexp_replace(F.array_join(at, ""), r" (->|/) $", "").alias("chain"), "nodes", "covered", "edges", named.alias("named"))
    best = F.struct(F.bit_count("covered").alias("c"), (-F.size("edges")).alias("d"))
    # The first of equals by edges: a max over the count of better ones isn't needed, min_by of the negated rank is.
    order = F.struct((-best["c"]).alias("c"), (-best["d"]).alias("d"), F.col("edges").alias("e"))
    return rows.groupBy("anchor", "chain").agg(F.min_by(F.array_join("nodes", ">"), order).alias("witness"), F.count("*").alias("n_paths"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("named")))), "|").alias("candidates"))


def candidate_counts(paths: DataFrame) -> DataFrame:
    """(anchor, name, n): paths that hold each named node beyond the anchor."""
    each = paths.select("anchor", F.explode(F.array_distinct("nodes")).alias("name"))
    return each.where(~is_cvt(F.col("name")) & (F.col("name") != F.col("anchor"))).groupBy("anchor", "name").agg(F.count("*").alias("n"))


def _beyond(paths: DataFrame, endpoints: DataFrame | None, cut: bool) -> DataFrame:
    """(question, at, name) of a path's named nodes but the anchor and endpoints, with the place
    (path by covered, hops and edges; position) where each stands; with `cut` only those after
    the path's first endpoint, if it has one."""
    key = key_of(paths)
    none = F.array().cast("array<string>")
    own = paths.select(*key, "nodes", "edges", "covered")
    own = own.withColumn("_ends", none) if endpoints is None else with_ends(own, endpoints.where("endpoint <> anchor"))
    first = F.array_position(F.transform("nodes", lambda n: F.array_contains("_ends", n)), F.lit(True)).cast("int") if cut else F.lit(0)
    rank = F.struct((-F.bit_count("covered")).alias("c"), F.size("edges").alias("d"), "edges")
    each = own.select(*key, "_ends", rank.alias("_r"), first.alias("_first"), F.posexplode("nodes").alias("pos", "name"))
    each = each.where((F.col("pos") >= F.col("_first")) & (F.col("name") != F.col("anchor")) & ~F.array_contains("_ends", F.col("name")) & ~is_cvt(F.col("name")))
    return each.select(*key, F.struct("_r", "pos").alias("at"), "name")


def counted_candidates(paths: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """(anchor, place, name, n): occurrences of named nodes on paths, behind a path's first endpoint
    where it has one; names of two characters when normalized; in order of first appearance."""
    key = key_of(paths)
    rows = _beyond(paths, endpoints, cut=True).where(F.length(normalize(F.col("name"))) >= 2)
    counted = rows.groupBy(*key, "name").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("at", "name"))).select(*key, "place", "name", "n")


def counted_names(paths: DataFrame, endpoints: DataFrame | None = None) -> DataFrame:
    """(anchor, place, name, n): occurrences of names on paths, normalized and without a cut; most
    frequent first, then by name."""
    key = key_of(paths)
    counted = _beyond(paths, endpoints, cut=False).groupBy(*key, normalize(F.col("name")).alias("name")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("n").desc(), "name"))).select(*key, "place", "name", "n")


def first_names(counted: DataFrame, limit: int = 20) -> DataFrame:
    """(anchor, names): the first names of either count."""
    few = counted.where(F.col("place") <= limit)
    return few.groupBy(*key_of(few)).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("names"))


def bridge_triples(paths: DataFrame) -> DataFrame:
    """(h, r, t): a path's steps by name, runs of fact nodes bridged by joining relations."""
    step = F.transform(F.slice("nodes", 2, 1 << 30), lambda n, i: F.struct(F.element_at("nodes", i + 1).alias("h"), F.element_at("rels", i + 1).alias("r"), n.alias("t")))
    none = F.array().cast("array<struct<h:string,r:string,t:string>>")
    join = F.aggregate(step, none, lambda acc, s: F.when((F.size(acc) > 0) & is_cvt(s["h"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["h"].alias("h"), F.concat(F.try_element_at(acc, F.lit(-1))["r"], F.lit(" > "), s["r"]).alias("r"), s["t"].alias("t"))))).otherwise(F.array_append(acc, s)))
    return paths.select(F.explode(join).alias("x")).select("x.*").distinct()


def diagnose_layers(anchors: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, max_hops: int = 3, limit: int = 80, per_group: int = 5) -> DataFrame:
    """(anchor, layer, frontier_hit, anchor_hit, frontier_count, anchor_count). One node-simple
    beam search: a path's frontier advances when the next expected layer is met, and it
    remembers every layer it met. Hops from or to a fact node cost nothing."""
    graph, plans = edges if isinstance(edges, Graph) else pack(edges, noise=True), as_plans(layers)
    states = start(anchors, plans).withColumn("depth", F.lit(0)).withColumn("cost", F.lit(0)).withColumn("met", F.lit(0).cast("long")).withColumn("reached", F.lit(None).cast("int"))
    key, hits = key_of(states), None
    for _ in range(max_hops * 3):
        came = states.withColumn("_from", last())
        moved = graph.hop(came, node_simple=True).withColumn("met", mask(F.element_at("rels", -1)))
        due = F.col("met").bitwiseAND(bit(F.col("depth"))) != 0
        cost = F.col("cost") + F.when(is_cvt(F.col("_from")) | is_cvt(last()), 0).otherwise(1)
        grown = moved.withColumns({"covered": F.col("covered").bitwiseOR(F.col("met")), "reached": F.when(due, F.col("depth")), "depth": F.when(due, F.col("depth") + 1).otherwise(F.col("depth")), "cost": cost}).drop("_from")
        grown = kept(grown.where(F.col("cost") <= max_hops))
        rows = grown.select(*key, "met", "reached")
        hits = rows if hits is None else hits.unionByName(rows)
        if grown.isEmpty():
            break
        order = [F.col("depth").desc(), "edges"]
        ranked = grown.withColumn("g", F.row_number().over(Window.partitionBy(*key, last(), "depth").orderBy(*order)))
        states = ranked.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy((F.col("g") <= per_group).desc(), *order))).where(F.col("k") <= limit).drop("g", "k")
    own = plans.attach(anchors.select(*key))
    plan = own.withColumn("_n", plans.length()).where("_n > 0").select(*key, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("layer"))
    each = hits.select(*key, F.explode(F.sequence(F.lit(0), F.lit(max(plans.n, 1) - 1))).alias("layer"), "met", "reached")
    counts = each.groupBy(*key, "layer").agg(F.count_if(F.col("reached") == F.col("layer")).alias("frontier_count"), F.count_if(F.col("met").bitwiseAND(bit(F.col("layer"))) != 0).alias("anchor_count"))
    return plan.join(counts, [*key, "layer"], "left").na.fill(0, ["frontier_count", "anchor_count"]).select(*key, "layer", (F.col("frontier_count") > 0).alias("frontier_hit"), (F.col("anchor_count") > 0).alias("anchor_hit"), "frontier_count", "anchor_count")


def canonical_path(rels: Column, n: int) -> Column:
    """How many hops of a path to keep: each of the plan's layers in order up to its first hit
    after the one before, until a layer is missed."""
    known = F.transform(rels, mask)

    def step(state: Column, layer: Column) -> Column:
        due = F.col("live").bitwiseAND(bit(layer)) != 0
        here = F.transform(F.slice(known, state["at"] + 1, F.greatest(F.size(rels) - state["at"], F.lit(0))), lambda m: m.bitwiseAND(bit(layer)) != 0)
        found = F.array_position(here, F.lit(True)).cast("int")
        return F.struct(F.when(state["alive"] & due & (found > 0), state["at"] + found).otherwise(state["at"]).alias("at"), (state["alive"] & (~due | (found > 0))).alias("alive"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.struct(F.lit(0).alias("at"), F.lit(True).alias("alive")), step, lambda s: s["at"]) if n else F.lit(0)


def canonicalize(paths: DataFrame, layers: list[list[str]] | Plans) -> DataFrame:
    """Paths cut after their last layer hit in order; of equal ones the first; without any, gone."""
    plans = as_plans(layers)
    own = paths if "live" in paths.columns else plans.attach(paths)
    cut = own.withColumn("_n", canonical_path(F.col("rels"), plans.n)).where("_n > 0")
    for name, more in (("nodes", 1), ("rels", 0), ("edges", 0)):
        cut = cut.withColumn(name, F.slice(name, F.lit(1), F.col("_n") + more))
    return cut.drop("_n").dropDuplicates([*key_of(paths), "nodes", "rels"]).select(*paths.columns)


def has_next(states: DataFrame, graph: Graph) -> DataFrame:
    """States (with `next`, a layer or null) whose end has an edge of that layer, itself or
    through a fact node next to it; all of those without a next one."""
    key = key_of(states)
    open_ = states.where("next is not null").select(*key, "nodes", "edges", *PLAN, "next")
    wanted = holds(F.col("r"), F.col("next"))
    near = graph.lookup(open_).where(is_cvt(F.col("dst"))).select(*key, F.array("dst").alias("nodes"), "edges", *PLAN, "next")
    ok = graph.lookup(open_, wanted).select(*key, "edges").unionByName(graph.lookup(near, wanted).select(*key, "edges")).distinct()
    return states.where("next is null").unionByName(states.where("next is not null").join(ok, [*key, "edges"], "left_semi").select(*states.columns))


def chain_expand(anchors: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, limit: int = 1200) -> DataFrame:
    """A layer a hop, node-simple, through fact nodes to what is behind them; a hop must leave
    a way to the next layer. States that can't go on stay as they are and are results too."""
    graph, plans = as_graph(edges), as_plans(layers)
    front, done = start(anchors, plans), None
    key, columns = key_of(front), front.columns
    for i in range(plans.n):
        here = front.where(has(i)).withColumn("base", F.col("edges"))
        moved = graph.hop(here, holds(F.col("r"), i), node_simple=True)
        facts = moved.where(is_cvt(last()))
        moved = moved.unionByName(graph.hop(facts, None, ~is_cvt(F.col("dst")), node_simple=True)).withColumn("covered", F.col("covered").bitwiseOR(bit(i)))
        moved = kept(has_next(moved.withColumn("next", after(i)), graph))
        gone = moved.select(*key, F.col("base").alias("edges")).distinct()
        stuck = here.where(F.size("edges") > 0).join(gone, [*key, "edges"], "left_anti").select(*columns)
        done = stuck if done is None else done.unionByName(stuck)
        front = hit_beam(moved.select(*columns), limit).unionByName(front.where(~has(i)))
    front = front if done is None else front.unionByName(done)
    return bare(front.dropDuplicates([*key, "nodes", "rels"]))


def edge_tier(r: Column, target: list[str], pool: list[str]) -> Column:
    """0 for a target relation, 1 for one of the pool, 2 for others."""
    return F.when(r.isin(*target) if target else F.lit(False), 0).when(r.isin(*pool) if pool else F.lit(False), 1).otherwise(2)


def tiered_hop(states: DataFrame, steps: DataFrame | Graph, tier: Callable[[Column], Column], spare: int = 5, alone: int = 10) -> DataFrame:
    """One node-simple hop by tiers: target edges and the first `spare` of the pool; without
    target edges the pool and the first `spare` others; without both the first `alone`."""
    key = key_of(states)
    grown = hop(states.withColumn("base", F.col("edges")), steps, node_simple=True).withColumn("tier", tier(F.element_at("rels", -1)))
    own = Window.partitionBy(*key, "base")
    grown = grown.withColumn("best", F.min("tier").over(own)).withColumn("k", F.row_number().over(Window.partitionBy(*key, "base", "tier").orderBy("edges")))
    ok = (F.col("tier") == F.col("best")) & ((F.col("best") < 2) | (F.col("k") <= alone)) | (F.col("tier") == F.col("best") + 1) & (F.col("k") <= spare)
    return grown.where(ok).drop("base", "best", "k", "tier")


def guided_hop(states: DataFrame, steps: DataFrame | Graph, target: list[str], pool: list[str], spare: int = 5, alone: int = 10) -> DataFrame:
    """A tiered hop by relations that are the same for all states."""
    return tiered_hop(states, steps, lambda r: edge_tier(r, target, pool), spare, alone)


def plan_tier(layer: int | Column) -> Callable[[Column], Column]:
    """Tiers by the state's plan: a layer's relations, the other layers', others."""
    return lambda r: F.when(holds(r, layer), 0).when(mask(r) != 0, 1).otherwise(2)


def chain_search(anchors: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, max_hops: int = 4, limit: int = 80, per_group: int = 5) -> DataFrame:
    """Paths of at most `max_hops` hops that end in the last layer; where a question has none, in
    the one before, and so on. Hops take target edges before the plan's other relations
    before the first five others."""
    graph, plans = as_graph(edges), as_plans(layers)
    key = key_of(anchors)
    out, open_ = None, anchors.select(*key)
    for i in reversed([i for i in range(plans.n) if plans.layers is None or plans.layers[i]]):
        front, found = start(open_, plans).where(has(i)), None
        for _ in range(max_hops):
            grown = tiered_hop(front, graph, plan_tier(i)).withColumn("covered", covered_in_order(F.col("rels"), plans.n))
            grown = kept(diversity_beam(grown, limit, per_group))
            hits = grown.where(holds(F.element_at("rels", -1), i))
            found = hits if found is None else found.unionByName(hits)
            front = grown
        out = found if out is None else out.unionByName(found)
        open_ = kept(open_.join(out.select(*key).distinct(), key, "left_anti"))
        if open_.isEmpty():
            break
    if out is None:
        return bare(start(open_, plans)).limit(0)
    return bare(diversity_beam(out.dropDuplicates([*key, "nodes", "rels"]), limit, per_group))


def bidirectional(pairs: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, max_hops: int = 5, limit: int = 50, per_group: int = 6) -> DataFrame:
    """(anchor, target, nodes) of pairs (anchor, target): both ends are walked, the side with
    fewer states a hop at a time, each hop guided by the layer it should be; paths join where
    they meet, disjoint elsewhere. Each question takes its own side; without case_id all pairs
    are one question."""
    graph, plans = as_graph(edges), as_plans(layers)
    own = pairs if "case_id" in pairs.columns else pairs.withColumn("case_id", F.lit(0))
    held = [start(own.select("case_id", end.alias("anchor")).distinct(), plans).withColumn("done", F.lit(0)) for end in (F.col("anchor"), F.col("target"))]
    sides, out = list(held), None
    for _ in range(max_hops):
        n = [h.groupBy("case_id").agg(F.count("*").alias(f"n{i}"), F.max("done").alias(f"d{i}")) for i, h in enumerate(held)]
        both = n[0].join(n[1], "case_id", "full").na.fill(0)
        forward = (F.col("d0") == 0) | (F.col("d1") > 0) & (F.col("n0") <= F.col("n1"))
        turn = kept(both.select("case_id", forward.alias("forward")))
        for side in (0, 1):
            mine = turn.where(F.col("forward") == F.lit(side == 0)).select("case_id")
            going, resting = (held[side].join(mine, "case_id", how).select(*held[side].columns) for how in ("left_semi", "left_anti"))
            at = F.col("done") if side == 0 else plans.length() - 1 - F.col("done")
            layer = F.when((at >= 0) & (at < plans.n), at).otherwise(62)  # a layer that no plan has
            moved = tiered_hop(going.withColumn("_layer", layer.cast("int")), graph, plan_tier(F.col("_layer"))).drop("_layer")
            moved = moved.withColumns({"covered": covered_in_order(F.col("rels"), plans.n), "done": F.col("done") + 1})
            moved = kept(diversity_beam(moved, limit, per_group))
            sides[side], held[side] = sides[side].unionByName(moved), moved.unionByName(resting)
        found = meet(sides[0], sides[1]).join(own, ["case_id", "anchor", "target"], "left_semi")
        out = found if out is None else out.unionByName(found)
    return out.distinct() if "case_id" in pairs.columns else out.drop("case_id").distinct()


def arrival_beam(states: DataFrame, limit: int) -> DataFrame:
    """For questions with more than `limit` states: the best state of each (last node, covered),
    groups in order of their first arrival (`_at`), then the others by coverage, hops, group."""
    key = key_of(states)
    group = Window.partitionBy(*key, last(), "covered")
    rows = states.withColumn("_g", F.row_number().over(group.orderBy(F.size("edges"), "_at"))).withColumn("_came", F.min("_at").over(group)).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    first = F.col("_g") == 1
    order = [first.desc(), F.when(first, F.col("_came")), F.bit_count("covered").desc(), F.size("edges"), "_came", "_g"]
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return rows.where((F.col("_n") <= limit) | (F.col("_k") <= limit)).drop("_g", "_came", "_n", "_k")


def layer_frontier(anchors: DataFrame, edges: DataFrame | Graph, layers: list[list[str]] | Plans, limit: int = 80, hops: int = 2) -> DataFrame:
    """A breadth-first search for each layer that stops a branch at its first hit. A fact node on
    the way costs no hop of its own; a relation isn't taken twice in a row; only the anchor and
    the ends of earlier hits may not be met again. A path without a hit stays; each path keeps
    its first limit / paths open branches, five at least, in order of arrival (of edges: by
    edge_id where edges have one, else by name). A layer that no path of a question meets borrows
    the next one's relations, which is then done as well. Then `arrival_beam`, and at the end
    paths are cut at their last hit in order."""
    graph, plans = as_graph(edges), as_plans(layers)
    none = F.array().cast("array<string>")
    front = start(anchors, plans).withColumns({"committed": F.array("anchor"), "place": F.lit(1), "due": F.lit(0)})
    key, columns = key_of(front), front.columns

    def stepped(states: DataFrame, fresh: bool) -> DataFrame:
        """States one edge on, with the edge in `ord`; not to nodes of this search or committed ones."""
        begun = F.slice("nodes", F.col("inner") + 1, F.lit(1 << 30))
        ok = ~F.array_contains("committed", F.col("dst")) & ~F.array_contains(begun, F.col("dst"))
        if fresh:
            came = F.try_element_at(F.slice("rels", F.col("inner"), F.lit(1 << 30)), F.lit(-1))
            ok = ok & F.coalesce(came != F.col("r"), F.lit(True))
        met = graph.lookup(states).where(ok)
        grown = {"nodes": F.array_append("nodes", F.col("dst")), "rels": F.array_append("rels", F.col("r")), "edges": F.array_append("edges", F.col("edge")), "ord": F.array_append("ord", F.col("edge"))}
        return met.select(*(grown[c].alias(c) if c in grown else F.col(c) for c in states.columns))

    def search(active: DataFrame) -> tuple[DataFrame, DataFrame]:
        """From paths with `aim`, a layer: paths after it, of questions that hit it, by arrival; and
        all others as they were."""
        width = F.greatest(F.floor(F.lit(limit) / F.count("*").over(Window.partitionBy(*key))), F.lit(5))
        open_ = active.withColumns({"width": width, "inner": F.size("nodes"), "ord": none})
        hits = None
        for h in range(hops):
            near = stepped(open_, True)
            hit = holds(F.element_at("rels", -1), F.col("aim"))
            found = near.where(hit)
            if h + 1 < hops:
                through = stepped(near.where(~hit & is_cvt(last())), False)
                found = found.unionByName(through.where(hit))
                on = near.where(~hit & ~is_cvt(last())).unionByName(through.where(~hit))
                k = F.row_number().over(Window.partitionBy(*key, "place").orderBy("ord"))
                open_ = kept(on.withColumn("k", k).where(F.col("k") <= F.col("width")).drop("k"))
            found = found.withColumn("hop", F.lit(h))
            hits = found if hits is None else hits.unionByName(found)
        at = F.struct("place", "hop", "ord").alias("_at")
        moved = {"covered": F.col("covered").bitwiseOR(bit(F.col("aim"))), "committed": F.array_append("committed", last())}
        hits = kept(hits.select(*(moved[c].alias(c) if c in moved else F.col(c) for c in active.columns), at))
        some = hits.select(*key).distinct()
        stay = active.join(hits.select(*key, "place").distinct(), [*key, "place"], "left_anti").join(some, key, "left_semi")
        stay = stay.select(*active.columns, F.struct("place", F.lit(-1).alias("hop"), none.alias("ord")).alias("_at"))
        after_ = arrival_beam(hits.unionByName(stay), limit)
        after_ = after_.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("_at")))
        return kept(after_.select(*active.columns)), active.join(some, key, "left_anti").select(*active.columns)

    for i in range(plans.n):
        if plans.layers is not None and not plans.layers[i]:
            continue
        here = has(i) & (F.col("due") <= i)
        found, rest = search(front.where(here).withColumn("aim", F.lit(i)))
        parts = [found.select(*columns), front.where(~here)]
        if i + 1 < plans.n:
            lent, others = search(rest.where(has(i + 1)).withColumn("aim", F.lit(i + 1)))
            parts += [lent.withColumn("due", F.lit(i + 2)).select(*columns), others.select(*columns), rest.where(~has(i + 1)).select(*columns)]
        else:
            parts.append(rest.select(*columns))
        front = parts[0]
        for part in parts[1:]:
            front = front.unionByName(part)
        front = kept(front)
    front = front.drop("committed", "place", "due")
    return bare(canonicalize(front.where(F.size("edges") > 0), plans))
