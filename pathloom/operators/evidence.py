"""Evidence for an answer: concrete paths, their facts' attributes and siblings, and the text a
reader or a model sees. Rows are joined and ranked as tables; text is put together for each
question, whose evidence is bounded by the caps before it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import is_ascii, is_cvt, is_noisy, is_noisy_attribute, normalize, relation_short
from pathloom.operators.graph import directed, named_neighbours, owner
from pathloom.operators.lineage import kept
from pathloom.operators.stage import pattern_key
from pathloom.operators.walk import with_ends


def _key(nodes: Column, facts: bool) -> Column:
    return F.array_join(F.filter(nodes, lambda n: is_cvt(n) == F.lit(facts)), ">")


def support_paths(paths: DataFrame, most: int = 24) -> DataFrame:
    """(anchor, chain, place, nodes, rels): a pattern's concrete paths, the best first, then those
    that bring a new signature and a new pair of named and fact nodes, at most `most`. Paths of
    one fact node may say it (`fact`) and are compared in the parts they are dealt in."""
    rows = paths.withColumn("chain", pattern_key(F.col("nodes"), F.col("rels")))
    rank = F.struct((-F.bit_count("covered")).alias("c"), F.size("edges").alias("d"), F.col("edges").alias("e"))
    rows = rows.withColumn("_r", rank).withColumn("_n", _key(F.col("nodes"), False)).withColumn("_f", _key(F.col("nodes"), True))
    one = Window.partitionBy("anchor", "chain", "_n", "_f", *(c for c in paths.columns if c == "fact")).orderBy("_r")
    rows = rows.withColumn("_k", F.row_number().over(one)).where("_k = 1")
    place = F.row_number().over(Window.partitionBy("anchor", "chain").orderBy("_r"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("anchor", "chain", "place", "nodes", "rels")


def needs_rescue(rels: Column, depth: int = 4) -> Column:
    """A chain of noisy relations only, or of `depth` hops and more."""
    return (F.size(rels) >= depth) | (F.size(F.filter(rels, lambda r: is_noisy(r))) > 0)


def endpoint_rescue(paths: DataFrame, selected: DataFrame, endpoints: DataFrame, most: int = 4) -> DataFrame:
    """(anchor, place, nodes, rels, noisy, n_covered): where all selected patterns (anchor, rels)
    need a rescue, paths cut at their first endpoint, by coverage, noise and length."""
    ask = selected.groupBy("anchor").agg(F.min(needs_rescue(F.col("rels"))).alias("all")).where("all").select("anchor")
    asked = paths.join(ask, "anchor", "left_semi").select("anchor", "nodes", "rels", "covered")
    rows = with_ends(asked, endpoints.where("endpoint <> anchor"), "ends")
    at = F.array_position(F.transform("nodes", lambda n: F.array_contains("ends", n)), F.lit(True)).cast("int")
    rows = rows.withColumn("at", at).where("at > 1")
    rows = rows.select("anchor", F.slice("nodes", F.lit(1), F.col("at")).alias("nodes"), F.slice("rels", F.lit(1), F.col("at") - 1).alias("rels"), F.bit_count("covered").alias("n_covered"))
    rows = rows.withColumn("noisy", F.size(F.filter("rels", lambda r: is_noisy(r)))).dropDuplicates(["anchor", "nodes", "rels"])
    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("n_covered").desc(), "noisy", F.size("rels"), "nodes", "rels"))
    return rows.withColumn("place", place).where(F.col("place") <= most).select("anchor", "place", "nodes", "rels", "noisy", "n_covered")


def path_triples(support: DataFrame) -> DataFrame:
    """(anchor, chain, place, pos, h, r, t) of support paths."""
    step = F.transform(F.col("rels"), lambda r, i: F.struct(F.element_at("nodes", i + 1).alias("h"), r.alias("r"), F.element_at("nodes", i + 2).alias("t")))
    return support.select("anchor", "chain", "place", F.posexplode(step).alias("pos", "x")).select("anchor", "chain", "place", "pos", "x.h", "x.r", "x.t")


def _ranked(facts: DataFrame, edges: DataFrame, on_path: DataFrame | None) -> DataFrame:
    """(node, k, plain, r, h, t, name, out): edges of fact nodes with named neighbours; `k` ranks those on the
    path first, `plain` takes no notice of it. Edges and the path's triples come together by
    node, once; an edge is its ends and the side it is seen from. Edges that say their fact node
    (`fact`) keep the parts they are dealt in."""
    own = owner(edges)
    def seen(rows: DataFrame, on: bool) -> DataFrame:
        sides = directed(rows.select(*own, "h", "r", "t")).where(~is_cvt(F.col("dst")))
        return sides.select(*own, F.col("src").alias("node"), "r", F.col("dst").alias("name"), "out", F.lit(on).alias("on"))

    if "fact" in edges.columns:
        down = is_cvt(F.col("h"))
        one = edges.where("h is not null and t is not null").where(down != is_cvt(F.col("t")))
        near = one.select(*own, F.col("fact").alias("node"), "r", F.when(down, F.col("t")).otherwise(F.col("h")).alias("name"), down.alias("out"), F.lit(False).alias("on"))
    else:
        near = seen(edges, False)
    if on_path is not None:
        # Dealt by node before the union, which edges that are dealt by their fact node then don't leave.
        near = near.unionByName(seen(on_path, True).repartition(*own, "node") if "fact" in edges.columns else seen(on_path, True))
    near = near.join(facts.select(*own, "node").distinct(), [*own, "node"])  # a semi-join would be taken below the union, and its rows shuffled again
    name = F.col("name")
    near = near.select(*own, "node", "r", "name", "on", "out", F.when(F.col("out"), F.col("node")).otherwise(name).alias("h"), F.when(F.col("out"), name).otherwise(F.col("node")).alias("t"), is_noisy_attribute(F.col("r")).alias("_noisy"), (~is_ascii(name)).alias("_far"), F.length("name").alias("_long"))
    # All windows have one order, so a node's rows are sorted once; a triple of the path is the peer of its edge.
    by = Window.partitionBy(*own, "node").orderBy("_noisy", "_far", "_long", "r", "name", "h", "t")
    plain = F.row_number().over(by)
    if on_path is None:
        return near.select(*own, "node", plain.alias("k"), plain.alias("plain"), "r", "h", "t", "name", "out")
    near = near.withColumn("_on", F.max("on").over(by.rangeBetween(Window.currentRow, Window.currentRow)).cast("int")).where("not on")
    so_far = F.sum("_on").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    in_all = F.sum("_on").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    near = near.withColumns({"plain": plain, "_so_far": so_far, "_in_all": in_all})
    k = F.when(F.col("_on") == 1, F.col("_so_far")).otherwise(F.col("_in_all") + F.col("plain") - F.col("_so_far")).cast("int")
    return near.select(*own, "node", k.alias("k"), "plain", "r", "h", "t", "name", "out")


def fact_attributes(facts: DataFrame, edges: DataFrame, on_path: DataFrame | None = None) -> DataFrame:
    """(node, k, r, h, t): edges of fact nodes (node) with named neighbours, ordered by: on the
    path, quiet relation, ASCII name, short name, relation, name, then the edge itself. Edges
    with an anchor are that question's own, and so are the rows."""
    return _ranked(facts, edges, on_path).drop("plain", "name", "out")


def sibling_facts(nodes: DataFrame, edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, h, r, sibling): other fact nodes of the same head and relation as the asked ones,
    the first `most` of each. A head's facts are packed once, sorted; only the asked ones unpack
    the first `most` + 1 of them, so a head costs its facts and not their square."""
    own = owner(edges)
    facts = edges.where(is_cvt(F.col("t"))).select(*own, "h", "r", F.col("fact" if "fact" in edges.columns else "t").alias("t"))
    asked = facts.withColumnRenamed("t", "node").join(nodes.select(*own, "node").distinct(), [*own, "node"], "left_semi").distinct()
    heads = facts.join(asked.select(*own, "h", "r").distinct(), [*own, "h", "r"], "left_semi").distinct()
    k = F.row_number().over(Window.partitionBy(*own, "h", "r").orderBy("t"))
    few = heads.withColumn("k", k).where(F.col("k") <= most + 1).groupBy(*own, "h", "r").agg(F.array_sort(F.collect_list("t")).alias("all"))
    each = asked.join(few, [*own, "h", "r"]).withColumn("others", F.slice(F.filter("all", lambda x: x != F.col("node")), 1, most))
    return each.select(*own, "node", "h", "r", F.explode("others").alias("sibling"))


def pattern_evidence(support: DataFrame, edges: DataFrame, attributes: int = 8, siblings: int = 8) -> DataFrame:
    """(anchor, chain, place, phase, pos, h, r, t): triples of support paths (phase 0), attributes
    of their fact nodes (1) and, for the first path, the sibling facts with theirs (2). Names
    must be ASCII and longer than one character; of triples equal when normalized the first.
    Edges are one graph, or with an anchor each question's own."""
    own, key = owner(edges), ["anchor", "chain", "place"]
    support = kept(support.select(*key, "nodes", "rels"))
    facts = support.select(*key, F.explode(F.array_distinct(F.filter("nodes", is_cvt))).alias("node"))
    near = sibling_facts(facts.where("place = 1").select("anchor", "node"), edges, siblings)
    # A fact node, or a sibling with what leads to it: each meets its attributes once, as a list. Lists
    # and paths are shuffled as names beside their node; triples are made where they are compared.
    lead = F.struct("h", "r")
    heads = facts.where("place = 1").join(near, [*own, "node"]).select(*key, F.col("sibling").alias("node"), lead.alias("lead"))
    asked = kept(facts.withColumn("lead", F.lit(None).cast("struct<h:string,r:string>")).unionByName(heads))
    ranked = _ranked(asked, edges, path_triples(support)).where((F.col("k") <= attributes) | (F.col("plain") <= attributes))
    lists = ranked.groupBy(*own, "node").agg(F.collect_list(F.struct("k", "plain", "r", "name", "out")).alias("list"))
    met = asked.join(lists, [*own, "node"], "left").withColumn("list", F.filter(F.coalesce("list", F.array().cast(lists.schema["list"].dataType)), lambda x: F.when(F.col("lead").isNull(), x["k"]).otherwise(x["plain"]) <= attributes))
    none = F.lit(None).cast("array<string>")
    paths = support.select(*key, F.lit(None).cast("string").alias("node"), F.lit(None).cast("struct<h:string,r:string>").alias("lead"), F.lit(None).cast(lists.schema["list"].dataType).alias("list"), "nodes", "rels")
    rows = paths.unionByName(met.select(*key, "node", "lead", "list", none.alias("nodes"), none.alias("rels"))).repartition("anchor", "chain")
    triple = lambda phase, pos, h, r, t: F.struct(F.lit(phase).alias("phase"), pos.cast("int").alias("pos"), h.alias("h"), r.alias("r"), t.alias("t"))
    node = F.col("node")
    some = lambda phase, k: F.transform("list", lambda x: triple(phase, x[k], F.when(x["out"], node).otherwise(x["name"]), x["r"], F.when(x["out"], x["name"]).otherwise(node)))
    first = F.transform("rels", lambda r, i: triple(0, i, F.element_at("nodes", i + 1), r, F.element_at("nodes", i + 2)))
    led = F.array(triple(2, F.lit(0), F.col("lead.h"), F.col("lead.r"), node))
    rows = rows.withColumn("x", F.when(F.col("rels").isNotNull(), first).when(F.col("lead").isNull(), some(1, "k")).otherwise(F.concat(led, some(2, "plain"))))
    # What a pattern has is bounded by the caps: it comes together in lists, of which equals are neighbours when sorted.
    good = lambda c: is_ascii(c) & (F.length(c) > 1)
    name = lambda c: F.when(is_cvt(c), c).otherwise(normalize(c))
    keyed = F.transform(F.filter("x", lambda x: good(x["h"]) & good(x["t"])), lambda x: F.struct(F.concat_ws("|", name(x["h"]), x["r"], name(x["t"])).alias("key"), "place", x["phase"].alias("phase"), x["pos"].alias("pos"), x["h"].alias("h"), x["r"].alias("r"), x["t"].alias("t")))
    each = rows.select("anchor", "chain", keyed.alias("x")).groupBy("anchor", "chain").agg(F.array_sort(F.flatten(F.collect_list("x"))).alias("x"))
    one = F.filter("x", lambda x, i: (i == 0) | (x["key"] != F.get(F.col("x"), i - 1)["key"]))
    return each.select("anchor", "chain", F.explode(one).alias("x")).select("anchor", "chain", "x.place", "x.phase", "x.pos", "x.h", "x.r", "x.t")


def evidence_bodies(evidence: DataFrame, order: DataFrame, lines: int = 400) -> DataFrame:
    """(anchor, chain, text): a pattern's evidence as lines 'h -[relation]-> a, b', in order of
    first appearance; over a question's patterns, in order (anchor, chain, place), no more than
    `lines` in all."""
    at = F.struct(F.col("place").alias("p"), "phase", "pos")
    line = evidence.groupBy("anchor", "chain", "h", "r").agg(F.min(at).alias("at"), F.array_sort(F.collect_set("t")).alias("ts"))
    rows = line.join(order.select("anchor", "chain", F.col("place").alias("_place")), ["anchor", "chain"])
    k = F.row_number().over(Window.partitionBy("anchor").orderBy("_place", "at", "h", "r"))
    few = rows.withColumn("k", k).where(F.col("k") <= lines)
    text = F.concat(F.col("h"), F.lit(" -["), relation_short(F.col("r")), F.lit("]-> "), F.array_join("ts", ", "))
    return few.groupBy("anchor", "chain").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", text.alias("x")))), lambda x: x["x"]), "\n").alias("text"))


def shared_attributes(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(group, shared): 'relation=name' pairs that all fact nodes of a group (group, node) have,
    in order; of groups of two nodes and more."""
    pairs = named_neighbours(edges).groupBy(F.col("cvt").alias("node")).agg(F.collect_set(F.concat_ws("=", "r", "name")).alias("pairs"))
    asked = facts.groupBy("node").agg(F.collect_set("group").alias("groups")).join(pairs, "node", "left")
    own = asked.select(F.explode("groups").alias("group"), "node", F.coalesce("pairs", F.array().cast("array<string>")).alias("pairs"))
    size = F.count("*").over(Window.partitionBy("group"))
    each = own.withColumn("size", size).where("size > 1").select("group", "size", F.explode_outer("pairs").alias("pair"))
    counts = each.groupBy("group", "pair").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return counts.groupBy("group").agg(F.sort_array(F.collect_list(F.when(F.col("n") == F.col("size"), F.col("pair")))).alias("shared"))


def grouped_both_ways(edges: DataFrame, least: int = 2, most: int = 50) -> DataFrame:
    """(side, node, r, others, n): tails by head and relation ('out'), and heads by tail and
    relation ('in') where `least` or more share it; a triple shown 'in' isn't shown 'out'.
    At most `most` names are listed, in order; n counts all."""
    named = edges.where("h <> t").distinct()
    back = named.groupBy("t", "r").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    lists = named.join(back.select("t", "r"), ["t", "r"], "left_semi").groupBy("t", "r").agg(F.sort_array(F.collect_set("h")).alias("x"))
    inward = lists.select(F.lit("in").alias("side"), F.col("t").alias("node"), "r", F.array_join(F.slice("x", 1, most), " | ").alias("others"), F.size("x").cast("long").alias("n"))
    rest = named.join(back.select("t", "r"), ["t", "r"], "left_anti").groupBy("h", "r").agg(F.sort_array(F.collect_set("t")).alias("x"))
    outward = rest.select(F.lit("out").alias("side"), F.col("h").alias("node"), "r", F.array_join(F.slice("x", 1, most), " | ").alias("others"), F.size("x").cast("long").alias("n"))
    return outward.unionByName(inward)


def facts_grouped(triples: DataFrame) -> DataFrame:
    """(anchor, cvt, parents, attributes) of triples (anchor, h, r, t): a fact node's named heads
    as 'head -[relation]', and its named tails as 'relation: a, b', in order; a pair listed
    both ways counts once."""
    up, down = is_cvt(F.col("t")) & ~is_cvt(F.col("h")), is_cvt(F.col("h")) & ~is_cvt(F.col("t"))
    # A fact node's edges come together once, as sets: heads as (relation, name), tails as well.
    near = triples.where(up | down).select("anchor", F.when(up, F.col("t")).otherwise(F.col("h")).alias("cvt"), "r", F.when(up, F.col("h")).otherwise(F.col("t")).alias("name"), up.alias("up"))
    pair = F.struct("r", "name")
    facts = near.groupBy("anchor", "cvt").agg(F.collect_set(F.when(F.col("up"), pair)).alias("heads"), F.collect_set(F.when(~F.col("up"), pair)).alias("tails"))
    parents = F.transform("heads", lambda x: F.concat(x["name"], F.lit(" -["), relation_short(x["r"]), F.lit("]")))
    tails = F.array_except("tails", "heads")
    names = lambda r: F.array_sort(F.transform(F.filter(tails, lambda x: x["r"] == r), lambda x: x["name"]))
    lines = F.transform(F.array_distinct(F.transform(tails, lambda x: x["r"])), lambda r: F.concat(relation_short(r), F.lit(": "), F.array_join(names(r), ", ")))
    return facts.select("anchor", "cvt", F.sort_array(F.array_distinct(parents)).alias("parents"), F.sort_array(F.array_distinct(lines)).alias("attributes"))


def subgraph_text(triples: DataFrame, lines: int = 80, facts: int = 50) -> DataFrame:
    """(anchor, text): plain triples as 'h -[r]-> a, b', facts in place as 'h -[r]-> {attributes}',
    facts without a head as '{attributes}'; at most `lines` plain lines and `facts` facts."""
    t = triples.select("anchor", "h", "r", "t").distinct()
    arrow = F.concat(F.col("h"), F.lit(" -["), relation_short(F.col("r")), F.lit("]-> "))
    plain = t.where(~is_cvt(F.col("h")) & ~is_cvt(F.col("t"))).groupBy("anchor", "h", "r").agg(F.array_join(F.sort_array(F.collect_set("t")), ", ").alias("tails")).select("anchor", F.lit(0).alias("part"), F.concat(arrow, F.col("tails")).alias("line"))
    grouped = facts_grouped(triples).withColumn("body", F.concat(F.lit("{"), F.array_join("attributes", "; "), F.lit("}"))).where("size(attributes) > 0")
    inline = grouped.where("size(parents) > 0").select("anchor", F.lit(1).alias("part"), F.concat(F.array_join("parents", " & "), F.lit("-> "), F.col("body")).alias("line"))
    orphan = grouped.where("size(parents) = 0").select("anchor", F.lit(2).alias("part"), F.col("body").alias("line"))
    rows = plain.unionByName(inline).unionByName(orphan)
    k = F.row_number().over(Window.partitionBy("anchor", F.least("part", F.lit(1))).orderBy("part", "line"))
    few = rows.withColumn("k", k).where(F.col("k") <= F.when(F.col("part") == 0, lines).otherwise(facts))
    return few.groupBy("anchor").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n").alias("text"))


def render_tree(paths: list[tuple[list[str], list[str]]], first: set[str], width: int = 12, depth: int = 8) -> str:
    """Paths with a common start as an indented tree. Branches that name one of `first` come
    first, then larger ones, then by name; at most `width` branches a node, the rest counted;
    names that differ in nothing but their last step share a line."""
    root: dict = {}
    for nodes, rels in paths:
        at = root.setdefault(nodes[0], {})
        for r, n in list(zip(rels, nodes[1:], strict=False))[:depth]:
            at = at.setdefault((r, n), {})
    out: list[str] = []

    def leaves(tree: dict) -> int:
        return 1 if not tree else sum(leaves(x) for x in tree.values())

    def names(tree: dict) -> set[str]:
        return {k[1] for k in tree} | {n for x in tree.values() for n in names(x)}

    def show(tree: dict, indent: int) -> None:
        by: dict[str, list[str]] = {}
        deep = []
        for (r, n), below in tree.items():
            if below:
                deep.append((r, n, below))
            else:
                by.setdefault(r, []).append(n)
        rows: list[tuple] = [(not first & set(ns), -len(ns), r, sorted(ns), None) for r, ns in by.items()]
        rows += [(not first & ({n} | names(below)), -leaves(below), r, [n], below) for r, n, below in deep]
        rows.sort(key=lambda x: x[:4])
        for _, _, r, ns, below in rows[:width]:
            more = f", and {len(ns) - width} more" if len(ns) > width else ""
            out.append("  " * indent + f"-[{r}]-> " + ", ".join(ns[:width]) + more)
            if below:
                show(below, indent + 1)
        if len(rows) > width:
            out.append("  " * indent + f"... {len(rows) - width} more")

    for name, tree in root.items():
        out.append(name)
        show(tree, 1)
    return "\n".join(out)


def path_trees(support: DataFrame, constraints: DataFrame) -> DataFrame:
    """(anchor, text): an anchor's support paths as one tree; branches with a constraint entity
    (anchor, name) come first. One question's paths are one group, capped by support_paths."""
    rows = support.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("chain", "place", "nodes", "rels"))).alias("paths"))
    rows = rows.join(constraints.groupBy("anchor").agg(F.collect_set("name").alias("first")), "anchor", "left")

    def render(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [render_tree([(list(p["nodes"]), list(p["rels"])) for p in paths], set(first) if first is not None else set()) for paths, first in zip(part["paths"], part["first"], strict=True)]
            yield pd.DataFrame({"anchor": part["anchor"], "text": text})

    return rows.mapInPandas(render, "anchor string, text string")


def entity_trees(triples: DataFrame, most: int = 20) -> DataFrame:
    """(anchor, text): for each head of an anchor's triples its relations and tails, two levels."""
    rows = triples.select("anchor", "h", "r", "t").distinct().groupBy("anchor", "h", "r").agg(F.sort_array(F.collect_set("t")).alias("x"))
    line = F.concat(F.lit("  "), relation_short(F.col("r")), F.lit(": "), F.array_join(F.slice("x", 1, most), ", "), F.when(F.size("x") > most, F.concat(F.lit(", and "), F.size("x") - most, F.lit(" more"))).otherwise(""))
    heads = rows.withColumn("line", line).groupBy("anchor", "h").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("body"))
    return heads.groupBy("anchor").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("\n", "h", "body"))), "\n").alias("text"))


def evidence_text(patterns: DataFrame, bodies: DataFrame) -> DataFrame:
    """(anchor, text): 'Pattern n: readable', its candidates and its body, in order of place.
    `patterns` has anchor, chain, place, readable, candidates; `bodies` anchor, chain, text."""
    rows = patterns.join(bodies, ["anchor", "chain"], "left")
    block = F.concat_ws("\n", F.concat(F.lit("Pattern "), F.col("place"), F.lit(": "), F.col("readable")), F.concat(F.lit("Candidates: "), F.array_join("candidates", ", ")), F.col("text"))
    return rows.groupBy("anchor").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("place"), block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))
