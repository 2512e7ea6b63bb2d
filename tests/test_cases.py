"""Walks of many questions at once: each with its own plan and graph, names shared between them,
equal to one run for each; hubs in pieces."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import planning as P
from pathloom.operators import stage as ST
from pathloom.operators import walk as W
from pathloom.operators.adjacency import pack
from pathloom.operators.plan import Plans, covered_in_order

PLANS = {"q1": [["r1"], ["r2"], ["r3"]], "q2": [["r2", "r1"]], "q3": [["r3"], [], ["r9"], ["r1"]]}


def graphs(seed=1):
    rnd, out = random.Random(seed), []
    names = [*"ABCDEF", "m.1", "m.2", "g.3"]
    for case in PLANS:
        for _ in range(16):
            h, t = rnd.sample(names, 2)
            out.append((case, h, rnd.choice(["r1", "r2", "r3", "r4"]), t))
        out.append((case, "A", "r1" if case != "q3" else "r3", "B"))
    return sorted(set(out))


@pytest.fixture(scope="module")
def cases(spark):
    edges = spark.createDataFrame(graphs(), "case_id string, h string, r string, t string").cache()
    plans = Plans.of_cases(spark.createDataFrame([(c, i, r) for c, layers in PLANS.items() for i, layer in enumerate(layers) for r in layer], "case_id string, layer int, rel string"))
    anchors = spark.createDataFrame([(c, "A") for c in PLANS], "case_id string, anchor string")
    ends = spark.createDataFrame([("q1", "A", "D"), ("q1", "A", "E"), ("q3", "A", "F")], "case_id string, anchor string, endpoint string")
    return edges, plans, anchors, ends


def plain(df, case):
    df = df if "case_id" in df.columns else df.withColumn("case_id", F.lit(case))
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())


def report(paths, edges, plan, ends):
    return ST.explosion_filter(paths, ST.last_two_candidates(paths, edges), edges, plan, ends, threshold=2, trigger=0)


WALKS = {
    "mode_walk": lambda a, e, p, x: W.mode_walk(a, e, p, cap=20, endpoints=x),
    "k_queue": lambda a, e, p, x: W.k_queue(a, e, p, beam=6, most=30),
    "prior_expand": lambda a, e, p, x: W.prior_expand(a, e, p, limit=6, per_group=2, targets=x),
    "chain_expand": lambda a, e, p, x: W.chain_expand(a, e, p, limit=5),
    "chain_search": lambda a, e, p, x: W.chain_search(a, e, p, max_hops=3, limit=7),
    "layer_frontier": lambda a, e, p, x: W.layer_frontier(a, e, p, limit=6),
    "bidirectional": lambda a, e, p, x: W.bidirectional(x.withColumnRenamed("endpoint", "target"), e, p, max_hops=4, limit=9),
    "diagnose": lambda a, e, p, x: W.diagnose_layers(a, e, p, limit=9, per_group=2),
    "reachable": lambda a, e, p, x: P.reachable_relations(e, a, p),
    "preflight": lambda a, e, p, x: P.preflight(e, a, p, fanout=2, sample=3),
    "traverse": lambda a, e, p, x: ST.traverse(a, e, p, endpoints=x, cap=20, beam=6),
    "last_step": lambda a, e, p, x: ST.last_step_candidates(W.mode_walk(a, e, p), e, p),
    "patterns": lambda a, e, p, x: ST.patterns(W.mode_walk(a, e, p), x).drop("few"),
    "explosion": lambda a, e, p, x: report(W.mode_walk(a, e, p), e, p, x)[0],
}


@pytest.mark.parametrize("name", WALKS)
def test_all_at_once_as_one_by_one(cases, name):
    """One question in turn is compared with a run of its own."""
    edges, plans, anchors, ends = cases
    walk, case = WALKS[name], ["q1", "q3", "q2"][list(WALKS).index(name) % 3]
    case = "q1" if name == "bidirectional" else case
    got = [r for r in plain(walk(anchors, edges, plans, ends), None) if f"'{case}'" in r]
    mine = [df.where(F.col("case_id") == case).drop("case_id") for df in (anchors, edges, ends)]
    assert got == plain(walk(mine[0], mine[1], PLANS[case], mine[2]), case)
    assert got


def test_plans_as_data(spark, cases):
    _, plans, anchors, _ = cases
    row = {r.case_id: r for r in plans.attach(anchors.unionByName(spark.createDataFrame([("none", "A")], anchors.schema))).collect()}
    assert row["q1"].masks == {"r1": 1, "r2": 2, "r3": 4} and row["q3"].live == 0b1101 and row["none"].live == 0
    walked = W.mode_walk(anchors, spark.createDataFrame([], "case_id string, h string, r string, t string"), plans)
    assert walked.collect() == []
    same = Plans.same([["a"], ["b", "a"], ["c"]])
    rels = spark.createDataFrame([(["a", "b", "c"],), (["b", "c"],), (["c", "a", "b"],), ([],)], "rels array<string>")
    assert [r[0] for r in same.attach(rels).select(covered_in_order(F.col("rels"), 3)).collect()] == [7, 6, 3, 0]


def test_shared_graph_with_plans_of_cases(spark, cases):
    """One graph for all questions, two questions with one anchor and different plans."""
    edges = spark.createDataFrame([("A", "r1", "B"), ("B", "r2", "C"), ("A", "r2", "D")], "h string, r string, t string")
    plans = Plans.of_cases(spark.createDataFrame([(1, 0, "r1"), (1, 1, "r2"), (2, 0, "r2")], "case_id int, layer int, rel string"))
    got = ST.traverse(spark.createDataFrame([(1, "A"), (2, "A")], "case_id int, anchor string"), edges, plans)
    assert sorted((r.case_id, tuple(r.nodes)) for r in got.collect()) == [(1, ("A", "B")), (1, ("A", "B", "C")), (2, ("A", "B", "C")), (2, ("A", "D"))]


def test_hub_in_pieces(spark):
    """A hub of 200,000 edges is read by many tasks, its rows are those of flat edges, and a hop
    moves its states to the graph, never the graph."""
    hub = spark.range(200_000).select(F.lit("hub").alias("h"), F.when(F.col("id") % 2 == 0, "r1").otherwise("r2").alias("r"), F.concat(F.lit("n"), "id").alias("t"))
    edges = hub.unionByName(spark.createDataFrame([("A", "r0", "hub"), ("hub", "r1", "hub")], "h string, r string, t string"))
    graph = pack(edges, piece=1000, buckets=16)
    assert graph.n_hubs == 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(before, ("-1", "false", "16"), strict=True):
            spark.conf.set(k, v)
        start = W.start(spark.createDataFrame([("A",)], "anchor string"))
        far = graph.hop(graph.hop(start), F.col("r") == "r1")
        by_task = far.groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert sum(r["count"] for r in by_task) == 100_001
        assert len(by_task) >= 12 and max(r["count"] for r in by_task) < 30_000
        plan = far._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(_at") == 2 == plan.count("Exchange hashpartitioning"), plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_arrival_order(spark):
    """Edges that come in another order than their names: the first to arrive stay."""
    rows = [(k, "A", "r1", n) for k, n in enumerate(["Z", "Y", "X", "W", "V", "U", "T"])] + [(10, "Z", "r2", "P"), (11, "T", "r2", "Q"), (12, "Y", "r2", "P")]
    anchors = spark.createDataFrame([("A",)], "anchor string")
    numbered = spark.createDataFrame(rows, "edge_id int, h string, r string, t string")
    plain = numbered.drop("edge_id")

    def ends(e, layers, limit):
        return sorted(r.nodes[-1] for r in W.layer_frontier(anchors, e, layers, limit=limit).collect())

    assert ends(numbered, [["r1"]], 3) == ["X", "Y", "Z"] and ends(plain, [["r1"]], 3) == ["T", "U", "V"]
    # Paths without a hit stay; of more than the limit the first to arrive.
    assert ends(numbered, [["r1"], ["r2"]], 7) == ["P", "P", "Q", "U", "V", "W", "X"]
    assert ends(numbered, [["r1"], ["r2"]], 5) == ["P", "P", "V", "W", "X"]
    # Five open branches at least, by arrival: T is the seventh.
    far = spark.createDataFrame([(k, "A", "r0", n) for k, n in enumerate(["Z", "Y", "X", "W", "V", "U", "T"])] + [(20 + k, n, "r5", f"end{n}") for k, n in enumerate("ZT")], "edge_id int, h string, r string, t string")
    assert ends(far, [["r5"]], 5) == ["endZ"] and ends(far, [["r5"]], 80) == ["endT", "endZ"]


def test_layer_frontier_facts_and_borrowing(spark):
    anchors = spark.createDataFrame([("A",)], "anchor string")
    e = spark.createDataFrame([("A", "x", "m.1"), ("m.1", "y", "B"), ("B", "r2", "C"), ("C", "r3", "D"), ("A", "r2", "K")], "h string, r string, t string")
    walk = lambda layers: sorted(tuple(r.nodes) for r in W.layer_frontier(anchors, e, layers).collect())
    assert walk([["r2"]]) == [("A", "K"), ("A", "m.1", "B", "C")]  # two hops, as the fact node costs none
    assert walk([["y"], ["r2"], ["r3"]]) == [("A", "m.1", "B", "C", "D")]


def test_a_hop_without_hubs_shuffles_no_graph(spark):
    """Where no node is a hub, the piece that is 0 everywhere fell out of the join, whose keys then
    weren't those of the buckets: each hop shuffled the whole graph."""
    e = spark.range(4000).selectExpr("id % 50 as case_id", "concat('n', id % 7) as h", "'a.b' as r", "concat('t', id) as t")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        graph = pack(e, buckets=4)
        assert not graph.n_hubs
        states = W.start(spark.range(50).selectExpr("id as case_id", "concat('n', id % 7) as anchor"))
        got = graph.hop(states)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        assert got.count() == e.where("h = concat('n', case_id % 7)").count() and "edge" not in graph.lists.schema["out"].dataType.elementType.fieldNames()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
