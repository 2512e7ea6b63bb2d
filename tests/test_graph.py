"""Hand-written micro graphs."""

from pyspark.sql import functions as F

from pathloom.functions import text as X
from pathloom.operators import graph as G
from pathloom.operators import retrieve as R
from pathloom.operators import walk as W
from pathloom.plans import catalog
from pathloom.sources import provider, testkg
from pathloom.streaming.ingest import ingest_edges


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "h string, r string, t string")


def nodes(df):
    return sorted(tuple(r.nodes) for r in df.collect())


def test_self_loop_and_parallel_edges_once(spark):
    e = edges(spark, ("A", "r", "A"), ("A", "r", "B"), ("B", "r", "A"))
    assert sorted((r.src, r.dst) for r in G.both_ways(e).collect()) == [("A", "A"), ("A", "B"), ("A", "B"), ("B", "A"), ("B", "A")]


def test_named_neighbours(spark):
    e = edges(spark, ("A", "r", "m.1"), ("m.1", "s", "B"), ("m.1", "s", "B"), ("m.1", "t", "m.2"), ("m.2", "t", "m.2"), ("A", "r", "B"), ("m.2", "s", None), (None, "r", "m.2"), ("m.3", "s", "A"))
    assert sorted((r.cvt, r.attributes) for r in G.cvt_attributes(e).collect()) == [("m.1", "r=A; s=B"), ("m.3", "s=A")]


def test_fact_edges_are_shuffled_once(spark):
    """Line items are dealt by their fact node once; its attributes meet there, without names in a shuffle."""
    sf = "/root/testdata/sf0.001"
    by_fact = testkg.edges(spark, sf, by_fact=True)
    assert by_fact.select("h", "r", "t").exceptAll(testkg.edges(spark, sf)).count() == 0 and by_fact.count() == testkg.edges(spark, sf).count()
    assert by_fact.where("(r in ('sales.order.item', 'sales.item.part', 'sales.item.supplier')) <> (fact is not null) or fact <> h and fact <> t").count() == 0
    plan = catalog.queries()["cvt_attributes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    plan = catalog.queries()["shared_attributes"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert len(dealt) == 3 and sum("hashpartitioning(concat(m.li_" in x for x in dealt) == 2


def test_fanout_counts_tails_once(spark):
    e = edges(spark, ("A", "r", "B"), ("A", "r", "C"), ("D", "r", "B"), ("B", "r", "B"), ("A", "s", "C"), ("D", "s", None))
    got = {x.r: (x.n_edges, x.n_heads, x.n_tails, x.max_fanout) for x in G.fanout(e).collect()}
    assert got == {"r": (4, 3, 2, 2), "s": (2, 2, 1, 1)}


def test_noise_and_cvt(spark):
    row = spark.sql("select 'type.object.type' a, 'people.person.religion' b, 'm.0x' c, 'm.' d, cast(null as string) e").select(X.is_noisy(F.col("a")), X.is_noisy(F.col("b")), X.is_cvt(F.col("c")), X.is_cvt(F.col("d")), X.is_cvt(F.col("e")), X.is_noisy_attribute(F.lit("x.is_reviewed"))).first()
    assert tuple(row) == (True, False, True, False, False, False)


def test_mode_walk_skips_a_missing_layer(spark):
    e = edges(spark, ("A", "r1", "B"), ("B", "r3", "C"))
    a = spark.createDataFrame([("A",)], "anchor string")
    got = {tuple(r.nodes): (r.covered, r.skipped) for r in W.mode_walk(a, e, [["r1"], ["r2"], ["r3"]]).collect()}
    assert got[("A", "B", "C")] == (5, 2)


def test_mode_walk_stops_at_the_first_hit(spark):
    e = edges(spark, ("A", "x", "B"), ("B", "r1", "C"), ("A", "r1", "D"))
    a = spark.createDataFrame([("A",)], "anchor string")
    assert nodes(W.mode_walk(a, e, [["r1"]])) == [("A", "B", "C"), ("A", "D")]


def test_cycle_is_node_simple(spark):
    e = edges(spark, ("A", "r1", "B"), ("B", "r1", "C"), ("C", "r1", "A"))
    a = spark.createDataFrame([("A",)], "anchor string")
    assert all(len(set(n)) == len(n) for n in nodes(W.k_queue(a, e, [["r1"]])))


def test_compress_bridges_facts(spark):
    e = edges(spark, ("A", "r1", "m.x"), ("m.x", "r2", "B"), ("A", "r1", "m.y"), ("m.y", "r2", "C"))
    a = spark.createDataFrame([("A",)], "anchor string")
    steps = G.both_ways(e)
    row = W.compress(W.hop(W.hop(W.start(a), steps, F.col("r") == "r1"), steps, F.col("r") == "r2")).first()
    assert (row.chain, row.n_paths, row.candidates, row.witness) == ("r1 -> r2", 2, "B|C", "A>m.x>B")


def test_prefer_falls_back_to_all(spark):
    p = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    assert sorted(r.v for r in W.prefer(p, F.col("v") == 2, ["k"]).collect()) == [2, 3]


def test_empty_names_never_match(spark):
    d = spark.createDataFrame([(["日本"], ["Paris"]), (["paris, france"], ["Paris"])], "pred array<string>, gold array<string>")
    assert [r.f1 for r in R.match_stats(d).collect()] == [0.0, 1.0]


def test_sequence_ratio(spark):
    d = spark.createDataFrame([("abcd", "bcde")], "a string, b string")
    assert d.select(X.sequence_ratio("a", "b")).first()[0] == 0.75


def test_hydrate_and_last_of_a_repeated_id(spark, tmp_path):
    (tmp_path / "s.json").write_text('{"id": "q", "text_entity_list": ["old"], "non_text_entity_list": [], "relation_list": ["r"], "h_id_list": [0], "r_id_list": [0], "t_id_list": [0]}\n{"question_id": "q", "text_entity_list": ["A"], "non_text_entity_list": ["m.1"], "relation_list": ["r"], "h_id_list": [0, 0], "r_id_list": [0, 9], "t_id_list": [1, 7]}\n')
    entities, e = testkg.hydrate(testkg.read_samples(spark, str(tmp_path)))
    assert sorted((r.ent_id, r.name) for r in entities.collect()) == [(0, "A"), (1, "m.1")]
    assert sorted((r.h, r.r, r.t) for r in e.collect()) == [("A", "?", "?"), ("A", "r", "m.1")]


def test_provider_uses_the_cache(spark):
    prompts = spark.createDataFrame([(1, "x"), (2, "y")], "prompt_id int, prompt string")
    first = provider.complete(prompts.where("prompt_id = 1"), lambda p: [f"said {x}" for x in p])
    both = provider.complete(prompts, lambda p: ["new"] * len(p), cache=first)
    assert {r.prompt_id: r.response for r in both.collect()} == {1: "said x", 2: "new"}


def test_stream_appends_edges_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"h": "A", "r": "r", "t": "B"}\n{"h": null, "r": "r", "t": "B"}\n')
    for _ in range(2):
        ingest_edges(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_sinks_round_trip(spark, tmp_path):
    from pathloom.operators.select import fail_traces
    from pathloom.sources import sinks

    rows = spark.createDataFrame([(1, "q", True, False, ["b"], None, ["z", "a"], list(range(30))), (2, "p", True, True, ["c"], "c", [], [])], "case_id int, question string, gt_hit boolean, llm_hit boolean, gt_answers array<string>, llm_answer string, seen array<string>, patterns array<int>")
    sinks.write_states(rows, f"{tmp_path}/states", sets=("seen",))
    back = {r.case_id: r for r in spark.read.json(f"{tmp_path}/states").collect()}
    assert back[1].seen == ["a", "z"] and len(back[1].patterns) == 20 and back[1].llm_answer is None and back[2].patterns == []
    sinks.write_traces(fail_traces(rows), f"{tmp_path}/traces")
    assert "\n".join(r.value for r in spark.read.text(f"{tmp_path}/traces").collect()).endswith("Case: 1\nQ: q\nGT: b\nLLM: ")


def test_line_items_in_parts(spark, tmp_path, monkeypatch):
    """As many parts as the line items ask for, beyond the shuffle's own number."""
    from pathloom.sources import testkg

    rows = [(o, 1, o % 7, o % 3) for o in range(40)]
    spark.createDataFrame(rows + rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(testkg, "PART", 5)
    e = testkg.edges(spark, str(tmp_path), ("sales.order.item", "sales.item.part"))
    assert e.count() == e.distinct().count() == 80 and e.rdd.getNumPartitions() == 16


def test_facts_come_together_once(spark):
    """One shuffle of a fact's edges; a pair that is listed both ways is a head only."""
    from pathloom.operators import evidence as E

    rows = [("q", "A", "x.has", "m.1"), ("q", "m.1", "x.of", "B"), ("q", "m.1", "x.of", "C"), ("q", "m.1", "x.has", "A"), ("q", "m.1", "x.of", "B"), ("q", "A", "x.has", "m.2"), ("q", "m.3", "x.of", "B")]
    t = spark.createDataFrame(rows, "anchor string, h string, r string, t string")
    df = E.facts_grouped(t)
    assert {r.cvt: (r.parents, r.attributes) for r in df.collect()} == {"m.1": (["A -[x has]"], ["x of: B, C"]), "m.2": (["A -[x has]"], []), "m.3": ([], ["x of: B"])}
    assert df._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    facts = spark.createDataFrame([("g", "m.1"), ("g", "m.3"), ("g", "m.3"), ("h", "m.1"), ("k", "m.1"), ("k", "m.9")], "group string, node string")
    assert {r.group: r.shared for r in E.shared_attributes(facts, t).collect()} == {"g": ["x.of=B"], "k": []}


def test_a_hop_over_directed_edges_names_them_as_both_ways_does(spark):
    """Edges get their name once they met a state, so that no shuffle carries it."""
    e = spark.createDataFrame([(1, "a", "x.y", "b"), (2, "c", "x.y", "a"), (3, "a", "x.z", "a")], "edge_id long, h string, r string, t string")
    for edges in (e, e.drop("edge_id")):
        anchors = spark.createDataFrame([("a",)], "anchor string")
        one, two = (W.hop(W.hop(W.start(anchors), steps), steps) for steps in (G.directed(edges), G.both_ways(edges)))
        assert one.columns == two.columns and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
        assert "edge" not in G.directed(edges).columns
