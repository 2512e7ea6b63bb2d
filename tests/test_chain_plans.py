"""Two-turn chain plans with recorded replies: each branch is reached."""

from pyspark.sql import functions as F

from pathloom.functions import grammar as Y
from pathloom.plans import chain_plans as CP
from pathloom.plans import runner

ONE = "Chain: Rome -(capital of)-> node\nAnalysis:\n- Keyword: capital\n- Sub-question: Of what is Rome the capital\nEndpoints: [Italy] hop 1; [Lake of Garda]"
TWO = "Chain: Rome -(capital of)-> node -(leader)-> node\nAnalysis:\n- Keyword: capital\n- Keyword: head\nEndpoints: [Italy] hop 1"
FIRST = "<interpretation>who leads</interpretation><anchor>roma</anchor><endpoints>none</endpoints><answer_type>person</answer_type><rewritten>Who leads the land of Rome?</rewritten>"


def model(replies):
    asked = []

    def call(prompts):
        rows = prompts.collect()
        asked.extend(r.prompt for r in rows)
        return prompts.sparkSession.createDataFrame([(r.prompt_id, next((v for k, v in replies if all(x in r.prompt for x in k)), "")) for r in rows], "prompt_id string, response string")

    return call, asked


def questions(spark):
    return runner.init(spark.createDataFrame([("a", "Who leads A?", ["Rome", " "], []), ("b", "Who leads B?", [], []), ("c", "Who leads C?", ["Rome"], [])], "case_id string, question string, q_entity array<string>, gt array<string>"))


def test_turns_and_reflection(spark):
    call, asked = model([(("Say what", "A?"), FIRST), (("had one hop, capital of", "A?"), TWO), (("Write the chain", "A?"), ONE), (("Write the chain", "B?"), ONE)])
    got = {r.case_id: r for r in CP.chain_plan(call, allow_one_step=False)(questions(spark)).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.stage_1a_anchor, a.anchor_said, a.stage_1a_answer_type, a.stage_1a_rewritten) == ("roma", "roma", "person", "Who leads the land of Rome?")
    assert a.decomp_retry and len(a.chain.hops) == 2 and a.decomp_reflect_raw == TWO and a.active
    # No entity: no first turn; a second chain of no hop changes nothing.
    assert (b.stage_1a_raw, b.stage_1a_anchor, b.anchor_said, b.stage_1a_answer_type) == (None, None, "Rome", "other")
    assert b.decomp_retry and len(b.chain.hops) == 1 and b.active
    # No chain at all: the question fails and isn't asked again.
    assert (c.active, c.error, c.decomp_retry, c.stage_1a_anchor) == (False, "decomposition failed", False, "Rome")
    assert sum("Say what" in p for p in asked) == 2 and sum("had one hop" in p for p in asked) == 2
    assert "Start: roma" in next(p for p in asked if "Write the chain" in p and "A?" in p)
    call, _ = model([(("Write the chain",), ONE)])
    one = CP.chain_plan(call, allow_one_step=True)(questions(spark)).collect()
    assert not any(r.decomp_retry for r in one) and all(r.active for r in one)


def test_steps_anchors_endpoints(spark):
    call, _ = model([(("Write the chain", "A?"), ONE), (("Write the chain", "B?"), TWO.replace("Rome", "Ro")), (("Write the chain", "C?"), TWO.replace("[Italy] hop 1", "[m.1]; [Sea] hop 1; [old sea] hop 1"))])
    state = CP.chain_plan(call)(questions(spark))
    steps = [(r.case_id, r.step, r.question, r.keyword) for r in CP.chain_steps(state).orderBy("case_id", "step").collect()]
    assert steps[0] == ("a", 1, "Of what is Rome the capital", "capital") and steps[1][:3] == ("b", 1, "capital of") and steps[2] == ("b", 2, "leader", "head")
    ents = spark.createDataFrame([("a", 0, "Great Rome"), ("a", 1, "ROME!"), ("a", 2, "kingdom of italy"), ("a", 3, "garda"), ("b", 0, "Rome"), ("b", 1, "Rome of old"), ("c", 0, "New Rome"), ("c", 1, "Old Rome of yore"), ("c", 2, "m.1"), ("c", 3, "sea"), ("c", 4, "the old sea")], "case_id string, ent_id int, name string")
    seeds = spark.createDataFrame([("a", "Garda"), ("b", "rome")], "case_id string, seed string")
    anchors = {r.case_id: (r.ent_id, r.tier) for r in CP.chain_anchors(state, ents, seeds).collect()}
    assert anchors == {"a": (1, 1), "b": (0, 2), "c": (1, 3)}
    ends = sorted((r.case_id, r.key, r.query, r.ent_id) for r in CP.chain_endpoints(state, ents, seeds).collect())
    assert ends == [("a", 1, "Italy", 2), ("a", 2, "Lake of Garda", 3), ("b", 1, "Italy", None), ("c", 1, "Sea", 3), ("c", 3, "m.1", None), ("c", 101, "old sea", 4)]


def test_cases_that_share_a_graph(spark):
    """By graph_id a graph's names are there once; results are those of a copy for each case."""
    from pathloom.operators import answers as A

    ents = spark.createDataFrame([("g", 2, "Ada Lovelace"), ("g", 1, "ada lovelace!"), ("g", 3, "Charles Babbage"), ("h", 4, "Ada Lovelace")], "graph_id string, ent_id long, name string")
    own = spark.createDataFrame([(f"c{i}", "gh"[i % 2]) for i in range(4)], "case_id string, graph_id string")
    copied = own.join(ents, "graph_id").drop("graph_id")
    preds = own.selectExpr("case_id", "graph_id", "posexplode(array('ADA LOVELACE', 'Charles Babbag', 'x', null)) as (pos, pred)")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    got = rows(A.resolve_in_graph(preds, ents, 0.9))
    assert got == rows(A.resolve_in_graph(preds.drop("graph_id"), copied, 0.9)) and ("c0", 0, "ADA LOVELACE", "ada lovelace!", 1) in got
    state = own.withColumn("chain", Y.chain(F.lit("Chain: a -(in)-> node\nEndpoints: [ADA LOVELACE] hop 1; [Babbage]; [nowhere]"))).withColumn("anchor_said", F.lit("lovelace"))
    seeds = own.select("case_id", F.lit("none").alias("seed"))
    for of in (CP.chain_endpoints, CP.chain_anchors):
        shared = rows(of(state, ents, seeds))
        assert shared and shared == rows(of(state.drop("graph_id"), copied, seeds))
