"""Failures as data, vectors kept by content, counts of names."""

from pyspark.sql import functions as F

from pathloom.operators import answers as A
from pathloom.operators import walk as W
from pathloom.plans import runner
from pathloom.sources import cases as C
from pathloom.sources import provider


def test_a_failing_scorer_leaves_the_others(spark):
    pairs = spark.createDataFrame([(g, "q", i, f"{g}{i}") for g in "ab" for i in range(3)], "group string, query string, cand_id int, text string")

    def score(_, texts):
        if any(t == "a1" for t in texts):
            raise ValueError("a1 is bad")
        return [float(t[1:]) for t in texts]

    got = {(r.group, r.cand_id): (r.score, r.error, r["rank"]) for r in A.rerank(pairs, score).collect()}
    assert got["a", 2] == (2.0, None, 1) and got["b", 0] == (0.0, None, 3)
    assert got["a", 1] == (None, "ValueError: a1 is bad", 3)


def test_batches_are_given_up_for_good():
    calls = []

    def call(prompts):
        calls.append(len(prompts))
        raise TimeoutError("slow")

    def single(p):
        if p == "x":
            raise KeyError(p)
        return p.upper()

    c = provider.Caller(call, single, attempts=2)
    assert c(["a", "x"]) == [("A", None), ("", "KeyError: 'x'")]
    assert c(["b"]) == [("B", None)] and calls == [2, 2]
    alone = provider.Caller(call, None, attempts=2)
    assert alone(["a"]) == [("", "TimeoutError: slow")] and alone.batched


def test_replies_with_reasons(spark):
    p = spark.createDataFrame([("1", "good"), ("2", "bad")], "prompt_id string, prompt string")

    def call(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return [x.upper() for x in prompts]

    got = {r.prompt_id: (r.response, r.error) for r in provider.complete(p.coalesce(1), call, single=lambda x: call([x])[0]).collect()}
    assert got == {"1": ("GOOD", None), "2": ("", "ValueError: no")}


def test_a_stage_that_raises(spark):
    cases = spark.createDataFrame([("a", "q", ["x"])], "case_id string, question string, gt array<string>")

    def broken(state):
        return state.select("nothing_there")

    state, took = runner.run_stages(cases, [("first", lambda s: s.withColumn("seen", F.lit(1))), ("broken", broken)], keep_going=True)
    row = state.first()
    assert not row.active and row.error.startswith("broken: AnalysisException") and row.seen == 1 and set(took) == {"first", "broken"}


def test_vectors_are_kept(spark, tmp_path):
    store = provider.VectorStore(spark, str(tmp_path / "v"), "m")
    texts = spark.createDataFrame([("x",), ("y",), ("x",), (None,), ("bad",)], "text string")

    def encode(batch):
        if "bad" in batch:
            raise ValueError("bad")
        return [[3.0, float(len(t))] for t in batch]

    def never(_):
        raise AssertionError("encoded again")

    first = sorted((r.text, r.embedding) for r in store.embed(texts, encode).collect())
    assert [t for t, _ in first] == ["x", "y"]
    again = provider.VectorStore(spark, str(tmp_path / "v"), "m").embed(texts.where("text <> 'bad'"), never)
    assert sorted((r.text, r.embedding) for r in again.collect()) == first
    # A second writer has appended the same text; readers and the compacted store take one.
    store._rows().write.mode("append").parquet(str(tmp_path / "w"))
    store._rows().write.mode("append").parquet(str(tmp_path / "w"))
    twice = provider.VectorStore(spark, str(tmp_path / "w"), "m")
    assert twice._rows().count() == 4 and twice.known(texts).count() == 2
    assert twice.compact(str(tmp_path / "c"))._rows().count() == 2
    assert provider.VectorStore(spark, str(tmp_path / "w"), "other").known(texts).count() == 0
    errors = {r.text: r.error for r in provider.encoded(texts.where("text is not null"), encode).collect()}
    assert errors == {"x": None, "y": None, "bad": "ValueError: bad"}


def test_counts_of_names(spark):
    rows = [("A", ["A", "B", "E", "C"], 3), ("A", ["A", "m.1", "c!", "D"], 1), ("A", ["A", "C", "C"], 1)]
    paths = spark.createDataFrame([(a, n, [f"r{i}" for i in range(len(n) - 1)], [f"{k}{i}" for i in range(len(n) - 1)], c) for k, (a, n, c) in enumerate(rows)], "anchor string, nodes array<string>, rels array<string>, edges array<string>, covered long")
    ends = spark.createDataFrame([("A", "E")], "anchor string, endpoint string")
    longer = paths.withColumn("nodes", F.transform("nodes", lambda n: F.when((n == "A") | (n == "E") | n.startswith("m."), n).otherwise(F.concat(n, F.lit("x")))))
    got = [(r.name, r.n) for r in W.counted_candidates(longer, ends).orderBy("place").collect()]
    assert got == [("Cx", 3), ("c!x", 1), ("Dx", 1)]
    assert [(r.name, r.n) for r in W.counted_names(longer, ends).orderBy("place").collect()] == [("cx", 3), ("bx", 1), ("c x", 1), ("dx", 1)]
    assert W.first_names(W.counted_candidates(longer, ends), 2).first().names == ["Cx", "c!x"]


def test_prior_anchor_either_way(spark):
    cases = spark.createDataFrame([("a",)], "case_id string")
    plans = spark.createDataFrame([("a", "p", "The City of Rome", {})], "case_id string, plan string, anchor_name string, breakpoints map<int,string>")
    ents = spark.createDataFrame([("a", 0, ""), ("a", 1, "rome")], "case_id string, ent_id int, name string")
    assert C.prior_plans(cases, plans, ents).first().ent_id == 1


def test_last_of_a_repeated_id(spark, tmp_path):
    """By the converter's ordinal, however files are named or split."""
    import json

    from pathloom.sources.testkg import read_samples

    for name, ordinal in (("a", 2), ("b", 0), ("c", 1)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": "x", "question": f"{name}?", "ordinal": ordinal}))
    assert [(r.case_id, r.question) for r in read_samples(spark, str(tmp_path)).collect()] == [("x", "a?")]


def test_questions_for_a_profession(spark):
    from pathloom.operators.planning import asks_profession

    yes = ["What is her occupation?", "What did Ada Lovelace do?", "How did he do in life", "He is known for doing what?", "A city famous for the deeds of a king", "Which job had he"]
    no = ["what was done", "Where was she born?", "What works did he write", "for what is it known", "Who did it for fame", "", None]
    rows = spark.createDataFrame([(t,) for t in yes + no], "t string")
    got = [r.x for r in rows.select(asks_profession(F.col("t")).alias("x")).collect()]
    assert got == [True] * len(yes) + [False] * len(no)


def test_endpoints_on_a_path(spark):
    """A path carries the endpoints that are on it, not its question's whole list; twice if it is there twice."""
    rows = [("A", ["A", "E", "B"]), ("A", ["A", "E", "B"]), ("A", ["A", "C"]), ("B", ["B", "E"])]
    paths = spark.createDataFrame(rows, "anchor string, nodes array<string>")
    ends = spark.createDataFrame([("A", e) for e in ("E", "E", "X", "Y")], "anchor string, endpoint string")
    got = sorted((r.anchor, r.nodes, r["_ends"]) for r in W.with_ends(paths, ends).collect())
    assert got == [("A", ["A", "C"], []), ("A", ["A", "E", "B"], ["E"]), ("A", ["A", "E", "B"], ["E"]), ("B", ["B", "E"], [])]


def test_best_scores_a_few_queries_at_a_time(monkeypatch):
    import numpy as np

    from pathloom.operators import retrieve as R

    rng = np.random.default_rng(0)
    q, c, k = rng.integers(-2, 3, (9, 4)).astype(float), rng.integers(-2, 3, (50, 4)).astype(float), np.array([0, 1, 2, 3, 60, 5, 5, 1, 0])
    monkeypatch.setattr(R, "SCORES", 100)
    got = list(zip(*(x.tolist() for x in R._best(q, c, k)), strict=True))
    want = [(i, j, (q @ c.T)[i, j]) for i in range(9) for j in np.argsort(-(q @ c.T)[i], kind="stable")[: k[i]].tolist()]
    assert got == want
