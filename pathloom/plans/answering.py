"""From questions with their packed subgraphs to answers: every stage over all questions at once,
in joins keyed by case. A model and an encoder are functions given; the graph, plans, paths and
evidence are tables, so the number of questions changes no Spark plan."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import text as X
from pathloom.operators import answers as A
from pathloom.operators import evidence as E
from pathloom.operators import planning as P
from pathloom.operators import retrieve as R
from pathloom.operators import select as S
from pathloom.operators import stage as ST
from pathloom.operators.adjacency import pack
from pathloom.operators.lineage import kept
from pathloom.operators.plan import Plans
from pathloom.plans import runner
from pathloom.plans.prompts import prompt
from pathloom.sources import cases as C
from pathloom.sources import provider
from pathloom.sources import testkg

Encode = Callable[[list[str]], list[list[float]]]


def word_vectors(texts: list[str], size: int = 256) -> list[list[float]]:
    """Without an encoder: words and their first four letters, hashed to columns."""
    out = []
    for text in texts:
        v = [0.0] * size
        for word in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            for part in (word, word[:4] + "*"):
                v[int.from_bytes(hashlib.md5(part.encode()).digest()[:4], "big") % size] += 1.0
        out.append(v)
    return out


def roles(state: DataFrame) -> DataFrame:
    """(case_id, pos, entity, role) of a plan's entities."""
    own = F.coalesce(X.plan_json(F.col("triples_raw"))["entity_roles"], F.array().cast("array<struct<entity:string,role:string,reason:string>>"))
    return state.select("case_id", F.posexplode(own).alias("pos", "x")).select("case_id", "pos", "x.entity", "x.role")


def retrieved(queries: DataFrame, edges: DataFrame, encode: Encode, k: int) -> DataFrame:
    """(case_id, idx, rel, score, rank): the best relations of the case's own graph for each
    triple's queries (case_id, idx, source, query), over the queries of a triple."""
    rels = edges.select("case_id", "r").distinct()
    named = rels.select("r", X.relation_short(F.col("r")).alias("text")).distinct()
    vectors = kept(provider.embed(queries.select(F.col("query").alias("text")).unionByName(named.select("text")), encode))
    asked = queries.select("case_id", F.to_json(F.struct("idx", "source")).alias("query_id"), F.col("query").alias("text")).join(vectors, "text").select("case_id", "query_id", F.col("embedding").alias("query"))
    known = rels.join(named, "r").join(vectors, "text").select("case_id", F.col("r").alias("cand_id"), "embedding")
    top = R.topk_within(asked, known, k, ["case_id"])
    best = top.withColumn("idx", F.get_json_object("query_id", "$.idx").cast("int")).groupBy("case_id", "idx", F.col("cand_id").alias("rel")).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id", "idx").orderBy(F.col("score").desc(), "rel"))).where(F.col("rank") <= k)


def pruned(state: DataFrame, steps: DataFrame, found: DataFrame, call: runner.Ask, per_step: int) -> DataFrame:
    """(case_id, step, rel): what the model keeps of each step's relations, the first few where
    it names none."""
    by_step = steps.select("case_id", "idx", "step").distinct().join(found, ["case_id", "idx"]).groupBy("case_id", "step", "rel").agg(F.max("score").alias("score"))
    ranked = kept(by_step.withColumn("rank", F.row_number().over(Window.partitionBy("case_id", "step").orderBy(F.col("score").desc(), "rel"))))
    line = F.concat(F.lit("step_"), "step", F.lit(":\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "rel"))), lambda x: F.concat(x["rank"].cast("string"), F.lit(". "), x["rel"])), "\n"))
    listed = ranked.groupBy("case_id", "step").agg(line.alias("line")).groupBy("case_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "line"))), lambda x: x["line"]), "\n").alias("listed"))
    asked = state.select("case_id", "question").join(listed, "case_id")
    said = kept(runner.ask(asked, call, prompt("prune", question=F.col("question"), candidates=F.col("listed")), "raw"))
    picks = said.select("case_id", F.explode(X.relation_choices(F.coalesce("raw", F.lit("")))).alias("x")).select("case_id", F.col("x.step").alias("step"), F.col("x.numbers").alias("numbers")).where(F.size("numbers") > 0)
    return P.pick_by_number(ranked, picks, fallback=per_step).select("case_id", "step", "rel")


def ordered_patterns(found: DataFrame) -> DataFrame:
    """Patterns in order: endpoints first, layers covered, few hops, the chain."""
    order = Window.partitionBy("case_id").orderBy(F.col("endpoint").isNull(), F.col("n_covered").desc(), "depth", "chain", "endpoint")
    ends = F.when(F.col("endpoint").isNotNull(), F.array("endpoint")).otherwise(F.array().cast("array<string>"))
    return found.withColumn("pos", F.row_number().over(order) - 1).withColumn("readable", S.readable(F.col("witness"), F.col("rels"), ends))


def by_case(df: DataFrame) -> DataFrame:
    """The case as the anchor, for what works on one key."""
    return df.drop("anchor").withColumnRenamed("case_id", "anchor")


def evidence_of(paths: DataFrame, found: DataFrame, selected: DataFrame, edges: DataFrame, endpoints: DataFrame, lines: int) -> DataFrame:
    """(case_id, evidence): the selected patterns (case_id, pos) with their support paths, facts
    and siblings as text, a bounded number of lines for a question; where all selected patterns
    are noise, paths cut at an endpoint stand in."""
    chosen = found.join(selected, ["case_id", "pos"])
    at = Window.partitionBy("case_id").orderBy("pos")
    shown = kept(chosen.withColumn("place", F.row_number().over(at)))
    order = by_case(shown.dropDuplicates(["case_id", "chain"]).select("case_id", "chain", "place", "readable", "candidates"))
    own = by_case(paths.withColumn("chain", ST.pattern_key(F.col("nodes"), F.col("rels"))).join(shown.select("case_id", "chain").distinct(), ["case_id", "chain"], "left_semi").drop("chain"))
    support = kept(E.support_paths(own))
    graph = by_case(edges.select("case_id", "h", "r", "t"))
    bodies = E.evidence_bodies(E.pattern_evidence(support, graph), order, lines)
    text = E.evidence_text(order, bodies)
    rescued = E.endpoint_rescue(by_case(paths), by_case(shown.select("case_id", "rels")), by_case(endpoints))
    named = rescued.groupBy("anchor").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", F.array_join("nodes", " > ").alias("x")))), lambda x: x["x"]), "\n").alias("more"))
    out = text.join(named, "anchor", "full")
    return out.select(F.col("anchor").alias("case_id"), F.concat_ws("\n\n", "text", F.concat(F.lit("To the named entities:\n"), F.col("more"))).alias("evidence"))


def listed_candidates(names: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, candidates): names of the last step, then of patterns, distinct when normalized."""
    more = found.select("case_id", F.col("pos").alias("p"), F.posexplode("candidates").alias("i", "name"))
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("p", "i"))
    merged = ST.merge_names(names.select(F.col("case_id").alias("anchor"), F.row_number().over(Window.partitionBy("case_id").orderBy("name")).alias("pos"), "name"), more.withColumn("pos", rank).select(F.col("case_id").alias("anchor"), "pos", "name"))
    return merged.groupBy(F.col("anchor").alias("case_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("candidates"))


def answer_questions(cases: DataFrame, samples: DataFrame, call: runner.Ask, encode: Encode | None = None, options: C.Options | None = None, lines: int = 400) -> DataFrame:
    """The state of all cases (case_id, question, gt, sample_id) with their answers and scores. A
    question whose plan, anchor or graph fails says why in `error` and goes round the rest."""
    options, encode = options or C.Options(), encode or word_vectors
    own = samples.join(cases.select(F.col("case_id").alias("_case"), F.col("sample_id").alias("case_id")), "case_id").drop("case_id").withColumnRenamed("_case", "case_id")
    entities, edges = (kept(x) for x in testkg.hydrate(own))
    seeds = C.seed_names(own.select("case_id", "q_entity"))
    state, _ = runner.run_stages(cases, [("cascade", runner.cascade(call, options.allow_one_step))])
    live = state.where("active")
    triples, role = kept(runner._triples(live, "triples_raw")), kept(roles(live))

    mentions = triples.groupBy("case_id").agg(F.first("anchor").alias("mention")).where("mention is not null").withColumn("pos", F.lit(0))
    found = kept(P.resolve_anchors(mentions, entities, seeds))
    state = state.join(found.select("case_id", F.col("ent_id").alias("anchor_idx"), F.col("name").alias("anchor_name")), "case_id", "left")
    state = kept(runner.soft_fail(state, F.col("anchor_idx").isNull(), "no anchor in the graph"))
    anchors = state.where("active").select("case_id", F.col("anchor_name").alias("anchor"))
    ends = kept(P.role_endpoints(role, entities, found).join(anchors, "case_id").select("case_id", "anchor", F.col("name").alias("endpoint")))

    said = state.where("active").select("case_id", F.posexplode("subquestions").alias("n", "text")).withColumn("n", F.col("n") + 1)
    steps = kept(P.plan_steps(triples.join(anchors.select("case_id"), "case_id"), said))
    top = kept(retrieved(P.retrieval_queries(steps, cases), edges, encode, 15))
    picked = kept(pruned(state.where("active"), steps, top, call, options.relations_per_step))
    plans = Plans.of_cases(picked.select("case_id", (F.col("step") - 1).alias("layer"), "rel"))
    n_steps = steps.groupBy("case_id").agg(F.max("step").alias("n_steps"))

    graph = pack(edges.groupBy("case_id", "h", "r", "t").agg(F.min("edge_id").alias("edge_id")))
    paths = kept(ST.traverse(anchors.join(n_steps, "case_id"), graph, plans, endpoints=ends, cap=options.state_cap, beam=options.beam))
    names = kept(ST.last_step_candidates(paths, graph, plans))
    paths, _ = ST.explosion_filter(paths, names, graph, plans, ends, options.explosion, options.explosion, options.beam)
    paths = kept(paths)
    names = ST.last_step_candidates(paths, graph, plans)
    groups = kept(ordered_patterns(ST.patterns(paths, ends)))

    listed = groups.select(F.col("case_id").alias("anchor"), "pos", F.col("rels").alias("chain"), "readable")
    state = state.join(paths.groupBy("case_id").agg(F.count("*").cast("int").alias("num_paths"), F.max(F.size("edges")).alias("max_depth")), "case_id", "left")
    state = kept(state.na.fill(0, ["num_paths", "max_depth"]).withColumn("needs_direct_answer", F.col("active") & (F.col("num_paths") == 0)))
    state = kept(runner.gated(state, runner.select_patterns(call, listed), F.col("active") & (F.col("num_paths") > 0)))
    selected = state.select("case_id", F.explode("selected").alias("pos"))
    told = evidence_of(paths, groups, selected, edges, ends, lines)
    options_ = listed_candidates(names, groups)
    state = kept(state.join(told, "case_id", "left").join(options_, "case_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>"))).withColumn("answer_type", F.lit(None).cast("string")))
    state = kept(runner.gated(state, runner.answer(call, "v2", entities)))
    gold = cases.select("case_id", F.explode("gt").alias("gold"))
    flags = A.refresh_flags(state.select("case_id", F.explode("candidates").alias("name")), gold)
    return runner.scored(state.withColumn("answer_candidates", F.col("candidates")).join(flags, "case_id", "left").na.fill(False, ["gt_hit", "gt_hit_strict"]))
