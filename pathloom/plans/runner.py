"""A run over all questions, stage by stage. The state is one row a question with the flags
`active`, `error` and `needs_direct_answer`; a stage takes the rows it may and the others go
round it. Each stage's rows are kept in the shared folder."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import text as X
from pathloom.operators import answers as A
from pathloom.operators import planning as P
from pathloom.operators import select as S
from pathloom.operators.lineage import kept
from pathloom.plans.prompts import numbered, prompt
from pathloom.sources import cases as C
from pathloom.sources import sinks

#: (prompt_id, prompt) to (prompt_id, response): a model, or recorded replies.
Ask = Callable[[DataFrame], DataFrame]
Stage = Callable[[DataFrame], DataFrame]

_TEXT = "question decomposition_prompt decomposition_question decomposition decomp_reflect_raw decomp_retry_reason stage_1a_raw stage_1a_prompt stage_1a_anchor stage_1a_endpoints stage_1a_interpretation stage_1a_answer_type stage_1a_rewritten anchor_name path_select_prompt path_select_response llm_answer llm_reasoning_prompt llm_reasoning_full error".split()
_LISTS = "gt_answers steps_parsed step_relations answer_candidates logical_paths pattern_details selected_paths entity_retrieval_details relation_retrieval_details layer_diagnostics planning_attempts attempt_log".split()
_FLAGS = "decomp_retry gt_hit gt_hit_strict llm_hit".split()
_COUNTS = "max_depth num_paths num_patterns num_triples anchor_idx".split()
_RATES = "gt_f1 llm_f1 llm_precision llm_recall".split()
_MAPS = "breakpoints prune_debug stage_times".split()
#: The keys of a result row, by kind; with case_id 49.
RESULT_KEYS = ("case_id", *_TEXT, *_LISTS, *_FLAGS, *_COUNTS, *_RATES, *_MAPS)


def result_rows(state: DataFrame, shown: int = 10) -> DataFrame:
    """One row a question with every key of a result; what a run has not made is empty, and of
    the readable patterns the first `shown` are listed."""
    def of(name: str) -> Column:
        if name in state.columns:
            return F.slice(name, 1, shown) if name == "logical_paths" else F.col(name)
        if name in _TEXT:
            return F.lit(None if name == "error" else "").cast("string")
        if name in _LISTS:
            return F.array().cast("array<string>")
        if name in _FLAGS:
            return F.lit(False)
        if name in _COUNTS:
            return F.lit(None if name == "anchor_idx" else 0).cast("int")
        return F.lit(0.0) if name in _RATES else F.create_map().cast("map<string,string>")

    return state.select(*(of(k).alias(k) for k in RESULT_KEYS))


def init(cases: DataFrame) -> DataFrame:
    """State rows of questions (case_id, question, gt)."""
    return cases.select("*", F.lit(True).alias("active"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("needs_direct_answer"))


def soft_fail(state: DataFrame, failed: Column, why: str) -> DataFrame:
    """Rows that failed are no longer active and say why; an earlier reason stays."""
    bad = F.coalesce(failed, F.lit(False)) & F.col("active")
    return state.withColumn("error", F.when(bad, F.coalesce("error", F.lit(why))).otherwise(F.col("error"))).withColumn("active", F.col("active") & ~bad)


def gated(state: DataFrame, stage: Stage, flag: Column | None = None) -> DataFrame:
    """A stage on the rows it may take (active ones, or those of `flag`); the others come back
    with nulls in what it adds."""
    may = F.coalesce(flag if flag is not None else F.col("active"), F.lit(False))
    done = stage(state.where(may))
    return done.unionByName(state.where(~may), allowMissingColumns=True)


def ask(state: DataFrame, call: Ask, said: Column, into: str, who: Column | None = None) -> DataFrame:
    """Adds a column with the replies to the prompts of `said`, null where not asked."""
    rows = state.withColumn("_prompt", said)
    asked = rows.where(who) if who is not None else rows
    replies = call(asked.select(F.col("case_id").alias("prompt_id"), F.col("_prompt").alias("prompt")))
    return state.join(replies.select(F.col("prompt_id").alias("case_id"), F.col("response").alias(into)), "case_id", "left")


def _triples(state: DataFrame, column: str) -> DataFrame:
    p = X.plan_json(F.col(column))
    anchor = F.get(F.filter(F.coalesce(p["entity_roles"], F.array().cast("array<struct<entity:string,role:string,reason:string>>")), lambda r: r["role"] == "anchorentity"), F.lit(0))["entity"]
    rows = state.select("case_id", anchor.alias("anchor"), F.posexplode(p["triples"]).alias("idx", "t"))
    return rows.select("case_id", "idx", F.col("t.subject").alias("subject"), F.col("t.predicate").alias("predicate"), F.col("t.object").alias("object"), "anchor", F.col("t.source_subquestion").try_cast("int").alias("source"))


def cascade(call: Ask, allow_one_step: bool = True) -> Stage:
    """Question to sub-questions to triples: a plan that only repeats the question is asked for
    again unless one step is allowed; triples with a problem are asked for once more with it.
    Adds subquestions, triples_raw, plan_problem; a plan with a problem after that is inactive."""

    def run(state: DataFrame) -> DataFrame:
        first = kept(ask(state, call, prompt("subquestions", question=F.col("question")), "subs_raw"))
        subs = X.subquestions(F.col("subs_raw"))
        trivial = (F.size(subs) == 1) & X.is_trivial(F.get(subs, F.lit(0)), F.col("question")) & F.lit(not allow_one_step)
        again = prompt("subquestions", question=F.concat(F.col("question"), F.lit("\nUse at least two.")))
        first = kept(ask(first, call, again, "subs_again", trivial).withColumn("subs_raw", F.coalesce("subs_again", "subs_raw")).drop("subs_again"))
        first = first.withColumn("subquestions", X.subquestions(F.col("subs_raw")))
        told = {"question": F.col("question"), "subquestions": numbered(F.col("subquestions"))}
        out = kept(ask(first, call, prompt("triples", **told), "triples_raw"))

        def problems(rows: DataFrame) -> DataFrame:
            t = kept(_triples(rows, "triples_raw"))
            anchors = t.groupBy("case_id").agg(F.first("anchor").alias("anchor"))
            found = P.validate_triples(rows.select("case_id").join(anchors, "case_id", "left"), t)
            return rows.join(found.withColumnRenamed("problem", "plan_problem"), "case_id", "left")

        out = kept(problems(out))
        retry = prompt("triples", problem=F.concat(F.lit("The last plan was wrong: "), F.col("plan_problem"), F.lit(".\n")), **told)
        out = kept(ask(out, call, retry, "triples_again", F.col("plan_problem").isNotNull()))
        out = out.withColumn("decomp_retry", F.col("triples_again").isNotNull()).withColumn("triples_raw", F.coalesce("triples_again", "triples_raw")).drop("triples_again", "plan_problem")
        out = kept(problems(out))
        return soft_fail(out, F.col("plan_problem").isNotNull(), "no valid plan")

    return run


def select_patterns(call: Ask, patterns: DataFrame) -> Stage:
    """Adds `selected` (positions) by a reply's numbers over the shortlist of a question's
    patterns (anchor, pos, chain, readable), filled up to two."""

    def run(state: DataFrame) -> DataFrame:
        shown = kept(S.shortlist(patterns))
        order = F.transform(F.sort_array(F.collect_list(F.struct("pos", "readable"))), lambda x: x["readable"])
        listed = shown.groupBy(F.col("anchor").alias("case_id")).agg(order.alias("_shown"))
        rows = state.join(listed, "case_id", "left")
        rows = kept(ask(rows, call, prompt("select", question=F.col("question"), patterns=numbered(F.col("_shown"))), "path_select_response", F.size("_shown") > 0))
        picks = S.numbered_picks(shown, rows.select(F.col("case_id").alias("anchor"), X.selected(F.col("path_select_response")).alias("numbers")))
        full = S.at_least(picks, patterns).groupBy(F.col("anchor").alias("case_id")).agg(F.sort_array(F.collect_set("pos")).alias("selected"))
        return rows.drop("_shown").join(full, "case_id", "left")

    return run


def answer(call: Ask, style: str = "v2", entities: DataFrame | None = None) -> Stage:
    """Adds llm_answer, answer_tier and validation: a reply over the evidence (columns evidence,
    candidates, answer_type), a direct one for questions without paths; then answers are checked
    against the case's `entities`, if given, with a second question for names that are not there,
    then a retry for the format, one over the candidates, and the candidates themselves."""

    def run(state: DataFrame) -> DataFrame:
        known = {"question": F.col("question"), "evidence": F.col("evidence"), "candidates": F.array_join("candidates", ", "), "answer_type": F.coalesce("answer_type", F.lit("any"))}
        said = F.when(F.col("needs_direct_answer"), prompt("direct", **known)).otherwise(prompt(style, **known))
        rows = kept(ask(state, call, said, "llm_reasoning_full").withColumn("llm_reasoning_prompt", said))
        base = kept(rows.select("case_id", "question", "evidence", X.final_answer(F.col("llm_reasoning_full")).alias("answer"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates")))

        def again(template: str) -> Callable[[DataFrame], DataFrame]:
            def retry(bad: DataFrame) -> DataFrame:
                lost = F.array_join("unmatched", ", ") if "unmatched" in bad.columns else F.coalesce("answer", F.lit("nothing"))
                full = bad.select("case_id", lost.alias("_lost")).join(base, "case_id")
                told = prompt(template, problem=F.col("_lost"), question=F.col("question"), evidence=F.col("evidence"), candidates=F.array_join("candidates", ", "))
                return ask(full.drop("answer"), call, told, "r").select("case_id", X.final_answer(F.col("r")).alias("retried"))

            return retry

        asked = base.select("case_id", "answer", "candidates")
        if entities is not None:
            asked = kept(A.validated(asked, entities, again("not_in_graph")))
        mended = A.repair(asked, [again("retry"), again("entity")])
        extra = [F.col("validation")] if entities is not None else []
        return rows.join(mended.select("case_id", F.col("answer").alias("llm_answer"), F.col("tier").alias("answer_tier"), *extra), "case_id", "left")

    return run


def scored(state: DataFrame) -> DataFrame:
    """Adds llm_hit, precision, recall and f1 of llm_answer against gt."""
    pred = F.filter(F.transform(F.split(F.coalesce("llm_answer", F.lit("")), r" \| "), lambda x: F.trim(x)), lambda x: x != "")
    stats = A.match_stats_fuzzy(state.select("case_id", pred.alias("pred"), F.col("gt").alias("gold")), "case_id")
    return state.join(stats.select("case_id", F.col("precision").alias("llm_precision"), F.col("recall").alias("llm_recall"), F.col("f1").alias("llm_f1"), (F.col("matched_gold") > 0).alias("llm_hit")), "case_id", "left")


def run_stages(cases: DataFrame, stages: list[tuple[str, Stage]], keep_going: bool = False) -> tuple[DataFrame, dict[str, float]]:
    """The state after all stages, and seconds for each; inactive rows go round. With
    `keep_going` a stage that raises leaves its rows inactive with the reason, and those of
    earlier stages as they were; without, it ends the run."""
    state, took = init(cases), {}
    for name, stage in stages:
        began = time.time()
        try:
            state = kept(gated(state, stage))
        except Exception as failed:  # noqa: BLE001
            if not keep_going:
                raise
            state = kept(soft_fail(state, F.lit(True), f"{name}: {type(failed).__name__}: {str(failed)[:200]}"))
        took[name] = round(time.time() - began, 3)
    return state, took


def trajectories(state: DataFrame) -> DataFrame:
    """(case_id, trace): a question's way through the stages, as text."""
    rows = result_rows(state)
    part = [("Question", "question"), ("Gold", "gt_answers"), ("Sub-questions", "decomposition"), ("Anchor", "anchor_name"), ("Steps", "steps_parsed"), ("Relations", "step_relations"), ("Patterns", "logical_paths"), ("Selected", "selected_paths"), ("Candidates", "answer_candidates"), ("Answer", "llm_answer"), ("Error", "error")]
    said = [F.concat(F.lit(f"{title}: "), F.coalesce(F.to_json(F.struct(F.col(c).alias("v"))), F.lit(""))) for title, c in part]
    flags = F.concat_ws(", ", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in (*_FLAGS, *_RATES)))
    return rows.select("case_id", F.concat_ws("\n", *said, flags).alias("trace"))


def main(argv: list[str] | None = None, ask_with: Ask | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """Reads questions and samples, picks the preset, answers, and writes results. Without a
    model all replies are empty, which tests the way through; without an encoder texts are
    compared by their words."""
    at = argparse.ArgumentParser(description="Answers questions over packed subgraphs.")
    for name, more in (("questions", {"required": True}), ("samples", {"required": True}), ("out", {"required": True}), ("mask", {}), ("limit", {"type": int}), ("dataset", {"choices": sorted(C.PRESETS)})):
        at.add_argument(f"--{name}", **more)
    given = at.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    from pathloom.plans import answering
    from pathloom.sources.testkg import read_samples

    samples = read_samples(spark, given.samples)
    numbered_ = C.with_ordinal(samples.select(F.col("case_id").alias("id")), "id")
    dataset = given.dataset or C.detect_dataset(numbered_).first()["dataset"]
    options = C.Options.read({}, **C.PRESETS[dataset])
    mask = spark.read.schema("case_id string").json(given.mask) if given.mask else None
    cases = C.join_cases(C.read_questions(spark, given.questions), samples.select(F.col("case_id").alias("sample_id"), F.col("question").alias("sample_question")), mask, given.limit)
    silent: Ask = lambda p: p.select("prompt_id", F.lit("").alias("response"))
    state = kept(answering.answer_questions(cases, samples, ask_with or silent, encode, options))
    rows = result_rows(state.withColumn("gt_answers", F.col("gt")))
    sinks.write_results(rows, f"{given.out}/results.json")
    sinks.write_traces(trajectories(state.withColumn("gt_answers", F.col("gt"))), f"{given.out}/trajectories")
    return rows


if __name__ == "__main__":
    main()
