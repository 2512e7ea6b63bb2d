"""What is kept, shown and reported of paths and cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import is_ascii, is_cvt, normalize


def shortlist(patterns: DataFrame, distinct: int = 3, most: int = 20, among: int | None = None, least: int = 2) -> DataFrame:
    """Patterns (anchor, pos, chain) in order, at most `most` of an anchor: once `distinct`
    starts of two relations are seen, one seen before is passed over. `among` looks at the
    first so many only. An anchor left with fewer than `least` takes its first `most` instead."""
    order = Window.partitionBy("anchor").orderBy("pos")
    if among is not None:
        patterns = patterns.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= among).drop("_n")
    signed = patterns.withColumn("_sig", F.slice("chain", 1, 2))
    signed = signed.withColumn("_first", F.row_number().over(Window.partitionBy("anchor", "_sig").orderBy("pos")) == 1)
    seen = F.coalesce(F.sum(F.col("_first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    flagged = signed.withColumn("_seen", seen).withColumn("_keep", F.col("_first") | (F.col("_seen") < distinct))
    few = F.sum(F.col("_keep").cast("int")).over(Window.partitionBy("anchor")) < least
    chosen = flagged.withColumn("_few", few).where("_keep or _few")
    return chosen.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select(*patterns.columns)


def numbered_picks(shown: DataFrame, picks: DataFrame) -> DataFrame:
    """(anchor, pos) of a reply's numbers (anchor, numbers, from 1) mapped through what was shown
    (anchor, pos; numbered by pos), the first of repeated ones; numbers beyond it go."""
    by = shown.withColumn("n", F.row_number().over(Window.partitionBy("anchor").orderBy("pos"))).select("anchor", "n", "pos")
    said = picks.select("anchor", F.explode(F.array_distinct(F.transform("numbers", lambda x: x.cast("int")))).alias("n"))
    return said.join(by, ["anchor", "n"]).select("anchor", "pos")


def more_rounds(shown: DataFrame, rounds: list[DataFrame], most: int = 3) -> DataFrame:
    """(anchor, pos, round): picks of up to `most` rounds (each anchor, pos, need_more); a round
    counts for the anchors whose last one asked for more, and picks not made before."""
    asked, out = shown.select("anchor").distinct(), None
    for k, picked in enumerate(rounds[:most]):
        own = picked.join(asked, "anchor", "left_semi")
        new = own.select("anchor", "pos").distinct()
        if out is not None:
            new = new.join(out.select("anchor", "pos"), ["anchor", "pos"], "left_anti")
        new = new.withColumn("round", F.lit(k))
        out = new if out is None else out.unionByName(new)
        asked = own.where("need_more").select("anchor").distinct()
    return out


def at_least(picks: DataFrame, patterns: DataFrame, least: int = 2, first: int = 3) -> DataFrame:
    """(anchor, pos): the picks, filled up to `least` from an anchor's `first` patterns."""
    spare = patterns.where(F.col("pos") < first).select("anchor", "pos").join(picks, ["anchor", "pos"], "left_anti")
    both = picks.select("anchor", "pos", F.lit(0).alias("source")).unionByName(spare.withColumn("source", F.lit(1)))
    k = F.row_number().over(Window.partitionBy("anchor").orderBy("source", "pos"))
    return both.withColumn("k", k).where((F.col("source") == 0) | (F.col("k") <= least)).select("anchor", "pos")


def step_targets(paths: DataFrame, plan: DataFrame) -> DataFrame:
    """(anchor, step, r, n): distinct nodes but the anchor that a step's relations reach.
    `plan` has (step, r), a row for each relation of a question's steps."""
    hop = F.explode(F.arrays_zip(F.col("rels").alias("r"), F.slice("nodes", 2, 1 << 30).alias("t")))
    each = paths.select("anchor", hop.alias("x")).select("anchor", "x.r", "x.t").where("t <> anchor").distinct()
    return each.join(plan, "r").groupBy("anchor", "step", "r").agg(F.count("*").alias("n"))


def merge_depths(steps: DataFrame, relations: DataFrame) -> DataFrame:
    """(case_id, step, rel): triples (case_id, idx, depth) of one depth share a step if some
    depth of the case has two; else each keeps its own. `relations` has (case_id, idx, rel)."""
    case = Window.partitionBy("case_id")
    n = F.count("*").over(Window.partitionBy("case_id", "depth"))
    placed = steps.withColumn("n", n).withColumn("branched", F.max("n").over(case) > 1)
    step = F.when(F.col("branched"), F.dense_rank().over(case.orderBy("depth")) - 1).otherwise(F.col("idx"))
    return placed.withColumn("step", step).select("case_id", "idx", "step").join(relations, ["case_id", "idx"]).select("case_id", "step", "rel").distinct()


def distinct_names(names: DataFrame, least: int = 2, ascii_only: bool = True) -> DataFrame:
    """(case_id, pos, name): the first of names equal when normalized; short ones go."""
    ok = F.length("norm") >= least
    if ascii_only:
        ok = ok & is_ascii(F.col("name"))
    found = names.withColumn("norm", normalize(F.col("name"))).where(ok)
    return found.groupBy("case_id", "norm").agg(F.min(F.struct("pos", "name")).alias("x")).select("case_id", "x.pos", "x.name")


def readable(nodes: Column, rels: Column, endpoints: Column) -> Column:
    """'anchor --[rel]--> node1 ...': nodes by number, one number a node; the anchor by name.
    A tail of fact nodes after the last of two named ones shows its first hop only."""
    named = F.filter(F.transform(nodes, lambda n, i: F.when(~is_cvt(n), i)), lambda i: i.isNotNull())
    end = F.try_element_at(named, F.lit(-1))
    size = F.when((F.size(named) >= 2) & (F.size(nodes) - 1 - end > 1), end + 2).otherwise(F.size(nodes))
    shown = F.slice(nodes, F.lit(2), F.greatest(size - 1, F.lit(0)))

    def part(n: Column, i: Column) -> Column:
        mark = F.when(F.array_contains(endpoints, n) & (n != F.get(nodes, F.lit(0))), "[endpoint]").otherwise("")
        return F.concat(F.lit("--["), F.coalesce(F.get(rels, i), F.lit("?")), F.lit("]--> node"), F.array_position(F.array_distinct(shown), n).cast("string"), mark)

    return F.array_join(F.concat(F.slice(nodes, 1, 1), F.transform(shown, part)), " ")


def first_hit(answer: Column, gold: Column) -> Column:
    """Whether the first of the answers joined by ' | ' contains, or is in, a gold answer."""
    preds = F.filter(F.transform(F.split(answer, r" \| "), lambda x: F.trim(x)), lambda x: x != "")
    top = normalize(F.get(preds, F.lit(0)))
    return F.coalesce(F.exists(gold, lambda g: F.contains(top, normalize(g)) | F.contains(normalize(g), top)), F.lit(False))


def run_summary(cases: DataFrame) -> DataFrame:
    """One row: cases, hits, first hits, errors and means over result rows."""

    def n(flag: Column) -> Column:
        return F.count_if(F.coalesce(flag, F.lit(False)))

    means = [F.avg(F.coalesce(c, F.lit(0.0))).alias(c) for c in ("gt_f1", "llm_precision", "llm_recall", "llm_f1")]
    return cases.agg(F.count("*").alias("cases"), n(F.col("gt_hit")).alias("gt_hits"), n(F.col("gt_hit_strict")).alias("strict_hits"), n(F.col("llm_hit")).alias("llm_hits"), n(first_hit(F.col("llm_answer"), F.col("gt_answers"))).alias("hit_at_1"), n(F.coalesce("error", F.lit("")) != "").alias("errors"), *means)


def fail_traces(cases: DataFrame) -> DataFrame:
    """(case_id, trace): the cases that missed the gold answers in the graph or in the answer."""
    missed = cases.where(~(F.coalesce("gt_hit", F.lit(False)) & F.coalesce("llm_hit", F.lit(False))))
    text = F.concat_ws("\n", F.concat(F.lit("Q: "), "question"), F.concat(F.lit("GT: "), F.array_join("gt_answers", " | ")), F.concat(F.lit("LLM: "), F.coalesce("llm_answer", F.lit(""))))
    return missed.select("case_id", text.alias("trace"))
