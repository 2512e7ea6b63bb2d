"""Plans in two turns: what the question names and asks for, then a chain of relations from its
start; a chain of one hop is asked for again where one isn't enough. Steps, anchor and
endpoints come out as tables keyed by case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions import grammar as Y
from pathloom.functions.text import is_cvt, normalize, tag
from pathloom.operators.answers import graph_of
from pathloom.operators.lineage import kept
from pathloom.operators.matching import containing
from pathloom.plans.prompts import prompt
from pathloom.plans.runner import Ask, Stage, ask, soft_fail


def _said(raw: Column, name: str, otherwise: Column) -> Column:
    """A tag's text; `otherwise` where it is missing, empty, 'none' or 'n/a'."""
    text = F.trim(F.coalesce(tag(raw, name), F.lit("")))
    return F.when(F.lower(text).isin("", "none", "n/a"), otherwise).otherwise(text)


def n_hops(chain: Column) -> Column:
    return F.coalesce(F.when(chain.isNotNull(), F.size(chain["hops"])), F.lit(0))


def chain_plan(call: Ask, allow_one_step: bool = True) -> Stage:
    """Adds stage_1a_* (anchor, endpoints, answer_type, interpretation, rewritten, raw, prompt),
    chain, anchor_said, decomposition, decomposition_prompt, decomp_retry, decomp_retry_reason
    and decomp_reflect_raw to questions (case_id, question, q_entity). A question that names no
    entity starts with its second turn. The first turn's anchor comes before the chain's. A
    second chain is taken if it has two hops; without any chain a question fails."""

    def run(state: DataFrame) -> DataFrame:
        none = F.lit(None).cast("string")
        named = F.filter(F.coalesce("q_entity", F.array().cast("array<string>")), lambda e: F.trim(e) != "")
        rows = state.withColumn("_listed", F.array_join(named, " | ")).withColumn("_first", F.trim(F.get(named, F.lit(0))))
        first = prompt("analysis", question=F.col("question"), entities=F.col("_listed"))
        rows = kept(ask(rows, call, first, "stage_1a_raw", F.col("_listed") != "").withColumn("stage_1a_prompt", F.when(F.col("_listed") != "", first)))
        raw = F.coalesce("stage_1a_raw", F.lit(""))
        rows = rows.withColumns({
            "stage_1a_anchor": _said(raw, "anchor", F.col("_first")),
            "stage_1a_endpoints": _said(raw, "endpoints", F.lit("none")),
            "stage_1a_answer_type": _said(raw, "answer_type", F.lit("other")),
            "stage_1a_interpretation": _said(raw, "interpretation", F.lit("")),
            "stage_1a_rewritten": _said(raw, "rewritten", F.col("question")),
        })
        told = {"entities": F.col("_listed"), "anchor": F.coalesce("stage_1a_anchor", F.lit("N/A")), "endpoints": F.col("stage_1a_endpoints"), "answer_type": F.col("stage_1a_answer_type"), "interpretation": F.col("stage_1a_interpretation"), "rewritten": F.col("stage_1a_rewritten"), "question": F.col("question")}
        second = prompt("chain", **told)
        rows = kept(ask(rows, call, second, "decomposition").withColumn("decomposition_prompt", second))
        rows = kept(rows.withColumn("chain", Y.chain(F.coalesce("decomposition", F.lit("")))))
        rows = kept(soft_fail(rows, n_hops(F.col("chain")) == 0, "decomposition failed"))

        short = F.col("active") & (n_hops(F.col("chain")) <= 1) & F.lit(not allow_one_step)
        hop = F.get(F.col("chain.hops"), F.lit(0))
        before = F.concat(F.lit("Your last chain had one hop, "), F.coalesce(hop["relation"], F.lit("")), F.lit(", which is not enough for this question. Use two hops or more.\n"))
        rows = kept(ask(rows, call, prompt("chain", problem=before, **told), "decomp_reflect_raw", short))
        again = Y.chain(F.coalesce("decomp_reflect_raw", F.lit("")))
        better = F.col("decomp_reflect_raw").isNotNull() & (n_hops(again) >= 2)
        rows = rows.withColumns({"decomp_retry": F.col("decomp_reflect_raw").isNotNull(), "decomp_retry_reason": F.when(F.col("decomp_reflect_raw").isNotNull(), F.lit("one hop for a question that needs more")).otherwise(none), "chain": F.when(better, again).otherwise(F.col("chain"))})
        return kept(rows.withColumn("anchor_said", F.coalesce("stage_1a_anchor", F.col("chain.anchor"))).drop("_listed", "_first"))

    return run


def chain_steps(state: DataFrame) -> DataFrame:
    """(case_id, step, question, relation_query, keyword, definition, subquestion) of chains, from 1."""
    each = state.where("chain is not null").select("case_id", F.posexplode("chain.hops").alias("i", "h"))
    asked = F.when(F.col("h.subquestion") != "", F.col("h.subquestion")).otherwise(F.col("h.relation"))
    return each.select("case_id", (F.col("i") + 1).alias("step"), asked.alias("question"), F.col("h.relation").alias("relation_query"), "h.keyword", "h.definition", "h.subquestion")


def _named(entities: DataFrame) -> DataFrame:
    """Of a graph's named entities that are equal when normalized the first, and the longest."""
    own = graph_of(entities)
    e = entities.where(~is_cvt(F.col("name"))).select(own, "ent_id", "name", normalize(F.col("name")).alias("e")).where("e <> ''")
    longest = F.struct((-F.length("name")).alias("size"), "ent_id", "name")
    return e.groupBy(own, "e").agg(F.min(F.struct("ent_id", "name")).alias("first"), F.min(longest).alias("longest"))


def _reached(said: DataFrame, entities: DataFrame, seeds: DataFrame, least: int, longest: bool) -> DataFrame:
    """(case_id, pos, ent_id, name, tier) of names (case_id, pos, m: normalized) in a case's graph.
    Tier 1: equal; 2: a seed (case_id, seed) that is equal, or of which one contains the other,
    and that is an entity; 3: an entity of which one contains the other. `longest` takes the
    longest of these and asks only the name for `least` characters; else the first, with as many
    in both, before the seeds. With a graph_id, which names have then too, entities are a graph's
    that cases share; a name is looked up once in it, however many cases say it."""
    own = graph_of(entities)
    e = _named(entities)
    s = seeds.select("case_id", normalize(F.col("seed")).alias("s")).where("s <> ''").distinct()
    text, asked = said.select("case_id", F.col("m").alias("text")), said.select(own, F.col("m").alias("text"))
    equal = said.join(e.withColumnRenamed("e", "m"), [own, "m"]).select("case_id", "pos", "first.ent_id", "first.name", F.lit(1).alias("tier"), F.lit(0).alias("size"))
    near = containing(text, s.select("case_id", F.col("s").alias("text")), ["case_id"], least_left=1 if longest else least, least_right=1 if longest else least)
    near = near.unionByName(text.join(s.withColumn("text", F.col("s")), ["case_id", "text"]).select("case_id", F.col("text").alias("left"), F.col("s").alias("right"))).distinct()
    by_seed = said.join(near.withColumnsRenamed({"left": "m", "right": "e"}), ["case_id", "m"]).join(e, [own, "e"]).select("case_id", "pos", "first.ent_id", "first.name", F.lit(2 if longest else 3).alias("tier"), F.lit(0).alias("size"))
    pairs = containing(asked, e.select(own, F.col("e").alias("text")), [own], least_left=least, least_right=1 if longest else least)
    best = F.col("longest") if longest else F.struct(F.lit(0).alias("size"), "first.ent_id", "first.name")
    part = pairs.withColumnsRenamed({"left": "m", "right": "e"}).join(e, [own, "e"]).groupBy(own, "m").agg(F.min(best).alias("x"))
    part = said.join(part, [own, "m"]).select("case_id", "pos", "x.ent_id", "x.name", F.lit(3 if longest else 2).alias("tier"), "x.size")
    best = equal.unionByName(by_seed).unionByName(part).groupBy("case_id", "pos").agg(F.min(F.struct("tier", "size", "ent_id", "name")).alias("x"))
    return best.select("case_id", "pos", "x.ent_id", "x.name", "x.tier")


def chain_anchors(state: DataFrame, entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(case_id, ent_id, name, tier): the entity of each chain's anchor: equal, by a seed, or the
    longest that contains it or is in it."""
    own = dict.fromkeys(("case_id", graph_of(entities)))
    said = state.select(*own, F.lit(0).alias("pos"), normalize(F.col("anchor_said")).alias("m")).where("m <> ''")
    return _reached(said, entities, seeds, least=3, longest=True).drop("pos")


def chain_endpoints(state: DataFrame, entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(case_id, key, query, ent_id, name) of a chain's endpoints: equal, contained (four
    characters in both), or by a seed. The key is the hop an endpoint says, or one more than the
    steps; later ones of a key that is taken count on by hundreds. One without an entity is
    pending: ent_id is null."""
    own = dict.fromkeys(("case_id", graph_of(entities)))
    each = state.where("chain is not null").select(*own, (n_hops(F.col("chain")) + 1).alias("_after"), F.posexplode("chain.endpoints").alias("pos", "x"))
    said = kept(each.select(*own, "pos", F.coalesce("x.hop", "_after").alias("hop"), F.col("x.entity").alias("query"), normalize(F.col("x.entity")).alias("m")))
    found = _reached(said.where("m <> ''").select(*own, "pos", "m"), entities, seeds, least=4, longest=False)
    rows = said.join(found, ["case_id", "pos"], "left")
    nth = F.row_number().over(Window.partitionBy("case_id", "hop", F.col("ent_id").isNull()).orderBy("pos")) - 1
    key = F.when(F.col("ent_id").isNull(), F.col("hop")).otherwise(F.col("hop") + 100 * nth)
    return rows.select("case_id", key.cast("int").alias("key"), "query", "ent_id", "name")
