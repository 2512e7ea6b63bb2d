"""Entities of a question's graph for the names a plan asks for: retrieval within the case,
contexts, one round of questions to a model for all cases, and its replies read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import is_cvt, normalize, tag
from pathloom.operators.lineage import kept
from pathloom.operators.retrieve import topk_within

#: Candidates of an anchor and of an endpoint.
ANCHORS, ENDPOINTS = 5, 3


def entity_candidates(queries: DataFrame, entities: DataFrame, vectors: DataFrame) -> DataFrame:
    """(case_id, ask, kind, query, rank, name, score) for queries (case_id, ask, kind, query):
    the best distinct names of the case's entities (case_id, ent_id, name), fact nodes and
    single characters aside. `vectors` has (text, embedding) of queries and names."""
    v = vectors.select("text", "embedding")
    names = entities.where(~is_cvt(F.col("name")) & (F.length("name") > 1)).select("case_id", F.col("name").alias("cand_id")).distinct()
    names = names.join(v.withColumnRenamed("text", "cand_id"), "cand_id").select("case_id", "cand_id", "embedding")
    asked = queries.join(v.select(F.col("text").alias("query"), "embedding"), "query")
    most = F.when(F.col("kind") == "anchor", ANCHORS).otherwise(ENDPOINTS)
    asked = asked.select("case_id", F.col("ask").alias("query_id"), F.col("embedding").alias("query"), "kind")
    found = topk_within(asked, names, most, ["case_id"])
    return found.withColumnsRenamed({"query_id": "ask", "cand_id": "name"}).join(queries.select("case_id", "ask", "kind", "query"), ["case_id", "ask"]).select("case_id", "ask", "kind", "query", "rank", "name", "score")


def contexts(names: DataFrame, edges: DataFrame, outgoing: int = 2, incoming: int = 1) -> DataFrame:
    """(case_id, name, context): a few 'r->t' and 'h->r' of each asked name (case_id, name) in its
    case's edges between named nodes, in order."""
    quiet = edges.where(~is_cvt(F.col("h")) & ~is_cvt(F.col("t")) & (F.col("h") != F.col("t")))
    out = quiet.select("case_id", F.col("h").alias("name"), F.lit(0).alias("side"), F.concat_ws("->", "r", "t").alias("text"))
    back = quiet.select("case_id", F.col("t").alias("name"), F.lit(1).alias("side"), F.concat_ws("->", "h", "r").alias("text"))
    near = out.unionByName(back).join(names.select("case_id", "name").distinct(), ["case_id", "name"], "left_semi").distinct()
    k = F.row_number().over(Window.partitionBy("case_id", "name", "side").orderBy("text"))
    few = near.withColumn("k", k).where(F.col("k") <= F.when(F.col("side") == 0, outgoing).otherwise(incoming))
    return few.groupBy("case_id", "name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("side", "k", "text"))), lambda x: x["text"]), "; ").alias("context"))


def choice_prompt(query: Column, shown: Column) -> Column:
    return F.concat(F.lit("Which of these entities does the search mean? Their relations say what they are.\nSearch: "), query, F.lit("\n"), shown, F.lit("\nReply as <analysis>why</analysis><selected>the name</selected>"))


def chosen(reply: Column, names: Column) -> Column:
    """The candidate that a reply selects: the first that is equal when normalized, else the first
    that contains the selection or is in it, else the first of all."""
    said = normalize(F.regexp_replace(F.coalesce(tag(reply, "selected"), F.lit("")), "^[\"' ]+|[\"' ]+$", ""))
    equal = F.get(F.filter(names, lambda n: normalize(n) == said), F.lit(0))
    near = F.get(F.filter(names, lambda n: F.contains(normalize(n), said) | F.contains(said, normalize(n))), F.lit(0))
    return F.when(said != "", F.coalesce(equal, near, F.get(names, F.lit(0)))).otherwise(F.get(names, F.lit(0)))


def resolve_entities(queries: DataFrame, entities: DataFrame, edges: DataFrame, vectors: DataFrame, ask: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(case_id, ask, kind, query, candidates, selected, ent_id, asked) of queries (case_id, ask,
    kind: anchor or endpoint, query). One candidate alone is taken for an anchor and left open
    for an endpoint; of several the model chooses (`ask`: prompt_id, prompt to prompt_id,
    response; one call for all cases). ent_id is the first of the name in its case."""
    found = kept(entity_candidates(queries, entities, vectors))
    told = found.join(contexts(found, edges), ["case_id", "name"], "left")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("name"), F.when(F.col("context").isNotNull(), F.concat(F.lit(" ["), F.col("context"), F.lit("]"))).otherwise(""))
    each = told.groupBy("case_id", "ask", "kind", "query").agg(F.sort_array(F.collect_list(F.struct("rank", "name", line.alias("line")))).alias("x"))
    each = kept(each.select("case_id", "ask", "kind", "query", F.transform("x", lambda x: x["name"]).alias("candidates"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("shown")))
    several = each.where(F.size("candidates") > 1)
    key = F.to_json(F.struct("case_id", "ask"))
    replies = ask(several.select(key.alias("prompt_id"), choice_prompt(F.col("query"), F.col("shown")).alias("prompt")))
    rows = each.withColumn("prompt_id", key).join(replies.select("prompt_id", "response"), "prompt_id", "left")
    many = F.size("candidates") > 1
    picked = F.when(many, chosen(F.coalesce("response", F.lit("")), F.col("candidates"))).when(F.col("kind") == "anchor", F.get("candidates", F.lit(0)))
    first = entities.groupBy("case_id", F.col("name").alias("selected")).agg(F.min("ent_id").alias("ent_id"))
    rows = rows.withColumn("selected", picked).withColumn("asked", many).join(first, ["case_id", "selected"], "left")
    return rows.select("case_id", "ask", "kind", "query", "candidates", "selected", "ent_id", "asked")
