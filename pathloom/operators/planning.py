"""Plans: from a model's triples and roles to layers of relations. Plan tables are small (a few
rows a question) and keyed by case_id; every rule is a join or a window within a case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import is_cvt, is_noisy, normalize, token_overlap
from pathloom.operators.adjacency import Graph, as_graph, key_of, pack
from pathloom.operators.graph import both_ways
from pathloom.operators.lineage import kept
from pathloom.operators.matching import containing
from pathloom.operators.plan import PLAN, Plans, as_plans, has, holds
from pathloom.operators.retrieve import vector_topk

#: Triples a plan may have; more rounds than that find nothing new.
MOST = 12


def _plain(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def starts_at_anchor(subject: Column, anchor: Column) -> Column:
    """Equal, or one contains the other and the subject has three characters."""
    s, a = _plain(subject), _plain(anchor)
    return (s == a) | ((a != "") & (F.length(s) >= 3) & (F.contains(s, a) | F.contains(a, s)))


def _links(triples: DataFrame) -> DataFrame:
    """(case_id, idx, child): triple `child` starts where triple `idx` ends."""
    a = triples.select("case_id", "idx", _plain(F.col("object")).alias("x")).where("x <> ''")
    b = triples.select("case_id", F.col("idx").alias("child"), _plain(F.col("subject")).alias("x"))
    return a.join(b, ["case_id", "x"]).where("idx <> child").select("case_id", "idx", "child")


def triple_depths(triples: DataFrame, most: int = MOST) -> DataFrame:
    """(case_id, idx, depth) of triples (case_id, idx, subject, object, anchor): 0 at the
    anchor, else one more than the least depth of a triple whose object is the subject, as
    found in index order; triples that hang on none follow one by one after the deepest."""
    links = kept(_links(triples))
    known = triples.where(starts_at_anchor(F.col("subject"), F.col("anchor"))).select("case_id", "idx", F.lit(0).alias("depth"))
    front = known
    for d in range(1, most):
        front = links.join(front.select("case_id", "idx"), ["case_id", "idx"]).select("case_id", F.col("child").alias("idx")).distinct().join(known.select("case_id", "idx"), ["case_id", "idx"], "left_anti").withColumn("depth", F.lit(d))
        front = kept(front)
        if front.isEmpty():
            break
        known = known.unionByName(front)
    known = known.groupBy("case_id", "idx").agg(F.min("depth").alias("depth"))
    all_ = triples.select("case_id", "idx").join(known, ["case_id", "idx"], "left")
    deepest = F.coalesce(F.max("depth").over(Window.partitionBy("case_id")), F.lit(-1))
    late = F.sum(F.col("depth").isNull().cast("int")).over(Window.partitionBy("case_id").orderBy("idx"))
    return all_.withColumn("deepest", deepest).withColumn("late", late).select("case_id", "idx", F.coalesce("depth", F.col("deepest") + F.col("late")).cast("int").alias("depth"))


def plan_steps(triples: DataFrame, subquestions: DataFrame) -> DataFrame:
    """(case_id, step, idx, depth, relation_query, subquestion, subject, object): triples
    (case_id, idx, subject, predicate, object, anchor, source) of one depth share a step;
    `subquestions` has (case_id, n, text), n from 1."""
    depth = triple_depths(triples)
    step = F.dense_rank().over(Window.partitionBy("case_id").orderBy("depth"))
    rows = triples.join(depth, ["case_id", "idx"]).withColumn("step", step)
    said = subquestions.select("case_id", F.col("n").alias("source"), F.col("text").alias("subquestion"))
    return rows.join(said, ["case_id", "source"], "left").select("case_id", "step", "idx", "depth", F.coalesce("predicate", F.lit("")).alias("relation_query"), F.coalesce("subquestion", F.lit("")).alias("subquestion"), "subject", "object")


def validate_triples(cases: DataFrame, triples: DataFrame) -> DataFrame:
    """(case_id, problem) of cases (case_id, anchor): 'no triples', 'anchor' (it starts none),
    'cycle', or null. Cycles are found by closing the links of a plan, at most `MOST` times."""
    links = kept(_links(triples))
    closed = links
    for _ in range(MOST.bit_length()):
        more = closed.select("case_id", "idx", F.col("child").alias("mid")).join(closed.select("case_id", F.col("idx").alias("mid"), "child"), ["case_id", "mid"]).select("case_id", "idx", "child")
        closed = kept(closed.unionByName(more).distinct())
    cyclic = closed.where("idx = child").select("case_id").distinct().withColumn("cyclic", F.lit(True))
    own = cases.select("case_id", "anchor").join(triples.drop("anchor"), "case_id", "left")
    state = own.groupBy("case_id", "anchor").agg(F.count("idx").alias("n"), F.max(starts_at_anchor(F.col("subject"), F.col("anchor"))).alias("starts"))
    state = state.join(cyclic, "case_id", "left")
    problem = F.when(F.col("n") == 0, "no triples").when((_plain(F.col("anchor")) != "") & ~F.coalesce("starts", F.lit(False)), "anchor").when(F.col("cyclic"), "cycle")
    return state.select("case_id", problem.alias("problem"))


def validate_subquestions(subs: DataFrame) -> DataFrame:
    """(case_id, problem) of sub-questions (case_id, n, text): 'degenerate' if fewer than two
    have three characters though more were given, 'duplicate' if two are equal when
    normalized; one alone is fine if it has three characters."""
    long = F.length(F.trim("text")) >= 3
    rows = subs.withColumn("norm", F.when(long, normalize(F.col("text"))))
    state = rows.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(long).alias("ok"), F.count_distinct("norm").alias("kinds"), F.count("norm").alias("named"))
    problem = F.when((F.col("n") == 1) & (F.col("ok") == 1), None).when((F.col("ok") < F.col("n")) & (F.col("ok") < 2), "degenerate").when(F.col("kinds") < F.col("named"), "duplicate")
    return state.select("case_id", problem.alias("problem"))


def count_differs(declared: Column, triples: Column) -> Column:
    """Whether a plan declares another number of triples than it has."""
    return F.coalesce(declared != F.size(triples), F.lit(False))


def resolve_anchors(mentions: DataFrame, entities: DataFrame, seeds: DataFrame, least: int = 3) -> DataFrame:
    """(case_id, ent_id, name, tier) of a case's anchor mentions (case_id, pos, mention) among its
    entities (case_id, ent_id, name). Tiers: equal when normalized; one contains the other and
    the mention has `least` characters; by a seed (case_id, pos, seed) that matches the mention
    and equals an entity; the first seed's entity; the case's first entity. Mentions in
    order, then tier, then the first entity. Names that contain one another meet over
    grams within a case (`matching`)."""
    e = entities.select("case_id", "ent_id", "name", normalize(F.col("name")).alias("e"))
    m = mentions.select("case_id", "pos", normalize(F.col("mention")).alias("m")).where("m <> ''")

    def meet(side: DataFrame, name: str) -> DataFrame:
        """Mentions beside texts of `side` that are equal, or of which one contains the other."""
        pairs = containing(m.select("case_id", F.col("m").alias("text")), side.select("case_id", F.col(name).alias("text")), ["case_id"], least_left=least)
        same = m.select("case_id", F.col("m").alias("left"), F.col("m").alias("right")).distinct()
        pairs = pairs.unionByName(same).distinct().withColumnsRenamed({"left": "m", "right": name})
        return m.join(pairs, ["case_id", "m"]).join(side, ["case_id", name])

    direct = meet(e, "e").select("case_id", "pos", F.when(F.col("m") == F.col("e"), 1).otherwise(2).alias("tier"), "ent_id", "name")
    s = seeds.select("case_id", F.col("pos").alias("k"), normalize(F.col("seed")).alias("s")).where("s <> ''")
    told = meet(s.select("case_id", "s"), "s").join(e.withColumnRenamed("e", "s"), ["case_id", "s"]).select("case_id", "pos", F.lit(3).alias("tier"), "ent_id", "name")
    first = s.where("k = 0").join(e.withColumnRenamed("e", "s"), ["case_id", "s"]).select("case_id", F.lit(1 << 20).alias("pos"), F.lit(4).alias("tier"), "ent_id", "name")
    any_ = e.where("ent_id = 0").select("case_id", F.lit(1 << 20).alias("pos"), F.lit(5).alias("tier"), "ent_id", "name")
    found = reduce(DataFrame.unionByName, [x.withColumn("pos", F.col("pos").cast("int")) for x in (direct, told, first, any_)])
    return found.groupBy("case_id").agg(F.min(F.struct("pos", "tier", "ent_id", "name")).alias("x")).select("case_id", "x.ent_id", "x.name", "x.tier")


def resolve_longest(mentions: DataFrame, entities: DataFrame, least: int = 4) -> DataFrame:
    """(case_id, pos, ent_id, name): the other resolvers' rule. Named entities only; equal when
    normalized, else the longest name that contains or is in the mention, both of `least`
    characters."""
    e = entities.where(~is_cvt(F.col("name"))).select("case_id", "ent_id", "name", normalize(F.col("name")).alias("e"))
    m = mentions.select("case_id", "pos", normalize(F.col("mention")).alias("m"))
    pairs = containing(m.select("case_id", F.col("m").alias("text")), e.select("case_id", F.col("e").alias("text")), ["case_id"], least_left=least, least_right=least)
    same = m.where("m <> ''").select("case_id", F.col("m").alias("left"), F.col("m").alias("right"))
    pairs = pairs.unionByName(same).distinct().withColumnsRenamed({"left": "m", "right": "e"})
    both = m.join(pairs, ["case_id", "m"]).join(e, ["case_id", "e"])
    rank = F.struct((F.col("m") != F.col("e")).alias("far"), (-F.length("e")).alias("size"), "ent_id", "name")
    return both.groupBy("case_id", "pos").agg(F.min(rank).alias("x")).select("case_id", "pos", "x.ent_id", "x.name")


def role_endpoints(roles: DataFrame, entities: DataFrame, anchors: DataFrame) -> DataFrame:
    """(case_id, k, ent_id, name): path entities of the plan that are entities of the case, by
    trimmed lower-case name, the last of equal names; numbered from 0; never the anchor."""
    said = roles.where("role = 'pathentity'").select("case_id", "pos", _plain(F.col("entity")).alias("x")).where("x <> ''")
    named = entities.select("case_id", "ent_id", "name", _plain(F.col("name")).alias("x")).groupBy("case_id", "x").agg(F.max(F.struct("ent_id", "name")).alias("e"))
    found = said.join(named, ["case_id", "x"]).select("case_id", "pos", "e.ent_id", "e.name").join(anchors.select("case_id", "ent_id"), ["case_id", "ent_id"], "left_anti")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy("pos")) - 1).select("case_id", "k", "ent_id", "name")


#: Words of what people do for a living, singular and plural.
OCCUPATION_WORDS = ("career", "careers", "employment", "job", "jobs", "occupation", "occupations", "profession", "professions", "vocation", "vocations")
#: Words that ask for what somebody is known for.
FAME_WORDS = ("acclaimed", "best", "celebrated", "famous", "known", "notable", "remembered", "renowned")


def asks_profession(text: Column) -> Column:
    """Whether a text asks what somebody does: it has a word of an occupation, or asks with
    'what' or 'how' and a later form of 'do', or speaks of fame for doings (a word of fame, then
    'for', then a form of 'do', deeds or actions)."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+", " ")), " ")

    def place(*some: str) -> Column:
        """Of the first of some words, from 1; a place beyond all without any."""
        at = F.array_position(F.transform(words, lambda w: w.isin(*some)), F.lit(True))
        return F.when(at > 0, at).otherwise(F.lit(1 << 30))

    def later(first: Column, *some: str) -> Column:
        return (first < (1 << 30)) & F.exists(F.slice(words, F.least(first, F.size(words)).cast("int"), F.size(words)), lambda w: w.isin(*some))

    occupied = F.exists(words, lambda w: w.isin(*OCCUPATION_WORDS))
    asked = later(F.least(place("what"), place("how")), "do", "did", "does", "doing") & (F.array_contains(words, "do") | F.array_contains(words, "doing"))
    famed = (place(*FAME_WORDS) < place("for")) & later(place("for"), "do", "doing", "done", "deed", "deeds", "action", "actions", "contribution", "contributions")
    return occupied | asked | famed


def retrieval_queries(steps: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, idx, source, query): a triple's predicate, its sub-question if it differs, and
    'profession or occupation' where the texts ask for one. Repeats in a case's triple go,
    letters' case aside."""
    rows = steps.join(cases.select("case_id", "question"), "case_id")
    q, s = F.trim("relation_query"), F.trim("subquestion")
    all_ = F.array(F.struct(F.lit(0).alias("source"), q.alias("query")), F.struct(F.lit(1).alias("source"), F.when(s != q, s).otherwise("").alias("query")), F.struct(F.lit(2).alias("source"), F.when(asks_profession(F.concat_ws(" ", "relation_query", "subquestion", "question")), "profession or occupation").otherwise("").alias("query")))
    each = rows.select("case_id", "idx", F.explode(F.filter(all_, lambda x: x["query"] != "")).alias("x")).select("case_id", "idx", "x.source", "x.query")
    one = Window.partitionBy("case_id", "idx", F.lower("query")).orderBy("source")
    return each.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k")


def prefixed(query: Column, task: str) -> Column:
    """A query as an instruction model reads it."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def retrieve_relations(queries: DataFrame, vectors: DataFrame, relations: DataFrame, k: int = 15) -> DataFrame:
    """(case_id, idx, rel, score, rank): relations (cand_id, embedding) for a triple's queries
    (case_id, idx, source, query) by exact dot products with `vectors` (query, vector), the
    best score of a relation over the queries. A text is looked up once, however many ask it."""
    texts = queries.select("query").distinct().join(vectors, "query").select(F.col("query").alias("query_id"), F.col("vector").alias("query"))
    top = vector_topk(texts, relations, k).select(F.col("query_id").alias("query"), "cand_id", "score")
    best = queries.join(top, "query").groupBy("case_id", "idx", F.col("cand_id").alias("rel")).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("case_id", "idx").orderBy(F.col("score").desc(), "rel"))).where(F.col("rank") <= k)


def pick_by_number(candidates: DataFrame, picks: DataFrame, k: int = 5, fallback: int = 3) -> DataFrame:
    """(case_id, step, rel, place): a step's candidates (case_id, step, rel, rank) by the numbers
    of a reply (case_id, step, numbers, from 1), the first `k` that exist; the first `fallback`
    candidates of a step without any."""
    said = picks.select("case_id", "step", F.posexplode("numbers").alias("i", "rank")).groupBy("case_id", "step", "rank").agg(F.min("i").alias("i"))
    got = candidates.join(said, ["case_id", "step", "rank"]).withColumn("place", F.row_number().over(Window.partitionBy("case_id", "step").orderBy("i"))).where(F.col("place") <= k)
    rest = candidates.join(got.select("case_id", "step").distinct(), ["case_id", "step"], "left_anti").where(F.col("rank") <= fallback)
    return got.select("case_id", "step", "rel", "place").unionByName(rest.select("case_id", "step", "rel", F.col("rank").alias("place")))


def merge_constraints(steps: DataFrame) -> DataFrame:
    """Steps (case_id, step, constraint, rel) with all constraint steps of a case as one last
    step, numbered anew from 1."""
    last = F.max("step").over(Window.partitionBy("case_id")) + 1
    moved = steps.withColumn("step", F.when(F.coalesce("constraint", F.lit(False)), last).otherwise(F.col("step")))
    return moved.withColumn("step", F.dense_rank().over(Window.partitionBy("case_id").orderBy("step"))).select("case_id", "step", "rel").distinct()


def reachable_relations(edges: DataFrame | Graph, anchors: DataFrame, layers: list[list[str]] | Plans) -> DataFrame:
    """(anchor, layer, r) of the layers' relations that lie within layer + 2 hops of the anchor:
    breadth-first, each node once."""
    graph, plans, key = as_graph(edges), as_plans(layers), key_of(anchors)
    seen = anchors.select(*key, F.col("anchor").alias("node"))
    front, met = seen, None
    for h in range(plans.n + 1):
        moved = kept(graph.lookup(front.withColumn("nodes", F.array("node"))).select(*key, "r", "dst").distinct())
        rels = moved.select(*key, "r").distinct().withColumn("hop", F.lit(h))
        met = rels if met is None else met.unionByName(rels)
        front = kept(moved.select(*key, F.col("dst").alias("node")).distinct().join(seen, [*key, "node"], "left_anti"))
        seen = seen.unionByName(front)
    first = plans.attach(met.groupBy(*key, "r").agg(F.min("hop").alias("hop")).where(F.lit(plans.n > 0)))
    at = F.filter(F.sequence(F.lit(0), F.lit(max(plans.n, 1) - 1)), lambda i: holds(F.col("r"), i) & (F.col("hop") < i + 2) & (F.col("hop") < plans.length() + 1))
    return first.select(*key, F.explode(at).alias("layer"), "r")


def preflight(edges: DataFrame | Graph, anchors: DataFrame, layers: list[list[str]] | Plans, fanout: int = 50, sample: int = 80) -> DataFrame:
    """(anchor, layer, r, status, hits, facts, next_hits): what a layer's relation reaches from
    the frontier, nodes seen before aside: BLOCK without any, WARN above `fanout`, for a noisy
    relation, or if none of the first `sample` nodes leads to the next layer; else PASS. The
    next frontier is the first `sample` nodes of the layer."""
    graph, plans, key = edges if isinstance(edges, Graph) else pack(edges, noise=True), as_plans(layers), key_of(anchors)
    own = plans.attach(anchors.select(*key))
    front = own.withColumn("nodes", F.array("anchor"))
    seen, out = front.select(*key, F.col("anchor").alias("node")), None
    for i in range(plans.n):
        if plans.layers is not None and not plans.layers[i]:
            continue
        here = own.where(has(i))
        plan = here.select(*key, F.explode(F.filter(F.map_keys("masks"), lambda r: holds(r, i))).alias("r"))
        found = kept(graph.lookup(front.where(has(i)), holds(F.col("r"), i)).select(*key, *PLAN, "r", F.col("dst").alias("node")).dropDuplicates([*key, "r", "node"]).join(seen, [*key, "node"], "left_anti"))
        few = found.withColumn("k", F.row_number().over(Window.partitionBy(*key, "r").orderBy("node"))).where(F.col("k") <= sample).drop("k").withColumnRenamed("r", "_r")
        ahead = graph.lookup(few.withColumn("nodes", F.array("node")), holds(F.col("r"), i + 1)).groupBy(*key, F.col("_r").alias("r")).agg(F.count_distinct("node").alias("next_hits"))
        counts = found.groupBy(*key, "r").agg(F.count("*").alias("hits"), F.count_if(is_cvt(F.col("node"))).alias("facts"))
        rows = plan.join(counts, [*key, "r"], "left").join(ahead, [*key, "r"], "left").join(here.select(*key, has(i + 1).alias("_more")), key).na.fill(0, ["hits", "facts", "next_hits"])
        warn = (F.col("hits") > fanout) | is_noisy(F.col("r")) | (F.col("_more") & (F.col("next_hits") == 0))
        rows = rows.select(*key, F.lit(i).alias("layer"), "r", F.when(F.col("hits") == 0, "BLOCK").when(warn, "WARN").otherwise("PASS").alias("status"), "hits", "facts", "next_hits")
        out = rows if out is None else out.unionByName(rows)
        k = F.row_number().over(Window.partitionBy(*key).orderBy("node"))
        new = kept(found.dropDuplicates([*key, "node"]).withColumn("k", k).where(F.col("k") <= sample).select(*key, *PLAN, "node", F.array("node").alias("nodes")))
        front = new.drop("node").unionByName(front.join(new.select(*key).distinct(), key, "left_anti").select(*key, *PLAN, "nodes"))
        seen = seen.unionByName(new.select(*key, "node")).distinct()
    return out


def incident_overlap(entities: DataFrame, edges: DataFrame, relations: DataFrame) -> DataFrame:
    """(case_id, name, n): how many of a case's query relations (case_id, r) touch each of its
    candidate entities (case_id, name)."""
    ends = both_ways(edges).select(F.col("src").alias("name"), "r").distinct()
    both = entities.join(ends, "name").join(relations.select("case_id", "r").distinct(), ["case_id", "r"])
    return entities.join(both.groupBy("case_id", "name").agg(F.count_distinct("r").alias("n")), ["case_id", "name"], "left").na.fill(0, ["n"])


def rank_anchors(candidates: DataFrame, edges: DataFrame, relations: DataFrame, least: float = 0.5, most: int = 6) -> DataFrame:
    """(case_id, place, name, n, score): retrieved entities (case_id, mention, name, score) whose
    tokens the mention shares to `least`, by relations in common, then score; distinct names."""
    near = candidates.where(token_overlap(F.col("mention"), F.col("name")) >= least)
    best = near.groupBy("case_id", "name").agg(F.max("score").alias("score"))
    ranked = best.join(incident_overlap(best.select("case_id", "name"), edges, relations), ["case_id", "name"])
    order = Window.partitionBy("case_id").orderBy(F.col("n").desc(), F.col("score").desc(), "name")
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("case_id", "place", "name", "n", "score")


def anchor_shortcuts(diagnostics: DataFrame) -> DataFrame:
    """(anchor, clear): layers to empty. A layer that the frontier misses but the anchor reaches
    empties the one before it. `diagnostics` has anchor, layer, frontier_hit, anchor_hit."""
    return diagnostics.where(~F.col("frontier_hit") & F.col("anchor_hit") & (F.col("layer") > 0)).select(*key_of(diagnostics), (F.col("layer") - 1).alias("clear")).distinct()


def without_layers(plans: DataFrame, clear: DataFrame) -> DataFrame:
    """Plans (anchor, layer, r) without the cleared layers."""
    return plans.join(clear.withColumnRenamed("clear", "layer"), [*key_of(clear), "layer"], "left_anti")
