"""The registry of queries: each a DataFrame builder over the driver's tables and, where SQL
can express it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions import grammar as Y
from pathloom.functions import text as X
from pathloom.operators import graph as G
from pathloom.operators import planning as P
from pathloom.operators import retrieve as R
from pathloom.operators import select as S
from pathloom.operators import stage as ST
from pathloom.operators import walk as W
from pathloom.sources import testkg
from pathloom.streaming.ingest import event_counts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    return dict(_ORACLES)


#: Parts of the graph that queries walk.
SUPPLY = ("geo.nation.region", "org.supplier.nation", "org.customer.nation", "type.object.type", "common.topic.webpage")
ITEMS = ("sales.order.item", "sales.item.part", "sales.item.supplier")
LAYERS = [["geo.nation.region"], ["org.supplier.nation"]]
_NOISE = "(regexp_matches(r, '^(type|common|freebase|kg|user|base\\.ontologies)\\.') or split_part(r, '.', -1) in ('type','types','instance','instances','notable_types','topic_equivalent_webpage','webpage','mid','guid','key','keys','permission','is_reviewed'))"


def _e(relations: tuple[str, ...] | None, rest: str) -> str:
    """SQL with edges, clean edges and both directions (src, r, dst, edge)."""
    return f"""with edges as ({testkg.edges_sql(relations)}), clean as (select * from edges where not {_NOISE}),
bi as (select h as src, r, t as dst, h || '|' || r || '|' || t as edge from clean union all select t, r, h, h || '|' || r || '|' || t from clean where h <> t) {rest}"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/region.parquet").select(F.concat(F.lit("region:"), "r_regionkey").alias("anchor"))


def _join(*arrays: str):
    return [F.array_join(a, ">").alias(a) for a in arrays]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return region_suppliers(spark, sf_dir)


@query(_e(SUPPLY, "select distinct a.src as region, b.dst as supplier from bi a join bi b on a.dst = b.src where a.src like 'region:%' and a.r = 'geo.nation.region' and b.r = 'org.supplier.nation'"))
def region_suppliers(spark, d):
    paths = W.mode_walk(_anchors(spark, d), testkg.edges(spark, d, SUPPLY), LAYERS, cap=1_000_000)
    return paths.where("covered = 3").select(F.col("anchor").alias("region"), F.element_at("nodes", -1).alias("supplier")).distinct()


@query(_e(None, "select h, r, t from edges"))
def kg_edges(spark, d):
    return testkg.edges(spark, d)


@query(_e(None, "select distinct node as name, regexp_matches(node, '^[mg]\\.[A-Za-z0-9_]+$') as is_cvt from (select h as node from edges union all select t from edges)"))
def kg_entities(spark, d):
    e = testkg.edges(spark, d)
    return e.select(F.col("h").alias("name")).unionByName(e.select(F.col("t").alias("name"))).distinct().withColumn("is_cvt", X.is_cvt(F.col("name")))


@query(_e(None, "select r, count(*) as n from clean group by r"))
def noise_filter(spark, d):
    return G.clean(testkg.edges(spark, d)).groupBy("r").agg(F.count("*").alias("n"))


@query(_e(SUPPLY, "select h as node, r, t as next from edges where r in ('org.supplier.nation')"))
def hop_forward(spark, d):
    e = testkg.edges(spark, d, SUPPLY)
    return G.expand(e.select(F.col("h").alias("node")).distinct(), e, ["org.supplier.nation"])


@query(_e(SUPPLY, "select t as node, r, h as next from edges where r in ('org.supplier.nation')"))
def hop_reverse(spark, d):
    e = testkg.edges(spark, d, SUPPLY)
    return G.expand(e.select(F.col("t").alias("node")).distinct(), e, ["org.supplier.nation"], reverse=True)


@query(_e(SUPPLY, "select src, r, dst from bi"))
def hop_both(spark, d):
    return G.both_ways(G.clean(testkg.edges(spark, d, SUPPLY))).select("src", "r", "dst")


@query(_e(SUPPLY, "select a.src as anchor, a.dst as mid, b.dst as last from bi a join bi b on a.dst = b.src where a.src like 'region:%' and b.dst not in (a.src, a.dst)"))
def two_hop_simple(spark, d):
    steps = G.both_ways(G.clean(testkg.edges(spark, d, SUPPLY)))
    p = W.hop(W.hop(W.start(_anchors(spark, d)), steps, node_simple=True), steps, node_simple=True)
    return p.select("anchor", F.col("nodes")[1].alias("mid"), F.col("nodes")[2].alias("last"))


@query(_e(ITEMS, "select distinct src as cvt, dst as nb from bi where src like 'm.%' and src <> dst"))
def through_cvt(spark, d):
    return G.through_cvt(testkg.edges(spark, d, ITEMS))


@query(_e(("sales.order.customer",), "select h, r, t from edges where (h, r) in (select h, r from edges e join customer on e.t = 'customer:' || c_custkey where c_acctbal < 0)"))
def sibling_tails(spark, d):
    e = testkg.edges(spark, d, ("sales.order.customer",))
    owing = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal < 0").select(F.concat(F.lit("customer:"), "c_custkey").alias("t"))
    return G.sibling_tails(e, e.join(owing, "t", "left_semi"))


@query(_e(("sales.order.item",), "select a.t as node, b.t as sibling from edges a join edges b on a.h = b.h and a.r = b.r and a.t <> b.t"))
def sibling_cvt(spark, d):
    e = testkg.edges(spark, d, ("sales.order.item",))
    return G.sibling_cvts(e, e.select(F.col("t").alias("node")))


@query(_e(ITEMS, "select src as cvt, string_agg(distinct r || '=' || dst, '; ' order by r || '=' || dst) as attributes from bi where src like 'm.%' and dst not like 'm.%' group by src"))
def cvt_attributes(spark, d):
    return G.cvt_attributes(testkg.edges(spark, d, ITEMS, by_fact=True))


@query(_e(None, "select src as node, count(*) as degree from bi group by src"))
def node_degree(spark, d):
    return G.degree(G.clean(testkg.edges(spark, d)))


@query(_e(("sales.item.part",), "select src as node, count(*) as degree from bi where src like 'm.%' group by src having count(*) <= 1"))
def cvt_leaves(spark, d):
    return G.cvt_leaves(testkg.edges(spark, d, ("sales.item.part",)))


@query(_e(None, "select r, h, t from (select *, row_number() over (partition by r order by h, t) as k from edges) where k = 1"))
def sample_triple(spark, d):
    return G.sample_triple(testkg.edges(spark, d))


_NAMED = "n as (select h as node, 0 as side, r || '->' || t as text from edges union all select t, 1, h || '->' || r from edges), k as (select *, row_number() over (partition by node, side order by text) as k from n)"


@query(_e(SUPPLY, f", {_NAMED} select node, string_agg(text, '; ' order by side, k) as context from k where k <= case side when 0 then 2 else 1 end group by node"))
def entity_context(spark, d):
    return G.entity_context(testkg.edges(spark, d, SUPPLY))


@query(_e(SUPPLY, "select seed, edge from (select src as seed, edge, row_number() over (partition by src order by edge) as k from bi where src like 'nation:%') where k <= 6 order by k, seed, edge limit 120"))
def local_subgraph(spark, d):
    e = G.clean(testkg.edges(spark, d, SUPPLY))
    seeds = e.where("r = 'geo.nation.region'").select(F.col("h").alias("node")).distinct()
    return G.local_subgraph(e, seeds)


@query(_e(None, "select r, sum(n)::bigint as n_edges, count(*) as n_heads, any_value(n_tails) as n_tails, max(n) as max_fanout from (select r, h, count(*) as n from edges group by r, h) join (select r, count(distinct t) as n_tails from edges group by r) using (r) group by r"))
def relation_fanout(spark, d):
    return G.fanout(testkg.edges(spark, d))


@query(_e(("sales.order.customer",), "select h, r, string_agg(distinct t, ' | ' order by t) as tails, count(*) as n from edges group by h, r"))
def grouped_triples(spark, d):
    return G.grouped_triples(testkg.edges(spark, d, ("sales.order.customer",)))


@query(_e(SUPPLY, """, s as (select distinct src, dst from bi), f0 as (select distinct src as anchor, src as node from bi where src like 'region:%'),
f1 as (select distinct anchor, dst as node from f0 join s on node = src where dst <> anchor),
f2 as (select distinct f1.anchor, dst as node from f1 join s on f1.node = src where dst <> f1.anchor and not exists (select 1 from f1 x where x.anchor = f1.anchor and x.node = dst))
select anchor, node, 0 as hop from f0 union all select anchor, node, 1 from f1 union all select anchor, node, 2 from f2"""))
def reachability(spark, d):
    return G.reachable(G.clean(testkg.edges(spark, d, SUPPLY)), _anchors(spark, d), 2)


_PATH2 = """, p1 as (select src as anchor, src || '>' || dst as nodes, r as rels, edge as edges, dst as last, 1 as depth, (r = 'geo.nation.region')::int as c, edge as e1, '' as e2, src as n0, dst as n1 from bi where src like 'region:%'),
p2 as (select anchor, nodes || '>' || b.dst as nodes, rels || '>' || b.r as rels, b.dst as last, [e1, b.edge] as edges, 2 as depth, case when rels = 'geo.nation.region' then 1 else 0 end + case when rels = 'geo.nation.region' and b.r = 'org.supplier.nation' then 2 when rels <> 'geo.nation.region' and b.r = 'geo.nation.region' then 1 else 0 end as covered
  from p1 join bi b on p1.last = b.src where b.dst not in (n0, n1))"""


@query(_e(SUPPLY, _PATH2 + " select anchor, nodes, rels, covered::bigint as covered from p2"))
def layer_coverage(spark, d):
    steps = G.both_ways(G.clean(testkg.edges(spark, d, SUPPLY)))
    p = W.hop(W.hop(W.start(_anchors(spark, d)), steps, node_simple=True), steps, node_simple=True)
    return p.select("anchor", *_join("nodes", "rels"), X.coverage(F.col("rels"), LAYERS).alias("covered"))


@query(_e(SUPPLY, _PATH2 + " select anchor, nodes, bit_count(covered::bigint)::int as n_covered, case when covered >= 2 then 1 when covered = 1 then 0 else -1 end as last_covered, -2 as near from p2"))
def causal_tier(spark, d):
    steps = G.both_ways(G.clean(testkg.edges(spark, d, SUPPLY)))
    p = W.hop(W.hop(W.start(_anchors(spark, d)), steps, node_simple=True), steps, node_simple=True)
    tier = X.causal_tier(X.coverage(F.col("rels"), LAYERS), F.size("edges"))
    return p.select("anchor", *_join("nodes"), tier["covered"].alias("n_covered"), tier["last"].alias("last_covered"), tier["near"].alias("near"))


_MODE = """, a as (select distinct src as anchor from bi where src like 'region:%'),
s1 as (select anchor, dst as n1, edge as e1 from a join bi on src = anchor where r = 'geo.nation.region'),
h1 as (select s1.*, dst as n2, edge as e2, r as r2 from s1 join bi on src = n1 where r = 'org.supplier.nation' and edge <> e1),
m as (select s1.*, dst as m, edge as em, r as rm from s1 join bi on src = n1 where r <> 'org.supplier.nation' and edge <> e1),
h2 as (select m.*, dst as n2, edge as e2 from m join bi on src = m where r = 'org.supplier.nation' and edge not in (e1, em)),
z as (select * from s1 where not exists (select 1 from h1 where h1.anchor = s1.anchor and h1.e1 = s1.e1) and not exists (select 1 from h2 where h2.anchor = s1.anchor and h2.e1 = s1.e1)),
w as (select anchor, anchor || '>' || n1 as nodes, 1 as covered, 0 as skipped from s1
  union all select anchor, anchor || '>' || n1 || '>' || n2, 3, 0 from h1
  union all select anchor, anchor || '>' || n1 || '>' || m || '>' || n2, 3, 0 from h2)"""


@query(_e(SUPPLY, _MODE + ", q as (select *, row_number() over (partition by anchor, nodes order by bit_count(covered) desc, skipped) as k from w) select anchor, nodes, covered::bigint as covered from q where k = 1"))
def mode_walk(spark, d):
    return W.mode_walk(_anchors(spark, d), testkg.edges(spark, d, SUPPLY), LAYERS, cap=100_000).select("anchor", *_join("nodes"), "covered")


_SKIP = [["geo.nation.region"], ["product.part.brand"], ["org.supplier.nation"]]


@query(_e(SUPPLY, _MODE + """, v as (select anchor, anchor || '>' || n1 as nodes, 1 as covered, 2 as skipped from s1
  union all select anchor, anchor || '>' || n1 || '>' || n2, 5, 2 from h1), u as (select anchor, nodes, 1 as covered, 0 as skipped from w where covered = 1 union all select * from v),
  q as (select *, row_number() over (partition by anchor, nodes order by bit_count(covered) desc, bit_count(skipped)) as k from u) select anchor, nodes, covered::bigint as covered, skipped::bigint as skipped from q where k = 1"""))
def mode_walk_skip(spark, d):
    return W.mode_walk(_anchors(spark, d), testkg.edges(spark, d, SUPPLY), _SKIP, cap=100_000).select("anchor", *_join("nodes"), "covered", "skipped")


WALK = (*SUPPLY, "sales.order.customer")
_BEAM = 40


def _kq(hops: int, beam: int, most: int, rest: str) -> str:
    """The k-queue unrolled over the layers nation of region, supplier of nation."""
    first, second = "'geo.nation.region'", "'org.supplier.nation'"
    covered = f"(case when list_contains(rels, {first}) then 1 else 0 end + case when list_contains(rels[coalesce(list_position(rels, {first}), 0) + 1:], {second}) then 2 else 0 end)"
    ctes, last = ["f0 as (select distinct src as anchor, [src] as nodes, []::varchar[] as rels, []::varchar[] as edges from bi where src like 'region:%')"], "f0"
    for h in range(1, hops + 1):
        ctes.append(f"g{h} as (select anchor, list_append(nodes, dst) as nodes, list_append(rels, r) as rels, list_append(edges, edge) as edges from {last} join bi on nodes[-1] = src where not list_contains(nodes, dst))")
        ctes.append(f"w{h} as (select *, {covered} as covered from g{h})")
        ctes.append(f"f{h} as (select anchor, nodes, rels, edges from (select *, row_number() over (partition by anchor order by bit_count(covered::bigint) desc, edges) as k from w{h}) where k <= {2 * beam})")
        last = f"f{h}"
    done = " union all ".join(f"select * from w{h} where rels[-1] in ({first}, {second})" for h in range(1, hops + 1))
    ctes.append(f"c as (select anchor, nodes, rels, edges, covered::bigint as covered from ({done}))")
    ctes.append("k as (select *, row_number() over (partition by anchor order by bit_count(covered) = 2 desc, bit_count(covered) desc, covered desc, len(edges), edges) as rank from c)")
    return ", " + ", ".join(ctes) + rest.replace("{most}", str(most))


@query(_e(WALK, _kq(4, _BEAM, 5000, " select anchor, array_to_string(nodes, '>') as nodes, covered, rank::int as rank from k where rank <= {most}")))
def kqueue_paths(spark, d):
    return W.k_queue(_anchors(spark, d), testkg.edges(spark, d, WALK), LAYERS, beam=_BEAM).select("anchor", *_join("nodes"), "covered", "rank")


@query(_e(WALK, _kq(4, _BEAM, 0, """, g as (select *, row_number() over (partition by anchor, nodes[-1], covered order by bit_count(covered) desc, len(edges), edges) as g from k),
  b as (select *, row_number() over (partition by anchor order by g <= 2 desc, bit_count(covered) desc, len(edges), edges) as b from g) select anchor, array_to_string(nodes, '>') as nodes from b where b <= 12""")))
def diversity_beam(spark, d):
    p = W.k_queue(_anchors(spark, d), testkg.edges(spark, d, WALK), LAYERS, beam=_BEAM)
    return W.diversity_beam(p, 12, 2).select("anchor", *_join("nodes"))


@query(_e(SUPPLY, _MODE + """, t as (select anchor, [n1] as n, 1 as covered, 0 as skipped, 1 as depth, ['geo.nation.region'] as term, [e1] as es, n1 as fin from s1),
  t1 as (select * from (select *, row_number() over (partition by anchor order by fin, es) as k from t) where k <= 3),
  u as (select t1.anchor, anchor_nodes.n1, h1.n2, h1.e2 from t1 join (select anchor as a, n1, e1 from s1) anchor_nodes on a = t1.anchor and n1 = t1.fin join h1 on h1.anchor = t1.anchor and h1.n1 = t1.fin),
  v as (select *, row_number() over (partition by anchor order by n2, n1, e2) as k from (select *, row_number() over (partition by anchor, n2 order by n1, e2) as one from u) where one = 1)
  select anchor, anchor || '>' || fin as nodes from t1 union all select anchor, anchor || '>' || n1 || '>' || n2 from v where k <= 3"""))
def mode_walk_capped(spark, d):
    """A cap that cuts: three states of an anchor go on from each layer."""
    return W.mode_walk(_anchors(spark, d), testkg.edges(spark, d, SUPPLY), LAYERS, cap=3).select("anchor", *_join("nodes"))


@query(_e(SUPPLY, _MODE + " select anchor, anchor || '>' || n1 || '>' || n2 as nodes, 3::bigint as covered from h1"))
def prior_expand(spark, d):
    return W.prior_expand(_anchors(spark, d), testkg.edges(spark, d, SUPPLY), LAYERS, limit=100_000).select("anchor", *_join("nodes"), "covered")


@query(_e(SUPPLY, _MODE + ", c as (select *, count(*) over (partition by anchor) as n, row_number() over (partition by anchor order by n1, n2) as k from h1) select anchor, anchor || '>' || n1 || '>' || n2 as nodes, least(n, 10000) as path_count from c where k <= 200"))
def pattern_materialize(spark, d):
    return W.materialize(_anchors(spark, d), G.clean(testkg.edges(spark, d, SUPPLY)), ["geo.nation.region", "org.supplier.nation"]).select("anchor", *_join("nodes"), "path_count")


@query(_e(SUPPLY, _PATH2 + ", x as (select anchor, replace(rels, '>', ' / ') as chain, nodes, covered, edges, unnest(string_split(nodes, '>')[2:]) as name from p2), w as (select anchor, chain, nodes as witness from (select *, row_number() over (partition by anchor, chain order by bit_count(covered::bigint) desc, edges) as k from x) where k = 1) select x.anchor, x.chain, any_value(witness) as witness, count(distinct nodes) as n_paths, string_agg(distinct name, '|' order by name) as candidates from x join w on x.anchor = w.anchor and x.chain = w.chain group by x.anchor, x.chain"))
def pattern_compress(spark, d):
    steps = G.both_ways(G.clean(testkg.edges(spark, d, SUPPLY)))
    p = W.hop(W.hop(W.start(_anchors(spark, d)), steps, node_simple=True), steps, node_simple=True)
    return W.compress(p)


@query(_e(SUPPLY, _PATH2 + ", x as (select distinct anchor, nodes, unnest(string_split(nodes, '>')[2:]) as name from p2) select anchor, name, count(*) as n from x group by anchor, name"))
def pattern_candidates(spark, d):
    steps = G.both_ways(G.clean(testkg.edges(spark, d, SUPPLY)))
    return W.candidate_counts(W.hop(W.hop(W.start(_anchors(spark, d)), steps, node_simple=True), steps, node_simple=True))


@query(_e(SUPPLY, _PATH2 + ", f as (select *, (last in (select 'supplier:' || s_suppkey from supplier where s_acctbal < 0))::int as f from p2), g as (select *, max(f) over (partition by anchor) as m from f) select anchor, nodes from g where f = m"))
def endpoint_prefer(spark, d):
    return ST.prefer_endpoints(_two_hops(spark, d), G.clean(testkg.edges(spark, d, SUPPLY)), _endpoints(spark, d)).select("anchor", *_join("nodes"))


@query(_e(SUPPLY, _PATH2 + ", x as (select anchor, unnest(string_split(nodes, '>')[-2:]) as name from p2) select distinct anchor, name from x where name <> anchor"))
def last_two_candidates(spark, d):
    return ST.last_two_candidates(_two_hops(spark, d))


@query(_e(ITEMS, "select distinct a.h, 'sales.order.item > ' || b.r as r, b.t from edges a join edges b on a.t = b.h where a.r = 'sales.order.item' and b.r = 'sales.item.part'"))
def bridge_triples(spark, d):
    e = testkg.edges(spark, d, ITEMS)
    anchors = e.where("r = 'sales.order.item'").select(F.col("h").alias("anchor")).distinct()
    steps = G.directed(e)
    p = W.hop(W.hop(W.start(anchors), steps, F.col("r") == "sales.order.item"), steps, F.col("r") == "sales.item.part")
    return W.bridge_triples(p)


@query(_e(SUPPLY, _MODE + " select distinct h1.anchor, n2 as target, h1.anchor || '>' || n1 || '>' || n2 as nodes from h1"))
def bidir_meet(spark, d):
    e = testkg.edges(spark, d, SUPPLY)
    steps = G.both_ways(G.clean(e))
    f = W.hop(W.start(_anchors(spark, d)), steps, F.col("r") == "geo.nation.region")
    ends = e.where("r = 'org.supplier.nation'").select(F.col("h").alias("anchor")).distinct()
    return W.meet(f, W.hop(W.start(ends), steps, F.col("r") == "org.supplier.nation")).select("anchor", "target", *_join("nodes"))


@query("with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0), s as (select q.vec_id as query_id, e.vec_id as cand_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 4) as score from q, embeddings e), k as (select *, row_number() over (partition by query_id order by score desc, cand_id) as rank from s) select query_id, cand_id, score, rank::int as rank from k where rank <= 5")
def vector_topk(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return R.vector_topk(q, e.select(F.col("vec_id").alias("cand_id"), "embedding"), 5)


@query("with q as (select vec_id, embedding, label from embeddings where vec_id % 50 = 0), s as (select q.vec_id as query_id, q.label, e.vec_id as cand_id, round(list_dot_product(q.embedding::double[], e.embedding::double[]), 4) as score from q, embeddings e), k as (select *, row_number() over (partition by query_id order by score desc, cand_id) as rank from s) select label, cand_id, max(score) as score from k where rank <= 5 group by label, cand_id")
def multi_query_merge(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    labels = e.select(F.col("vec_id").alias("query_id"), "label")
    return R.merge_queries(vector_topk(spark, d).join(labels, "query_id"), "label")


@query(r"select doc_id, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9%.'' ]+', ' ', 'g'), '\s+', ' ', 'g')) as norm from documents")
def normalize_text(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.normalize(F.trim("text")).alias("norm"))


@query("select doc_id, octet_length(encode(text)) = length(text) as ascii, regexp_matches(text, '[a-zA-Z]') as latin from documents")
def ascii_names(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", X.is_ascii(F.col("text")).alias("ascii"), X.has_latin(F.col("text")).alias("latin"))


@query(r"with p as (select p_partkey, list_distinct(list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')) as a, list_distinct(list_filter(string_split(regexp_replace(lower(p_type), '[^a-z0-9%.'' ]+', ' ', 'g'), ' '), lambda x: x <> '')) as b from part) select p_partkey, round(case when len(b) > 0 then len(list_intersect(list_transform(a, lambda x: regexp_replace(x, '[^a-z0-9%.'']+', '', 'g')), b)) / len(b)::double else 0 end, 6) as overlap from p")
def token_overlap(spark, d):
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.round(X.token_overlap(F.col("p_name"), F.col("p_type")), 6).alias("overlap"))


#: Model output made from rows, one statement for both engines: whole replies, broken ones, none.
_SAID = "case n_nationkey % 4 when 0 then concat('<analysis>on ', n_name, '</analysis><answer>1. Who is ', n_name, '?', chr(10), '2. in', chr(10), 'x. no', chr(10), '3. Where is it</answer>') when 1 then concat('<answer>1. ', n_name, chr(10), '  2.  spaced out  </answer><answer>1. second tag</answer>') when 2 then concat('<answer>1. ', n_name) else concat('no tag ', n_name) end"
_BOXED = "case p_partkey % 6 when 0 then concat('<answer>old</answer> then <answer>\\\\boxed{', p_brand, '} \\\\boxed{', p_name, '}</answer>') when 1 then concat('<answer> ', p_name, ' </answer>') when 2 then concat('<answer>', p_name) when 3 then '<answer>\\\\boxed{None}</answer>' when 4 then concat('<answer>\\\\boxed{', p_name) || '</answer>' else '<answer>There is no answer here</answer>' end"


@query("select n_nationkey, case n_nationkey % 4 when 0 then 'Who is ' || n_name || '?|Where is it' when 1 then n_name || '|spaced out' else '' end as subs, case n_nationkey % 4 when 0 then 'on ' || n_name else '' end as analysis from nation")
def parse_subquestions(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.array_join(X.subquestions(F.expr(_SAID)), "|").alias("subs"), X.analysis(F.expr(_SAID)).alias("analysis"))


@query(r"select p_partkey, case p_partkey % 6 when 0 then p_brand || ' | ' || p_name when 1 then p_name when 2 then null when 3 then 'None' when 4 then '\boxed{' || p_name else 'There is no answer here' end as answer, p_partkey % 6 in (2, 3, 4, 5) as empty, case when p_partkey % 6 in (0, 1) then 'ok' when p_partkey % 6 = 2 then 'incomplete_xml' else 'malformed_content' end as status from part".replace("\\\\", "\\"))
def parse_answer(spark, d):
    raw = F.expr(_BOXED)
    said = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", X.final_answer(raw).alias("answer"), X.answer_status(raw).alias("status"))
    return said.withColumn("empty", X.is_empty_answer(F.col("answer")))


@query("select n_nationkey, case n_nationkey % 3 when 0 then '1:3,1;2:' || n_nationkey when 1 then '7:' else '' end as choices from nation")
def parse_prune(spark, d):
    raw = F.expr("case n_nationkey % 3 when 0 then concat('<selected>step_1: [3, 1]', chr(10), 'step_2: [', n_nationkey, ']</selected>') when 1 then 'step_7: [none]' else 'step_x: [1]' end")
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.array_join(X.step_choices(raw), ";").alias("choices"))


@query("select n_nationkey, case n_nationkey % 4 when 0 then '1=2,3|2=' || n_nationkey when 1 then '1=5' when 2 then '3=1' else '' end as choices from nation")
def parse_relation_json(spark, d):
    raw = F.expr("""case n_nationkey % 4 when 0 then concat('<selected>{"step_1": [2, 3], "step_2": [', n_nationkey, '], "note": [9]}</selected>') when 1 then "<answer>{'step_1': [5],}</answer>" when 2 then 'step_3: [1]' else '{"step_1": "x"' end""")
    shown = F.transform(X.relation_choices(raw), lambda c: F.concat_ws("=", c["step"].cast("string"), F.array_join(c["numbers"].cast("array<string>"), ",")))
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.array_join(shown, "|").alias("choices"))


@query("select n_nationkey, n_name as subject, case n_nationkey % 4 when 2 then 'of' else 'in' end as predicate, '?x' as object from nation where n_nationkey % 4 <> 3")
def parse_triples(spark, d):
    raw = F.expr("""case n_nationkey % 4 when 0 then concat('<answer>{"triples": [{"source_subquestion": "q", "subject": "', n_name, '", "predicate": "in", "object": "?x",},]}</answer>') when 1 then concat('{“triples”: [{“subject”: “', n_name, '”, "predicate": "in", "object": "?x"}]}') when 2 then concat("<answer>{'triples': [{'subject': '", n_name, "', 'predicate': 'of', 'object': '?x'}]}</answer>") else concat('nothing of ', n_name) end""")
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", F.explode(X.triples_json(raw)).alias("t")).select("n_nationkey", "t.subject", "t.predicate", "t.object")


@query("with p as (select 's' || (p_size % 5) as step, p_brand as rel, min(p_partkey) as rank from part group by 1, 2), r as (select 's' || (p_size % 5) as step, p_brand as rel, max(p_partkey) as rank from part group by 1, 2), b as (select *, 0 as source from p where rank <= 20 union all select *, 1 from r), f as (select *, row_number() over (partition by step, rel order by source, rank) as f from b), k as (select *, row_number() over (partition by step order by source, rank, rel) as place from f where f = 1) select step, rel, place::int as place from k where place <= 5")
def relation_select(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.concat(F.lit("s"), F.col("p_size") % 5).alias("step"), F.col("p_brand").alias("rel"), "p_partkey").groupBy("step", "rel")
    return R.select_relations(p.agg(F.min("p_partkey").alias("rank")).where("rank <= 20"), p.agg(F.max("p_partkey").alias("rank")), 5)


_N = r"trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9%.'' ]+', ' ', 'g'), '\s+', ' ', 'g'))"
_PG = f"select a.n_nationkey as a, b.r_regionkey as b, {_N.format('a.n_name')} as p, {_N.format('b.r_name')} as g from nation a join region b on true"


@query(f"select a, b, p <> '' and g <> '' and (p = g or contains(p, g) or contains(g, p)) as hit, least(length(p), length(g)) >= 2 and (p = g or (least(length(p), length(g)) >= 4 and (contains(p, g) or contains(g, p)))) as strict from ({_PG})")
def match_hit(spark, d):
    n, r = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/region.parquet")
    both = n.join(F.broadcast(r), F.lit(True))  # 25 x 5 names, fixed by the schema
    return both.select(F.col("n_nationkey").alias("a"), F.col("r_regionkey").alias("b"), R.hits(F.col("n_name"), F.col("r_name")).alias("hit"), R.strict_hits(F.col("n_name"), F.col("r_name")).alias("strict"))


_PRF = f"""with x as (select p_partkey, unnest([0, 1, 2]) as i, unnest([p_brand, p_type, 'zzz never']) as pred, unnest([p_brand, split_part(p_type, ' ', 1), p_name]) as gold from part),
n as (select *, {_N.format('pred')} as p, {_N.format('gold')} as g from x),
h as (select a.p_partkey, a.i as pi, b.i as gi, a.p = b.g or contains(a.p, b.g) or contains(b.g, a.p) as hit from n a join n b on a.p_partkey = b.p_partkey),
c as (select p_partkey, count(distinct pi) filter (hit) as mp, count(distinct gi) filter (hit) as mg from h group by p_partkey)"""


@query(_PRF + " select p_partkey, round(mp / 3.0::double, 6) as precision, round(mg / 3.0::double, 6) as recall, round(case when mp + mg > 0 then 2 * (mp / 3.0::double) * (mg / 3.0::double) / (mp / 3.0::double + mg / 3.0::double) else 0 end, 6) as f1 from c")
def match_prf(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array("p_brand", "p_type", F.lit("zzz never")).alias("pred"), F.array(F.col("p_brand"), F.split("p_type", " ")[0], F.col("p_name")).alias("gold"))
    return R.match_stats(p).select("p_partkey", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


#: Mentions and seeds of the nations' cases that reach every tier, for both engines.
_MENTION = "select n_nationkey as case_id, 0 as pos, case n_nationkey % 5 when 0 then lower(n_name) when 1 then concat('the ', n_name, ' of old') when 2 then 'queen' when 3 then 'zzz' else '?' end as mention from nation"
_SEED = "select n_nationkey as case_id, 0 as pos, case n_nationkey % 5 when 2 then 'queen mother' when 3 then 'Seed Town' else 'nowhere' end as seed from nation"
_ENT = "select n_nationkey as case_id, 0 as ent_id, 'first' as name from nation union all select n_nationkey, 1, n_name from nation union all select n_nationkey, 2, 'Queen Mother' from nation where n_nationkey % 5 <> 2 union all select n_nationkey, 3, 'QUEEN MOTHER!' from nation where n_nationkey % 5 = 2 union all select n_nationkey, 4, 'seed town' from nation where n_nationkey % 10 = 3"


def _sql(spark: SparkSession, d: str, text: str, table: str = "nation") -> DataFrame:
    """SQL over one of the driver's tables, without a view that outlives it."""
    return spark.sql(text.replace(f"from {table}", "from {t}"), t=spark.read.parquet(f"{d}/{table}.parquet"))


@query("select n_nationkey as case_id, case n_nationkey % 5 when 2 then 3 when 3 then case when n_nationkey % 10 = 3 then 4 else 0 end when 4 then 0 else 1 end::int as ent_id, case n_nationkey % 5 when 2 then 'QUEEN MOTHER!' when 3 then case when n_nationkey % 10 = 3 then 'seed town' else 'first' end when 4 then 'first' else n_name end as name, case n_nationkey % 5 when 0 then 1 when 1 then 2 when 2 then 2 when 3 then case when n_nationkey % 10 = 3 then 4 else 5 end else 5 end::int as tier from nation")
def anchor_resolve(spark, d):
    return P.resolve_anchors(_sql(spark, d, _MENTION), _sql(spark, d, _ENT), _sql(spark, d, _SEED))


@query("select c_custkey, c_name, o_orderkey from customer left join (select o_custkey, max(o_orderkey) as o_orderkey from orders group by o_custkey) on c_custkey = o_custkey")
def case_join(spark, d):
    last = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return spark.read.parquet(f"{d}/customer.parquet").join(last, "c_custkey", "left").select("c_custkey", "c_name", "o_orderkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def case_mask(spark, d):
    listed = spark.read.parquet(f"{d}/orders.parquet").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return spark.read.parquet(f"{d}/customer.parquet").join(listed, "c_custkey", "left_anti").select("c_custkey")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, d):
    return event_counts(spark.read.parquet(f"{d}/events.parquet"))


_TWO_HOPS = ", ends as (select 'supplier:' || s_suppkey as e from supplier where s_acctbal < 0), hops as (select anchor, rels, nodes, last, split_part(rels, '>', 1) as r1, split_part(rels, '>', 2) as r2, split_part(nodes, '>', 2) as n1 from p2)"


def _endpoints(spark: SparkSession, d: str) -> DataFrame:
    """(anchor, endpoint): for every region the suppliers in debt."""
    s = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal < 0").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("endpoint"))
    return _anchors(spark, d).join(s, F.lit(True))  # five regions


def _two_hops(spark: SparkSession, d: str) -> DataFrame:
    steps = G.both_ways(G.clean(testkg.edges(spark, d, SUPPLY)))
    return W.hop(W.hop(W.start(_anchors(spark, d)), steps, node_simple=True), steps, node_simple=True)


@query(_e(SUPPLY, _PATH2 + _TWO_HOPS + " select anchor, nodes, anchor || ' --[' || r1 || ']--> node1' || case when n1 in (select e from ends) then '[endpoint]' else '' end || ' --[' || r2 || ']--> node2' || case when last in (select e from ends) then '[endpoint]' else '' end as pattern from hops"))
def readable_patterns(spark, d):
    paths = _two_hops(spark, d).select("anchor", "nodes", "rels", "edges")
    shown = W.with_ends(paths, _endpoints(spark, d), "ends")
    shown = shown.withColumn("pattern", S.readable(F.col("nodes"), F.col("rels"), F.col("ends")))
    return shown.select("anchor", *_join("nodes"), "pattern")


@query(_e(SUPPLY, _PATH2 + _TWO_HOPS + ", t as (select anchor, r1 as r, n1 as t from hops union select anchor, r2, last from hops), p as (select 0 as step, 'geo.nation.region' as r union all select 1, 'org.supplier.nation' union all select 1, 'geo.nation.region') select anchor, step, r, count(distinct t) as n from t join p using (r) where t <> anchor group by anchor, step, r"))
def step_targets(spark, d):
    plan = spark.createDataFrame([(0, "geo.nation.region"), (1, "org.supplier.nation"), (1, "geo.nation.region")], "step int, r string")
    return S.step_targets(_two_hops(spark, d), F.broadcast(plan))  # a question's plan: a few rows


_PATTERNS = "x as (select p_brand as anchor, row_number() over (partition by p_brand order by p_partkey) - 1 as pos, list_slice(string_split(p_type, ' '), 1, 2) as sig from part)"


def _patterns(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_brand").alias("anchor"), (F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1).cast("long").alias("pos"), F.split("p_type", " ").alias("chain"))


def _shortlist(distinct: int, most: int, among: str) -> str:
    return f"with {_PATTERNS}, f as (select *, row_number() over (partition by anchor, sig order by pos) = 1 as fst from x {among}), c as (select *, coalesce(sum(fst::int) over (partition by anchor order by pos rows between unbounded preceding and 1 preceding), 0) as seen from f), k as (select *, row_number() over (partition by anchor order by pos) as k from c where fst or seen < {distinct}) select anchor, pos from k where k <= {most}"


@query(_shortlist(3, 20, ""))
def pattern_shortlist(spark, d):
    return S.shortlist(_patterns(spark, d)).select("anchor", "pos")


@query(_shortlist(4, 5, "where pos < 20"))
def pattern_reselect(spark, d):
    return S.shortlist(_patterns(spark, d), distinct=4, most=5, among=20).select("anchor", "pos")


@query(f"with {_PATTERNS}, p as (select anchor, pos from x where pos = 5 or (pos = 1 and anchor like '%1')), n as (select a.anchor, count(p.pos) as n from (select distinct anchor from x) a left join p using (anchor) group by a.anchor), s as (select x.anchor, x.pos, row_number() over (partition by x.anchor order by x.pos) + n as k from x join n using (anchor) where x.pos < 3 and not exists (select 1 from p where p.anchor = x.anchor and p.pos = x.pos)) select anchor, pos from p union all select anchor, pos from s where k <= 2")
def pattern_minimum(spark, d):
    p = _patterns(spark, d)
    return S.at_least(p.where("pos = 5 or (pos = 1 and anchor like '%1')").select("anchor", "pos"), p)


@query("with r as (select distinct p_size as case_id, (p_partkey % 4)::int as idx, p_brand as rel from part), t as (select distinct case_id, idx, case when case_id % 2 = 0 then [0, 1, 1, 2][idx + 1] else idx end as depth from r), n as (select *, count(*) over (partition by case_id, depth) as n from t), b as (select *, max(n) over (partition by case_id) > 1 as b, dense_rank() over (partition by case_id order by depth) - 1 as k from n) select distinct case_id, case when b then k else idx end::int as step, rel from b join r using (case_id, idx)")
def branch_merge(spark, d):
    rel = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_size").alias("case_id"), (F.col("p_partkey") % 4).cast("int").alias("idx"), F.col("p_brand").alias("rel")).distinct()
    steps = rel.select("case_id", "idx").distinct().withColumn("depth", F.expr("if(case_id % 2 = 0, array(0, 1, 1, 2)[idx], idx)"))
    return S.merge_depths(steps, rel)


@query("with x as (select c_nationkey as case_id, c_custkey as pos, c_mktsegment as name, lower(c_mktsegment) as norm from customer), k as (select *, row_number() over (partition by case_id, norm order by pos) as k from x) select case_id, pos, name from k where k = 1")
def distinct_names(spark, d):
    return S.distinct_names(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_nationkey").alias("case_id"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("name")))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(
        F.col("c_custkey").alias("case_id"), F.concat(F.lit("Who is "), "c_name").alias("question"), F.expr("c_custkey % 2 = 0").alias("gt_hit"), F.expr("c_custkey % 4 = 0").alias("gt_hit_strict"), F.expr("c_custkey % 3 = 0").alias("llm_hit"),
        F.expr("if(c_custkey % 5 = 0, '', concat(c_name, ' | x'))").alias("llm_answer"), F.expr("array(if(c_custkey % 2 = 0, c_name, 'zzz'))").alias("gt_answers"), *(F.expr(f"cast(c_custkey % {m} as double) / {m}").alias(n) for n, m in (("gt_f1", 4), ("llm_precision", 5), ("llm_recall", 8), ("llm_f1", 10))), F.expr("if(c_custkey % 7 = 0, 'timeout', null)").alias("error"))


@query("select count(*) as cases, count(*) filter (c_custkey % 2 = 0) as gt_hits, count(*) filter (c_custkey % 4 = 0) as strict_hits, count(*) filter (c_custkey % 3 = 0) as llm_hits, count(*) filter (c_custkey % 2 = 0 and c_custkey % 5 <> 0) as hit_at_1, count(*) filter (c_custkey % 7 = 0) as errors, round(avg((c_custkey % 4) / 4.0::double), 6) as gt_f1, round(avg((c_custkey % 5) / 5.0::double), 6) as llm_precision, round(avg((c_custkey % 8) / 8.0::double), 6) as llm_recall, round(avg((c_custkey % 10) / 10.0::double), 6) as llm_f1 from customer")
def run_summary(spark, d):
    out = S.run_summary(_cases(spark, d))
    means = ("gt_f1", "llm_precision", "llm_recall", "llm_f1")
    return out.select(*(F.round(c, 6).alias(c) if c in means else c for c in out.columns))


@query("select c_custkey as case_id, 'Q: Who is ' || c_name || chr(10) || 'GT: ' || case when c_custkey % 2 = 0 then c_name else 'zzz' end || chr(10) || 'LLM: ' || case when c_custkey % 5 = 0 then '' else c_name || ' | x' end as trace from customer where not (c_custkey % 2 = 0 and c_custkey % 3 = 0)")
def fail_traces(spark, d):
    return S.fail_traces(_cases(spark, d))


_LINE_PLAN = """concat('Anchor: ', n_name, ' (entity_query: q ', n_name, ')', chr(10), 'Answer_type: person', chr(10), '1. "Who rules?" (type: verify; relation_query: ruler; endpoint: none)', chr(10), '2. Where is it (relation_query: place; endpoint: ', n_name, ' (entity_query: eq))', chr(10), 'noise')"""


@query("select n_nationkey, n_name as anchor, 'q ' || n_name as anchor_query, 'person' as answer_type, 1 as step, 'Who rules?' as question, 'verify' as type, 'ruler' as relation_query, null::varchar as endpoint, null::varchar as endpoint_query from nation union all select n_nationkey, n_name, 'q ' || n_name, 'person', 2, 'Where is it', 'find', 'place', n_name, 'eq' from nation")
def parse_plan(spark, d):
    raw = F.expr(_LINE_PLAN)
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", Y.plan_anchor(raw).alias("a"), F.explode(Y.plan_steps(raw)).alias("s"))
    return rows.select("n_nationkey", F.col("a.name").alias("anchor"), F.col("a.query").alias("anchor_query"), "a.answer_type", "s.step", "s.question", "s.type", "s.relation_query", F.col("s.endpoint.name").alias("endpoint"), F.col("s.endpoint.query").alias("endpoint_query"))


_CHAIN = "concat('Reasoning: r', chr(10), 'Chain:', chr(10), n_name, ' -(in)-> node -(ruled by)-> the', chr(10), 'Endpoints: [', n_name, '] at hop 2', chr(10), 'Analysis:', chr(10), '- Keyword: k1', chr(10), '- Definition: d1', chr(10), '- Keyword: k2')"


@query("select n_nationkey, n_name as anchor, 'in:node:k1:d1|ruled by:node:k2:' as hops, n_name || '@2' as endpoints from nation")
def parse_chain(spark, d):
    rows = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", Y.chain(F.expr(_CHAIN)).alias("c"))
    hops = F.transform("c.hops", lambda h: F.concat_ws(":", h["relation"], h["endpoint"], h["keyword"], h["definition"]))
    ends = F.transform("c.endpoints", lambda e: F.concat_ws("@", e["entity"], e["hop"].cast("string")))
    return rows.select("n_nationkey", F.col("c.anchor").alias("anchor"), F.array_join(hops, "|").alias("hops"), F.array_join(ends, "|").alias("endpoints"))


from pathloom.plans import stage_catalog  # noqa: E402, F401  its queries register themselves here
