"""The graph that the driver's tables hold, and packed question subgraphs as JSON.

Line items are reified facts (`m.li_...`), distinct by order, line, part and supplier; an
edge is the triple itself, so that no global numbering is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: relation, table, head, tail; {} in a name is a column.
EDGES = [
    ("geo.nation.region", "nation", "nation:{n_nationkey}", "region:{n_regionkey}"),
    ("org.supplier.nation", "supplier", "supplier:{s_suppkey}", "nation:{s_nationkey}"),
    ("org.customer.nation", "customer", "customer:{c_custkey}", "nation:{c_nationkey}"),
    ("sales.order.customer", "orders", "order:{o_orderkey}", "customer:{o_custkey}"),
    ("sales.order.item", "lineitem", "order:{l_orderkey}", "m.li_{l_orderkey}_{l_linenumber}_{l_partkey}_{l_suppkey}"),
    ("sales.item.part", "lineitem", "m.li_{l_orderkey}_{l_linenumber}_{l_partkey}_{l_suppkey}", "part:{l_partkey}"),
    ("sales.item.supplier", "lineitem", "m.li_{l_orderkey}_{l_linenumber}_{l_partkey}_{l_suppkey}", "supplier:{l_suppkey}"),
    ("product.part.brand", "part", "part:{p_partkey}", "brand:{p_brand}"),
    ("type.object.type", "nation", "nation:{n_nationkey}", "class:nation"),
    ("common.topic.webpage", "supplier", "supplier:{s_suppkey}", "web:{s_suppkey}"),
]


def _parts(name: str) -> list[tuple[str, bool]]:
    out = []
    for i, piece in enumerate(name.replace("}", "{").split("{")):
        if piece:
            out.append((piece, i % 2 == 1))
    return out


def _column(name: str) -> Column:
    return F.concat(*(F.col(p).cast("string") if is_col else F.lit(p) for p, is_col in _parts(name)))


#: Line items that are made distinct, and then edges, by one task.
PART = 250_000


#: A line item's fact node.
FACT = "m.li_{l_orderkey}_{l_linenumber}_{l_partkey}_{l_suppkey}"


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] | None = None, by_fact: bool = False) -> DataFrame:
    """(h, r, t), distinct. Only the tables of the relations asked for are read, each once,
    however many relations it gives; line items are made distinct before they become edges, in
    as many parts as their number asks for: what a task holds doesn't grow with the table. With
    `by_fact` edges say their fact node (`fact`, null without one) and line items are dealt by
    it, so that what groups them by `fact` needs no further shuffle."""
    tables: dict[str, list[tuple[str, str, str]]] = {}
    for rel, table, h, t in EDGES:
        if relations is None or rel in relations:
            tables.setdefault(table, []).append((rel, h, t))
    out = None
    for table, wanted in tables.items():
        keys = sorted({p for _, h, t in wanted for name in (h, t) for p, is_col in _parts(name) if is_col})
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*keys)
        if table == "lineitem":
            by = [_column(FACT)] if by_fact else keys
            rows = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PART)), *by)
            rows = (rows.withColumn("fact", *by) if by_fact else rows).distinct()
        own = [F.col("fact") if table == "lineitem" else F.lit(None).cast("string").alias("fact")] if by_fact else []
        made = [F.struct(_column(h).alias("h"), F.lit(rel).alias("r"), _column(t).alias("t")) for rel, h, t in wanted]
        part = rows.select(*own, *(made[0][c].alias(c) for c in "hrt")) if len(made) == 1 else rows.select(*own, F.explode(F.array(*made)).alias("e")).select(*["fact"][: len(own)], "e.*")
        if table == "lineitem" and len(keys) < 4:
            part = part.distinct()
        out = part if out is None else out.unionByName(part)
    return out


def edges_sql(relations: tuple[str, ...] | None = None) -> str:
    def sql(name: str) -> str:
        return " || ".join(f"{p}::varchar" if is_col else f"'{p}'" for p, is_col in _parts(name))

    return " union all ".join(f"select {'distinct ' if t == 'lineitem' else ''}{sql(h)} as h, '{r}' as r, {sql(x)} as t from {t}" for r, t, h, x in EDGES if relations is None or r in relations)


SAMPLE = "id string, question_id string, question string, q_entity array<string>, text_entity_list array<string>, non_text_entity_list array<string>, relation_list array<string>, h_id_list array<int>, r_id_list array<int>, t_id_list array<int>, ordinal long"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Packed subgraphs, one JSON object a line; the last of a repeated id wins: by the ordinal
    that the converter gives, which no split of a file changes; without one by file and place."""
    rows = spark.read.schema(SAMPLE).json(path).withColumn("case_id", F.coalesce("id", "question_id"))
    rows = rows.withColumn("place", F.struct(F.coalesce("ordinal", F.lit(-1).cast("long")), F.input_file_name(), F.monotonically_increasing_id()))
    return rows.groupBy("case_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("case_id", "place", "ordinal")]), "place").alias("s")).select("case_id", "s.*")


def hydrate(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (case_id, ent_id, name) and edges (case_id, edge_id, h, r, t) by name; ids
    out of range are '?'."""
    s = samples.withColumn("names", F.concat(F.coalesce("text_entity_list", F.array()), F.coalesce("non_text_entity_list", F.array())))
    entities = s.select("case_id", F.posexplode("names").alias("ent_id", "name"))
    e = s.select("case_id", "names", "relation_list", F.posexplode(F.arrays_zip("h_id_list", "r_id_list", "t_id_list")).alias("edge_id", "e"))

    def name(array: str, at: str) -> Column:
        return F.coalesce(F.try_element_at(array, F.col(at) + 1), F.lit("?"))

    return entities, e.select("case_id", "edge_id", name("names", "e.h_id_list").alias("h"), name("relation_list", "e.r_id_list").alias("r"), name("names", "e.t_id_list").alias("t"))
