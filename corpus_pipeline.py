"""The corpus pipeline: quality rules, line dedup, near duplicates, benchmark
decontamination, mixing. Each stage takes (spark, docs, sf_dir), works on all documents its
predecessor kept, and all but the last return the columns of documents.

Defined results of all stages: null texts count as empty (quality rules reject them); null
sources are a source, null ids are ids like others but come last; repeated rows are rows of
their own except in the near duplicates, where one of them stays; an empty table gives an
empty result; other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.decontaminate import decontaminate
from pathloom.llm.jaccard_join import jaccard_join, text_node
from pathloom.llm.line_rules import line_dedup, quality_rules
from pathloom.llm.mixing import mix
from pathloom.llm.shared import kept, shared_dir, small

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(df: DataFrame, **changed) -> DataFrame:
    return df.select(*(changed.get(c, F.col(f"row.{c}")).alias(c) for c in COLUMNS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are depleted go. Copies come as far as the
    near duplicates: equal texts count as one document."""
    return _rows(quality_rules(docs.select(*COLUMNS), carry=True, distinct=True).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go from the texts; n_chars follows."""
    left = line_dedup(docs.select(*COLUMNS), carry=True, distinct=True)
    same = F.col("n_dropped") == 0
    return _rows(left, text=F.when(same, F.col("row.text")).otherwise(F.col("text")), n_chars=F.when(same, F.col("row.n_chars")).otherwise(F.length("text").cast("long")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that of the least id, then of the least text hash; null ids
    come last. Rows are told apart by id and text, so an id stored with several texts, or no
    id, keeps no other row alive; of rows equal in both one stays."""
    docs = docs.select(*COLUMNS)
    found = jaccard_join(docs).groupBy("cls", "doc_id", "node").agg(F.count("*").alias("same"))
    first = found.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node", "same")).alias("x"))
    stay = kept(first.select(F.col("x.doc_id").alias("_id"), F.col("x.node").alias("_node"), F.col("x.same").alias("_same")))
    stay = small(stay, 48)
    rows = docs.withColumn("node", text_node("text")).join(stay, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    once = rows.where("_same = 1").select(*COLUMNS)
    return once.unionByName(rows.where("_same > 1").dropDuplicates(["doc_id", "node"]).select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _rows(decontaminate(docs.select(*COLUMNS), tests, carry=True).where("not contaminated"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    return mix(docs.select(*COLUMNS)).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontaminate", benchmark), ("mixing", mixing)]

#: Chosen paths and near-duplicate classes are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder as Parquet and read again."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
