"""Questions as tables: readers, the join with their subgraphs, presets, gold anchors and plans
made before."""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.functions.text import normalize


@dataclass(frozen=True)
class Options:
    """What a run may set; the values are those in effect by default."""

    dataset: str = "webqsp"
    relations_per_step: int = 3
    beam: int = 80
    hops_per_step: int = 2
    state_cap: int = 1200
    explosion: int = 50
    batch: int = 500
    temperature: float = 0.3
    top_p: float = 0.8
    allow_one_step: bool = True
    skip_entities: bool = True

    @staticmethod
    def read(given: dict[str, str], **preset) -> Options:
        """Options from text, as in an environment or spark.conf; flags are 1, true, yes or on."""
        out = replace(Options(), **preset)
        for name, raw in given.items():
            now = getattr(out, name, None)
            if now is None:
                continue
            kind = type(now)
            value = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
            out = replace(out, **{name: value})
        return out

    def hot(self) -> Options:
        """For a second try: a wider choice of words."""
        return replace(self, temperature=0.7, top_p=0.9)


#: What a dataset sets beside the defaults.
PRESETS = {"webqsp": {"dataset": "webqsp", "allow_one_step": True}, "cwq": {"dataset": "cwq", "allow_one_step": False}}

QUESTION = "case_id string, question_id string, id string, question string, gt array<string>, ground_truth array<string>, gt_answers array<string>"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, case_id, question, gt) of a JSON array or JSON lines; answers under any of three
    names. Files are read in name order."""
    rows = spark.read.schema(QUESTION).option("multiLine", True).json(path)
    gt = F.coalesce("gt", "ground_truth", "gt_answers", F.array().cast("array<string>"))
    return with_ordinal(rows.select(F.coalesce("case_id", "id", "question_id").alias("case_id"), "question", gt.alias("gt"), F.monotonically_increasing_id().alias("_at")), "_at").drop("_at")


def with_ordinal(rows: DataFrame, *order: str) -> DataFrame:
    """Adds `ordinal`, from 0, without one task that sorts everything: ranges are sorted apart
    and their counts summed."""
    ranged = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"))  # one row a partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_k", within).join(F.broadcast(before), "_p").withColumn("ordinal", F.col("_k") + F.col("_before")).drop("_p", "_k", "_before")


def join_cases(questions: DataFrame, samples: DataFrame, mask: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """The first `limit` questions (ordinal, case_id, question, gt), then without masked ones
    (case_id), with their sample (sample_id, sample_question): by id, else by the question's
    text; questions without a sample go."""
    if limit is not None:
        questions = questions.where(F.col("ordinal") < limit)
    if mask is not None:
        questions = questions.join(mask.select("case_id"), "case_id", "left_anti")
    own = samples.select("sample_id", F.trim("sample_question").alias("sample_question"))
    by_id = questions.join(own.select(F.col("sample_id").alias("case_id"), F.col("sample_id").alias("s1")).distinct(), "case_id", "left")
    by_text = own.groupBy("sample_question").agg(F.min("sample_id").alias("s2"))
    both = by_id.join(by_text, F.trim("question") == F.col("sample_question"), "left").withColumn("sample_id", F.coalesce("s1", "s2"))
    return both.where("sample_id is not null").select("ordinal", "case_id", "question", "gt", "sample_id")


def detect_dataset(samples: DataFrame, first: int = 50, most: int = 30, long: int = 10) -> DataFrame:
    """One row (dataset, n_hash): of the `first` ids (ordinal, id), those whose last part after
    '_' is longer than `long` are hashes; more than `most` of them mean 'cwq', else 'webqsp'."""
    few = samples.where(F.col("ordinal") < first)
    n = F.count_if(F.length(F.element_at(F.split("id", "_"), -1)) > long)
    return few.agg(n.alias("n_hash")).select(F.when(F.col("n_hash") > most, "cwq").otherwise("webqsp").alias("dataset"), "n_hash")


def gold_anchors(cases: DataFrame, gold: DataFrame) -> DataFrame:
    """Cases (case_id, anchor_id, n_entities) with the first gold entity id (case_id, q_ids) in
    place of theirs, where it is one of the case's entities."""
    g = gold.select("case_id", F.get("q_ids", F.lit(0)).alias("g"))
    ok = (F.col("g") >= 0) & (F.col("g") < F.col("n_entities"))
    return cases.join(g, "case_id", "left").withColumn("anchor_id", F.when(ok, F.col("g")).otherwise(F.col("anchor_id"))).drop("g")


def prior_plans(cases: DataFrame, plans: DataFrame, entities: DataFrame) -> DataFrame:
    """(case_id, plan, ent_id, anchor, breakpoints): plans made before (case_id, plan, anchor_name,
    breakpoints map<int,string>) for known cases; the anchor's name found again, equal or else
    one of both contained in the other, case aside, the first entity; breakpoints to entity ids by equal names."""
    p = cases.select("case_id").join(plans, "case_id")
    e = entities.select("case_id", "ent_id", "name", F.lower("name").alias("e"))
    a = F.lower(F.trim("anchor_name"))
    at = p.withColumn("a", a).where("a <> ''").join(e, "case_id").where((F.col("a") == F.col("e")) | F.contains("e", F.col("a")) | ((F.col("e") != "") & F.contains("a", F.col("e"))))
    best = at.groupBy("case_id").agg(F.min(F.struct((F.col("a") != F.col("e")).alias("far"), "ent_id", "name")).alias("x"))
    points = p.select("case_id", F.explode("breakpoints").alias("step", "point")).join(e.groupBy("case_id", "e").agg(F.min("ent_id").alias("id")), "case_id").where(F.lower(F.trim("point")) == F.col("e"))
    points = points.groupBy("case_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("step", "id")))).alias("breakpoints"))
    return p.drop("breakpoints").join(best, "case_id", "left").join(points, "case_id", "left").select("case_id", "plan", "x.ent_id", F.col("x.name").alias("anchor"), "breakpoints")


def seed_names(cases: DataFrame) -> DataFrame:
    """(case_id, pos, seed) of the entities a question names (case_id, q_entity)."""
    return cases.select("case_id", F.posexplode("q_entity").alias("pos", "seed")).where(normalize(F.col("seed")) != "")


class _Plain(pickle.Unpickler):
    """Lists, dicts, numbers and text only."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} is not plain data")


def convert_packed(path: str, out: str, fields: tuple[str, ...]) -> int:
    """One packed list of records on local disk to JSON lines, as a step of its own before Spark
    reads them, numbered in order; anything but plain data is refused. Returns their number."""
    with open(path, "rb") as f:
        records = _Plain(f).load()
    n = 0
    with open(out, "w", encoding="utf-8") as f:
        for record in _records(records):
            f.write(json.dumps({k: record.get(k) for k in fields} | {"ordinal": n}, ensure_ascii=False) + "\n")
            n += 1
    return n


def _records(packed: object) -> Iterator[dict]:
    yield from (packed.values() if isinstance(packed, dict) else packed)  # type: ignore[attr-defined]


def is_hash_id(case_id: Column, long: int = 10) -> Column:
    return F.length(F.element_at(F.split(case_id, "_"), -1)) > long
