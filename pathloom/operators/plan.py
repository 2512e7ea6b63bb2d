"""Plans of layers as data: a layer is a set of relations that a question expects next.

A walk carries its question's plan in each state, as a map from relation to the bits of the
layers that hold it, so that questions with different plans take the same steps of one Spark plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a state carries of its question's plan.
PLAN = ("masks", "live")


def bit(layer: int | Column) -> Column:
    return F.lit(1 << layer).cast("long") if isinstance(layer, int) else F.call_function("shiftleft", F.lit(1).cast("long"), layer)


def mask(rel: Column) -> Column:
    """The layers of the state's plan that hold a relation."""
    return F.coalesce(F.try_element_at("masks", rel), F.lit(0).cast("long"))


def holds(rel: Column, layer: int | Column) -> Column:
    """Whether a layer of the state's plan holds a relation."""
    return mask(rel).bitwiseAND(bit(layer)) != 0


def has(layer: int) -> Column:
    """Whether the state's plan has the layer, and it isn't empty."""
    return F.col("live").bitwiseAND(bit(layer)) != 0


def is_last(layer: int) -> Column:
    """Whether no layer of the state's plan follows."""
    return F.shiftright("live", layer + 1) == 0


def after(layer: int) -> Column:
    """The next layer of the state's plan, null if none follows."""
    rest = F.shiftright("live", layer + 1)
    low = rest.bitwiseAND(-rest)
    return F.when(rest != 0, F.lit(layer + 1) + F.length(F.bin(low)) - 1)


def covered_in_order(rels: Column, n: int) -> Column:
    """Greedy in-order coverage as a bit mask: each of the plan's `n` layers takes the first
    position at or after the cursor whose relation it holds; a missed one leaves the cursor."""
    known = F.transform(rels, mask)

    def step(state: Column, layer: Column) -> Column:
        here = F.transform(F.slice(known, state["at"], F.greatest(F.size(rels) - state["at"] + 1, F.lit(0))), lambda m: m.bitwiseAND(bit(layer)) != 0)
        found = F.array_position(here, F.lit(True))
        return F.struct(F.when(found > 0, state["mask"].bitwiseOR(bit(layer))).otherwise(state["mask"]).alias("mask"), F.when(found > 0, (state["at"] + found).cast("int")).otherwise(state["at"]).alias("at"))

    begin = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(1).alias("at"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), begin, step, lambda s: s["mask"]) if n else F.lit(0).cast("long")


class Plans:
    """Either one list of layers for all questions, or rows (case_id, layer, rel) with a plan
    for each; `n` layers at most."""

    def __init__(self, n: int, layers: list[list[str]] | None = None, rows: DataFrame | None = None):
        self.n, self.layers, self.rows = n, layers, rows

    @staticmethod
    def same(layers: list[list[str]]) -> Plans:
        return Plans(len(layers), layers=layers)

    @staticmethod
    def of_cases(rows: DataFrame) -> Plans:
        """Layers count from 0, up to 62. Their number is the one thing read here."""
        rows = rows.select("case_id", F.col("layer").cast("int").alias("layer"), "rel").where("rel is not null and layer is not null")
        deepest = rows.agg(F.max("layer")).first()[0]
        return Plans(0 if deepest is None else deepest + 1, rows=rows)

    def attach(self, df: DataFrame) -> DataFrame:
        """`df` with the plan of each row's question; an empty one where it has none."""
        if self.layers is not None:
            masks: dict[str, int] = {}
            for i, layer in enumerate(self.layers):
                for rel in layer:
                    masks[rel] = masks.get(rel, 0) | 1 << i
            pairs = [x for rel, m in masks.items() for x in (F.lit(rel), F.lit(m).cast("long"))]
            live = sum(1 << i for i, layer in enumerate(self.layers) if layer)
            return df.withColumn("masks", F.create_map(*pairs).cast("map<string,bigint>")).withColumn("live", F.lit(live).cast("long"))
        each = self.rows.groupBy("case_id", "rel").agg(F.bit_or(bit(F.col("layer"))).alias("m"))
        own = each.groupBy(F.col("case_id").alias("_plan")).agg(F.map_from_entries(F.collect_list(F.struct("rel", "m"))).alias("masks"), F.bit_or("m").alias("live"))
        none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
        return df.join(own, F.col("case_id") == F.col("_plan"), "left").drop("_plan").withColumn("masks", F.coalesce("masks", none)).withColumn("live", F.coalesce("live", F.lit(0).cast("long")))

    def length(self) -> Column:
        """Layers of a row's plan, empty ones at the end of a plan of its own aside."""
        return F.lit(self.n) if self.layers is not None else F.when(F.col("live") == 0, 0).otherwise(F.length(F.bin("live")))

    def without(self, gone: DataFrame) -> Plans:
        """Plans without some layers' relations: `gone` has (case_id, layer, rel)."""
        return Plans(self.n, rows=self.rows.join(gone.select("case_id", "layer", "rel"), ["case_id", "layer", "rel"], "left_anti"))

    def as_rows(self, cases: DataFrame) -> Plans:
        """The same plans as rows of the cases (case_id)."""
        if self.rows is not None:
            return self
        at = F.array(*(F.struct(F.lit(i).alias("layer"), F.lit(rel).alias("rel")) for i, layer in enumerate(self.layers) for rel in layer))
        return Plans(self.n, rows=cases.select("case_id").distinct().select("case_id", F.explode(at).alias("x")).select("case_id", "x.layer", "x.rel"))


def as_plans(layers: list[list[str]] | Plans) -> Plans:
    return layers if isinstance(layers, Plans) else Plans.same(layers)
