"""Operator 9, mixing sources to target weights: Efraimidis-Spirakis sampling, native.

Each document gets the key -ln(u) / w, u a reproducible hash of its id and w its
quality weight; sorting a source by key draws documents without replacement with
chances in proportion to w.  A source whose target is e complete sizes and a rest
takes every document e times, then the documents in key order until the rest is full,
the last one in part, so that taken words meet the target to within a word.

The order is never made in one task: ln(key) is cut into ranges, ranges are
summed (map-side partial sums), and prefix sums over the ranges, at most `ranges` rows
a source, tell which lie wholly inside or outside the budget.  Only the one range a
source that the budget cuts is sorted, and the number of ranges follows the row count,
so that range stays small in a hot source too.

Defined results: null text has size 0 and takes 0; a null source is the last source; rows
that repeat a doc_id are ordered by text hash and fill the budget one by one, so they
may differ in taken; all sizes 0 gives targets 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm.shared import columns, kept, small

#: The word pattern.
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds `target` to (source, source_size): weights in turn by source order, the
    excess over `most` sizes reshared by weight.  Resharing until none is above ends
    where targets are min(level * weight, most * size) and sum to share * all; the
    sources sorted by size / weight are capped up to some row, which running sums find.
    One row a source: the only window without a partition."""
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, len(weights)) + 1).cast("int"))
    ranked = sources.withColumn("weight", turn)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("cap", most * F.col("source_size"))
    ranked = ranked.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    # From the first source that is not capped on, none is; its level holds for all that follow.
    level = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return ranked.select("source", "source_size", F.least(F.coalesce(level * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def draw(seed: int, *by: Column) -> Column:
    """A reproducible uniform number in (0, 1): 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *by))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def quality_weight(text: Column, size: Column) -> Column:
    """A document's weight: 1, less its share of symbols, at least 0.1."""
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return F.greatest(F.lit(0.1), 1 - symbols / F.greatest(size, F.lit(1)))


def mix(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weight_col: str | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 9, range_rows: int = 1000) -> DataFrame:
    """Returns doc_id, size, source_size, target, taken (words, repeats counted), epochs
    (complete), source. `weight_col` holds quality weights, such as a classifier's scores (at
    least 0.1 counts; null: that of the text)."""
    docs = columns(docs, doc_id=id_col, source=source_col, text=text_col, **({"given": weight_col} if weight_col else {}))
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long")
    sized = docs.withColumn("size", size)
    own = quality_weight(F.coalesce("text", F.lit("")), F.col("size"))
    sized = sized.withColumn("weight", F.greatest(F.lit(0.1), F.coalesce(F.col("given").cast("double"), own)) if weight_col else own)
    u = draw(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = kept(sized.select("doc_id", "source", "size", (-F.ln(u) / F.col("weight")).alias("key"), F.xxhash64("text").alias("tie")))
    ranges = max(64, rows.count() // range_rows)
    # ln(key) is a shifted ln(exponential), whose density is at most 1/e: a range gets at
    # most 1/ranges of a source's rows whatever their weights; equal keys share a range.
    rows = rows.withColumn("part", F.floor(F.ln("key") * (ranges * 0.368)).cast("long"))
    parts = kept(rows.groupBy("source", "part").agg(F.sum("size").alias("part_size")))
    goals = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, most)
    inside = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part_size").over(inside), F.lit(0)))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goals = goals.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = parts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan.withColumn("extra", F.when(F.col("ahead") + F.col("part_size") <= F.col("rest"), 1).when(F.col("ahead") >= F.col("rest"), 0))
    plan = small(kept(plan.select(F.col("source").alias("s"), F.col("part").alias("p"), "source_size", "target", "epochs", "rest", "ahead", "extra")), 96)
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).drop("s", "p")
    whole = rows.where("extra is not null").select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("extra"))).cast("long").alias("taken"), F.col("epochs").cast("int").alias("epochs"), "source")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where("extra is null").withColumn("ahead", F.col("ahead") + F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("ahead")))
    cut = cut.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + part).cast("long").alias("taken"), F.col("epochs").cast("int").alias("epochs"), "source")
    return whole.unionByName(cut)
