"""Edges as a stream: micro-batches appended, windowed counts with a watermark, and hop results
kept up to date by delta joins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pathloom.operators.graph import both_ways

EDGE, PATH = "h string, r string, t string", "nodes array<string>, edges array<string>"


def event_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling window; works on streams and tables."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    return seen.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def ingest_edges(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """JSON lines of (h, r, t) appended to Parquet, once each by the checkpoint."""
    rows = spark.readStream.schema("h string, r string, t string").json(path)
    return rows.where("h is not null and r is not null and t is not null").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def walks(steps: list[DataFrame]) -> DataFrame:
    """(nodes, edges) of walks that take an edge of each of `steps` (src, dst, edge) in turn."""
    out = steps[0].select(F.array("src", "dst").alias("nodes"), F.array("edge").alias("edges"))
    for step in steps[1:]:
        met = out.join(step, F.element_at("nodes", -1) == F.col("src"))
        out = met.select(F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("edge")).alias("edges"))
    return out


def new_walks(old: DataFrame, new: DataFrame, layers: list[list[str]]) -> DataFrame:
    """The walks along `layers` that `new` edges make possible beside `old` ones: for each layer,
    those whose first new edge is of it (older ones before it, any after it). Each new walk is
    found once, and old edges meet only what leads to or from a new one."""
    before, fresh = both_ways(old), both_ways(new)
    both = before.unionByName(fresh)

    def of(steps: DataFrame, layer: list[str]) -> DataFrame:
        return steps.where(F.col("r").isin(*layer)).select("src", "dst", "edge")

    out = None
    for i in range(len(layers)):
        steps = [of(before if k < i else fresh if k == i else both, layer) for k, layer in enumerate(layers)]
        # From the new edge outwards, so that it prunes both sides.
        ahead = walks(steps[i:])
        if i:
            back = walks([s.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge") for s in reversed(steps[:i])])
            back = back.select(F.reverse("nodes").alias("_n"), F.reverse("edges").alias("_e"), F.element_at("nodes", 1).alias("_end"))
            near = back.join(ahead.select(F.element_at("nodes", 1).alias("_end")).distinct(), "_end", "left_semi")
            ahead = ahead.withColumn("_end", F.element_at("nodes", 1)).join(near, "_end").select(F.concat("_n", F.slice("nodes", 2, 1 << 30)).alias("nodes"), F.concat("_e", "edges").alias("edges"))
        out = ahead if out is None else out.unionByName(ahead)
    return out


class WalkView:
    """All walks along some layers over a growing graph, in two folders of parts by micro-batch.
    A batch that is played again after a failure writes its own parts anew, from the parts of
    earlier batches only."""

    def __init__(self, spark: SparkSession, out: str, layers: list[list[str]]):
        self.spark, self.out, self.layers = spark, out.rstrip("/"), layers

    def _parts(self, name: str, schema: str, before: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.out}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            rows = self.spark.createDataFrame([], f"{schema}, batch long")
        return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")

    def edges(self) -> DataFrame:
        return self._parts("edges", EDGE)

    def walks(self) -> DataFrame:
        return self._parts("walks", PATH)

    def apply(self, batch: DataFrame, number: int) -> None:
        """One micro-batch of edges: those not seen before, and the walks they add."""
        old = self._parts("edges", EDGE, number)
        rows = batch.select("h", "r", "t").where("h is not null and r is not null and t is not null").distinct()
        rows.join(old, ["h", "r", "t"], "left_anti").write.mode("overwrite").parquet(f"{self.out}/edges/batch={number}")
        new = self.spark.read.schema(EDGE).parquet(f"{self.out}/edges/batch={number}")
        new_walks(old, new, self.layers).write.mode("overwrite").parquet(f"{self.out}/walks/batch={number}")

    def follow(self, path: str, checkpoint: str) -> StreamingQuery:
        """Edges of JSON lines in a folder, batch after batch, until none is left."""
        rows = self.spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 1).json(path)
        return rows.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
