"""Where intermediate tables go, and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is known to hold no more bytes than this.
BROADCAST_BYTES = 32 << 20

#: Spark's setting that drops an execution's shuffle files once it has ended: nothing reads
#: the shuffles behind a kept table again.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir, which driver and executors share. A folder of our
    own only in local mode (tests), where they are one machine; an error elsewhere."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="pathloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: lineage ends here,
    so a lost executor costs a read and no recomputation. A checkpoint keeps the size
    estimate of the plan behind it, whose digits double with each join of a loop, so the
    rows come back as a relation of unknown size; adaptive execution measures it."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        rows = df.select("*").checkpoint(eager=True)._jdf  # a new plan, so that it takes the setting
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), spark)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as compressed Parquet and read from there: for
    what is large and read more than once."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, *arrays: str) -> DataFrame:
    """`df` (already kept) with a broadcast hint if its measured size allows one;
    otherwise as it is, for a shuffled join. `arrays` are columns of 8-byte items."""
    size = F.lit(row_bytes)
    for name in arrays:
        size = size + 8 * F.coalesce(F.size(name), F.lit(0))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


#: The text in a carried row, if the input calls it something else than text.
_TEXT = "_operator_text"


def columns(df: DataFrame, carry: bool = False, **names: str) -> DataFrame:
    """Only the named columns, under the operator's own names; other columns of the
    input can't clash with what the operator adds. With `carry`, the whole input row
    comes along in one struct, `row`, so that a filter needs no join to get it back; the
    text travels in there alone (see `text_of`)."""
    text = names.get("text")
    other = [F.col(f"`{text}`").alias(_TEXT)] if text not in (None, "text") else []
    own = [F.col(f"`{source}`").alias(name) for name, source in names.items() if not (carry and name == "text")]
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns), *other)
    return df.select(*own, *[row.alias("row")] * carry)


def carried_text(df: DataFrame) -> str:
    """Where the text of carried rows is."""
    return f"row.`{_TEXT}`" if _TEXT in df.schema["row"].dataType.names else "row.text"


def text_of(b: pa.RecordBatch) -> pa.Array:
    """A batch's texts, whether they are a column or in the carried row."""
    if "text" in b.schema.names:
        return b.column("text")
    row = b.column("row")
    return row.field(_TEXT if row.type.get_field_index(_TEXT) >= 0 else "text")


def carried(b, lo: int, n: int) -> list:
    """The id, and the carried row if there is one, of n rows of a batch."""
    return [b.column(c).slice(lo, n) for c in ("doc_id", "row") if c in b.schema.names]


def head(df: DataFrame) -> tuple[str, list[str]]:
    """The start of a schema, and the names, of what carried() gives."""
    names = [c for c in ("doc_id", "row") if c in df.columns]
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in names), names
