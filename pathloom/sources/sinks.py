"""Where results go: JSON lines for rows and full states, text for traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(rows: DataFrame, path: str) -> None:
    """A JSON object a row; nulls stay visible."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_states(states: DataFrame, path: str, sets: tuple[str, ...] = (), patterns: str = "patterns", most: int = 20) -> None:
    """Full states as JSON: columns that are sets in sorted order, the first patterns only."""
    for name in sets:
        states = states.withColumn(name, F.array_sort(name))
    if patterns in states.columns:
        states = states.withColumn(patterns, F.slice(patterns, 1, most))
    write_results(states, path)


def write_traces(traces: DataFrame, path: str) -> None:
    """(case_id, trace) as text, a heading for each case."""
    traces.select(F.concat_ws("\n", F.lit("=" * 70), F.concat(F.lit("Case: "), F.col("case_id").cast("string")), "trace").alias("value")).write.mode("overwrite").text(path)
