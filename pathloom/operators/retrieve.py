"""Vector retrieval, relation selection, plans and matching."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import normalize

#: Queries and candidates that meet in one task, and scores of them held at once (8 bytes each).
QUERY_BLOCK, CANDIDATE_BLOCK, SCORES = 4096, 1 << 14, 1 << 21


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(queries: np.ndarray, candidates: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of the k (one a query) best of each query by score rounded to 4
    digits, equal ones in order of candidates. Scores are made for a few queries at a time, and
    only those that reach the worst one taken are sorted."""
    step, n, found = max(1, SCORES // max(len(candidates), 1)), len(candidates), []
    for i in range(0, len(queries), step):
        score = np.round(queries[i : i + step] @ candidates.T, 4)
        most = min(max(int(k[i : i + step].max()), 0), n)
        if not most:
            continue
        row, col = np.nonzero(score >= np.partition(score, n - most, axis=1)[:, n - most, None])
        value = score[row, col]
        order = np.lexsort((col, -value, row))
        row, col, value = row[order], col[order], value[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        few = place < k[i : i + step][row]
        found.append((row[few] + i, col[few], value[few]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def vector_topk(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Exact top-k of candidates (cand_id, embedding) for a stated set of queries (query_id,
    query), by score rounded to 4 digits, then id. Blocks of queries meet blocks of candidates
    as matrix products; a pair of blocks sends on its k best a query, and those are ranked.
    Both sides are dealt by joins, so nothing is gathered or broadcast, whatever their sizes."""
    qs, cs = -(-queries.count() // QUERY_BLOCK) or 1, -(-candidates.count() // CANDIDATE_BLOCK) or 1
    block = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    q = queries.select("query_id", "query", block("query_id", qs).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(cs - 1))).alias("cb"))
    c = candidates.select("cand_id", "embedding", block("cand_id", cs).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(qs - 1))).alias("qb"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": left.column("query_id").slice(0, 0), "cand_id": right.column("cand_id").slice(0, 0), "score": pa.array([], pa.float64())})
        right = right.sort_by("cand_id")
        row, col, score = _best(_matrix(left.column("query")), _matrix(right.column("embedding")), np.full(left.num_rows, k))
        return pa.table({"query_id": left.column("query_id").take(pa.array(row)), "cand_id": right.column("cand_id").take(pa.array(col)), "score": pa.array(score)})

    kinds = queries.schema["query_id"].dataType.simpleString(), candidates.schema["cand_id"].dataType.simpleString()
    found = q.groupBy("qb", "cb").cogroup(c.groupBy("qb", "cb")).applyInArrow(best, f"query_id {kinds[0]}, cand_id {kinds[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "cand_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk_within(queries: DataFrame, candidates: DataFrame, k: int | Column, group: list[str], query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """Exact top-k of the candidates (group, cand_id, embedding) of a query's own group (group,
    query_id, query), by score rounded to 4 digits, then id; `k` may be a column of the
    queries. A group meets itself only, block by block: large groups are cut into blocks by
    their counted size, a pair of blocks sends on its k best a query, and those are ranked."""
    key = [F.col(g) for g in group]
    q = queries.select(*key, "query_id", "query", (F.lit(k) if isinstance(k, int) else k).cast("int").alias("k"))
    n_q = q.groupBy(*group).agg(F.ceil(F.count("*") / query_block).cast("int").alias("qs"))
    n_c = candidates.groupBy(*group).agg(F.ceil(F.count("*") / candidate_block).cast("int").alias("cs"))
    sizes = n_q.join(n_c, group)

    def blocks(df: DataFrame, own: str, other: str, name: str, a: str, b: str) -> DataFrame:
        return df.join(sizes, group).withColumn(a, F.pmod(F.xxhash64(name), F.col(own)).cast("int")).withColumn(b, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("qs", "cs")

    left, right = blocks(q, "qs", "cs", "query_id", "qb", "cb"), blocks(candidates.select(*key, "cand_id", "embedding"), "cs", "qs", "cand_id", "cb", "qb")
    right = right.select(*(F.col(c).alias(f"r_{c}" if c in (*group, "qb", "cb") else c) for c in right.columns))  # both sides hold columns of `sizes`

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            none = {g: mine.column(g).slice(0, 0) for g in group}
            return pa.table(none | {"query_id": mine.column("query_id").slice(0, 0), "k": mine.column("k").slice(0, 0), "cand_id": theirs.column("cand_id").slice(0, 0), "score": pa.array([], pa.float64())})
        theirs = theirs.sort_by("cand_id")
        row, col, score = _best(_matrix(mine.column("query")), _matrix(theirs.column("embedding")), mine.column("k").to_numpy())
        at = pa.array(row)
        return pa.table({g: mine.column(g).take(at) for g in group} | {"query_id": mine.column("query_id").take(at), "k": mine.column("k").take(at), "cand_id": theirs.column("cand_id").take(pa.array(col)), "score": pa.array(score)})

    kinds = {c: df.schema[c].dataType.simpleString() for df, names in ((queries, [*group, "query_id"]), (candidates, ["cand_id"])) for c in names}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*group, "query_id"]) + f", k int, cand_id {kinds['cand_id']}, score double"
    found = left.groupBy(*group, "qb", "cb").cogroup(right.groupBy(*(f"r_{c}" for c in (*group, "qb", "cb")))).applyInArrow(best, schema)
    order = Window.partitionBy(*group, "query_id").orderBy(F.col("score").desc(), "cand_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).drop("k")


def merge_queries(hits: DataFrame, group: str) -> DataFrame:
    """(group, cand_id, score): the best score of a candidate over the queries of a group."""
    return hits.groupBy(group, "cand_id").agg(F.max("score").alias("score"))


def select_relations(picked: DataFrame, retrieved: DataFrame, k: int) -> DataFrame:
    """Up to k relations a step: the picked ones in order, then retrieved ones, no repeats.
    Both have step, rel, rank."""
    both = picked.withColumn("source", F.lit(0)).unionByName(retrieved.withColumn("source", F.lit(1)))
    first = both.withColumn("f", F.row_number().over(Window.partitionBy("step", "rel").orderBy("source", "rank"))).where("f = 1")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("step").orderBy("source", "rank", "rel"))).where(F.col("place") <= k).select("step", "rel", "place")


def hits(pred: Column, gold: Column) -> Column:
    """Loose hit: equal when normalized, or one contains the other; empty names never hit."""
    p, g = normalize(pred), normalize(gold)
    return (p != "") & (g != "") & ((p == g) | F.contains(p, g) | F.contains(g, p))


def strict_hits(pred: Column, gold: Column) -> Column:
    """As `hits`, with at least four characters in what is contained, two in all."""
    p, g = normalize(pred), normalize(gold)
    return (F.least(F.length(p), F.length(g)) >= 2) & ((p == g) | ((F.least(F.length(p), F.length(g)) >= 4) & (F.contains(p, g) | F.contains(g, p))))


def match_stats(answers: DataFrame) -> DataFrame:
    """precision, recall and f1 of array columns pred and gold."""
    got = F.size(F.filter("pred", lambda p: F.exists("gold", lambda g: hits(p, g))))
    found = F.size(F.filter("gold", lambda g: F.exists("pred", lambda p: hits(p, g))))
    out = answers.withColumn("precision", F.coalesce(F.try_divide(got, F.size("pred")), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide(found, F.size("gold")), F.lit(0.0)))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
