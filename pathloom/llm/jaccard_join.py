"""Operator 4, n-gram Jaccard join: chosen-path similarity join.

Sets are the 5-word shingles of a text (all its words as one shingle if it has fewer).
Two sets share a bucket if they chose the same *path* of sampled tokens: in a run, a set
takes the tokens it has not used yet whose hash, seeded by the run and the path so far, is
below `spread` / (number of those); each token taken extends the path by one step.  A pair
of Braun-Blanquet similarity b (at least its Jaccard similarity) shares about `spread` * b
of them at each step, so a similar pair's paths branch faster than they end, and a
dissimilar pair's die out.  Runs are repeated until a pair at the threshold is missed with
a chance below 1 - `recall`, however deep its paths have to go (see `runs_for`).

Equal texts are one node from the start, so copies cost nothing (a node is the first 60
bits of the text's SHA-256). At each level:

* buckets with one node, or whose nodes are already in one class, are done;
* buckets of at most `small` nodes are compared by brute force, as pairs of ids: by sketches
  (see below), then by whole sets;
* in larger ones every node is compared with the bucket's pivot, its smallest set, which
  links a group of near copies without making its pairs. A set that has used all its tokens
  is such a pivot, and equal to all others that have, so it needs no further step;
* what is then still in several classes splits by the next token if it has more than `limit`
  nodes: sets that share a passage and no more part at once, and nodes of a group of near
  copies meet other pivots, until the group is one class;
* mixed buckets of at most `limit` nodes, and those left after `LEVELS` tokens, are compared
  by brute force: by sketches (the `SKETCH` least hashes of a set), which tell the nodes
  that may have a partner in the bucket, then those nodes by their whole sets, in blocks of about `block` nodes and `block_tokens` shingles, but never two
  blocks of one class: the nodes outside the bucket's largest class meet all, and those of
  that class meet them alone. A block sends on a forest: links that join two of its
  classes, fewer than its nodes, never its pairs.

Sets are compared by 64-bit hashes of their shingles. Classes are connected components of
links. A node is one row with a list of its buckets where its class is looked up; a hot
bucket is counted and given its pivot by partial aggregates, and joins that adaptive
execution can split bring those back.

Links are counted once the classes are known. Similar texts share a class, so all pairs of
a class are compared, each in the one block, or pair of blocks, that holds both; a block
sends on a number a text, never its pairs.

Result: one row a document with its class (the least id in it), its number of links
(different texts similar to its own) and of copies (other documents of equal text).

Defined results: texts without a word are similar to nothing, though equal texts still
share a class; null text is empty, a null id belongs to its text's class and is never
the least; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, exp, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.components import components
from pathloom.llm.shared import columns, kept, small as checked

#: Tokens a path may have. A bucket of all its nodes' shared tokens shrinks slowly in a group of
#: near copies, so more than a few don't pay.
LEVELS = 3


def runs_for(threshold: float, spread: float, recall: float) -> int:
    """Runs until a pair at the threshold shares a path of any depth with chance `recall`:
    shared tokens of a step are Poisson with mean spread * threshold, so the chance that
    its paths end is the least x with x = exp(-spread * threshold * (1 - x))."""
    lost = 0.0
    for _ in range(200):
        lost = exp(-spread * threshold * (1 - lost))
    return max(1, ceil(log(1 - recall) / log(lost)))


def shingles(c: K.Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the first of each text."""
    ws, we, first = c.spans(~K.SPACE[c.buf])
    word = K.SpanHash(K.letters(21)[c.buf])(ws, we)
    by_word = K.SpanHash(word)
    start, text = K.windows(first, size)
    value = by_word(start, start + size)
    n = np.diff(first)
    short = np.flatnonzero((n > 0) & (n < size))
    value = np.concatenate([value, by_word(first[short], first[short + 1])])
    text = np.concatenate([text, short])
    order = np.lexsort((value, text))
    value, text = value[order], text[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[new], text[new]
    return value, np.searchsorted(text, np.arange(len(c) + 1))


def choose(value: np.ndarray, first: np.ndarray, text: np.ndarray, path: np.ndarray, used: np.ndarray, spread: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For paths (of text text[i], with the tokens used[i]): the index of the path, the
    bucket and the token of each step taken."""
    size = np.diff(first)[text]
    limit = (np.minimum(spread / np.maximum(size - used.shape[1], 1), 1 - 2**-53) * 2.0**64).astype(K.U64)
    of = np.repeat(np.arange(len(text)), size)
    own = value[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + first[:-1][text][of]]
    take = K.mix(own ^ K.mix(path)[of]) < limit[of]
    for k in range(used.shape[1]):
        take &= own != used[of, k]
    hit = np.flatnonzero(take)
    return of[hit], K.mix(K.mix(own[hit]) + K.mix(path)[of[hit]]), own[hit]


_ROW = "node long, n int, paths array<struct<bucket:long,used:array<long>>>"
_TYPE = pa.struct([("bucket", pa.int64()), ("used", pa.list_(pa.int64()))])


def _packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and firsts of a column of packed sets."""
    data, at = K.text_column(column)
    return np.frombuffer(np.ascontiguousarray(data[at[0] : at[-1]]), K.U64), (at - at[0]) // 8


def _paths(runs: int, spread: float, size: int):
    """Texts to the paths of the first level of all runs; packed sets with lists of paths to
    those of the next level."""
    roots = K.mix(np.arange(1, runs + 1, dtype=K.U64))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            deeper = "paths" in b.schema.names
            for c in K.chunks(b.column("tokens" if deeper else "text"), 1 << 19):
                if deeper:
                    value, first = _packed(b.column("tokens").slice(c.lo, len(c)))
                    lists = b.column("paths").slice(c.lo, len(c))
                    flat = lists.flatten()
                    path = flat.field(0).to_numpy(zero_copy_only=False).view(K.U64)
                    used = flat.field(1).flatten().to_numpy(zero_copy_only=False).view(K.U64).reshape(len(path), -1)
                    text = np.repeat(np.arange(len(c)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                else:
                    value, first = shingles(c, size)
                    path, text = np.repeat(roots, len(c)), np.tile(np.arange(len(c)), runs)
                    used = np.zeros((len(path), 0), K.U64)
                n = np.diff(first)
                found: list[tuple[np.ndarray, ...]] = []
                ends, lo = np.cumsum(n[text]), 0
                while lo < len(text):  # some million tokens at a time, one path at least
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
                    of, bucket, token = choose(value, first, text[lo:hi], path[lo:hi], used[lo:hi], spread)
                    found.append((text[lo:hi][of], bucket, np.column_stack([used[lo:hi][of], token])))
                    lo = hi
                if not found:
                    continue
                of, bucket, token = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(of, kind="stable")
                count = np.bincount(of, minlength=len(c))
                some = np.flatnonzero(count)
                depth = token.shape[1]
                used_lists = pa.ListArray.from_arrays(pa.array(np.arange(len(of) + 1) * depth, pa.int32()), pa.array(K.signed(token[order].ravel())))
                steps = pa.StructArray.from_arrays([pa.array(K.signed(bucket[order])), used_lists], fields=list(_TYPE))
                paths = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[some])]), pa.int32()), steps)
                yield pa.RecordBatch.from_arrays([b.column("node").slice(c.lo, len(c)).take(pa.array(some)), pa.array(n[some], pa.int32()), paths], ["node", "n", "paths"])

    return step


#: Hashes of a sketch. Of a similar pair's about SKETCH * 0.8 are common; fewer than LEAST of
#: them are a chance of 3 in 100,000.
SKETCH, LEAST = 48, 0.56


def _sets(size: int):
    """Packed sets, and sketches: 32 bits of the least hashes (sets are sorted)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(b.column("text"), 1 << 19):
                value, first = shingles(c, size)
                low = value.astype(np.uint32)
                tokens, sketch = ([x[first[i] : min(first[i + 1], first[i] + most)].tobytes() for i in range(len(c))] for x, most in ((value, 1 << 40), (low, SKETCH)))
                yield pa.RecordBatch.from_arrays([b.column("node").slice(c.lo, len(c)), pa.array(tokens, pa.binary()), pa.array(sketch, pa.binary())], ["node", "tokens", "sketch"])

    return make


def partners(cls: np.ndarray, side: np.ndarray, n: np.ndarray, sketches: list[np.ndarray], threshold: float, across: bool, owned: Callable[[int, int], bool] = lambda i, j: True) -> np.ndarray:
    """Which rows have a row of another class (with `across`, of the other side) that their
    sketches leave possible and that is `owned` here."""
    order = np.argsort(n, kind="stable")
    n, cls, side = n[order], cls[order], side[order]
    width = np.array([len(sketches[k]) for k in order], np.int64)
    first = np.concatenate([[0], np.cumsum(width)])
    token = np.unique(np.concatenate([sketches[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(token.max(initial=0)) + 1, np.uint8)
    out = np.zeros(len(n), bool)
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, n[i] / threshold + 1e-6, "right"))
        j = np.arange(i + 1, stop)
        j = j[(cls[j] != cls[i]) & (not across or side[j] != side[i])]
        if out[i]:
            j = j[~out[j]]
        if not len(j):
            continue
        own = token[first[i] : first[i + 1]]
        mark[own] = 1
        end = np.cumsum(width[j])
        at = np.arange(int(end[-1])) + np.repeat(first[j] - (end - width[j]), width[j])
        both = np.add.reduceat(mark[token[at]], end - width[j], dtype=np.int64)
        mark[own] = 0
        close = j[both >= LEAST * width[i]]
        close = close[[owned(order[i], order[k]) for k in close]] if len(close) else close
        out[close] = True
        out[i] |= bool(len(close))
    back = np.zeros(len(n), bool)
    back[order] = out
    return back


def _possible(threshold: float):
    """The rows of a block, or of two blocks, that have possible partners in it. A pair that
    shares several buckets counts in the least of them alone."""

    def find(table: pa.Table) -> pa.Table:
        cls, side, n, lo, hi = (table.column(k).to_numpy() for k in ("cls", "side", "n", "lo", "hi"))
        buckets = [set(x) for x in table.column("buckets").to_pylist()]
        here = table.column("bucket")[0].as_py()
        ok = partners(cls, side, n, [np.frombuffer(x, np.uint32) for x in table.column("sketch").to_pylist()], threshold, bool(lo[0] != hi[0]), lambda i, j: min(buckets[i] & buckets[j]) == here)
        return table.select(["bucket", "node", "cls", "lo", "hi", "side"]).filter(pa.array(ok))

    return find


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets without repeats."""
    if not len(x) or not len(y):
        return 0.0
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return both / (len(x) + len(y) - both)


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs that their sketches leave possible."""
    for b in batches:
        x, y = ([set(np.frombuffer(v, np.uint32).tolist()) for v in b.column(name).to_pylist()] for name in ("x", "y"))
        yield b.select(["a", "b"]).filter(pa.array([len(p & q) >= LEAST * min(len(p), len(q)) for p, q in zip(x, y, strict=True)], pa.bool_()))


def _verify(threshold: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v, K.U64) for v in b.column(name).to_pylist()] for name in ("x", "y"))
            ok = pa.array([similarity(p, q) >= threshold for p, q in zip(x, y, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(ok)

    return check


def forest(cls: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Pairs of rows at the threshold that join different classes, at most one fewer than
    rows: a pair whose classes an earlier pair has joined is left out. If there are two
    sides, only pairs between them count."""
    n = np.array([len(p) for p in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n, cls, side = n[order], cls[order].copy(), side[order]
    first = np.concatenate([[0], np.cumsum(n)])
    _, token = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    across = len(np.unique(side)) > 1
    mark = np.zeros(int(token.max(initial=0)) + 1, np.uint8)
    out = []
    for i in range(len(n) - 1):
        stop = int(np.searchsorted(n, n[i] / threshold + 1e-6, "right"))
        other = cls[i + 1 : stop] != cls[i]
        if across:
            other &= side[i + 1 : stop] != side[i]
        j = i + 1 + np.flatnonzero(other)
        if not len(j):
            continue
        end = np.cumsum(n[j])
        at = np.arange(int(end[-1])) + np.repeat(first[j] - (end - n[j]), n[j])
        own = token[first[i] : first[i + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[token[at]], end - n[j], dtype=np.int64)
        mark[own] = 0
        for k in j[both / (n[j] + n[i] - both) >= threshold]:
            if cls[k] != cls[i]:
                out.append((int(order[i]), int(order[k])))
                cls[cls == cls[k]] = cls[i]
    return out


def _compare(threshold: float):
    """The links of `forest` within a block or between two blocks of a bucket."""

    def links(table: pa.Table) -> pa.Table:
        cls, side, node = (table.column(k).to_numpy() for k in ("cls", "side", "node"))
        found = np.array(forest(cls, side, [np.frombuffer(p, K.U64) for p in table.column("tokens").to_pylist()], threshold), np.int64).reshape(-1, 2)
        a, b = node[found[:, 0]], node[found[:, 1]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return links


def degrees(cls: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: float, across: bool) -> np.ndarray:
    """For each row, the rows of its class at the threshold; with `across`, of the other side."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((size, cls))
    n, cls, side = size[order], cls[order], side[order]
    first = np.concatenate([[0], np.cumsum(n)])
    token = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    mark = np.zeros(int(token.max(initial=0)) + 1, np.uint8)
    out = np.zeros(len(n), np.int64)
    ends = np.searchsorted(cls, cls, "right")
    for i in range(len(n) - 1):
        j = np.arange(i + 1, i + 1 + int(np.searchsorted(n[i + 1 : ends[i]], n[i] / threshold + 1e-6, "right")))
        if across:
            j = j[side[j] != side[i]]
        own = token[first[i] : first[i + 1]]
        mark[own] = 1
        for part in np.split(j, np.arange(256, len(j), 256)) if len(j) else ():
            end = np.cumsum(n[part])
            at = np.arange(int(end[-1])) + np.repeat(first[part] - (end - n[part]), n[part])
            both = np.add.reduceat(mark[token[at]], end - n[part], dtype=np.int64)
            close = part[both / (n[part] + n[i] - both) >= threshold]
            out[close] += 1
            out[i] += len(close)
        mark[own] = 0
    back = np.empty(len(n), np.int64)
    back[order] = out
    return back


def _count(threshold: float):
    """The degrees within a block or between two blocks of a class."""

    def count(table: pa.Table) -> pa.Table:
        cls, side, lo, hi = (table.column(k).to_numpy() for k in ("cls", "side", "lo", "hi"))
        n = degrees(cls, side, [np.frombuffer(s, K.U64) for s in table.column("tokens").to_pylist()], threshold, bool(lo[0] != hi[0]))
        return pa.table({"node": table.column("node"), "n_links": pa.array(n)}).filter(pa.array(n > 0))

    return count


def text_node(text: str) -> Column:
    """60 bits of a text's SHA-256; null as empty."""
    return F.conv(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 15), 16, 10).cast("long")


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.999, spread: float = 2.0, small: int = 8, limit: int = 8192, block: int = 4096, block_tokens: int = 1 << 21, count_block: int = 512, count_tokens: int = 1 << 19) -> DataFrame:
    """Returns doc_id, class_id, n_links, n_copies, node (its text's hash, `text_node`) and cls
    (the class by the least node of its links, which null ids can't blur)."""
    docs = columns(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.withColumn("node", text_node("text"))
    copies = kept(docs.select("doc_id", "node"))
    nodes = copies.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))

    def sets_of(wanted: DataFrame, row_bytes: int = 40) -> DataFrame:
        """The sets of wanted nodes, with the other columns of `wanted` (one row a node)."""
        few = checked(wanted.withColumnRenamed("node", "w"), row_bytes)
        return sets.join(few, F.col("node") == F.col("w")).drop("w")

    def made(wanted: DataFrame, what: str = "tokens") -> DataFrame:
        return sets_of(kept(wanted.select("node").distinct())).select("node", what)

    def verified(pairs: DataFrame) -> DataFrame:
        for what, check in (("sketch", _near), ("tokens", _verify(threshold))):  # few pairs get past their sketches
            own = made(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")), what)
            both = pairs.join(own.select(F.col("node").alias("b"), F.col(what).alias("y")), "b").join(own.select(F.col("node").alias("a"), F.col(what).alias("x")), "a")
            pairs = kept(both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))
        return pairs

    def fits(n, m):
        return F.least(n, m) / F.greatest(n, m) >= threshold

    rows = kept(docs.select("node", "text").mapInArrow(_paths(runs_for(threshold, spread, recall), spread, size), _ROW).dropDuplicates(["node"]))
    labels: DataFrame | None = None

    def degree_of(labels: DataFrame) -> DataFrame:
        """(d, n_links) of the nodes of classes. The two of a class of two are linked; classes
        of one block share a group with others, as many as about `count_tokens` shingles."""
        placed = kept(labels.join(labels.groupBy("cls").agg(F.count("*").alias("size")), "cls"))
        pairs = placed.where("size = 2").select(F.col("node").alias("d"), F.lit(1).cast("long").alias("n_links"))
        tokens = made(placed.where("size > 2"))
        member = kept(placed.where("size > 2").join(tokens.select("node", (F.octet_length("tokens") / 8).alias("n")), "node"))
        sized = member.groupBy("cls").agg(F.sum("n").alias("tokens"))
        groups = int((member.agg(F.sum("n")).first()[0] or 0) // count_tokens) + 1
        near = member.join(sized, "cls").withColumn("blocks", F.ceil(F.greatest(F.col("size") / count_block, F.col("tokens") / count_tokens)).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        near = near.withColumn("own", F.when(F.col("blocks") > 1, F.col("cls")).otherwise(-1 - F.pmod(F.xxhash64("cls"), F.lit(groups))))  # classes are not negative
        near = near.withColumn("j", F.explode(F.expr("sequence(0, blocks - 1)")))
        near = near.select("own", "node", "cls", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").alias("side"))
        found = near.join(tokens, "node").groupBy("own", "lo", "hi").applyInArrow(_count(threshold), "node long, n_links long")
        return kept(pairs.unionAll(found.groupBy(F.col("node").alias("d")).agg(F.sum("n_links").alias("n_links"))))

    sets: DataFrame | None = None
    for level in range(LEVELS):
        mixed = _mixed(rows, labels)
        if mixed.isEmpty():
            break
        if sets is None:  # no later step needs another node, so the texts are not read again
            wanted = checked(kept(mixed.select(F.col("node").alias("w")).distinct()), 40)
            again = docs.drop("doc_id").join(wanted, F.col("node") == F.col("w"), "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))
            sets = kept(again.mapInArrow(_sets(size), "node long, tokens binary, sketch binary"))
        stats = mixed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("n", "node", "cls")).alias("pivot"))
        live = mixed.join(stats, "bucket")
        # A small bucket's nodes, at most `small` of them, make their pairs in one row.
        pairs_in = F.expr("flatten(transform(members, x -> transform(filter(members, y -> y.node > x.node and y.cls <> x.cls and least(x.n, y.n) / greatest(x.n, y.n) >= t), y -> struct(x.node as a, y.node as b))))")
        few = live.where(F.col("size") <= small).groupBy("bucket").agg(F.collect_list(F.struct("node", "n", "cls")).alias("members")).withColumn("t", F.lit(threshold)).select(F.explode(pairs_in).alias("p")).select("p.a", "p.b")
        large = live.where(F.col("size") > small)
        star = large.where((F.col("cls") != F.col("pivot.cls")) & fits(F.col("n"), F.col("pivot.n"))).select(F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
        links = verified(kept(few.unionByName(star).distinct()))
        # Large buckets that the new links leave in several classes.
        if links.isEmpty():
            mixed = kept(large.drop("size", "pivot"))
        else:
            labels = components(links, labels)
            mixed = _mixed(_by_node(large), labels)
        sized = kept(mixed.groupBy("bucket", "cls").agg(F.struct(F.count("*").alias("n"), F.sum("n").alias("tokens"), "cls").alias("c")).groupBy("bucket").agg(F.max("c").alias("most"), F.sum("c.n").alias("size"), F.sum("c.tokens").alias("tokens")))
        deep = sized.where(F.col("size") > (limit if level < LEVELS - 1 else 1 << 62))

        def blocks(n, tokens):
            return F.ceil(F.greatest(n / block, tokens / block_tokens)).cast("int")

        # Blocks 0 to k - 1 are of the nodes outside the largest class, the next m of that class.
        near = mixed.join(sized.join(deep.select("bucket"), "bucket", "left_anti"), "bucket")
        near = near.withColumn("k", blocks(F.col("size") - F.col("most.n"), F.col("tokens") - F.col("most.tokens"))).withColumn("m", blocks(F.col("most.n"), F.col("most.tokens")))
        own = F.col("cls") == F.col("most.cls")
        near = near.withColumn("i", F.when(own, F.col("k") + F.pmod(F.xxhash64("node"), F.col("m"))).otherwise(F.pmod(F.xxhash64("node"), F.col("k"))).cast("int"))
        near = near.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1 + F.when(own, 0).otherwise(F.col("m")))))
        near = near.select("bucket", "node", "n", "cls", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.col("i").alias("side"))
        lists = near.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))
        near = kept(near.join(sets.select("node", "sketch").join(lists, "node"), "node").groupBy("bucket", "lo", "hi").applyInArrow(_possible(threshold), "bucket long, node long, cls long, lo int, hi int, side int"))
        links = kept(near.join(made(near), "node").groupBy("bucket", "lo", "hi").applyInArrow(_compare(threshold), "a long, b long").distinct())
        if not links.isEmpty():
            labels = components(links, labels)
        if deep.isEmpty():
            break
        again = _by_node(mixed.join(deep.select("bucket"), "bucket"))
        again = kept(again if links.isEmpty() else _by_node(_mixed(again, labels)))
        if again.isEmpty():
            break
        rows = kept(sets.join(again.select(F.col("node").alias("w"), "paths"), F.col("node") == F.col("w")).drop("w").mapInArrow(_paths(0, spread, size), _ROW))
    if labels is None:
        return copies.join(nodes, "node").select("doc_id", F.col("least").alias("class_id"), F.lit(0).cast("long").alias("n_links"), (F.col("copies") - 1).alias("n_copies"), "node", F.col("node").alias("cls"))
    degree = degree_of(labels)
    named = nodes.join(labels.withColumnRenamed("node", "l"), F.col("node") == F.col("l"))
    class_id = named.groupBy("cls").agg(F.min("least").alias("class_id"))
    linked = named.join(class_id, "cls").select("node", "class_id", "cls").join(degree, F.col("node") == F.col("d")).select(F.col("node").alias("k"), "class_id", "n_links", "cls")
    info = nodes.join(linked, F.col("node") == F.col("k"), "left").select(F.col("node").alias("k"), F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (F.col("copies") - 1).alias("n_copies"), F.coalesce("cls", "node").alias("cls"))
    return copies.join(info, F.col("node") == F.col("k")).select("doc_id", "class_id", "n_links", "n_copies", "node", "cls")


def _by_node(rows: DataFrame) -> DataFrame:
    """(node, n, paths) of rows (node, n, bucket, used): one row a node."""
    return rows.groupBy("node", "n").agg(F.collect_list(F.struct("bucket", "used")).alias("paths"))


def _mixed(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, n, cls, bucket, used): the paths of nodes whose buckets hold several classes.
    Classes meet nodes, one row each, before their paths are dealt to buckets."""
    if labels is None:
        placed = nodes.withColumn("cls", F.col("node"))
    else:
        placed = nodes.join(labels.withColumnRenamed("node", "l"), F.col("node") == F.col("l"), "left").select("node", "n", F.coalesce("cls", "node").alias("cls"), "paths")
    dealt = placed.select("node", "n", "cls", F.inline("paths"))
    several = dealt.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi").select("bucket")
    return kept(dealt.join(several, "bucket"))


def brute_force(texts: list[str | None], size: int = 5, threshold: float = 0.8) -> set[tuple[int, int]]:
    """Indices of all similar pairs of texts, for tests."""
    sets = []
    for text in texts:
        words = (text or "").encode().split()
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return {(i, j) for j in range(len(sets)) for i in range(j) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
