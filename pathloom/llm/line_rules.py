"""Line frequency over the documents of a host: operators 6 (line dedup) and 8 (quality rules).

One pass counts, for every host and line, the documents that hold the line: each
Arrow chunk counts on its own first, so a hot host or line reaches the shuffle as one
row a chunk.  Lines above the limit form one list a host.  A line above a ratio r of
its host's documents is one of at most (mean distinct lines a document) / r such
lines, so a list stays short however many documents the host has.  The lists' size is
measured before they are broadcast; beyond the bound the join shuffles.

Defined results: null text is empty; a null host is a host of its own; blank lines are
never counted or dropped; an empty table gives an empty result; other columns are
ignored. A repeated row counts as a document of its own, as in the operators' SQL; with
`distinct`, the rows of a host with equal text count as one document, so that copies of a
document don't make its lines boilerplate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.shared import carried, carried_text, columns, head, kept, small, text_of

_COUNTS = pa.schema([("host", pa.string()), ("line", pa.int64()), ("n", pa.float64())])


def _weighted(docs: DataFrame) -> DataFrame:
    """(host, text, share): the share of a row in its text's one document, 1 / copies."""
    docs = docs.withColumn("key", F.conv(F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 15), 16, 10).cast("long"))
    copies = kept(docs.groupBy("host", "key").agg(F.count("*").alias("copies")).where("copies > 1"))
    copies = small(copies.withColumnsRenamed({"host": "_host", "key": "_key"}), 64)
    return docs.join(copies, F.col("host").eqNullSafe(F.col("_host")) & (F.col("key") == F.col("_key")), "left").select("host", "text", (1 / F.coalesce("copies", F.lit(1))).alias("share"))


def frequent_lines(docs: DataFrame, ratio: float, fold: bool, distinct: bool = False) -> DataFrame:
    """(host, lines): hashes of the lines in two documents or more and in more than ratio *
    documents of the host. `docs` has host and text. With `distinct`, equal texts of a host are
    one document."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = pc.dictionary_encode(b.column("host"), null_encoding="encode")
            host = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for c in K.chunks(b.column("text")):
                of = host[c.lo : c.hi]
                found, *_ = K.lines(c, fold)
                _, before = K.repeats(found.text, found.hash)
                line, by = found.hash[~before], of[found.text[~before]]
                share = b.column("share").to_numpy(zero_copy_only=False)[c.lo : c.hi]
                _, at, place = np.unique(K.mix(line + by.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True)
                n = np.bincount(place, weights=share[found.text[~before]], minlength=len(at))
                docs_of = np.bincount(of, weights=share, minlength=len(names.dictionary))
                seen = np.flatnonzero(docs_of)
                yield K.batch(
                    _COUNTS,
                    host=names.dictionary.take(pa.array(np.concatenate([by[at], seen]))).cast(pa.string()),
                    line=pa.array(np.concatenate([K.signed(line[at]), np.zeros(len(seen), np.int64)]), mask=np.arange(len(at) + len(seen)) >= len(at)),
                    n=np.concatenate([n, docs_of[seen]]),
                )

    text = F.col("text" if "text" in docs.columns else carried_text(docs)).alias("text")
    shares = _weighted(docs.select("host", text)) if distinct else docs.select("host", text, F.lit(1.0).alias("share"))
    # A text's shares add up to 1 for each of its lines, so that the sums are whole but for rounding.
    counted = shares.mapInArrow(count, "host string, line long, n double").groupBy("host", "line").agg(F.round(F.sum("n")).cast("long").alias("n"))
    counted = kept(counted.where((F.col("n") > 1) | F.col("line").isNull()))
    total = counted.where("line is null").select(F.col("host").alias("h"), F.col("n").alias("total"))
    over = counted.where("line is not null").join(total, F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") > ratio * F.col("total"))
    return kept(over.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")))


def with_lists(docs: DataFrame, over: DataFrame) -> DataFrame:
    over = small(over.select(F.col("host").alias("_host"), "lines"), 64, "lines")
    return docs.join(over, F.col("host").eqNullSafe(F.col("_host")), "left").drop("_host")


def _listed(b: pa.RecordBatch, c: K.Chunk, found: K.Lines) -> np.ndarray:
    """Which of the chunk's lines are in the list of their row."""
    lists = b.column("lines").slice(c.lo, len(c))
    n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if not n.sum() or not len(found.text):
        return np.zeros(len(found.text), bool)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(K.U64)
    salt = K.U64(0x9E3779B97F4A7C15)
    known = K.mix(values + np.repeat(np.arange(len(n)), n).astype(K.U64) * salt)
    return np.isin(K.mix(found.hash + found.text.astype(K.U64) * salt), known)


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = 0.1, carry: bool = False, distinct: bool = False) -> DataFrame:
    """Drop the lines that two pages or more, and more than ratio * pages, of the host hold (with
    `distinct`, pages of different text).

    Returns doc_id, text (what is left; lines joined by \\n as before), n_lines (lines
    with a word) and n_dropped (of those)."""
    docs = columns(docs, carry, doc_id=id_col, host=host_col, text=text_col)
    kind, names = head(docs)
    over = frequent_lines(docs, ratio, fold=False, distinct=distinct)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(text_of(b)):
                found, *_ = K.lines(c, False)
                out = _listed(b, c, found)
                size = np.bincount(found.text, minlength=len(c))
                lost = np.bincount(found.text[out], minlength=len(c))
                texts = text_of(b).slice(c.lo, len(c))
                if lost.any():
                    # A dropped line goes with the \n before it, or with the one after if it is its text's first.
                    values, raw = texts.to_pylist(), c.buf.tobytes()
                    for i in np.flatnonzero(lost):
                        gone = {int(x) for x in found.lo[out & (found.text == i)] - c.starts[i]}
                        at, left = 0, []
                        for line in raw[c.starts[i] : c.ends[i]].split(b"\n"):
                            if at not in gone:
                                left.append(line)
                            at += len(line) + 1
                        values[i] = b"\n".join(left).decode()
                    texts = pa.array(values, pa.string())
                yield pa.RecordBatch.from_arrays([*carried(b, c.lo, len(c)), texts, pa.array(size, pa.int64()), pa.array(lost, pa.int64())], [*names, "text", "n_lines", "n_dropped"])

    return with_lists(docs, over).mapInArrow(drop, f"{kind}, text string, n_lines long, n_dropped long")


_SYMBOL = K.flags(b"#*$%&|<>")


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = 0.1, least_left: float = 0.3, carry: bool = False, distinct: bool = False) -> DataFrame:
    """Base counts of each document, and a verdict from cross-document line frequency.

    Lines (A-Z lower-cased, white space collapsed) in two documents or more and in
    more than ratio * documents of the host (with `distinct`, of different text) are removed; a document with less than
    `least_left` of its words outside them is depleted and rejected, as is one that
    fails the base rules. Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_common_words (words on removed lines)."""
    docs = columns(docs, carry, doc_id=id_col, host=host_col, text=text_col)
    kind, names = head(docs)
    over = frequent_lines(docs, ratio, fold=True, distinct=distinct)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(text_of(b)):
                found, ws, we, first, _ = K.lines(c, True)
                exact = K.SpanHash(K.letters(2)[c.buf])
                n_words = np.diff(first)
                chars = c.sums(~K.SPACE[c.buf] & ((c.buf & 0xC0) != 0x80))
                symbols = c.sums(_SYMBOL[c.buf])
                _, before = K.repeats(found.text, exact(found.lo, found.hi))
                dup = np.bincount(found.text[before], minlength=len(c))
                word = exact(ws, we)
                start, text = K.windows(first, 5)
                again, _ = K.repeats(text, K.SpanHash(word)(start, start + 5))
                marked = np.zeros(len(ws) + 1, np.int64)
                np.cumsum(K.cover(len(ws), start[again], start[again] + 5), out=marked[1:])
                repeat = marked[first[1:]] - marked[first[:-1]]
                common = np.bincount(found.text, weights=found.n_words * _listed(b, c, found), minlength=len(c)).astype(np.int64)
                failed = (n_words < 10) | (100 * repeat > 20 * n_words)
                ok = ~failed & (n_words - common >= least_left * n_words)
                yield pa.RecordBatch.from_arrays([*carried(b, c.lo, len(c)), *(pa.array(x) for x in (n_words, chars, symbols, dup, repeat, failed, ok, common))], [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words"])

    return with_lists(docs, over).mapInArrow(judge, f"{kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_common_words long")
