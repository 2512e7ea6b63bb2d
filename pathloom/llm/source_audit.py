"""Operator 13, source divergence audit: how far each source's terms are from the other sources
of its language, over integer-encoded terms.

1. Terms are counted where the texts lie: a task dictionary-encodes the terms of some MB of
   text and leaves one packed row for each language and bucket of terms (a hash of the term),
   with its terms and their counts by source. A hot source, language or term reaches the
   shuffle as one packed row a chunk and bucket.
2. A bucket merges its rows as they stream in. Terms in at least `min_docs` documents of the
   language become one sorted array, the bucket's dictionary; counts are encoded as ids into
   it by searchsorted. Ids follow the UTF-8 order of the terms.
3. With N of each group and V of each language known, every bucket makes dense vectors of its
   ids (bincount for each group), all probabilities, its share of each pair's sum, and the
   `top` terms of each group; ids break ties. Sums and tops of buckets are then merged.

Buckets grow in number with the text, one for `bucket_bytes`, up to `max_buckets` (beyond that
the distinct terms of a bucket grow, far slower than the text); wide languages (many sources)
are handled some terms at a time.

All arithmetic is on integers: floor(10**9 * a / b) by long division in base 1000, exact
while b < 9 * 10**15; sums of a pair stay below (10**9 + V)**2, exact for V < 2 * 10**9.

Defined results: null text, lang and source are ''; an empty table gives an empty result;
ids play no part, so repeated rows and repeated or null ids count as documents of their own;
ties rank by item; a group without terms has all its probabilities from count 0; a language
without kept terms has 0 for each pair; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.shared import columns, kept, small

#: Bytes of terms: letters of ASCII, and all of other characters.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True
CHUNK = 8 << 20
SCALE = 1_000_000_000


def scaled(count: np.ndarray, total: int | np.ndarray) -> np.ndarray:
    """floor(10**9 * count / total) without overflow, for count <= total."""
    out, rest = np.zeros(np.broadcast(count, total).shape, np.int64), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out


def term_array(c: K.Chunk) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased terms of a chunk, and the text of each."""
    inside = _TERM[c.buf]
    lo, hi, first = c.spans(inside)
    at = np.zeros(len(lo) + 1, np.int64)
    np.cumsum(hi - lo, out=at[1:])
    letters = K.LOWER[c.buf[inside]]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lo), [None, pa.py_buffer(at), pa.py_buffer(letters)]), K.owner(first)


_PACKED = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("sources", pa.list_(pa.string())), ("terms", pa.binary()), ("sizes", pa.binary()), ("source", pa.binary()), ("n", pa.binary()), ("docs", pa.binary())])
PACKED = "lang string, bucket int, sources array<string>, terms binary, sizes binary, source binary, n binary, docs binary"


def _sliced(values: pa.Array, at: np.ndarray) -> tuple[bytes, bytes]:
    """Binary values at some places, as one blob and their sizes."""
    taken = values.take(pa.array(at))
    return b"".join(taken.to_pylist()), np.diff(np.frombuffer(taken.buffers()[1], np.int64)[: len(at) + 1]).astype(np.uint32).tobytes()


def _bucket_of(terms: pa.Array, n: int) -> np.ndarray:
    """A hash of each term's bytes, modulo n."""
    at = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset : terms.offset + len(terms) + 1]
    data = terms.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (K.SpanHash(K.letters(13)[buf])(at[:-1], at[1:]) % K.U64(n)).astype(np.int64)


def packed_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows of PACKED; `docs` has lang, source and text. Entries are (term, source), in order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sources = (pc.dictionary_encode(b.column(x)) for x in ("lang", "source"))
            names = sources.dictionary.to_pylist()
            lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (langs, sources))
            for c in K.chunks(b.column("text"), CHUNK):
                terms, text = term_array(c)
                if not len(terms):
                    continue
                coded = pc.dictionary_encode(terms)
                words, n_docs = coded.dictionary, len(c)
                key, n = np.unique(coded.indices.to_numpy().astype(np.int64) * n_docs + text, return_counts=True)
                word, doc = key // n_docs, key % n_docs + c.lo
                spread = _bucket_of(words, buckets)
                # One entry for each language, bucket, term and source, in that order.
                group = (lang_of[doc] * buckets + spread[word]) * len(words) + word
                order = np.lexsort((source_of[doc], group))
                group, source, n = group[order], source_of[doc][order], n[order]
                new = np.ones(len(group), bool)
                new[1:] = (group[1:] != group[:-1]) | (source[1:] != source[:-1])
                at = np.flatnonzero(new)
                total, seen = np.add.reduceat(n, at), np.diff(np.append(at, len(group)))
                group, source = group[at], source[at]
                place = group // len(words)
                cut = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
                for lo, hi in zip(cut, np.append(cut[1:], len(place)), strict=True):
                    there, code = np.unique(source[lo:hi], return_inverse=True)
                    blob, sizes = _sliced(words, group[lo:hi] % len(words))
                    yield pa.RecordBatch.from_pylist([{
                        "lang": langs.dictionary[int(place[lo]) // buckets].as_py(), "bucket": int(place[lo]) % buckets, "sources": [names[i] for i in there],
                        "terms": blob, "sizes": sizes, "source": code.astype(np.uint32).tobytes(), "n": total[lo:hi].astype(np.int64).tobytes(), "docs": seen[lo:hi].astype(np.int64).tobytes(),
                    }], _PACKED)

    return docs.select("lang", "source", "text").mapInArrow(count, PACKED)


def _terms(blob: bytes, sizes: np.ndarray) -> pa.Array:
    at = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at), pa.py_buffer(blob)])


class Merge:
    """Sums of (term, source) entries of one bucket, merged whenever new ones outweigh them."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.parts: list[tuple] = []
        self.weight = self.merged = 0

    def add(self, sources: list[str], blob: bytes, sizes: bytes, source: bytes, n: bytes, docs: bytes) -> None:
        code = np.array([self.names.setdefault(x, len(self.names)) for x in sources], np.int64)
        self.parts.append((_terms(blob, np.frombuffer(sizes, np.uint32)), code[np.frombuffer(source, np.uint32)], np.frombuffer(n, np.int64), np.frombuffer(docs, np.int64)))
        self.weight += len(blob) + len(n)
        if self.weight > max(8 << 20, 2 * self.merged):
            self.shrink()

    def shrink(self) -> None:
        coded = pc.dictionary_encode(pa.concat_arrays([p[0] for p in self.parts]))
        source = np.concatenate([p[1] for p in self.parts])
        key, place = np.unique(coded.indices.to_numpy().astype(np.int64) * len(self.names) + source, return_inverse=True)
        n, docs = (np.zeros(len(key), np.int64) for _ in range(2))
        np.add.at(n, place, np.concatenate([p[2] for p in self.parts]))
        np.add.at(docs, place, np.concatenate([p[3] for p in self.parts]))
        terms = coded.dictionary.take(pa.array(key // len(self.names)))
        self.parts = [(terms, key % len(self.names), n, docs)]
        self.weight = self.merged = terms.nbytes + 24 * len(key)

    def encoded(self, min_docs: int) -> tuple[pa.Array, list[str], np.ndarray, np.ndarray, np.ndarray] | None:
        """(sorted kept terms, sources, source and id and count of each entry)."""
        self.shrink()
        terms, source, n, docs = self.parts[0]
        coded = pc.dictionary_encode(terms)
        word = coded.indices.to_numpy().astype(np.int64)
        in_docs = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(in_docs, word, docs)
        keep = in_docs >= min_docs
        kept_terms = coded.dictionary.filter(pa.array(keep))
        if not len(kept_terms):
            return None
        dictionary = np.array(kept_terms.to_pylist(), object)
        dictionary.sort()
        mine = keep[word]
        ids = np.searchsorted(dictionary, np.array(coded.dictionary.to_pylist() + [b""], object)[:-1])[word[mine]]
        return dictionary, list(self.names), source[mine], ids, n[mine]


_BLOCK = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("v", pa.int64()), ("terms", pa.binary()), ("sizes", pa.binary()), ("sources", pa.list_(pa.string())), ("sums", pa.list_(pa.int64())), ("source", pa.binary()), ("ids", pa.binary()), ("n", pa.binary())])
BLOCK = "lang string, bucket int, v long, terms binary, sizes binary, sources array<string>, sums array<long>, source binary, ids binary, n binary"


def encoded_blocks(packed: DataFrame, partitions: int, min_docs: int) -> DataFrame:
    """A row of BLOCK for each language and bucket with a kept term."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, merge: Merge) -> Iterator[pa.RecordBatch]:
            if found := merge.encoded(min_docs):
                terms, names, source, ids, n = found
                sums = np.zeros(len(names), np.int64)
                np.add.at(sums, source, n)
                row = {"lang": key[0], "bucket": key[1], "v": len(terms), "terms": b"".join(terms), "sizes": np.array([len(t) for t in terms], np.uint32).tobytes(), "sources": names, "sums": sums.tolist(), "source": source.astype(np.uint32).tobytes(), "ids": ids.astype(np.uint32).tobytes(), "n": n.tobytes()}
                yield pa.RecordBatch.from_pylist([row], _BLOCK)

        last, merge = None, Merge()
        for b in batches:
            for r in b.to_pylist():
                if (key := (r["lang"], r["bucket"])) != last:
                    if last is not None:
                        yield from done(last, merge)
                    last, merge = key, Merge()
                merge.add(*(r[x] for x in ("sources", "terms", "sizes", "source", "n", "docs")))
        if last is not None:
            yield from done(last, merge)

    return packed.repartition(partitions, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(encode, BLOCK)


_PART = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])
PART = "lang string, source string, part string, item string, value long"


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def block_parts(row: dict, top: int, cells: int = 2 << 20) -> tuple[np.ndarray, list[tuple[str, bytes, int]]]:
    """Of one block: the sums of all ordered pairs of the language's sources, and each
    source's best terms."""
    groups = [g["source"] for g in row["groups"]]
    total = np.array([g["total"] for g in row["groups"]], np.int64) + row["all_v"]
    code = {g: i for i, g in enumerate(groups)}
    own = np.array([code[x] for x in row["sources"]], np.int64)[np.frombuffer(row["source"], np.uint32)]
    ids, n = np.frombuffer(row["ids"], np.uint32).astype(np.int64), np.frombuffer(row["n"], np.int64)
    size, v = len(groups), row["v"]
    terms = _terms(row["terms"], np.frombuffer(row["sizes"], np.uint32))
    order = np.argsort(ids, kind="stable")
    own, ids, n = own[order], ids[order], n[order]
    pairs = np.zeros((size, size), np.int64)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * size
    width = max(1, cells // size)
    for lo in range(0, v, width):
        hi = min(v, lo + width)
        a, b = np.searchsorted(ids, [lo, hi])
        # bincount adds in float64: exact below 2**53.
        count = np.bincount(own[a:b] * (hi - lo) + ids[a:b] - lo, weights=n[a:b], minlength=size * (hi - lo)).astype(np.int64).reshape(size, hi - lo)
        p = 1 + scaled(count + 1, total[:, None])
        q = 1 + scaled(count.sum(axis=0) + 1, int(row["all_n"]) + row["all_v"])
        for j in range(size):
            pairs[:, j] += divergence(p, p[j]).sum(axis=1)
        for i in range(size):
            here = np.flatnonzero((count[i] > 0) & (p[i] > q))
            value = np.concatenate([best[i][1], divergence(p[i, here], q[here])])
            here = np.concatenate([best[i][0], here + lo])
            first = np.lexsort((here, -value))[:top]
            best[i] = here[first], value[first]
    return pairs, [(groups[i], terms[int(t)].as_py(), int(x)) for i in range(size) for t, x in zip(*best[i], strict=True)]


def source_audit(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = 3, top: int = 200, bucket_bytes: int = 32 << 20, max_buckets: int = 1 << 16) -> DataFrame:
    """Returns lang, source, part ('pair' or 'term'), item, value, rank."""
    docs = columns(docs, lang=lang_col, source=source_col, text=text_col)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in docs.columns))
    spark = docs.sparkSession
    occurring = kept(docs.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")))
    buckets = min(max_buckets, (occurring.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes + 16)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    blocks = kept(encoded_blocks(packed_counts(docs, buckets), partitions, min_docs))

    sums = blocks.select("lang", F.explode(F.arrays_zip("sources", "sums")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.sums").alias("total"))
    groups = occurring.select("lang", "source").join(sums, ["lang", "source"], "left").na.fill(0, ["total"])
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "total"))).alias("groups"), F.sum("total").alias("all_n"))  # as long as a row of the result's pairs
    langs = kept(langs.join(blocks.groupBy("lang").agg(F.sum("v").alias("all_v")), "lang"))
    per_lang = small(langs.withColumn("names", F.transform("groups", lambda g: g["total"])).withColumn("pad", F.transform("groups", lambda g: F.length(g["source"]).cast("long"))), 64, "names", "pad", "names").drop("names", "pad")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, tuple[list[str], np.ndarray]] = {}
        for b in batches:
            for i in range(len(b)):
                row = b.slice(i, 1).to_pylist()[0]
                sums, best = block_parts(row, top)
                names = [g["source"] for g in row["groups"]]
                pairs[row["lang"]] = (names, sums + pairs[row["lang"]][1]) if row["lang"] in pairs else (names, sums)
                yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(best), pa.string()), pa.array([x[0] for x in best], pa.string()), pa.array(["term"] * len(best), pa.string()), pa.array([x[1] for x in best], pa.binary()).cast(pa.string()), pa.array([x[2] for x in best], pa.int64())], schema=_PART)
        for lang, (names, sums) in pairs.items():
            for i, name in enumerate(names):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array([name] * len(names), pa.string()), pa.array(["pair"] * len(names), pa.string()), pa.array(names, pa.string()), pa.array(sums[i])], schema=_PART)

    parts = kept(blocks.join(per_lang, "lang").mapInArrow(score, PART))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = parts.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    found = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = occurring.select("lang", F.col("source").alias("item"))
    pairs = occurring.select("lang", "source").join(other, "lang").where("source <> item").join(found, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(own))
    return pairs.unionByName(terms.select(*pairs.columns))
