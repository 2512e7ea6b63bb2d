"""Operator 10, quality classifier: nearest-neighbour voting on latent-semantic vectors.

A document's terms are its lower-cased words, hashed to `WORDS` columns, and the shapes of
its text, hashed to `SHAPES`: pairs of word shapes (case, digits, symbols, length) and class
trigrams of characters, which say how a text is written; each kind has unit length.  Term weights (idf) and the truncated SVD that makes latent-semantic
vectors are fitted on a bounded sample of labelled documents: `max_labelled` rows, the
first by a hash of the id.  Those rows' vectors and labels are broadcast; every document
is projected and compared with all of them by exact, blocked cosine products, and its
`k` nearest vote with their similarity as weight; rows as near as the `k`-th all vote, so
that no order of rows decides.

Only labels of the training fold are read (see `train`); language, source and id are
never part of a vector.  Defined results: null and empty texts have no terms and score
the labelled share of ones, as does everything when one label or none is known (0.5 if
there are no labels at all); null labels are ignored; a doc_id labelled or stored more
than once counts once for each pair; repeated documents are scored one by one; of a doc_id stored with several texts the
sample takes them in order of hash, id, label and terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.shared import columns

#: Character classes: small letter, capital, digit, white space, newline, then each ASCII symbol by itself.
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = 1
_CLASS[0x80:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_CLASS[10] = 5
for _i, _ch in enumerate(x for x in range(33, 127) if not chr(x).isalnum()):
    _CLASS[_ch] = 6 + _i
SHAPES, WORDS = 1024, 1024
TERMS = SHAPES + WORDS


def terms(c: K.Chunk) -> np.ndarray:
    """A row of term frequencies, scaled by sqrt, for each text of a chunk."""
    kind = _CLASS[c.buf]
    n = len(c)
    text = np.repeat(np.arange(n), c.ends - c.starts)
    code = np.zeros(0, np.int64)
    if len(kind) > 2:
        ok = text[2:] == text[:-2]
        code = ((kind[:-2] * 64 + kind[1:-1]) * 64 + kind[2:])[ok]
        table = (K.mix(np.arange(64**3, dtype=K.U64)) % K.U64(SHAPES // 2)).astype(np.int64)
        code = table[code] + text[2:][ok] * TERMS
    buf = K.LOWER[c.buf]
    ws, we, first = c.spans(~K.SPACE[c.buf])
    shape = (np.minimum(we - ws, 15) * 64 + kind[ws]) * 64 + kind[we - 1] if len(ws) else np.zeros(0, np.int64)
    of = K.owner(first)
    same = of[1:] == of[:-1]
    pair = (K.mix((shape[:-1].astype(K.U64) << K.U64(20)) + shape[1:].astype(K.U64))[same] % K.U64(SHAPES // 2)).astype(np.int64)
    word = (K.SpanHash(K.letters(31)[buf])(ws, we) % K.U64(WORDS)).astype(np.int64) if len(ws) else np.zeros(0, np.int64)
    code = np.concatenate([code, SHAPES // 2 + pair + of[1:][same] * TERMS, SHAPES + word + of * TERMS])
    return np.sqrt(np.bincount(code, minlength=n * TERMS)).reshape(n, TERMS).astype(np.float32)


def weighed(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Terms by idf, shapes and words of unit length each, together of unit length."""
    x = counts * idf
    return unit(np.concatenate([unit(x[:, :SHAPES]), unit(x[:, SHAPES:])], axis=1))


def unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


class Model:
    """idf and SVD from labelled texts; vectors and labels of those texts."""

    def __init__(self, counts: np.ndarray, label: np.ndarray, dims: int, k: int):
        self.k, self.prior = k, float(label.mean()) if len(label) else 0.5
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        known = weighed(counts, self.idf)
        _, vectors = np.linalg.eigh((known.T @ known).astype(np.float64))
        self.basis = np.ascontiguousarray(vectors[:, ::-1][:, :dims]).astype(np.float32)
        # Only the direction that all texts share is left out: it says nothing about any of them.
        self.mean = (known @ self.basis).mean(axis=0) if len(known) else np.zeros(self.basis.shape[1], np.float32)
        self.known = unit(known @ self.basis - self.mean)
        self.label = label.astype(np.float32)

    def score(self, counts: np.ndarray, block: int = 512) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(axis=1))
        if not len(self.label) or self.label.min() == self.label.max():
            return out
        k = min(self.k, len(self.label))
        for lo in range(0, len(some), block):
            rows = some[lo : lo + block]
            near = np.round(unit(weighed(counts[rows], self.idf) @ self.basis - self.mean) @ self.known.T, 5)
            least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
            weight = np.where(near >= least, np.maximum(near, 1e-6) ** 4, 0)
            out[rows] = (weight @ self.label) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text falls in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "quality", max_labelled: int = 4000, dims: int = 48, k: int = 25, threshold: float = 0.3) -> DataFrame:
    """Returns doc_id, held_out, score, predicted."""
    docs = columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    train = columns(labels, doc_id=label_id_col, label=label_col).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    sample = F.broadcast(train.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled))  # max_labelled rows of two numbers
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in K.chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.lo, len(c)), b.column("label").slice(c.lo, len(c)), pa.array([x.astype(np.float32).tobytes() for x in terms(c)], pa.binary())], ["doc_id", "label", "terms"])

    rows = docs.join(sample, "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "text").mapInArrow(count, f"doc_id {kind}, label int, terms binary")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "label", "terms").limit(max_labelled).collect()  # 8 KB each
    rows.sort(key=lambda r: (r[0], r[1], r[2]))
    counts = np.frombuffer(b"".join(bytes(r[2]) for r in rows), np.float32).reshape(-1, TERMS)
    sent = docs.sparkSession.sparkContext.broadcast(Model(counts, np.array([r[1] for r in rows], np.float64), dims, k))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = sent.value
        for b in batches:
            for c in K.chunks(b.column("text"), 1 << 19):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(c.lo, len(c)), b.column("held_out").slice(c.lo, len(c)), pa.array(model.score(terms(c)))], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
