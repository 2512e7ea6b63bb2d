"""Operator 5, benchmark decontamination: a distributed positional inverted index.

The index is partitioned by document, as large search engines do it: each task keeps
the postings (term -> sorted positions) of the training tokens in its own chunk of
documents, and every test phrase is looked up in each chunk's index.  A phrase takes
its rarest term's list first, shifts it by the term's offset to give candidate starts,
and intersects those with the offset-adjusted lists of the next rarer terms until all
terms agree.  No posting is shuffled, so no term, passage or source can make a hot
partition.

The test set is the side that is sent to the tasks, as arrays of about 17 times its text
(8 bytes for each of a word's windows).  Its size is measured; one larger than
`block_bytes` of text, whose arrays hold some 36 MB, is cut into blocks of items, each looked up in a pass of its own,
and the passes' hits are merged by document: id, text (its SHA-256) and, if carried, the
row. Each pass returns every row once, so a group's rows over the passes are its copies.

Defined results: null or empty text has no words and no hits; an item without words
never matches, as do null item texts; items with equal texts each count; repeated
document rows each come back, in one block or several; an empty benchmark leaves all
documents clean.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.shared import carried, columns, head, text_of

#: The word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ on text with A-Z lower-cased.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def tokens(c: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a chunk's words, and the first word of each text."""
    buf = K.LOWER[c.buf]
    lo, hi, first = c.spans(_WORD[buf])
    return K.SpanHash(K.letters(5)[buf])(lo, hi), first


@dataclass
class Phrases:
    """Distinct phrases, padded to `size` terms, and the items that hold each."""

    terms: np.ndarray  # phrases x size, hashes
    length: np.ndarray
    item_of: list[np.ndarray]
    ids: list[str]


def phrases(items: list[tuple], size: int) -> Phrases | None:
    """All `size`-word windows of the items; an item of fewer words is one phrase. About
    8 * size bytes a word, as arrays."""
    ids = [str(i) for i, _ in items]
    parts: list[tuple[np.ndarray, ...]] = []
    for c in K.chunks(pa.array([t for _, t in items], pa.string())):
        word, first = tokens(c)
        start, item = K.windows(first, size)
        n = np.diff(first)
        short = np.flatnonzero((n > 0) & (n < size))
        start, item = np.concatenate([start, first[short]]), np.concatenate([item, short])
        length = np.minimum(n[item], size)
        at = np.minimum(start[:, None] + np.arange(size), max(len(word) - 1, 0))
        terms = np.where(np.arange(size) < length[:, None], word[at] if len(word) else K.U64(0), K.U64(0))
        parts.append((K.SpanHash(word)(start, start + length), terms, length, item + c.lo))
    key, terms, length, item = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, K.U64),) * 4
    if not len(key):
        return None
    order = np.lexsort((item, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    other = new.copy()
    other[1:] |= item[order][1:] != item[order][:-1]
    lists = np.split(item[order][other], np.flatnonzero(new[other])[1:])
    return Phrases(terms[order[new]], length[order[new]], lists, ids)


class Index:
    """Postings of one chunk: positions sorted by term, then by place."""

    def __init__(self, word: np.ndarray, wanted: np.ndarray):
        """`wanted`: the sorted terms worth keeping; other tokens have no postings."""
        term = np.searchsorted(wanted, word)
        term[term == len(wanted)] = 0
        here = np.flatnonzero(wanted[term] == word) if len(wanted) else np.zeros(0, np.int64)
        term = term[here]
        order = np.argsort(term, kind="stable")
        self.place, self.n = here[order], len(word)
        self.count = np.bincount(term, minlength=len(wanted))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.key = term[order] * (self.n + 1) + self.place

    def postings(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of some terms, end to end, and for each posting the index of its term."""
        n = self.count[term]
        of = np.repeat(np.arange(len(term)), n)
        return self.place[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.first[term][of]], of

    def near(self, term: np.ndarray, place: np.ndarray, slop: int) -> np.ndarray:
        """Whether each term has a posting at most `slop` places from the one given."""
        ok = (place >= -slop) & (place < self.n + slop)
        lo, hi = np.maximum(place - slop, 0), np.minimum(place + slop, self.n)
        return ok & (np.searchsorted(self.key, term * (self.n + 1) + hi, "right") > np.searchsorted(self.key, term * (self.n + 1) + lo, "left"))


def match(index: Index, term: np.ndarray, length: np.ndarray, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, start) of every match: exact with slop 0, else each term at most `slop`
    places from where the rarest term puts it. term: phrases x size indices of terms."""
    real = np.arange(term.shape[1]) < length[:, None]
    count = np.where(real, index.count[term], np.iinfo(np.int64).max)
    alive = np.flatnonzero(count.min(axis=1) > 0)
    order = np.argsort(count[alive], axis=1, kind="stable")  # rarest terms first
    of_row = term[alive]
    place, row = index.postings(of_row[np.arange(len(alive)), order[:, 0]])
    start = place - order[row, 0]
    for k in range(1, term.shape[1]):
        off = order[row, k]
        ok = (off >= length[alive][row]) | index.near(of_row[row, off], start + off, slop)
        row, start = row[ok], start[ok]
    return alive[row], start


def _block(docs: DataFrame, held: Phrases | None, slop: int, merge: bool) -> DataFrame:
    kind, names = head(docs)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Phrases | None = sent.value
        if p is not None:
            wanted = np.unique(p.terms[np.arange(p.terms.shape[1]) < p.length[:, None]])
            term = np.minimum(np.searchsorted(wanted, p.terms), len(wanted) - 1)
        for b in batches:
            for c in K.chunks(text_of(b)):
                word, first = tokens(c)
                n_words = np.diff(first)
                hit = np.zeros(len(word), bool)
                items: dict[int, set[int]] = {}
                if p is not None and len(word):
                    which, start = match(Index(word, wanted), term, p.length, slop)
                    stop = start + p.length[which]
                    text = np.searchsorted(first, start, "right") - 1
                    ok = (start >= 0) & (stop <= first[np.minimum(text + 1, len(first) - 1)])
                    which, start, stop, text = which[ok], start[ok], stop[ok], text[ok]
                    if len(which):
                        hit = K.cover(len(word), start, stop)
                        for w, t in set(zip(which.tolist(), text.tolist(), strict=True)):
                            items.setdefault(t, set()).update(p.item_of[w].tolist())
                total = np.concatenate([[0], np.cumsum(hit)])
                n_hit = total[first[1:]] - total[first[:-1]]
                lists = [sorted(p.ids[i] for i in items[t]) if t in items else [] for t in range(len(c))]
                out = [*carried(b, c.lo, len(c)), pa.array(n_words, pa.int64())]
                if merge:
                    raw = c.buf.tobytes()
                    out += [pa.array([hashlib.sha256(raw[lo:hi]).digest() for lo, hi in zip(c.starts, c.ends, strict=True)], pa.binary()), pa.array([(np.flatnonzero(hit[first[t] : first[t + 1]])).tolist() if n_hit[t] else [] for t in range(len(c))], pa.list_(pa.int64())), pa.array(lists, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(out, [*names, "n_words", "text_sha256", "places", "items"])
                else:
                    sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]
                    out += [pa.array(n_hit, pa.int64()), pa.array([len(x) for x in lists], pa.int64()), pa.array(sha), pa.array((n_hit > 0) & (20 * n_hit >= n_words)), pa.array(lists, pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(out, [*names, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])

    if merge:
        return docs.mapInArrow(find, f"{kind}, n_words long, text_sha256 binary, places array<long>, items array<string>")
    return docs.mapInArrow(find, f"{kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, slop: int = 0, block_bytes: int = 2 << 20, carry: bool = False) -> DataFrame:
    """Exact phrase matches (slop 0) or proximity matches of `size`-word test windows.

    Returns doc_id, n_words, n_hit (words inside a match), n_items, items_sha256,
    contaminated (n_hit > 0 and 20 * n_hit >= n_words), items (sorted ids)."""
    docs = columns(docs, carry, doc_id=id_col, text=text_col)
    items = columns(benchmark, item_id=item_col, text=item_text_col).select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for k in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        held = phrases([(r[0], r[1]) for r in own.toLocalIterator()], size)  # at most about block_bytes of text
        parts.append(_block(docs, held, slop, blocks > 1))
    if blocks == 1:
        return parts[0]
    union = parts[0]
    for x in parts[1:]:
        union = union.unionByName(x)
    hits = [F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")]
    merged = union.groupBy(*head(docs)[1], "n_words", "text_sha256").agg(*hits, (F.count("*") / blocks).cast("int").alias("copies"))
    merged = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return merged.select(*head(docs)[1], "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "items")
