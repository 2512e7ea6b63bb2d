"""Operator 1, suffix-array dedup: longest-previous-factor arrays, in buckets.

A byte goes if a string of `size` bytes that covers it also starts earlier, that is if
it lies in [i, i + size) for a position i whose longest previous factor LPF[i] is at
least `size`.  LPF comes from the suffix array: of all earlier positions, the previous
and the next smaller one in suffix order share the longest prefix with i.

One suffix array of the corpus would fit nowhere, and suffixes that share `size` bytes
are all that matters.  So suffixes go to buckets such that any two sharing `size` bytes
meet, and each bucket gets its own suffix array, LCP and LPF:

1. Each position's window of `size` bytes picks the least hash among its k-byte strings
   (a minimiser, leftmost on ties), which depends on the window's bytes alone: equal
   windows pick equal minimisers. Neighbouring windows with the same pick form a *run*,
   and only runs travel: (minimiser, hash of the run's bytes, id, place), about one for
   every 30 bytes of text.
2. Runs of equal bytes have equal suffixes throughout, so all but the first such run
   are covered and need no sorting. Each task settles those inside its own chunks
   before any shuffle (a passage held by a third of all documents reaches the shuffle
   as one run a chunk), the rest after sorting by (minimiser, hash, id, place), in a
   stream that holds one run at a time.
3. Minimisers left with one distinct run have nothing to compare. For the others the
   runs' bytes are cut from the texts, in two: windows with the minimiser in their first
   half hold the bytes after it, the others those before it, so each half goes to the
   bucket of its minimiser and those bytes. A frequent phrase in many surroundings is
   thus spread by its surroundings. There the suffix array, its LCP and the previous and
   next smaller positions within stretches of LCP `size` give LPF.
4. Covered stretches meet the texts by id, merge, and are cut out.

Hashes of runs are two independent 64-bit values; the suffix arrays compare bytes.

Defined results: null text is empty; rows of one id (repeated or not) count as one
document whose texts follow each other in text order, and strings don't cross rows;
rows of null id come first, those of equal text as one document; ids must be integers, another
type raises; texts shorter than `size` lose nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from pathloom.llm import kernels as K
from pathloom.llm.shared import columns

#: place = position << 32 | number of windows; of runs with a minimiser, that number is below
#: 1 << 16 and shares its half with the minimiser's offset in the first window.
_BITS, _HALF = 32, 16


def runs(c: K.Chunk, size: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of a chunk: text, first window, number of windows, minimiser, hash of bytes, and
    the minimiser's offset in the first window."""
    n = len(c.buf)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, none.view(K.U64), none.view(K.U64), none
    grams = n - k + 1
    at = np.arange(n + 1)
    hashes = K.SpanHash(K.letters(11)[c.buf])
    gram = hashes(at[:grams], at[k : k + grams])
    # Strict comparison keeps the leftmost of equal grams.
    width = size - k + 1
    del at
    ranked = gram
    least, arg = ranked, np.arange(grams, dtype=np.int32)
    done = 1

    def join(step: int, least: np.ndarray, arg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = least[step:] < least[:-step]
        return np.where(right, least[step:], least[:-step]), np.where(right, arg[step:], arg[:-step])

    while done * 2 <= width:
        least, arg = join(done, least, arg)
        done *= 2
    if width > done:
        least, arg = join(width - done, least, arg)
    del least, ranked
    windows = len(arg)  # n - size + 1
    count = np.maximum(c.ends - c.starts - size + 1, 0)
    valid = K.cover(windows, np.minimum(c.starts, windows)[count > 0], (c.starts + count)[count > 0])
    new = np.ones(windows, bool)
    new[1:] = (arg[1:] != arg[:-1]) | ~valid[:-1]
    first_of_text = c.starts[count > 0]
    new[first_of_text] = True
    lo = np.flatnonzero(new & valid)
    stop = np.ones(windows, bool)
    stop[:-1] = new[1:] | ~valid[1:]
    hi = np.flatnonzero(stop & valid) + 1
    text = np.searchsorted(c.starts, lo, "right") - 1
    whole = K.SpanHash(K.letters(12)[c.buf])(lo, hi - 1 + size)
    return text, lo - c.starts[text], hi - lo, gram[arg[lo]], whole, arg[lo] - lo


def stretches(text: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows (sorted by text and start), adjoining ones merged."""
    if not len(lo):
        return text, lo, n
    new = np.ones(len(lo), bool)
    new[1:] = (text[1:] != text[:-1]) | (lo[1:] != lo[:-1] + n[:-1])
    first = np.flatnonzero(new)
    return text[first], lo[first], np.add.reduceat(n, first)


def suffix_array(buf: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes starting at `at`, ordered by their first `depth` bytes and then by place,
    and the rank of each (equal if those bytes are). Prefix doubling on 8-byte keys."""
    padded = np.concatenate([buf, np.zeros(depth + 8, np.uint8)])
    wide = np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(buf) + depth]
    key = np.ascontiguousarray(wide).view(">u8").ravel().astype(K.U64)
    rank = np.unique(key, return_inverse=True)[1]
    known = 8
    while known < depth:
        step = min(known, depth - known)
        rank = np.unique(rank[:-step].astype(K.U64) << K.U64(32) | rank[step:].astype(K.U64), return_inverse=True)[1]
        known += step
    own = rank[at]
    return np.argsort(own, kind="stable"), own


def previous_factors(order: np.ndarray, rank: np.ndarray, size: int) -> np.ndarray:
    """LPF of each suffix where it reaches `size`, else 0, from a suffix array of that depth.

    Stretches of the suffix array with LCP `size` hold the suffixes that share so much; a
    suffix has an earlier one among them if its stretch holds a smaller position before it
    (previous smaller) or after it (next smaller): running minima from both ends."""
    n = len(order)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.where(rank[order[1:]] == rank[order[:-1]], size, 0)
    base = np.cumsum(lcp < size) * n  # larger for later stretches, so that minima start anew in each
    previous, following = np.full(n, n), np.full(n, n)
    least = np.minimum.accumulate(order - base) + base
    previous[1:] = np.where(lcp[1:] == size, least[:-1], n)
    least = np.minimum.accumulate((order + base)[::-1])[::-1] - base
    following[:-1] = np.where(lcp[1:] == size, least[1:], n)
    out[order] = np.where((previous < order) | (following < order), size, 0)
    return out


_LETTERS = K.letters(13)
_RUN = "m long, s long, doc long, place long"


def suffix_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 100, k: int | None = None) -> DataFrame:
    """Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of
    (lo, hi) byte ranges removed), kept (remaining bytes)."""
    k = k or max(1, size * 2 // 5)
    if size >= 1 << _HALF:
        raise ValueError(f"size must be below {1 << _HALF}")
    docs = columns(docs, doc_id=id_col, text=text_col)
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("suffix_dedup takes integer ids")
    # Rows without an id: below all ids, apart by their text.
    no_id = F.shiftright(F.xxhash64("text"), 2) - (3 << 61)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc"), "text", F.col("doc_id").isNull().alias("no_id"))
    dealt = docs.repartition("doc")  # three steps read it, through one exchange
    placed = dealt.sortWithinPartitions("doc", "text")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Rows of one id follow each other: where each row's text starts in its document."""
        last, done = None, 0
        for b in batches:
            doc = b.column("doc").to_numpy()
            size_of = np.diff(K.text_column(b.column("text"))[1]) if len(doc) else np.zeros(0, np.int64)
            at = np.zeros(len(doc), np.int64)
            new = np.ones(len(doc), bool)
            new[1:] = doc[1:] != doc[:-1]
            if len(doc):
                total = np.cumsum(size_of) - size_of
                at = total - np.maximum.accumulate(np.where(new, total, 0))
                if last == doc[0]:
                    at[: int(np.argmax(new[1:])) + 1 if new[1:].any() else len(doc)] += done
                last, done = doc[-1], int(at[-1] + size_of[-1])
            yield b, at

    def find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs; those that an earlier run of the chunk covers have a null minimiser."""
        for b, at in offsets(batches):
            doc = b.column("doc").to_numpy()
            for c in K.chunks(b.column("text"), 2 << 20):
                text, lo, n, m, s, off = runs(c, size, k)
                if not len(text):
                    continue
                order = np.lexsort((s, m))  # stable: places stay in order
                again = (m[order][1:] == m[order][:-1]) & (s[order][1:] == s[order][:-1])
                dup = np.zeros(len(text), bool)
                dup[order[1:]] = again
                own = c.lo + text
                a, b_, e = own[~dup], lo[~dup], off[~dup] << _HALF | n[~dup]
                t, l, w = stretches(own[dup], lo[dup], n[dup])
                place = ((np.concatenate([b_, l]) + at[np.concatenate([a, t])]) << _BITS) | np.concatenate([e, w])
                null = np.arange(len(place)) >= len(a)
                pad = np.zeros(len(t), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([K.signed(m[~dup]), pad]), mask=null), pa.array(np.concatenate([K.signed(s[~dup]), pad])), pa.array(doc[np.concatenate([a, t])]), pa.array(place)], ["m", "s", "doc", "place"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From runs sorted by (m, s, doc, place): covered ones with m null; the first ones
        of minimisers with several. One run is held back until its successor is known."""
        held: tuple[int, int, int, int] | None = None  # the only distinct run of its minimiser so far
        last: tuple[int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            null = b.column("m").is_null().to_numpy(zero_copy_only=False)
            m, s, doc, place = (pc.fill_null(x, 0).to_numpy() for x in b.columns)
            same_m = np.zeros(len(m), bool)
            same_m[1:] = (m[1:] == m[:-1]) & ~null[:-1]
            same = np.zeros(len(m), bool)
            same[1:] = same_m[1:] & (s[1:] == s[:-1])
            if last is not None and not null[0]:
                same_m[0] = m[0] == last[0]
                same[0] = same_m[0] and s[0] == last[1]
            live = ~null
            dup = live & same
            place = np.where(dup, place >> _BITS << _BITS | place & ((1 << _HALF) - 1), place)
            rep = np.flatnonzero(live & ~same)
            carry: list[tuple[int, int, int, int]] = []
            if len(rep):
                first = ~same_m[rep]  # the minimiser's first distinct run
                more = np.zeros(len(rep), bool)  # a later distinct run of the same minimiser is in this batch
                more[:-1] = ~first[1:]
                several = ~first | more
                if held is not None and not first[0]:
                    carry.append(held)
                    held = None
                elif held is not None:
                    held = None
                if first[-1]:
                    i = rep[-1]
                    held = (int(m[i]), int(s[i]), int(doc[i]), int(place[i]))
                rep = rep[several]
            out = null | dup
            if live.any():
                i = np.flatnonzero(live)[-1]
                last = (int(m[i]), int(s[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(int(out.sum()), np.int64), m[rep], np.array([x[0] for x in carry], np.int64)]), mask=np.arange(int(out.sum()) + len(rep) + len(carry)) < out.sum())]
                + [pa.array(np.concatenate([x[out], x[rep], np.array([y[i] for y in carry], np.int64)])) for i, x in ((2, doc), (3, place))],
                ["m", "doc", "place"],
            )

    near = (size - k) // 2
    found = placed.mapInArrow(find_runs, _RUN)
    # Covered runs have no bucket to go to and are spread by place.
    by_bucket = found.repartition(F.coalesce("m", F.xxhash64("doc", "place"))).sortWithinPartitions("m", "s", "doc", "place")
    settled = by_bucket.mapInArrow(settle, "m long, doc long, place long")
    # A document's runs are as bounded as its text.
    by_doc = settled.groupBy("doc").agg(F.collect_list(F.struct("m", "place")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the runs that must be compared; covered stretches, merged, without."""
        for b, at in offsets(batches):
            doc = b.column("doc").to_numpy()
            listed = b.column("runs")
            n = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            if not n.sum():
                continue
            flat = listed.flatten()
            covered = flat.field(0).is_null().to_numpy(zero_copy_only=False)
            m, place = pc.fill_null(flat.field(0), 0).to_numpy(), flat.field(1).to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            r, lo, w = row[covered], place[covered] >> _BITS, place[covered] & ((1 << _BITS) - 1)
            order = np.lexsort((lo, r))
            r, lo, w = stretches(r[order], lo[order], w[order])
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(r), pa.int64()), pa.array(doc[r]), pa.array(lo << _BITS | w), pa.nulls(len(r), pa.binary())], ["m", "doc", "place", "piece"])
            row, m, place = row[~covered], m[~covered], place[~covered]
            data, start = K.text_column(b.column("text"))
            n = place & ((1 << _HALF) - 1)
            off = place >> _HALF & ((1 << _HALF) - 1)
            lo = (place >> _BITS) - at[row]
            ok = (lo >= 0) & (lo + n + size - 1 <= (start[1:] - start[:-1])[row])  # else it is of another row of this id
            row, m, place, n, off, lo = row[ok], m[ok], place[ok], n[ok], off[ok], lo[ok]
            half = np.clip(off - (size - k - near), 0, n)  # windows before this one have `near` bytes before the minimiser
            for side in (0, 1):
                first, count = (np.zeros_like(half), half) if side == 0 else (half, n - half)
                some = np.flatnonzero(count)
                for i in range(0, len(some), 20_000):
                    r = some[i : i + 20_000]
                    begin = start[row[r]] + lo[r]
                    around = begin + off[r] + (k if side else -near)
                    beside = _LETTERS[data[around[:, None] + np.arange(near)]] if near else np.zeros((len(r), 0), K.U64)
                    key = K.mix(m[r].view(K.U64) + K.mix((beside * K.powers(near + 1)[0][1:]).sum(axis=1, dtype=K.U64) + K.U64(side)))
                    width = count[r] + size - 1
                    total = np.concatenate([[0], np.cumsum(width)])
                    take = np.arange(total[-1]) - np.repeat(total[:-1], width) + np.repeat(begin + first[r], width)
                    piece = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[take]))])
                    yield pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(doc[row[r]]), pa.array(((place[r] >> _BITS) + first[r]) << _BITS | count[r]), piece], ["m", "doc", "place", "piece"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Suffix array and LPF of whole buckets, some MB of them at a time."""
        held: list[pa.RecordBatch] = []
        size_held = 0
        for b in batches:
            n = b.column("m").null_count  # covered stretches come first and only pass through
            if n:
                yield pa.RecordBatch.from_arrays([b.column("doc").slice(0, n), b.column("place").slice(0, n)], ["doc", "place"])
                b = b.slice(n)
            if not b.num_rows:
                continue
            m = b.column("m").to_numpy()
            before = held[-1].column("m")[-1].as_py() if held else None
            held.append(b)
            size_held += b.nbytes
            last = int(np.searchsorted(m, m[-1]))
            if size_held < 4 << 20 or (last == 0 and before in (None, int(m[0]))):
                continue
            yield lpf(pa.Table.from_batches([*held[:-1], b.slice(0, last)]))
            held = [b.slice(last)]
            size_held = held[0].nbytes
        if held:
            yield lpf(pa.Table.from_batches(held))

    def lpf(table: pa.Table) -> pa.RecordBatch:
        doc, place = table.column("doc").to_numpy(), table.column("place").to_numpy()
        table = table.take(pa.array(np.lexsort((place, doc))))  # text order
        doc, place = table.column("doc").to_numpy(), table.column("place").to_numpy()
        buf, start = K.text_column(table.column("piece"))
        buf = buf[start[0] : start[-1]]
        start = start - start[0]
        n = place & ((1 << _BITS) - 1)
        run = np.repeat(np.arange(len(n)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        order, rank = suffix_array(buf, start[:-1][run] + inner, size)
        dup = previous_factors(order, rank, size) == size
        r, lo, count = stretches(run[dup], inner[dup], np.ones(int(dup.sum()), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array((((place[r] >> _BITS) + lo) << _BITS) | count)], ["doc", "place"])

    both = dealt.join(by_doc.hint("shuffle_hash"), "doc").sortWithinPartitions("doc", "text")
    pieces = both.mapInArrow(cut, "m long, doc long, place long, piece binary").repartition(F.coalesce("m", F.xxhash64("doc", "place"))).sortWithinPartitions("m")
    covered = pieces.mapInArrow(compare, "doc long, place long").groupBy("doc").agg(F.collect_list("place").alias("places"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, at in offsets(batches):
            raw, start = K.text_column(b.column("text"))
            places = b.column("places").to_pylist()
            ids = [None if x else d for d, x in zip(b.column("doc").to_pylist(), b.column("no_id").to_pylist(), strict=True)]
            out: list[list] = [[], [], [], [], []]
            for i, own in enumerate(places):
                text = raw[start[i] : start[i + 1]]
                spans, keep = [], text
                if own:
                    p = np.array(own, np.int64)
                    lo = (p >> _BITS) - at[i]
                    hi = lo + (p & ((1 << _BITS) - 1)) + size - 1
                    ok = (lo >= 0) & (hi <= len(text))
                    hit = K.cover(len(text), lo[ok], hi[ok])
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                    spans, keep = edge.reshape(-1, 2).tolist(), text[~hit]
                keep = keep.tobytes()
                for column, value in zip(out, (len(text), sum(y - x for x, y in spans), len(spans), hashlib.sha256(keep).hexdigest(), [{"lo": x, "hi": y} for x, y in spans]), strict=True):
                    column.append(value)
            n_bytes, n_removed, n_spans, sha, spans = out
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return dealt.join(covered.hint("shuffle_hash"), "doc", "left").sortWithinPartitions("doc", "text").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<lo:long,hi:long>>")


def brute_force(texts: list[tuple[int, str | None]], size: int = 100) -> dict[int, tuple[int, int, int, str]]:
    """What suffix_dedup returns, for tests: a set of all strings seen."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(texts):
        raw = (text or "").encode()
        hit = [False] * len(raw)
        for i in range(len(raw) - size + 1):
            window = raw[i : i + size]
            if window in seen:
                hit[i : i + size] = [True] * size
            seen.add(window)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out[doc] = (len(raw), sum(hit), spans, hashlib.sha256(bytes(b for b, h in zip(raw, hit, strict=True) if not h)).hexdigest())
    return out
