"""Vectorised byte kernels shared by the text operators.

Everything here works on one *chunk*: the UTF-8 bytes of some whole texts, laid end
to end in one ``uint8`` array, with the start and end of each text.  A chunk holds a
few MB (one text alone if it is longer), so memory does not grow with a partition.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def letters(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte value."""
    with np.errstate(over="ignore"):
        return mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(seed))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(max(n, 1 << 16) * 5 // 4, base, U64)
                steps[0] = 1
                _powers[name] = np.cumprod(steps, dtype=U64)
    return _powers["up"][:n], _powers["down"][:n]


class SpanHash:
    """64-bit polynomial hashes of any span of a sequence, from prefix sums."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.prefix[1:])

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.prefix[hi] - self.prefix[lo]) * self.down[lo] + (hi - lo).astype(U64) * _BASE)


def flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(chars, np.uint8)] = True
    return table


#: The white space of the word pattern, [\x20\x09-\x0D].
SPACE = flags(b" \t\n\x0b\x0c\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Chunk:
    """Rows lo..hi of a batch; text i is buf[starts[i]:ends[i]]."""

    lo: int
    hi: int
    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return self.hi - self.lo

    def sums(self, flag: np.ndarray) -> np.ndarray:
        """For each text, how many of its bytes are flagged."""
        total = np.zeros(len(flag) + 1, np.int64)
        np.cumsum(flag, out=total[1:])
        return total[self.ends] - total[self.starts]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of flagged bytes that stay in one text: starts, ends, and the
        index of each text's first run (one more entry than texts)."""
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[self.starts] = True
        edge[self.ends] = True
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        lo = np.flatnonzero(inside & (~before | edge[:-1]))
        hi = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return lo, hi, np.append(np.searchsorted(lo, self.starts), len(lo))


def text_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    if not len(column):
        return
    data, offsets = text_column(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        at = offsets[lo : hi + 1] - offsets[lo]
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], at[:-1], at[1:])
        lo = hi


def owner(first: np.ndarray) -> np.ndarray:
    """For each run, the index of its text, from the first run of each text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all `size`-word windows inside one text, and the text of each."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    skip = np.cumsum(count) - count
    return np.arange(int(count.sum())) - skip[text] + first[:-1][text] if len(text) else np.zeros(0, np.int64), text


def cover(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n items any of the ranges lo..hi covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0


@dataclass
class Lines:
    """Lines (split at \\n) that hold a word; hashes are equal for equal word lists."""

    text: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n_words: np.ndarray
    hash: np.ndarray


def lines(c: Chunk, fold: bool) -> tuple[Lines, np.ndarray, np.ndarray, np.ndarray, SpanHash]:
    """All lines of a chunk with words, and the words' starts, ends and firsts.

    A line's hash is that of its words with single spaces between them; `fold`
    lower-cases A-Z first."""
    buf = LOWER[c.buf] if fold else c.buf
    over = SpanHash(letters(1)[buf])
    ws, we, first = c.spans(~SPACE[buf])
    word = over(ws, we)
    by_word = SpanHash(word)
    cut = np.flatnonzero(c.buf == 10)
    lo = np.sort(np.concatenate([c.starts[c.ends > c.starts], cut + 1]))
    inside = np.searchsorted(c.starts, lo, "right") - 1
    keep = lo < c.ends[np.maximum(inside, 0)] if len(lo) else np.zeros(0, bool)
    lo = np.unique(lo[keep])
    text = np.searchsorted(c.starts, lo, "right") - 1
    stop = np.append(cut, len(c.buf))
    hi = np.minimum(stop[np.searchsorted(stop, lo)], c.ends[text]) if len(lo) else lo
    a, b = np.searchsorted(ws, lo), np.searchsorted(ws, hi)
    has = b > a
    found = Lines(text[has], lo[has], hi[has], (b - a)[has], by_word(a[has], b[has]))
    return found, ws, we, first, over


def repeats(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items with a text and a key: whether the pair occurs more than once, and
    whether it occurred before (in item order)."""
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key):
        both = mix(key + text.astype(U64) * _BASE)
        order = np.argsort(both, kind="stable")
        same = both[order][1:] == both[order][:-1]
        before[order[1:]] = same
        again[order[1:]] = same
        again[order[:-1]] |= same
    return again, before


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
