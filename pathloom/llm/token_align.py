"""Operator 12, cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes,
and how often over the corpus, in id-striped dense count matrices.

1. Each text is encoded by both. Token ends that both share cut the text into groups; the
   ends of either cut it into intervals, each of which is one A-B pair of overlapping tokens.
   No token of either crosses a single space between words, so a word is encoded and aligned
   once and looked up from then on (`Words`); a text's result is that of its words.
   A chunk of documents leaves a digest row a document, and one packed row for each stripe of
   `STRIPE` A ids: its pairs, and for each pair the documents that hold it, with how often.
   All of it is written once to the shared folder, so no text is encoded twice.
2. Documents of a pair are summed for each task's rows, sent to the pair's stripe and added
   up by np.add.at in a dense block (A ids of the stripe by B ids). The maximum of a row is its A id's best
   count. A hot stripe's rows are first added up in `FAN` parts.
3. Links go to their stripe, in as many parts as the stripe's measured bytes need; a stripe's
   counts are sent to each part. A task holds one block at a time and scores the links that
   follow it; sums of documents are added up by chunk.

Defined results: null, empty and unfaithfully encoded texts (joined token bytes other than space
+ text) have no tokens and zeros; rows are told apart by place, so repeated ids keep rows of
their own (each row counts as a document) and null ids stay; an empty table gives an empty
result; other columns are ignored; equal counts are all best.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.shared import columns, stored

#: A ids of one stripe; a dense block holds STRIPE x B's ids of 8 bytes.
STRIPE = 32
#: Rows of a stripe are added up in so many parts before they meet.
FAN = 16
CHUNK = 2 << 20
#: Words are forgotten, all at once, when they have so many characters.
HELD = 2 << 20

#: Fixed value: how byte-level BPE cuts a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A single space between words. A starts a match there, whatever is before; B has no piece
#: with a space behind another character (`Pair.by_word`).
CUT = re.compile(r"(?<=\S) (?=\S)")
RAGGED = re.compile(r"\s | \s|^\s|\s\Z")


def _byte_letters() -> dict[str, int]:
    """Byte-level BPE writes a byte as itself if it is printable, else as one of U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        letters = _byte_letters()
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if all(c in letters for c in token)}
        special = {x["id"] for x in model["added_tokens"]}
        # Ids are in the order of the merges, so they are ranks.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for t, i in vocab.items() if i not in special}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.n_a, self.n_b = 1 + max(*vocab.values(), *special), self.b.get_piece_size()
        self.a_bytes = [b""] * self.n_a
        for token, i in vocab.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.n_b) for p in [self.b.id_to_piece(i)]]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.by_word = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.n_b))
        #: Ids as decimals with what follows them: ',' inside a side, '|' after A's, ';' after B's.
        self.text = [f"{i}{end}" for i in range(max(self.n_a, self.n_b)) for end in ",|;"]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none for both if either isn't faithful."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            whole = b" " + text.encode()
            a = self.a.encode_ordinary(" " + text)
            if not text or b"".join(map(self.b_bytes.__getitem__, b)) != whole or b"".join(map(self.a_bytes.__getitem__, a)) != whole:
                a, b = [], []
            out.append((np.array(a, np.int64), np.array(b, np.int64)))
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of A and B of all words, laid end to end; how many each word has; whether it is
        faithful (if not, it has none)."""
        whole = [b" " + w.encode() if w else b"" for w in words]
        size = np.array([len(w) for w in whole], np.int64)
        edged = np.array([w[:1].isspace() or w[-1:].isspace() for w in words], bool)
        coded = self.b.encode(words, num_threads=1)
        b = np.fromiter(chain.from_iterable(coded), np.int64)
        n_b = np.array([len(x) for x in coded], np.int64)
        b_of = np.repeat(np.arange(len(words)), n_b)
        good = (np.bincount(b_of, self.b_size[b], len(words)) == size) & (size > 0)
        n_b[~good], b, b_of = 0, b[good[b_of]], b_of[good[b_of]]
        own = [w for w, x in zip(whole, good.tolist(), strict=True) if x]
        differ = np.frombuffer(b"".join(own), np.uint8) != np.frombuffer(b"".join(map(self.b_bytes.__getitem__, b.tolist())), np.uint8)
        if differ.any():
            wrong = np.zeros(len(words), bool)
            wrong[np.repeat(np.arange(len(words)), np.where(good, size, 0))[differ]] = True
            good &= ~wrong
            n_b[wrong], b = 0, b[~wrong[b_of]]
        # A's words are encoded as one text, but for those with white space at an end.
        plain = good & ~edged
        a, a_of = [self.a.encode_ordinary("".join([" " + w for w, x in zip(words, plain.tolist(), strict=True) if x]))], []
        ends = np.cumsum(size[plain])
        a_of.append(np.flatnonzero(plain)[np.searchsorted(ends, np.cumsum(self.a_size[a[0]]))])
        for i in np.flatnonzero(good & edged).tolist():
            a.append(self.a.encode_ordinary(" " + words[i]))
            a_of.append(np.full(len(a[-1]), i))
        a, a_of = np.fromiter(chain.from_iterable(a), np.int64), np.concatenate(a_of)
        if len(a_of) and edged.any():
            order = np.argsort(a_of, kind="stable")
            a, a_of = a[order], a_of[order]
        return a, np.bincount(a_of, minlength=len(words)), b, n_b, good | (size == 0)


@lru_cache(1)
def pair(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


class Aligned:
    """Groups and links of some encoded texts laid end to end."""

    def __init__(self, p: Pair, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.n_a, self.n_b = n_a, n_b
        a_end, b_end = np.cumsum(p.a_size[a]), np.cumsum(p.b_size[b])
        size = int(a_end[-1]) if len(a_end) else 0
        in_a, in_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        in_a[a_end], in_b[b_end] = True, True
        end = np.flatnonzero(in_a | in_b)
        # An interval's tokens are the first of each side that end at its end or later.
        a_at = np.cumsum(in_a)[end] - in_a[end]
        b_at = np.cumsum(in_b)[end] - in_b[end]
        doc_of = np.repeat(np.arange(len(n_a)), self.n_a)
        self.doc, self.code = doc_of[a_at], a[a_at] * p.n_b + b[b_at]
        shared = (in_a & in_b)[end]
        self.n_groups = np.bincount(self.doc[shared], minlength=len(n_a))
        self.n_links = np.bincount(self.doc, minlength=len(n_a))
        #: Tokens in group order, A's before B's, as entries of Pair.text.
        both = np.flatnonzero(in_a & in_b)
        a_group, b_group = np.searchsorted(both, a_end), np.searchsorted(both, b_end)
        a_before = np.searchsorted(b_group, a_group)
        b_before = np.searchsorted(a_group, b_group, "right")
        order = np.zeros(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + a_before] = a * 3 + in_b[a_end]
        order[np.arange(len(b)) + b_before] = b * 3 + 2 * in_a[b_end]
        self.order, self.first = order, np.append(0, np.cumsum(self.n_a + self.n_b))

    def groups(self, p: Pair) -> list[str]:
        """The groups of each text in decimals."""
        items, first = list(map(p.text.__getitem__, self.order.tolist())), self.first.tolist()
        return ["".join(items[lo:hi])[:-1] for lo, hi in zip(first[:-1], first[1:], strict=True)]


class Words:
    """Words encoded and aligned so far. `held` bounds their characters."""

    def __init__(self, p: Pair, held: int = HELD):
        self.p, self.held = p, held
        self.forget()

    def forget(self) -> None:
        #: Words are numbered as they are met.
        self.at: dict[str, int] = defaultdict(count().__next__)
        self.groups: list[str] = []
        #: n_a, n_b, n_groups, n_links and 1 if the word isn't faithful, of each word.
        self.n, self.code, self.size = np.zeros((5, 0), np.int64), np.zeros(0, np.int64), 0

    def learn(self, words: list[str]) -> None:
        *ids, good = self.p.encode_words(words)
        x = Aligned(self.p, *ids)
        self.groups += x.groups(self.p)
        self.n = np.hstack([self.n, np.array([x.n_a, x.n_b, x.n_groups, x.n_links, ~good], np.int64)])
        self.code = np.append(self.code, x.code)
        self.size += sum(map(len, words))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links of each text, digests, and the text and code of each link."""
        if self.size > self.held:
            self.forget()
        words = [[t] if not self.p.by_word else CUT.split(t) if RAGGED.search(t) else t.split(" ") for t in texts]
        first = np.cumsum([0, *map(len, words)])
        ids = np.fromiter(map(self.at.__getitem__, chain.from_iterable(words)), np.int64, int(first[-1]))
        self.learn(list(islice(self.at, len(self.groups), None)))
        n = np.add.reduceat(self.n[:, ids], first[:-1], axis=1)
        lost = n[4] > 0
        n[:, lost] = 0
        items, cuts = ids.tolist(), first.tolist()
        digests = [hashlib.sha256(";".join(map(self.groups.__getitem__, items[lo:hi])).encode()).hexdigest() if some else "" for lo, hi, some in zip(cuts[:-1], cuts[1:], n[0].tolist(), strict=True)]
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        ids, of = ids[~lost[of]], of[~lost[of]]
        links = self.n[3]
        many = links[ids]
        place = np.repeat((np.cumsum(links) - links)[ids] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        return n[:4], digests, np.repeat(of, many), self.code[place]


def _rows(schema: pa.Schema, **values) -> pa.RecordBatch:
    n = max(len(v) for v in values.values())
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)


def _spread(pairs: np.ndarray, docs: np.ndarray, times: np.ndarray) -> dict[str, bytes]:
    """Entries sorted by pair, packed: pairs, documents of each, then their places (16 bits, or
    32 if there are more) and numbers of links."""
    at = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return {"pairs": pairs[at].astype(np.uint32).tobytes(), "sizes": np.diff(np.append(at, len(pairs))).astype(np.uint32).tobytes(), "docs": docs.astype(np.uint32).tobytes(), "times": times.astype(np.uint32).tobytes()}


LINKS = "pairs binary, sizes binary, docs binary, times binary"


def _u32(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint32)


def align(docs: DataFrame, kind: str, a_path: str, b_path: str) -> DataFrame:
    """Digest rows (stripe is null) and link rows, by chunk."""
    sides = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("stripe", pa.int32()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), *((c, pa.binary()) for c in ("pairs", "sizes", "docs", "times"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p, chunk = pair(a_path, b_path), TaskContext.get().partitionId() << 32
        known = Words(p)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            ends, lo = np.cumsum([len(t) + 1 for t in texts]), 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
                n, digests, doc, code = known.align(texts[lo:hi])
                digest = _rows(sides, chunk=[chunk] * (hi - lo), place=range(hi - lo), n_a=n[0], n_b=n[1], n_groups=n[2], n_links=n[3], groups_sha256=digests)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), *digest.columns], ["doc_id", *sides.names])
                key, times = np.unique(code * (hi - lo) + doc, return_counts=True)
                code, doc = key // (hi - lo), key % (hi - lo)
                stripe = code // (STRIPE * p.n_b)
                cut = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(stripe) else []
                if len(cut):
                    packed = [_spread(code[i:j] - stripe[i] * STRIPE * p.n_b, doc[i:j], times[i:j]) for i, j in zip(cut, np.append(cut[1:], len(code)), strict=True)]
                    rows = _rows(sides, chunk=[chunk] * len(cut), place=[hi - lo] * len(cut), stripe=stripe[cut], **{k: [r[k] for r in packed] for k in ("pairs", "sizes", "docs", "times")})
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(cut), b.schema.field("doc_id").type), *rows.columns], ["doc_id", *sides.names])
                chunk, lo = chunk + 1, hi

    return docs.mapInArrow(run, f"doc_id {kind}, chunk long, place int, stripe int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {LINKS}")


_COUNTS = pa.schema([("stripe", pa.int32()), ("salt", pa.int32()), ("pairs", pa.binary()), ("n", pa.binary()), ("best", pa.binary())])
COUNTS = "stripe int, salt int, pairs binary, n binary, best binary"


def partial_counts(links: DataFrame, limit: int = 4 << 20) -> DataFrame:
    """Documents of each pair, added up over a task's link rows (some millions of entries at a time)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt, held, n_held = TaskContext.get().partitionId() % FAN, [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            key, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, place, np.concatenate([h[1] for h in held]))
            return key, n

        def flush() -> Iterator[pa.RecordBatch]:
            key, n = total()
            stripe = key >> 32
            cut = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1]))
            spans = list(zip(cut, np.append(cut[1:], len(key)), strict=True))
            yield _rows(_COUNTS, stripe=stripe[cut], salt=[salt] * len(cut), pairs=[(key[i:j] & 0xFFFFFFFF).astype(np.uint32).tobytes() for i, j in spans], n=[n[i:j].tobytes() for i, j in spans])

        for b in batches:
            for stripe, pairs, sizes in zip(*(b.column(c).to_pylist() for c in ("stripe", "pairs", "sizes")), strict=True):
                held.append(((stripe << 32) + _u32(pairs).astype(np.int64), _u32(sizes).astype(np.int64)))
                n_held += len(held[-1][0])
                if n_held > limit:
                    held = [total()]
                    n_held = len(held[0][0])
                    if n_held > limit // 2:
                        yield from flush()
                        held, n_held = [], 0
        if held:
            yield from flush()

    return links.select("stripe", "pairs", "sizes").mapInArrow(add, COUNTS)


def added(counts: DataFrame, keys: list[str], n_b: int) -> DataFrame:
    """Counts added up in dense blocks, one for each value of `keys`, with the best of each A id
    once they are whole (without salt). A lone row of a part is its sum already."""
    final = "salt" not in keys

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lone, block = None, None, np.zeros(STRIPE * n_b, np.int64)

        def put(pairs: bytes, n: bytes) -> None:
            np.add.at(block, _u32(pairs), np.frombuffer(n, np.int64))

        def done() -> pa.RecordBatch:
            if lone is not None:
                return _rows(_COUNTS, stripe=[last[0]], salt=[last[1]], pairs=[lone[0]], n=[lone[1]])
            at = np.flatnonzero(block)
            best = None
            if final:
                grid = block.reshape(STRIPE, n_b)
                best = (grid == grid.max(axis=1, keepdims=True)).reshape(-1)[at].tobytes()
            out = _rows(_COUNTS, stripe=[last[0]], salt=[last[1]], pairs=[at.astype(np.uint32).tobytes()], n=[block[at].tobytes()], best=[best])
            block[at] = 0
            return out

        for b in batches:
            for stripe, salt, pairs, n in zip(*(b.column(c).to_pylist() for c in ("stripe", "salt", "pairs", "n")), strict=True):
                key = (stripe, 0 if final else salt)
                if last is not None and key != last:
                    yield done()
                if key != last and not final:
                    last, lone = key, (pairs, n)
                    continue
                last = key
                if lone is not None:
                    put(*lone)
                    lone = None
                put(pairs, n)
        if last is not None:
            yield done()

    return counts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, COUNTS)


_SUMS = pa.schema([("chunk", pa.int64()), ("n_best", pa.binary()), ("count_sum", pa.binary())])


def link_scores(links: DataFrame, counts: DataFrame, part_bytes: int = 8 << 20, limit: int = 32 << 20) -> DataFrame:
    """(chunk, place, n_best, count_sum) of the documents with links. `links` and `counts` are kept."""
    size = F.length("pairs") + F.length("sizes") + F.length("docs") + F.length("times")
    parts = links.groupBy("stripe").agg(F.ceil(F.sum(size) / part_bytes).cast("int").alias("parts"))
    parts = F.broadcast(parts)  # a row for each stripe: A's ids / STRIPE
    none = F.lit(None).cast("binary")
    blocks = counts.join(parts, "stripe").select("stripe", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("place"), "pairs", F.col("n").alias("sizes"), F.col("best").alias("docs"), none.alias("times"))
    own = links.join(parts, "stripe").select("stripe", F.pmod(F.xxhash64("chunk"), "parts").cast("int").alias("part"), "chunk", "place", "pairs", "sizes", "docs", "times")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = n = best = None
        sums: dict[int, np.ndarray] = {}
        held = 0

        def flush() -> pa.RecordBatch:
            return _rows(_SUMS, chunk=list(sums), n_best=[x[0].tobytes() for x in sums.values()], count_sum=[x[1].tobytes() for x in sums.values()])

        for b in batches:
            for chunk, place, pairs, sizes, docs, times in zip(*(b.column(c).to_pylist() for c in ("chunk", "place", "pairs", "sizes", "docs", "times")), strict=True):
                if chunk < 0:
                    known, n, best = _u32(pairs), np.frombuffer(sizes, np.int64), np.frombuffer(docs, bool)
                    continue
                at = np.repeat(np.searchsorted(known, _u32(pairs)), _u32(sizes))
                doc, many = _u32(docs), _u32(times).astype(np.int64)
                if chunk not in sums:
                    sums[chunk] = np.zeros((2, place), np.int64)
                    held += 16 * place + 200
                np.add.at(sums[chunk][0], doc, many * best[at])
                np.add.at(sums[chunk][1], doc, many * n[at])
                if held > limit:
                    yield flush()
                    sums.clear()
                    held = 0
        if sums:
            yield flush()

    scored = blocks.unionByName(own).repartition("stripe", "part").sortWithinPartitions("stripe", "part", F.col("chunk") >= 0).mapInArrow(score, "chunk long, n_best binary, count_sum binary")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        schema = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("n_best", pa.int64()), ("count_sum", pa.int64())])

        def done() -> pa.RecordBatch:
            return _rows(schema, chunk=[last] * total.shape[1], place=range(total.shape[1]), n_best=total[0], count_sum=total[1])

        for b in batches:
            for chunk, *own in zip(*(b.column(c).to_pylist() for c in ("chunk", "n_best", "count_sum")), strict=True):
                rows = np.stack([np.frombuffer(x, np.int64) for x in own])
                if chunk == last:
                    total = total + rows
                else:
                    if last is not None:
                        yield done()
                    last, total = chunk, rows
        if last is not None:
            yield done()

    return scored.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(add, "chunk long, place int, n_best long, count_sum long")


def token_align(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Both files
    have to be at their path on every executor."""
    docs = columns(docs, doc_id=id_col, text=text_col)
    coded = stored(align(docs, docs.schema["doc_id"].dataType.simpleString(), a_path, b_path))
    links = coded.where("stripe is not null").select("chunk", "place", "stripe", "pairs", "sizes", "docs", "times")
    n_b = pair(a_path, b_path).n_b
    counts = stored(added(added(partial_counts(links), ["stripe", "salt"], n_b), ["stripe"], n_b))
    rows = coded.where("stripe is null").select("doc_id", "chunk", "place", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = rows.join(link_scores(links, counts), ["chunk", "place"], "left").na.fill(0, ["n_best", "count_sum"])
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_force(rows: list[tuple], a_path: str, b_path: str) -> list[tuple]:
    """The same by comparing all tokens of a text; `rows` are (doc_id, text)."""
    p, found, held = Pair(a_path, b_path), [], {}
    for doc_id, text in rows:
        a, b = p.encode([text or ""])[0]

        def spans(ids, table):
            ends = np.cumsum([len(table[i]) for i in ids]).tolist()
            return list(zip([0, *ends], ends, ids.tolist()))  # noqa: B905

        sa, sb = spans(a, p.a_bytes), spans(b, p.b_bytes)
        links = [(x[2], y[2]) for x in sa for y in sb if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in sa} & {y[1] for y in sb})
        text = ";".join(",".join(str(x[2]) for x in sa if lo < x[1] <= hi) + "|" + ",".join(str(y[2]) for y in sb if lo < y[1] <= hi) for lo, hi in zip([0, *cuts], cuts))  # noqa: B905
        found.append((doc_id, len(a), len(b), len(cuts), links, hashlib.sha256(text.encode()).hexdigest() if cuts else ""))
        for link in set(links):
            held[link] = held.get(link, 0) + 1
    most: dict[int, int] = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    return [(i, na, nb, g, len(links), sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha) for i, na, nb, g, links, sha in found]
