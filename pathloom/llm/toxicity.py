"""Operator 11, toxicity: noisy-channel deobfuscation before scoring.

1. A character language model (4-grams of 27 letters and the word's edge) is counted over all
   documents; a task's counts are added up before they leave it.
2. Tokens that may be disguised (signs or digits among letters, runs of three and more equal
   letters, letters set apart by spaces, dots or dashes) become lattices: each run of equal
   characters is a slot with the letters it may stand for. Viterbi finds the likeliest
   reading under the language model and the costs of the channel. All other tokens have one
   reading. Tokens of a chunk are decoded together, equal ones once.
3. Terms of the restored text (words, and their first three to seven letters) are scored by
   logistic regression on labelled documents of the training fold, at most `max_labelled` of
   them, over the terms whose evidence beats chance.

Only labels of the training fold are read (see `train`); language, source and id are never
part of a score. Defined results: null and empty texts have no terms; null labels and ids
without a document are ignored; a doc_id labelled or stored more than once counts once for
each different pair; equal texts with equal labels teach once; repeated documents are scored one by
one; without labels, or with labels of one kind only, everything scores their share (0.5
without any); other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import kernels as K
from pathloom.llm.shared import columns, kept

ORDER, LETTERS = 4, 28
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¥": "y", "(": "c"}
#: Costs of the channel: a sign for its letter, a sign as itself, a letter of a run more or less,
#: one of a double letter less, a separator kept between single letters, one left out elsewhere.
SIGN, ITSELF, RUN, DOUBLE, APART, JOINED = -1.0, -2.0, -0.7, -5.0, -6.0, -1.5
#: Signs that end a word as punctuation unless the model says much else.
_CLOSING, CLOSED = "!|+(", -5.0
#: Longer tokens are read in pieces of so many characters.
PIECE = 64

_SPACE, _OTHER = 0, 27
_SIGNS = re.escape("".join(LEET))
_LETTER, _BREAK = r"[^\W\d_]", r"[.\-_*]"
_CANDIDATE = re.compile(
    rf"(?<!\w){_LETTER}(?:[ .\-_*]{_LETTER}){{2,}}(?!\w)"  # letters set apart
    rf"|(?<!\S)(?=\S*(?:[{_SIGNS}]|({_LETTER})\1\1|{_LETTER}{_BREAK}{_LETTER}{{1,2}}{_BREAK}{_LETTER}))(?=\S*{_LETTER})\S+"  # signs, runs or breaks among letters
)


def _letter_table() -> np.ndarray:
    """The model's letter for each code point below U+0250: a-z without accents, 27 for other letters, 0 else."""
    out = np.zeros(0x250, np.int64)
    for c in range(0x250):
        if chr(c).isalpha():
            base = unicodedata.normalize("NFD", chr(c).lower())[0]
            out[c] = ord(base) - 96 if "a" <= base <= "z" else _OTHER
    return out


_TABLE = _letter_table()


def letter(ch: str) -> int:
    return int(_TABLE[ord(ch)]) if ord(ch) < 0x250 else _OTHER if ch.isalpha() else _SPACE


def text_letters(c: K.Chunk) -> np.ndarray:
    """A chunk as letters of the model, an edge before and after each text; runs of edges are one."""
    points = np.frombuffer(c.buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    out = np.where(points < 0x250, _TABLE[np.minimum(points, 0x24F)], _OTHER)
    starts = np.cumsum((c.buf & 0xC0) != 0x80)[c.starts[c.starts < len(c.buf)]] - 1
    out = np.insert(out, starts, _SPACE)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != _SPACE) | (out[:-1] != _SPACE)
    return np.append(out[keep], _SPACE)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, n): 4-grams of letters over all texts, each task's added up first (28**4 numbers)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**ORDER, np.int64)
        for b in batches:
            for c in K.chunks(b.column("text")):
                x = text_letters(c)
                if len(x) >= ORDER:
                    total += np.bincount(((x[:-3] * LETTERS + x[1:-2]) * LETTERS + x[2:-1]) * LETTERS + x[3:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    return docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class Model:
    """log p(letter | three before), each order interpolated with the one below."""

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        counts = np.zeros(LETTERS**ORDER)
        counts[gram] = n
        p = np.full(LETTERS, 1 / LETTERS)
        for order in range(1, ORDER + 1):
            own = counts.reshape([LETTERS] * ORDER).sum(axis=tuple(range(ORDER - order))).reshape(-1, LETTERS)
            seen, kinds = own.sum(axis=1, keepdims=True), (own > 0).sum(axis=1, keepdims=True) + 1
            lower = np.tile(p.reshape(-1, LETTERS), (len(own) // (p.size // LETTERS), 1)) if p.size > LETTERS else np.broadcast_to(p, own.shape)
            p = ((own + kinds * lower) / (seen + kinds)).reshape(-1)
        self.log = np.log(p).astype(np.float32)

    def step(self, context: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and next contexts (three letters) after one letter more."""
        key = context * LETTERS + x
        return self.log[key], key % LETTERS**3


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Slots of (reading, cost) of a candidate token. Readings have at most three characters."""
    apart = re.fullmatch(rf"{_LETTER}(?:[ .\-_*]{_LETTER})+", token)
    slots, n = [], len(token)
    i = 0
    while i < n:
        j = i + 1
        while j < n and token[j] == token[i]:
            j += 1
        ch, run = token[i], j - i
        inside = 0 < i and j < n and token[i - 1].isalpha() and token[j].isalpha()
        if ch.isalpha():
            if run > 2:
                slots.append([(ch, RUN), (ch * 2, RUN), (ch * 3, 3 * RUN)])
            elif run == 2:
                slots.append([(ch * 2, 0.0), (ch, DOUBLE)])
            else:
                slots.append([(ch, 0.0)])
        elif apart:
            slots.append([("", 0.0), (" ", APART)])
        elif inside and run == 1 and ch in ".-_*":
            slots.append([(ch, 0.0), ("", JOINED)])
        elif ch in LEET and (run < 3 or inside):
            more = CLOSED if j == n and ch in _CLOSING else 0.0
            slots.append([(x * k, SIGN + more + (run > k) * RUN) for x in LEET[ch] for k in ((1, 2) if run > 1 else (1,))] + [(ch * min(run, 3), ITSELF * (3 if inside else 1) if not more else 0.0)])
        else:
            slots.append([(ch * min(run, 3), 0.0)])
        i = j
    return slots


def viterbi(model: Model, tokens: list[str]) -> list[str]:
    """The likeliest reading of each token. States of all tokens (token, three letters before)
    go on a slot at a time; of equal states the best stays, of equal scores the first reading."""
    slots = [lattice(t) for t in tokens]
    depth = np.array([len(s) for s in slots])
    edge = np.zeros(len(tokens), np.int64)
    token, context, score = np.arange(len(tokens)), edge, np.zeros(len(tokens))
    back: list[tuple[np.ndarray, np.ndarray]] = []  # parent and reading of each state, by slot
    ends: list[tuple[int, int] | None] = [None] * len(tokens)
    for at in range(int(depth.max(initial=0)) + 1):
        done = depth[token] == at
        if done.any():
            own, _ = model.step(context[done], np.zeros(int(done.sum()), np.int64))
            at_end, total = np.flatnonzero(done), score[done] + np.where(context[done] % LETTERS == _SPACE, 0, own)
            order = np.lexsort((at_end, -total, token[done]))
            first = np.flatnonzero(np.append(True, np.diff(token[done][order]) != 0))
            for k in order[first]:
                ends[token[at_end[k]]] = (at, int(at_end[k]))
        live = np.flatnonzero(~done)
        if not len(live):
            break
        width = [len(slots[t][at]) for t in token[live]]
        parent = np.repeat(live, width)
        option = np.concatenate([np.arange(w) for w in width])
        here = [slots[t][at][o] for t, o in zip(token[parent], option, strict=True)]
        cost = np.array([h[1] for h in here])
        letters = np.array([[letter(ch) for ch in h[0]] + [-1] * (3 - len(h[0])) for h in here], np.int64)
        ctx, total = context[parent], score[parent] + cost
        for k in range(3):
            x = letters[:, k]
            # Edges in a row are one, as in what was counted.
            move = (x >= 0) & ~((x == _SPACE) & (ctx % LETTERS == _SPACE))
            gain, then = model.step(ctx, np.maximum(x, 0))
            ctx, total = np.where(move, then, ctx), total + np.where(move, gain, 0)
        order = np.lexsort((np.arange(len(parent)), -total, ctx, token[parent]))
        t, c = token[parent][order], ctx[order]
        new = np.ones(len(order), bool)
        new[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
        best = order[new]
        back.append((parent[best], option[best]))
        token, context, score = token[parent[best]], ctx[best], total[best]
    out = []
    for i, end in enumerate(ends):
        at, k = end
        said = []
        while at:
            at -= 1
            parent, option = back[at]
            said.append(slots[i][at][option[k]][0])
            k = parent[k]
        out.append("".join(reversed(said)))
    return out


class Restorer:
    """Restored texts; readings are remembered within a task, up to a bound."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most, self.known = model, most, {}

    def __call__(self, texts: list[str]) -> list[str]:
        found = [[m.span() for m in _CANDIDATE.finditer(t)] for t in texts]
        asked = sorted({t[a:b] for t, spans in zip(texts, found, strict=True) for a, b in spans} - self.known.keys())
        if len(self.known) + len(asked) > self.most:
            self.known = {}
            asked = sorted({t[a:b] for t, spans in zip(texts, found, strict=True) for a, b in spans})
        for lo in range(0, len(asked), 4096):
            part = asked[lo : lo + 4096]
            pieces = [[t[i : i + PIECE] for i in range(0, len(t), PIECE)] for t in part]
            read = iter(viterbi(self.model, [x for p in pieces for x in p]))
            self.known.update((t, "".join(next(read) for _ in p)) for t, p in zip(part, pieces, strict=True))
        out = []
        for t, spans in zip(texts, found, strict=True):
            parts, last = [], 0
            for a, b in spans:
                parts += [t[last:a], self.known[t[a:b]]]
                last = b
            out.append("".join([*parts, t[last:]]) if spans else t)
        return out


def lowered(column: pa.Array) -> pa.Array:
    return pc.fill_null(pc.utf8_lower(column.cast(pa.large_string())), "")


def terms(c: K.Chunk, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(term, text), distinct and in order of text: hashes of words and of their beginnings of
    `BEGINNINGS` letters. With `among`, a sorted array, only those."""
    lo, hi, first = c.spans(_IN_WORD[c.buf])
    text = K.owner(first)
    first_byte = (c.buf & 0xC0) != 0x80
    point = np.zeros(len(c.buf) + 1, np.int64)
    np.cumsum(first_byte, out=point[1:])
    begins = np.append(np.flatnonzero(first_byte), len(c.buf))
    over = K.SpanHash(K.letters(11)[c.buf])
    found = []

    def add(term: np.ndarray, of: np.ndarray) -> None:
        if among is not None:
            at = np.minimum(np.searchsorted(among, term), max(len(among) - 1, 0))
            hit = among[at] == term if len(among) else np.zeros(len(term), bool)
            term, of = term[hit], of[hit]
        found.append((term, of))

    add(over(lo, hi), text)
    length = point[hi] - point[lo]
    for size in BEGINNINGS:
        long = length > size
        add(K.mix(over(lo[long], begins[point[lo[long]] + size]) + K.U64(size)), text[long])
    term, text = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((term, text))
    term, text = term[order], text[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (text[1:] != text[:-1])
    return term[new], text[new]


BEGINNINGS = range(3, 8)
#: Words are runs of ASCII letters and all other characters.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[97:123] = _IN_WORD[65:91] = _IN_WORD[128:] = True


def restored_chunks(restore: Restorer, b: pa.RecordBatch) -> Iterator[tuple[K.Chunk, int]]:
    """Chunks of restored, lower-cased text, with the row of the batch that each starts at."""
    low = lowered(b.column("text"))
    for c in K.chunks(low, 1 << 19):
        texts = pa.array(restore(low.slice(c.lo, len(c)).to_pylist()), pa.large_string())
        at = c.lo
        for r in K.chunks(texts, 1 << 20):
            yield r, at + r.lo


class Scorer:
    """Logistic weights of some terms: the chance that a text is toxic."""

    def __init__(self, term: np.ndarray, weight: np.ndarray, bias: float):
        order = np.argsort(term)
        self.term, self.weight, self.bias = term[order], weight[order], bias

    def __call__(self, c: K.Chunk) -> np.ndarray:
        term, text = terms(c, self.term)
        total = np.bincount(text, weights=self.weight[np.searchsorted(self.term, term)], minlength=len(c))
        return 1 / (1 + np.exp(-np.clip(self.bias + total, -30, 30)))


def evidence(toxic: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Log-likelihood ratio of a term's documents having a toxic share of their own; 0 if it is below the base's."""
    p = (toxic + 0.5) / (n + 1)
    out = toxic * np.log(p / base) + (n - toxic) * np.log((1 - p) / (1 - base))
    return np.where(p > base, out, 0)


def fit(doc: np.ndarray, term: np.ndarray, label: np.ndarray, rivals: np.ndarray, penalty: float = 0.01, steps: int = 600) -> Scorer:
    """Logistic regression on the terms whose evidence beats chance: `rivals[n]` terms are in n
    documents or more, and so many could look as good, so a term has to pass their log.
    `doc` and `term` are the pairs that occur. Words of copies share what their documents
    tell; words that turn up in many different toxic texts keep theirs."""
    kinds, of = np.unique(term, return_inverse=True)
    n, toxic = np.bincount(of, minlength=len(kinds)), np.bincount(of, weights=label[doc], minlength=len(kinds))
    good = evidence(toxic, n, label.mean()) > np.log(rivals[n]) + 1
    keep = good[of]
    kinds, doc, of = kinds[good], doc[keep], (np.cumsum(good) - 1)[of[keep]]
    weight, bias = np.zeros(len(kinds)), float(np.log(label.mean() / (1 - label.mean())))
    first, second = np.zeros(len(kinds) + 1), np.zeros(len(kinds) + 1)
    for step in range(1, steps + 1):  # Adam over all documents, with a shrinking rate
        p = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, weights=weight[of], minlength=len(label)), -30, 30)))
        slope = np.append(np.bincount(of, weights=(p - label)[doc], minlength=len(kinds)) + penalty * weight, (p - label).sum())
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        move = 0.2 * (1 - step / (steps + 1)) * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weight, bias = weight - move[:-1], bias - move[-1]
    return Scorer(kinds, weight, bias)


def held_out(doc_id, folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text falls in the fold held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", max_labelled: int = 20_000, min_toxic: int = 3, threshold: float = 0.3) -> DataFrame:
    """Returns doc_id, held_out, score, predicted."""
    docs = columns(docs, doc_id=id_col, text=text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    grams = gram_counts(docs).toPandas()  # at most 28**4 rows
    sent_model = spark.sparkContext.broadcast(Model(grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64)))

    train = columns(labels, doc_id=label_id_col, label=label_col).where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    sample = F.broadcast(train.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled))  # max_labelled rows of two numbers
    taught = docs.join(sample, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label")).distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(sent_model.value)
        for b in batches:
            for c, at in restored_chunks(restore, b):
                term, text = terms(c)
                cut = np.searchsorted(text, np.arange(len(c) + 1))
                yield pa.RecordBatch.from_arrays([b.column("label").slice(at, len(c)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(K.signed(term)))], ["label", "terms"])

    taught = kept(taught.mapInArrow(read, "label int, terms array<long>"))
    n, n_toxic = taught.agg(F.count("*"), F.sum("label")).first()
    if not n or n_toxic in (0, n):
        p = n_toxic / n if n else 0.5
        scorer = Scorer(np.zeros(0, K.U64), np.zeros(0), float(np.log((p + 1e-9) / (1 - p + 1e-9))))
    else:
        # Terms that can't have evidence enough go before anything comes to the driver.
        seen = kept(taught.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("toxic")))
        kinds = seen.groupBy("n").count().toPandas()  # at most max_labelled rows
        rivals = np.bincount(kinds["n"], weights=kinds["count"], minlength=n + 1)[::-1].cumsum()[::-1] + 1
        likely = kept(seen.where((F.col("toxic") >= min_toxic) & (F.col("toxic") * 2 >= F.col("n"))).select("term"))
        rows = taught.withColumn("row", F.struct("label", F.xxhash64("terms").alias("h")))
        pairs = rows.select("row", F.explode("terms").alias("term")).join(likely, "term").groupBy("row").agg(F.sort_array(F.collect_set("term")).alias("own"))
        got = rows.select("row").join(pairs, "row", "left").select("row.label", "own").orderBy("label", "own").toPandas()  # max_labelled documents, their likely terms only
        own = [np.zeros(0, np.int64) if t is None else np.asarray(t, np.int64) for t in got["own"]]
        scorer = fit(np.repeat(np.arange(len(own)), [len(t) for t in own]), np.concatenate(own).view(K.U64), got["label"].to_numpy(np.float64), rivals)
    sent = spark.sparkContext.broadcast(scorer)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(sent_model.value)
        for b in batches:
            for c, at in restored_chunks(restore, b):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(c)), b.column("held_out").slice(at, len(c)), pa.array(sent.value(c))], ["doc_id", "held_out", "score"])

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
