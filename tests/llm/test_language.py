"""Operators 11 to 13: brute force, readings, held-out accuracy and edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import source_audit as A
from pathloom.llm import toxicity as T
from pathloom.llm.queries import TOKENIZERS
from pathloom.llm.token_align import COUNTS, Aligned, Pair, Words, added, brute_force, token_align

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, chunk long, place int, rank int, label int, terms string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, s, 1, 2, 3, 4, "t") for i, t, x, s in rows], SCHEMA)


ODD = [(1, "a b c", "en", "s"), (2, None, None, None), (3, "", "", ""), (None, "no id", "en", None), (4, "w" * 5000, "en", "s"), (4, "a b c", "en", "s"), (1, "a b c", "en", "s"), (5, "漢字 ▁ é \x00 <|endoftext|> <s>", "zh", "s"), (6, " lead\n\n  tail \t", "en", "é"), (7, "1d10t $cum i d i o t l o o o ser!!!", "en", "s"), (8, "x" + "$" * 300 + "y " + "0a" * 200, "en", "s")]


def test_align_brute_force(spark):
    rnd = random.Random(3)
    words = ["the", " quick", "brown", "fox\n", "été", "naïve", "  ", "1234", "x=y;", "ßtraße", "🙂", "don't"]
    rows = [(1000 + i, "".join(rnd.choice(words) for _ in range(rnd.randrange(40)))) for i in range(60)] + [(i, t) for i, t, _, _ in ODD]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in token_align(d, *TOKENIZERS).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(i, *map(int, x), sha) for i, *x, sha in brute_force(rows, *TOKENIZERS)]))
    by_id = {g[0]: g for g in got}
    assert by_id[5][1:] == (0, 0, 0, 0, 0, 0, "")  # U+2581 comes back as a space
    assert by_id[None][1] > 0


def test_align_edges(spark):
    d = frame(spark, ODD)
    assert token_align(d, *TOKENIZERS).count() == len(ODD)
    assert token_align(d.limit(0), *TOKENIZERS).collect() == []


def test_align_words_once(monkeypatch):
    """Words are encoded once, whatever the number of texts, and give what whole texts give."""
    p, met = Pair(*TOKENIZERS), []
    encode = Pair.encode_words
    monkeypatch.setattr(Pair, "encode_words", lambda self, words: met.extend(words) or encode(self, words))
    rnd = random.Random(8)
    bits = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\x85", "a", "été", "12", ".", "don't", "'s", "🙂", "\x00", "<s>", "the", "\u0301", "漢"]
    texts = ["", "▁", *("".join(rnd.choice(bits) for _ in range(rnd.randrange(40))) for _ in range(3000)), "one ▁ lost", *["the same few words again"] * 500]
    for held in (1 << 20, 100):
        met.clear()
        known = Words(p, held)
        for lo in range(0, len(texts), 700):
            n, digests, doc, code = known.align(texts[lo : lo + 700])
            for i, t in enumerate(texts[lo : lo + 700]):
                a, b = p.encode([t])[0]
                x = Aligned(p, a, np.array([len(a)]), b, np.array([len(b)]))
                assert n[:, i].tolist() == [len(a), len(b), x.n_groups[0], x.n_links[0]], t
                assert digests[i] == (hashlib.sha256(x.groups(p)[0].encode()).hexdigest() if len(a) else "")
                assert code[doc == i].tolist() == x.code.tolist()
        if held > 100:
            assert len(met) == len(set(met)) and met.count("same") == 1


def test_align_lone_parts(spark):
    """Parts of a stripe that are one row are handed on; others are added up; bests are of the whole."""
    row = lambda stripe, salt, pairs, n: (stripe, salt, np.array(pairs, np.uint32).tobytes(), np.array(n, np.int64).tobytes(), None)
    rows = [row(0, 0, [1, 7], [2, 3]), row(0, 1, [1, 12], [4, 1]), row(0, 1, [7, 12], [1, 9]), row(3, 0, [5], [6])]
    parts = added(spark.createDataFrame(rows, COUNTS), ["stripe", "salt"], 10)
    read = lambda r: (r.stripe, np.frombuffer(r.pairs, np.uint32).tolist(), np.frombuffer(r.n, np.int64).tolist())
    assert sorted(map(read, parts.collect())) == [(0, [1, 7], [2, 3]), (0, [1, 7, 12], [4, 1, 10]), (3, [5], [6])]
    whole = added(parts, ["stripe"], 10).collect()
    assert sorted((*read(r), np.frombuffer(r.best, bool).tolist()) for r in whole) == [(0, [1, 7, 12], [6, 4, 10], [True, False, True]), (3, [5], [6], [True])]


def audit_brute_force(rows, min_docs=3, top=200):
    import re
    from collections import Counter, defaultdict

    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(words)
        seen[lang or ""].update(set(words))
    out = []
    for lang, source in counts:
        kept = sorted((t for t, n in seen[lang].items() if n >= min_docs), key=str.encode)
        own = {s: c for (x, s), c in counts.items() if x == lang}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept} for s, c in own.items()}
        both = {t: sum(c[t] for c in own.values()) for t in kept}
        q = {t: 1 + 10**9 * (both[t] + 1) // (sum(both.values()) + len(kept)) for t in kept}

        def f(a, b):
            return (a - b) ** 2 // b

        pairs = [(s, sum(f(p[source][t], p[s][t]) for t in kept)) for s in own if s != source]
        best = [(t, f(p[source][t], q[t])) for t in kept if own[source][t] and p[source][t] > q[t]]
        for part, items in (("pair", pairs), ("term", best)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, v, k) for k, (t, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize(("bytes_", "top"), [(32 << 20, 200), (50, 3)])
def test_audit_brute_force(spark, bytes_, top):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["the", "The", "été", "ä", "a1b", "x_y", "漢", "rare" + "abcdefgh"[i % 8] * (i % 3)]) for _ in range(rnd.randrange(20))), rnd.choice(["en", "de", None]), rnd.choice(["s1", "s2", "é", None])) for i in range(120)] + ODD
    got = A.source_audit(frame(spark, rows).repartition(3), bucket_bytes=bytes_, top=top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == audit_brute_force(rows, top=top)


def test_audit_edges(spark):
    assert A.source_audit(frame(spark, ODD).limit(0)).collect() == []
    none = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, None, "en", "z")]
    got = sorted(tuple(r) for r in A.source_audit(frame(spark, none)).collect())
    assert got == audit_brute_force(none) and {g[4] for g in got} == {0} and len(got) == 6
    # A block whose sources don't fit at once gives the same sums.
    row = {"groups": [{"source": s, "total": 9} for s in "abc"], "all_v": 4, "all_n": 27, "sources": ["a", "c"], "source": np.array([0, 0, 1, 1], np.uint32).tobytes(), "ids": np.array([0, 3, 1, 3], np.uint32).tobytes(), "n": np.array([4, 5, 2, 7], np.int64).tobytes(), "v": 4, "terms": b"wxyz", "sizes": np.ones(4, np.uint32).tobytes()}
    for x, y in zip(A.block_parts(row, 2), A.block_parts(row, 2, cells=1), strict=True):
        assert np.array_equal(x, y)


def test_scaled_is_exact():
    count = np.array([0, 1, 7, 10**15 - 1, 10**15])
    assert A.scaled(count, 10**15).tolist() == [10**9 * int(c) // 10**15 for c in count]


@pytest.fixture(scope="module")
def model(spark):
    grams = T.gram_counts(spark.read.parquet(f"{SF}/documents.parquet")).toPandas()
    return T.Model(grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.float64))


@pytest.mark.parametrize(("said", "meant"), [("1d10t", "idiot"), ("i d i o t", "idiot"), ("m.o.r.o.n!", "moron!"), ("idiiiiot", "idiot"), ("$cum", "scum"), ("st-u-p-i-d", "stupid"), ("tr@sh now", "trash now"), ("stingha$$$", "stingha$$$"), ("loooser!!", "loser!!"), ("athe.mggl", "athe.mggl"), ("by-nc 4.0", "by-nc 4.0"), ("plain words, here.", "plain words, here.")])
def test_readings(model, said, meant):
    assert T.Restorer(model)([said]) == [meant]


def test_viterbi_is_exhaustive(model):
    """The best of all readings, found by trying each."""
    import itertools

    def cost(slots, pick):
        context, total = np.zeros(1, np.int64), 0.0
        for slot, k in zip(slots, pick, strict=True):
            total += slot[k][1]
            for ch in slot[k][0]:
                x = T.letter(ch)
                if x == 0 and context[0] % T.LETTERS == 0:
                    continue
                gain, context = model.step(context, np.array([x]))
                total += float(gain[0])
        return total if context[0] % T.LETTERS == 0 else total + float(model.step(context, np.array([0]))[0][0])

    tokens = ["1d10t", "p4th3t1c", "a.b-c.d", "xx11yy", "looossser", "$$a!!", "s t u p"]
    for token, read in zip(tokens, T.viterbi(model, tokens), strict=True):
        slots = T.lattice(token)
        best = max(cost(slots, pick) for pick in itertools.product(*(range(len(s)) for s in slots)))
        ours = max(cost(slots, pick) for pick in itertools.product(*(range(len(s)) for s in slots)) if "".join(s[k][0] for s, k in zip(slots, pick, strict=True)) == read)
        assert abs(best - ours) < 1e-3


def test_toxicity_held_out_and_disguised(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    plain = "Then edinth is thndor, thonndon ernd reer thor edtionnt to"
    more = spark.createDataFrame([(10**9 + i, f"{plain} {w} nd sting anti") for i, w in enumerate(["idiot", "1d10t", "i d i o t", "idiiiot", "l0ser", "w0rthless", "house"])], "doc_id long, text string")
    out = T.toxicity(docs.select("doc_id", "text").unionByName(more), labels)
    got = out.join(labels, "doc_id").where("held_out and toxic is not null").groupBy("toxic", "predicted").count().collect()
    right = sum(r["count"] for r in got if r.toxic == r.predicted)
    assert right / sum(r["count"] for r in got) > 0.97
    new = {r.doc_id - 10**9: r.predicted for r in out.where("doc_id >= 1000000000").collect()}
    assert [new[i] for i in range(7)] == [1, 1, 1, 1, 1, 1, 0]


def test_toxicity_edges(spark):
    d = frame(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (8, 0), (1, 1)], "doc_id long, toxic int")
    got = T.toxicity(d, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, *_ in ODD)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.score for r in T.toxicity(d, labels.limit(0)).collect()} == {0.5}
    assert T.toxicity(d.limit(0), labels).collect() == []
    assert [r.held_out for r in d.select(T.held_out(F.lit(None).cast("long")).alias("held_out")).limit(1).collect()] == [False]
