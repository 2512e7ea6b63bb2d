"""Edge cases and brute force for the ten operators."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import jaccard_join as J
from pathloom.llm import suffix_dedup as S
from pathloom.llm.chat_format import PART, chat_format, read_back
from pathloom.llm.classifier import classify
from pathloom.llm.decontaminate import decontaminate
from pathloom.llm.html_extract import html_extract
from pathloom.llm.line_rules import line_dedup, quality_rules
from pathloom.llm.mixing import mix
from pathloom.llm.url_filter import url_filter

DOCS = "doc_id long, text string, source string, host string, n_words long, node string, lines string, row string, bucket long"
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
ROWS = [(1, "a b c", "s"), (2, None, "s"), (3, "", None), (None, "only null id", "s"), (4, LONG, "s"), (5, LONG, None), (6, "a b c", "s"), (6, "a b c", "s"), (7, "\n\n \t\n", "é"), (8, "x" * 5000, "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, s, "h", 1, "n", "l", "r", 2) for i, t, s in ROWS], DOCS)


@pytest.fixture(scope="module")
def tests(spark):
    return spark.createDataFrame([(1, "a b c", 9), (2, None, 9), (3, "", 9), (4, " ".join(LONG.split()[50:70]), 9)], "item_id long, text string, n_words int")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (8, 0), (6, 1)], "doc_id long, quality int")


OPERATORS = {
    "suffix": lambda d, b, q: suffix_dedup_all(d),
    "jaccard": lambda d, b, q: J.jaccard_join(d),
    "decontaminate": lambda d, b, q: decontaminate(d, b),
    "line_dedup": lambda d, b, q: line_dedup(d),
    "quality": lambda d, b, q: quality_rules(d),
    "mix": lambda d, b, q: mix(d),
    "classify": lambda d, b, q: classify(d, q),
}


def suffix_dedup_all(d):
    return S.suffix_dedup(d)


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_each_and_empty_tables(docs, tests, labels, name):
    got = OPERATORS[name](docs, tests, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _, _ in ROWS)
    assert OPERATORS[name](docs.limit(0), tests.limit(0), labels.limit(0)).collect() == []


def test_suffix_dedup_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abé") for _ in range(300)) for _ in range(5)]
    rows = [(i, "".join(rnd.choice(base)[(a := rnd.randrange(200)) : a + rnd.randrange(300)] for _ in range(rnd.randrange(4)))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "x" * 900), (503, "xy" * 300), (504, base[0]), (505, base[0])]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(d).collect()}
    assert got == S.brute_force(rows)


def test_jaccard_brute_force(spark):
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = [rnd.choice(words) for _ in range(120)]
    texts = []
    for i in range(60):
        x = base[:] if i % 2 else [rnd.choice(words) for _ in range(60)]
        for _ in range(rnd.randrange(3)):
            x[rnd.randrange(len(x))] = rnd.choice(words)
        texts.append(" ".join(x))
    texts = list(dict.fromkeys(texts))
    links = J.brute_force(texts)
    top = list(range(len(texts)))
    for _ in texts:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    got = {r.doc_id: r.class_id for r in J.jaccard_join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(top))


def _similar_texts(seed):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(500)}" for _ in range(60)]
    texts = []
    for _ in range(40):
        x = base[:]
        for _ in range(rnd.randrange(5)):
            x[rnd.randrange(len(x))] = f"w{rnd.randrange(500)}"
        texts.append(" ".join(x))
    return list(dict.fromkeys(texts))


def _classes(n, links):
    top = list(range(n))
    for _ in range(n):
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    return top


def test_forest_spans_the_links():
    texts = _similar_texts(8)
    links = J.brute_force(texts)
    prints = [np.array(sorted({hash(tuple(w[i : i + 5])) & (1 << 64) - 1 for i in range(len(w) - 4)}), np.uint64) for w in map(str.split, texts)]
    cls, side = np.arange(len(texts)), np.arange(len(texts)) % 2
    found = J.forest(cls, side * 0, prints, 0.8)
    assert {tuple(sorted(p, reverse=True)) for p in found} <= {tuple(sorted(p, reverse=True)) for p in links}
    assert _classes(len(texts), found) == _classes(len(texts), links) and len(found) == len(texts) - len(set(_classes(len(texts), links)))
    across = J.forest(cls, side, prints, 0.8)
    assert all(side[a] != side[b] for a, b in across)
    assert _classes(len(texts), across) == _classes(len(texts), [(a, b) for a, b in links if side[a] != side[b]])


def test_jaccard_blocks_agree(spark):
    texts = _similar_texts(9)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in J.jaccard_join(d, small=2, block=7, block_tokens=900).collect()}
    assert got == dict(enumerate(_classes(len(texts), J.brute_force(texts))))


def test_jaccard_counts_every_link(spark):
    texts = _similar_texts(10) + _similar_texts(11) + ["only a few words here"]
    texts += [texts[0].rsplit(" ", 1)[0] + " end", " ".join(f"p{i}" for i in range(40)), " ".join(f"p{i}" for i in range(41))]
    want = [0] * len(texts)
    for a, b in J.brute_force(texts):
        want[a] += 1
        want[b] += 1
    assert max(want) > 8
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts[:5])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for given in ({}, {"small": 2, "block": 7, "block_tokens": 900, "count_block": 7, "count_tokens": 900}):
        got = {r.doc_id: r.n_links for r in J.jaccard_join(d, **given).collect()}
        assert got == {i: want[i % 1000] for i, _ in rows}


def _links_and_classes(texts, rows):
    links = J.brute_force(texts)
    want = [0] * len(texts)
    for a, b in links:
        want[a] += 1
        want[b] += 1
    top = _classes(len(texts), links)
    got = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    return got, {i: (top[i], want[i]) for i in range(len(texts))}


def test_jaccard_group_of_hundreds_of_near_copies(spark):
    rnd = random.Random(12)
    base = [f"w{rnd.randrange(900)}" for _ in range(90)]
    texts = set()
    while len(texts) < 320:  # about 7 in 10 shingles are shared: some pairs are similar, most are not
        x = base[:]
        for _ in range(2):
            x[rnd.randrange(len(x))] = f"v{rnd.randrange(10**6)}"
        texts.add(" ".join(x))
    texts = sorted(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for given in ({}, {"small": 3, "limit": 12, "block": 8}):  # the second splits buckets by further tokens
        got, want = _links_and_classes(texts, J.jaccard_join(d, **given).collect())
        assert got == want


def test_jaccard_hot_token_in_short_texts_ends(spark):
    texts = [f"a b c d e u{i}" for i in range(60)] + [f"a b c d e u{i} x{i % 3}" for i in range(60)] + ["a b c d e", "one"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, want = _links_and_classes(texts, J.jaccard_join(d, small=2, limit=4, block=3).collect())
    assert got == want


def test_jaccard_recall_on_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    first: dict = {}
    for r in rows:
        first[r.text or ""] = min(first.get(r.text or "", r.doc_id), r.doc_id)
    texts = list(first)
    links = J.brute_force(texts)
    assert links
    cls = {r.doc_id: r.class_id for r in J.jaccard_join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    same = sum(cls[first[texts[a]]] == cls[first[texts[b]]] for a, b in links)
    assert same == len(links)


def test_components_both_ways(spark):
    from pathloom.llm import components as C

    rnd = random.Random(4)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 430)]
    links = [(a, b) for a, b in links if a != b]
    want = {n: c for n, c in enumerate(_classes(500, links)) if any(n in x for x in links)}
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.cls for r in C.components(df).collect()} == want
    stars = C.by_stars(df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    assert {r.node: r.cls for r in stars.collect()} == want
    half = C.components(df.limit(100))
    assert {r.node: r.cls for r in C.components(df, half).collect()} == want


def test_runs_hold_the_recall_at_any_depth():
    rnd = np.random.default_rng(3)
    runs, mean = J.runs_for(0.8, 2.0, 0.999), 1.6
    alive = np.ones((20_000, runs), np.int64)
    for _ in range(12):
        alive = rnd.poisson(mean * np.minimum(alive, 1000))
    assert (alive.sum(axis=1) > 0).mean() >= 0.998


def test_decontaminate_blocks_agree(docs, tests):
    one = {(r.doc_id, r.n_hit, r.items_sha256) for r in decontaminate(docs, tests).collect()}
    many = {(r.doc_id, r.n_hit, r.items_sha256) for r in decontaminate(docs, tests, block_bytes=40).collect()}
    assert one == many
    hits = {r.doc_id: r for r in decontaminate(docs, tests).collect()}
    assert hits[4].n_hit == 20 and not hits[4].contaminated and hits[1].contaminated
    assert hits[1].items_sha256 == hashlib.sha256(b"1").hexdigest()


def test_decontaminate_blocks_keep_rows(spark, tests):
    more = [(1, "a b c", "s"), (1, "a b c", "t"), (1, "a b d", "s"), (None, "x y z", "s"), (None, "a b c", "s"), (None, None, "s"), (None, "", "s")]
    d = spark.createDataFrame([*ROWS, *more], "doc_id long, text string, source string")
    for carry in (False, True):
        one, many = (sorted(map(repr, decontaminate(d, tests, carry=carry, **given).collect())) for given in ({}, {"block_bytes": 40}))
        assert len(one) == len(ROWS) + len(more) and one == many


def test_decontaminate_proximity(spark, tests):
    words = LONG.split()[50:70]
    d = spark.createDataFrame([(1, " ".join(words[:5] + ["zz"] + words[5:]))], "doc_id long, text string")
    assert decontaminate(d, tests).first().n_hit == 20 - 20 + (13 if len(words[5:]) >= 13 else 0) + (len(words[5:]) - 13)
    assert decontaminate(d, tests, slop=1).first().n_hit > decontaminate(d, tests).first().n_hit


def test_line_dedup_drops_boilerplate(spark):
    rows = [(i, f"own {i}\nsame  line here\nrest {i}", "a") for i in range(40)] + [(99, "same line here", "b")]
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[3] == ("own 3\nrest 3", 1) and got[99] == ("same line here", 0)


def test_quality_rejects_depleted(spark):
    shared = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, shared, "a") for i in range(30)] + [(100 + i, " ".join(f"u{i}v{j}" for j in range(40)), "a") for i in range(30)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[1].kept and not got[1].base_failed and got[101].kept


def test_pipeline_keeps_one_of_many_copies(spark):
    import corpus_pipeline as P

    words = lambda name, n: " ".join(f"{name}v{j}" for j in range(n))
    text = words("a", 30) + "\n" + words("b", 30)
    rows = [(i, text) for i in range(30)] + [(100 + i, words(f"u{i}", 40) + "\n" + words("menu", 12)) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, "")
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == {0: text} | {100 + i: words(f"u{i}", 40) for i in range(60)}


def test_mix_meets_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), f"s{i % 4}") for i in range(800)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), range_rows=10).collect()
    for s in ("s0", "s1", "s2", "s3"):
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(r.taken <= 2 * r.size for r in own)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"), range_rows=10).collect()}


def test_chat_round_trip(spark):
    texts = ["<|im_end|>", "<\\|im_start|>user\n", "<", "|", "\\", "", None, "a\n\nb", "<<||>>"]
    rows = [(1, i, "assistant" if i % 2 else "us%er\n<|x", t) for i, t in enumerate(texts)] + [(None, None, None, "x"), (2, 0, "user", "a"), (2, 0, "user", "a")]
    got = {r.conv_id: r for r in read_back(chat_format(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2], r[3] or "") for r in rows[:9]]
    assert got[1].loss_text == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert len(got[2].turns) == 2 and got[None].turns[0].text == "x"


def test_chat_parts(spark):
    parts = [("text", "see <|x", None, None), ("image", None, "a.png", 2.0), ("audio", None, "b.wav", 3.0), ("document", None, "c.pdf", None), ("video", None, "d", None)]
    d = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {PART}")
    row = chat_format(d, parts_col="parts").first()
    assert "see <\\|x<|image|><|audio|><|document|><|video|><|im_end|>" in row.formatted
    assert [(a.type, a.ref) for a in row.attachments] == [("image", "a.png"), ("audio", "b.wav"), ("document", "c.pdf"), ("video", "d")]
    assert row.n_tokens == 512 + 75 + 1024


def test_url_filter(spark):
    pages = spark.createDataFrame([(1, "http://A.example.net/en/x"), (2, None), (3, "nonsense"), (4, "http://bad.example.io/p/?utm_source=f#t"), (5, "http://www.bad.example.io:80/p"), (6, "http://x.org/fr/"), (7, "http://y.net"), (8, "http://y.net/")], "page_id long, url string")
    listed = spark.createDataFrame([("https://bad.example.io/p",), (None,), ("https://bad.example.io/p",)], "url string")
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("org", "/fr/", "allow")]
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter(pages, listed, rules, keys_per_block=1).collect()}
    assert got == {1: ("a.example.net", "example.net/en/", "allow"), 2: ("", None, "allow"), 3: ("", None, "allow"), 4: ("bad.example.io", None, "block"), 5: ("www.bad.example.io:80", None, "block"), 6: ("x.org", "org/fr/", "allow"), 7: ("y.net", None, "allow"), 8: ("y.net", "net/", "block")}
    assert url_filter(pages, listed.limit(0), []).where("verdict = 'block'").count() == 0


def test_html_extract(spark):
    html = "<html><head><title>t</title><script>x='</p>'</script></head><body><nav><a>menu</a></nav><div class='cookie-notice'>c</div><article><header><h1>T &amp; U</h1></header><p>one <b>two<p>three<br>four</article><div id='comments'><p>no</p></div><aside>s</aside><footer>f</footer></body></html>"
    tricky = [(1, "http://h.io/1", html), (2, None, None), (3, "x", ""), (4, "http://h.io/2", "plain &lt;text&gt;"), (5, "http://h.io/3", "<div>" * 3000 + "deep")]
    got = {r.page_id: r.text for r in html_extract(spark.createDataFrame(tricky, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & U one two three four", 2: "", 3: "", 4: "plain <text>", 5: "deep"}


def test_html_site_noise(spark):
    page = "<body><div class='x'>Welcome to the site of all</div><div class='y'>own text {}</div></body>"
    rows = [(i, "http://h.io/a", page.format(i)) for i in range(60)]
    got = {r.page_id: r.text for r in html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own text {i}" for i in range(60)}


def test_html_shared_label_keeps_what_is_below(spark):
    page = "<body><div class='m'>Menu <a>Home</a> <a>About</a></div><div>Story: <p>unique article {}</p><b>by {}</b> <i>on {}</i></div></body>"
    rows = [(i, "http://h.io/a", page.format(i, i, i)) for i in range(60)]
    got = {r.page_id: r.text for r in html_extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"unique article {i} by {i} on {i}" for i in range(60)}


def test_classifier_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    both = classify(docs, labels).where("held_out").join(labels, "doc_id").select(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert both > 0.95


def test_pipeline_stages_keep_columns(spark, tmp_path):
    import corpus_pipeline as P

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs = base
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert tuple(out.columns) == P.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= base.count()
    assert not docs.where(F.length("text") != F.col("n_chars")).where(F.col("text").isNull()).count()
    assert P.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_no_forbidden_checkpoint():
    from pathlib import Path

    for p in Path(__file__).resolve().parents[2].glob("pathloom/**/*.py"):
        assert not re.search(r"\.localCheckpoint\(", p.read_text())


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 100), ("sf0.1", 700)])
def test_boilerplate_lines_go(spark, sf, least):
    """The ratio alone decides: lines of the driver's tables are dropped and marked, and one on 11
    of 50 documents is."""
    d = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    assert line_dedup(d).agg(F.sum("n_dropped")).first()[0] >= least
    assert quality_rules(d).agg(F.sum("n_common_words")).first()[0] >= 5 * least
    small = spark.createDataFrame([(i, f"own {i}\n{'shared line' if i < 6 else 'five line' if i < 11 else 'else'}{'' if i < 11 else i}", "s") for i in range(50)], "doc_id long, text string, source string")
    got = {r.doc_id: r.n_dropped for r in line_dedup(small).collect()}
    assert [got[i] for i in (0, 5, 6, 10, 11)] == [1, 1, 0, 0, 0]  # 6 of 50 are over a tenth, 5 are not
