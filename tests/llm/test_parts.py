"""Brute force for parts, and for each stage of the pipeline."""

import collections
import hashlib
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.llm import classifier as C
from pathloom.llm import html_extract as H
from pathloom.llm import jaccard_join as J
from pathloom.llm import kernels as K
from pathloom.llm import suffix_dedup as S
from pathloom.llm.chat_format import chat_format, read_back
from pathloom.llm.mixing import mix
from pathloom.llm.url_filter import url_filter

SF = "/root/testdata/sf0.001"


def test_previous_factors_brute_force():
    rnd = random.Random(2)
    text = "".join(rnd.choice("ab") for _ in range(400)) + "abba" * 20
    raw, size = np.frombuffer(text.encode(), np.uint8), 9
    at = np.arange(len(raw) - size + 1)
    order, rank = S.suffix_array(raw, at, size)
    assert [text[i : i + size] for i in order] == sorted(text[i : i + size] for i in at)
    want = [size if any(text[j : j + size] == text[i : i + size] for j in range(i)) else 0 for i in at]
    assert S.previous_factors(order, rank, size).tolist() == want
    back = np.lexsort((-at, rank))  # equal suffixes last first: the next smaller positions decide
    assert S.previous_factors(back, rank, size).tolist() == want


def test_suffix_dedup_hot_passages_and_ids(spark):
    rnd = random.Random(7)
    hot = "".join(rnd.choice("abcdefgh ") for _ in range(70))  # frequent, but in other surroundings each time
    long = "".join(rnd.choice("abcdefgh ") for _ in range(180))
    noise = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    rows = [(i, noise(rnd.randrange(150)) + hot + noise(rnd.randrange(150)) + (long if i % 3 == 0 else "")) for i in range(200)]
    rows += [(1000 + i, noise(40) + hot[:50] + rows[i][1][-120:]) for i in range(60)] + [(-5, long), (2000, long + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.suffix_dedup(df).collect()}
    assert got == S.brute_force(rows)
    null = spark.createDataFrame([(None, long), (None, noise(300)), (None, long), (3, long)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.n_removed, r.n_bytes) for r in S.suffix_dedup(null).collect())
    assert got == [(False, 180, 180), (True, 0, 180), (True, 0, 300), (True, 180, 180)] or got == [(False, 180, 180), (True, 0, 180), (True, 0, 180), (True, 0, 300)]
    with pytest.raises(TypeError):
        S.suffix_dedup(spark.createDataFrame([("a", long)], "doc_id string, text string"))


def test_style_tree_brute_force(spark):
    nav = "<ul>" + "".join(f"<li><a>m{i}</a></li>" for i in range(4)) + "</ul>"
    pages = [("h.io", f"<body>{nav}<div class='n'>We use cookies</div><div class='t'><p>own {i} " + "w " * (1 << (i % 6)) + f"</p><p>{'x ' * (i % 9)}</p></div></body>") for i in range(30)]
    pages += [("small.io", f"<body><p>p{i}</p></body>") for i in range(2)] + [("small.io", ""), (None, None)]
    df = spark.createDataFrame([(i, f"http://{h}/{i}" if h else None, x) for i, (h, x) in enumerate(pages)], "page_id long, url string, html string")
    rows = df.select(H.host_of(F.col("url")).alias("host"), "html")
    got = {r.host: (dict(zip(r.nodes, r.forms, strict=True)), dict(zip(zip(r.text_nodes, r.texts, strict=True), r.lefts, strict=True))) for r in H.style_tree(rows, 20.0).collect()}
    count: dict = collections.defaultdict(collections.Counter)
    for h, x in pages:
        count[h or ""].update(H.features(H.Tree(x or "")))

    def entropy(forms):
        m = sum(forms.values())
        return min(1.0, (math.log2(m) - sum(n * math.log2(n) for n in forms.values()) / m) / 3)

    everywhere: dict = collections.defaultdict(collections.Counter)
    for c in count.values():
        for (node, kind, f), n in c.items():
            if kind == H.FORM:
                everywhere[node][f] += n
    for host, c in count.items():
        pages_of = {node: n for (node, kind, _), n in c.items() if kind == H.PAGES}
        own: dict = collections.defaultdict(collections.Counter)
        for (node, kind, f), n in c.items():
            if kind == H.FORM:
                own[node][f] += n
        want = {node: (pages_of[node] * entropy(f) + 20 * entropy(everywhere[node])) / (pages_of[node] + 20) for node, f in own.items() if pages_of[node] > 1}
        shared = {(node, f): 1 - math.log(n) / math.log(pages_of[node] + 2) for (node, kind, f), n in c.items() if kind == H.CONTENT and n > 1}
        forms, lefts = got.get(host, ({}, {}))
        assert forms == pytest.approx(want) and lefts == pytest.approx(shared)


def test_style_tree_alone_finds_menus_and_footers(spark):
    """On the driver's pages, whose menus, adverts and footers differ on every page, with the
    lists of names off."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    named = H.html_extract(pages).select("page_id", "text")
    alone = H.html_extract(pages, named=False).select("page_id", F.col("text").alias("alone"))
    nothing = H.html_extract(pages, named=False, importance=0.0, repeat=0.0).select("page_id", F.col("text").alias("raw"))
    row = named.join(alone, "page_id").join(nothing, "page_id").select(F.avg((F.col("text") == F.col("alone")).cast("int")), F.avg((F.col("text") == F.col("raw")).cast("int"))).first()
    assert row[0] > 0.9 and row[1] == 0


def test_html_wrappers_and_edges(spark):
    rows = [(1, "http://a.io/", "<body><form><h1>T</h1><p>all of the page is in a form</p></form></body>"), (2, "http://a.io/2", "<div class='header'><article><p>kept</p></article></div><nav>menu</nav>"), (2, "http://a.io/2", "<div class='header'><article><p>kept</p></article></div><nav>menu</nav>"), (3, "http://a.io/3", "<p>" + "long " * 60_000 + "</p>"), (4, "bad url", "<p hidden>no</p>yes")]
    df = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, host string, nodes int")
    got = sorted((r.page_id, r.text[:40], r.n_chars) for r in H.html_extract(df).collect())
    assert got == [(1, "T all of the page is in a form", 30), (2, "kept", 4), (2, "kept", 4), (3, ("long " * 8), 299_999), (4, "yes", 3)]
    assert H.html_extract(df.limit(0)).collect() == []


def test_plain_tags_read_as_others(monkeypatch):
    """Tags as pages write them are read at once and give what HTMLParser gives; others are left to it."""

    class Whole(H.Tree):
        updatepos, parse_starttag, parse_endtag = HTMLParser.updatepos, HTMLParser.parse_starttag, HTMLParser.parse_endtag

    def nodes(tree):
        return [(x.name, x.noise, x.unseen, x.words, x.text, x.key) for x in tree.seen]

    rnd = random.Random(6)
    bits = ["<", ">", "</", "div", "P", "script", "style", "title", ' class="ad"', ' ID="x y"', " a='b'", " hidden", ' x="&amp;"', ' y="<b>"', "/>", "text ", "&lt;", "-", '"', "=", "<p>", "</p>", "<li>", "</script>", "<DIV>", "</Div>", ' class="1" class="ad"', ' class=""', ' class="Nav\nad"']
    for _ in range(3000):
        html = "".join(rnd.choice(bits) for _ in range(rnd.randrange(25)))
        assert nodes(H.Tree(html)) == nodes(Whole(html)), html
    slow = []
    monkeypatch.setattr(HTMLParser, "check_for_whole_start_tag", lambda self, i: slow.append(i) or -1)
    page = '<body><ul class="menu"><li><a href="/x" id="y">x</a></li></ul><DIV><p>one</p><br></DIV>'
    assert [x.name for x in H.Tree(page).seen] == ["", "body", "ul.menu", "li", "a.y", "div", "p", "br"] and not slow


def test_votes_brute_force():
    rnd = random.Random(9)
    words = ["alpha", "Beta", "gamma!", "12", "Delta-x", "e"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 30))) for _ in range(80)]
    texts[10:14] = [texts[0]] * 4  # ties
    label = np.array([i % 2 for i in range(60)], np.float64)
    counts = np.concatenate([C.terms(c) for c in K.chunks(pa.array(texts))])
    model = C.Model(counts[:60], label, dims=8, k=5)
    got = model.score(counts[60:])
    vec = lambda x: C.unit(C.weighed(x, model.idf) @ model.basis - model.mean)
    for row, score in zip(counts[60:], got, strict=True):
        near = [round(float(s), 5) for s in (vec(row[None]) @ vec(counts[:60]).T)[0]]
        least = sorted(near)[-5]
        voters = [(max(s, 1e-6) ** 4, label[i]) for i, s in enumerate(near) if s >= least]
        assert score == pytest.approx(sum(w * v for w, v in voters) / sum(w for w, _ in voters), abs=2e-3)


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "q " * 50_000, "x"), (3, "", "x")], "doc_id long, text string, terms string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, quality int")
    got = [(r.doc_id, r.score) for r in C.classify(docs, labels).collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i == 1}) == 1


def test_url_edges(spark):
    long = "http://x.io/" + "a" * 200_000
    pages = spark.createDataFrame([(1, long, "h"), (1, long, "h"), (2, "http://x.io/b", "h")], "page_id long, url string, host string")
    listed = spark.createDataFrame([(long,), ("http://x.io/zz",)], "url string")
    assert sorted((r.page_id, r.verdict) for r in url_filter(pages, listed, []).collect()) == [(1, "block"), (1, "block"), (2, "allow")]
    assert url_filter(pages.limit(0), listed, []).collect() == []


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 300_000, "f"), (1, 1, "assistant", "y", "f")], "conv_id long, turn long, role string, text string, formatted string")
    row = read_back(chat_format(turns)).first()
    assert [len(t.text) for t in row.turns] == [300_000, 1] and row.loss_text == "y"
    assert read_back(chat_format(turns.limit(0))).collect() == []


def test_mix_by_given_weights(spark):
    rows = [(i, "w w w w", "s", 1.0 if i % 2 else 0.0) for i in range(400)] + [(1000 + i, "w", "t", None) for i in range(50)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string, score double"), weight_col="score").where("source = 's'").collect()
    extra = [r.taken - r.size * r.epochs for r in got]
    good, bad = (sum(x for r, x in zip(got, extra, strict=True) if r.doc_id % 2 == k) for k in (1, 0))
    assert good > 2 * bad


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _frequent(docs, fold):
    """(source, line) above the limit; equal texts of a source are one document."""
    by = collections.defaultdict(set)
    for d in docs:
        by[d.source].add(d.text or "")
    out = set()
    for source, texts in by.items():
        count = collections.Counter()
        for t in texts:
            count.update({" ".join(_words(x)).lower() if fold else " ".join(_words(x)) for x in t.split("\n") if _words(x)})
        out |= {(source, line) for line, n in count.items() if n > 1 and n > 0.1 * len(texts)}
    return out


def _keeps(d, frequent):
    words = _words(d.text)
    grams = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    common = sum(len(_words(x)) for x in (d.text or "").split("\n") if (d.source, " ".join(_words(x)).lower()) in frequent)
    return len(words) >= 10 and 100 * len(hit) <= 20 * len(words) and len(words) - common >= 0.3 * len(words)


def _bag(rows):
    return collections.Counter((r.doc_id, r.text, r.source) for r in rows)


def test_pipeline_stages_brute_force(spark, tmp_path):
    """Each stage on its own input: documents of the smallest size with shared lines, near copies,
    a contaminated text, null ids, empty texts and repeated rows among them."""
    import corpus_pipeline as P

    base = spark.read.parquet(f"{SF}/documents.parquet").select(*P.COLUMNS)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    words = lambda n, k: " ".join(f"{n}q{j}" for j in range(k))
    more = [(9001, words("a", 40) + "\nshared line of all of them", "en", "z")] + [(9100 + i, words(f"b{i}", 30) + "\nshared line of all of them", "en", "z") for i in range(30)]
    more += [(None, words("a", 40) + "\nshared line of all of them", "en", "z"), (None, words("n", 30), "en", None), (None, words("n", 30), "en", None), (9002, None, "en", "z"), (9003, "", None, None), (9004, next(r.text for r in items if len(r.text.split()) > 20) + " " + words("c", 15), "en", "z")]
    extra = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in more], base.schema)
    docs = base.unionByName(extra).unionByName(extra.where("doc_id = 9001"))
    for name, stage in P.STAGES[:-1]:
        rows = docs.collect()
        out = stage(spark, docs, SF)
        got = out.collect()
        assert tuple(out.columns) == P.COLUMNS
        if name == "quality_rules":
            frequent = _frequent(rows, True)
            assert _bag(got) == _bag([r for r in rows if _keeps(r, frequent)])
        elif name == "line_dedup":
            frequent = _frequent(rows, False)
            want = collections.Counter()
            for r in rows:
                left = [x for x in (r.text or "").split("\n") if not _words(x) or (r.source, " ".join(_words(x))) not in frequent]
                want[(r.doc_id, "\n".join(left) if r.text is not None and len(left) < len(r.text.split("\n")) else r.text, r.source)] += 1
            assert _bag(got) == want
        elif name == "jaccard_join":
            texts = sorted({r.text or "" for r in rows})
            top = list(range(len(texts)))
            for a, b in sorted(J.brute_force(texts)):
                x, y = top[a], top[b]
                top = [min(x, y) if t in (x, y) else t for t in top]
            cls = {t: top[i] for i, t in enumerate(texts)}
            assert sorted(cls[r.text or ""] for r in got) == sorted(set(cls.values()))
            least = {}
            for r in rows:
                if r.doc_id is not None:
                    least[cls[r.text or ""]] = min(least.get(cls[r.text or ""], r.doc_id), r.doc_id)
            assert all(r.doc_id == least.get(cls[r.text or ""]) for r in got)
        else:
            grams = set()
            for it in items:
                w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), it.text or ""))
                grams |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
            sizes = {len(g) for g in grams}

            def clean(text):
                w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
                hit = {i + k for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in grams for k in range(n)}
                return not (hit and 20 * len(hit) >= len(w))

            assert _bag(got) == _bag([r for r in rows if clean(r.text)])
            assert 9004 not in {r.doc_id for r in got}
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    last = P.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == docs.count() and {r.source for r in last} == {r.source for r in docs.select("source").distinct().collect()}
    for s in {r.source for r in last}:
        own = [r for r in last if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 2 * r.size for r in own)


def test_near_duplicates_by_row_not_by_id(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (None, text + " end"), (None, "another " * 3 + text[::-1]), (7, "x y z"), (7, " ".join(f"k{i}" for i in range(30))), (7, "x y z")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = collections.Counter((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, "").collect())
    assert got == collections.Counter([rows[0], rows[2], rows[3], rows[4]])
    assert hashlib.sha256(b"").hexdigest()  # equal texts of null rows too
    same = spark.createDataFrame([(None, text, "en", "s", 1)] * 3, docs.schema)
    assert P.near_duplicates(spark, same, "").count() == 1


def test_carried_text_under_another_name(spark):
    """The operator's text column has another name, and a column called text is something else."""
    from pathloom.llm.line_rules import line_dedup

    d = spark.createDataFrame([(1, "a b\nshared x", "other", "s"), (2, "c d\nshared x", None, "s"), (3, None, None, "s")], "doc_id long, body string, text string, source string")
    got = {r.doc_id: (r.text, r.row.text, r.n_dropped) for r in line_dedup(d, text_col="body", carry=True, distinct=True).collect()}
    assert got == {1: ("a b", "other", 1), 2: ("c d", None, 1), 3: (None, None, 0)}
