"""Hop results under new edges equal a recompute after each batch, also when one is played again."""

import json
import random

from pathloom.operators.graph import both_ways
from pathloom.streaming.ingest import WalkView, walks

LAYERS = [["r1", "r2"], ["r2"], ["r1", "r3"]]


def recomputed(edges):
    steps = both_ways(edges)
    return sorted((tuple(r.nodes), tuple(r.edges)) for r in walks([steps.where(steps.r.isin(*layer)) for layer in LAYERS]).collect())


def test_walks_follow_the_stream(spark, tmp_path):
    rnd = random.Random(2)
    view, seen = WalkView(spark, str(tmp_path / "view"), LAYERS), []
    (tmp_path / "in").mkdir()
    for n in range(4):
        rows = [(rnd.choice("ABCDE"), rnd.choice(["r1", "r2", "r3"]), rnd.choice("ABCDE")) for _ in range(7)]
        rows += seen[:2] + rows[:1] + [(None, "r1", "A")] if n else rows  # edges come again
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip("hrt", r, strict=True))) for r in rows))
        seen += [r for r in rows if r[0]]
        view.follow(str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination()
        now = spark.createDataFrame(sorted(set(seen)), "h string, r string, t string")
        assert sorted(map(tuple, view.edges().collect())) == sorted(set(seen))
        got = sorted((tuple(r.nodes), tuple(r.edges)) for r in view.walks().collect())
        assert got == recomputed(now) and len(got) == len(set(got))
    again = spark.createDataFrame(rows, "h string, r string, t string")
    view.apply(again, 3)  # the last batch once more
    assert sorted((tuple(r.nodes), tuple(r.edges)) for r in view.walks().collect()) == got
