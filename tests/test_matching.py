"""Joins over grams against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from pathloom.operators import matching as M


def texts(seed, n, alphabet="abcd ", most=9):
    rnd = random.Random(seed)
    return [(rnd.choice(["x", "y"]), "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(most)))) for _ in range(n)] + [("x", None), ("x", ""), ("y", "a"), ("x", "abcab" * 60)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "case_id string, text string")


@pytest.mark.parametrize("least", [1, 2, 3, 4])
def test_contained_loses_nothing(spark, least):
    a, b = texts(1, 150), texts(2, 150, most=14)
    got = sorted(tuple(r) for r in M.contained(frame(spark, a), frame(spark, b), ["case_id"], least=least).collect())
    assert got == sorted({(c, s, t) for c, s in a for d, t in b if c == d and s and t and len(s) >= least and s in t})
    both = sorted(tuple(r) for r in M.containing(frame(spark, a), frame(spark, b), ["case_id"], least_left=least).collect())
    assert both == sorted({(c, s, t) for c, s in a for d, t in b if c == d and s and t and len(s) >= least and (s in t or t in s)})


@pytest.mark.parametrize(("ratio", "least"), [(0.95, 2), (0.92, 8), (0.85, 4), (0.8, 7)])
def test_resembling_loses_nothing(spark, ratio, least):
    rnd = random.Random(int(ratio * 100))
    base = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(least, 24))) for _ in range(60)]

    def near(x):
        x = list(x)
        for _ in range(rnd.randrange(4)):
            i = rnd.randrange(len(x) + 1)
            x[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "z"])
        return "".join(x)

    a = [(rnd.choice("xy"), x) for x in base] + [("x", None), ("y", "")]
    b = [(rnd.choice("xy"), near(rnd.choice(base))) for _ in range(200)]
    got = sorted((r.case_id, r.left, r.right) for r in M.resembling(frame(spark, a), frame(spark, b), ["case_id"], ratio, least=least).collect())
    assert got == sorted({(c, s, t) for c, s in a for d, t in b if c == d and s and len(s) >= least and len(t) >= least and SequenceMatcher(None, s, t).ratio() >= ratio})
    assert got


def test_few_pairs_are_verified(spark):
    """Of 400 x 400 names, what shares a rare gram is a small part."""
    rnd = random.Random(9)
    names = [("x", " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(4, 9))) for _ in range(2))) for _ in range(400)]
    a = frame(spark, names)
    pairs = M.may_resemble(a, a, ["case_id"], 0.92, least=8)
    assert pairs.count() < 4000
    assert M.resembling(a, a, ["case_id"], 0.92, least=8).count() == 400
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_low_ratio_is_refused(spark):
    with pytest.raises(ValueError, match="may share no 2-gram"):
        M.resembling(frame(spark, []), frame(spark, []), ["case_id"], 0.5, least=4)


def test_one_character_apart_meets_few(spark):
    """Numbers behind a common word: what has to be verified grows with the pairs that hold, not with their square."""
    a, b = ([("s", f"Customer#{i:09d}") for i in r] for r in (range(0, 6000, 3), range(0, 6000, 7)))
    rows = lambda x: spark.createDataFrame(x, "case_id string, text string")
    near = M.may_resemble(rows(a), rows(b), ["case_id"], 0.92, least=8)
    assert 0 < near.where("levenshtein(left, right) <= 1").count() <= near.count() < 60_000  # of 1,716,000
