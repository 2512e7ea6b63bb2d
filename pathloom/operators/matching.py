"""Joins of names by what they contain or resemble, over posting tables of short substrings
(grams). Candidates share a rare gram; every candidate is then verified, and no pair that
holds is lost. `scope` are columns that both sides share, such as the case; texts are compared
as they are, so normalize them first. Null and empty texts match nothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathloom.functions.text import may_reach, sequence_ratio

GRAM = 3
#: Texts of fewer characters have their number of shared grams worked out beforehand.
LONG = 200


def grams(text: Column, size: int = GRAM) -> Column:
    """The distinct substrings of a length."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _texts(df: DataFrame, scope: list[str], text: str, name: str) -> DataFrame:
    return df.select(*scope, F.col(text).alias(name)).where(f"{name} <> ''").distinct()


def contained(small: DataFrame, large: DataFrame, scope: list[str], text: str = "text", least: int = 1) -> DataFrame:
    """(scope, small, large): distinct texts of `small` of at least `least` characters that are a
    part of, or equal to, a text of `large`. A text is looked up by the one of its grams that
    fewest texts of `large` hold (by itself if it is shorter than a gram); one that has a gram
    which none holds is part of none."""
    s = _texts(small, scope, text, "small").where(F.length("small") >= least)
    t = _texts(large, scope, text, "large")
    sizes = range(min(least, GRAM), GRAM + 1)
    postings = t.select(*scope, "large", F.explode(F.flatten(F.array(*(grams(F.col("large"), k) for k in sizes)))).alias("gram"))
    asked = s.select(*scope, "small", F.explode(F.when(F.length("small") < GRAM, F.array("small")).otherwise(grams(F.col("small")))).alias("gram"))
    counts = postings.groupBy(*scope, "gram").agg(F.count("*").alias("n"))
    counted = asked.join(counts, [*scope, "gram"], "left").na.fill(0, ["n"])
    key = counted.groupBy(*scope, "small").agg(F.min(F.struct("n", "gram")).alias("x")).where("x.n > 0").select(*scope, "small", "x.gram")
    return key.join(postings, [*scope, "gram"]).where(F.contains("large", F.col("small"))).select(*scope, "small", "large")


def containing(left: DataFrame, right: DataFrame, scope: list[str], text: str = "text", least_left: int = 1, least_right: int = 1) -> DataFrame:
    """(scope, left, right): distinct texts of which one is part of the other, or both are equal,
    with at least so many characters each."""
    a = left.where(F.length(text) >= least_left)
    b = right.where(F.length(text) >= least_right)
    down = contained(a, b, scope, text, least_left).withColumnsRenamed({"small": "left", "large": "right"})
    up = contained(b, a, scope, text, least_right).withColumnsRenamed({"small": "right", "large": "left"})
    return down.unionByName(up).distinct()


def shared_least(a: int, b: int, ratio: float) -> int | None:
    """How many 2-grams, repeats counted, texts of a and b characters share at least if their
    sequence ratio reaches `ratio`; None if it can't. m characters match in order; each of the
    a - m others breaks two grams at most, each of the b - m one of what is left."""
    m = math.ceil(ratio * (a + b) / 2 - 1e-9)
    return None if m > min(a, b) else max(a - 1 - 2 * (a - m) - (b - m), b - 1 - 2 * (b - m) - (a - m))


def least_shared(size: int, least: int, ratio: float) -> int:
    """The same over all partners of at least `least` characters of a text."""
    return min((c for b in _reach(size, least, ratio) if (c := shared_least(size, b, ratio)) is not None), default=size)


def _reach(size: int, least: int, ratio: float) -> range:
    """Lengths that a partner of a text may have, and a few more."""
    return range(max(least, int(size * ratio / (2 - ratio)) - 1), int(size * (2 - ratio) / ratio) + 2)


def one_off(a: int, b: int, ratio: float) -> bool:
    """Whether texts of a and b characters at `ratio` are equal without one character of each at most."""
    m = math.ceil(ratio * (a + b) / 2 - 1e-9)
    return m <= min(a, b) and max(a, b) - m <= 1


def _less_one(texts: DataFrame, scope: list[str], name: str) -> DataFrame:
    """(scope, name, rest): hashes of a text and of what is left of it without one character."""
    t, n = F.col(name), F.length(name)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, n))))
    return texts.select(*scope, name, F.explode(F.array_distinct(F.concat(F.array(F.xxhash64(t)), cut))).alias("rest"))


def _numbered(texts: DataFrame, scope: list[str], name: str) -> DataFrame:
    """(scope, name, gram): 2-grams, repeats told apart by number."""
    t = F.col(name)
    each = texts.select(*scope, name, F.posexplode(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).alias("pos", "g"))
    again = F.row_number().over(Window.partitionBy(*scope, name, "g").orderBy("pos"))
    return each.select(*scope, name, F.concat_ws("#", "g", again.cast("string")).alias("gram"))


def resembling(left: DataFrame, right: DataFrame, scope: list[str], ratio: float, text: str = "text", least: int = 4) -> DataFrame:
    """(scope, left, right, score): distinct texts of `least` characters each whose sequence ratio
    (difflib's, with the left one first) is at least `ratio`."""
    pairs = may_resemble(left, right, scope, ratio, text, least)
    return pairs.withColumn("score", sequence_ratio("left", "right")).where(F.col("score") >= ratio)


def may_resemble(left: DataFrame, right: DataFrame, scope: list[str], ratio: float, text: str = "text", least: int = 4) -> DataFrame:
    """(scope, left, right): the pairs that have to be verified for `resembling`.

    Where lengths and ratio leave each text one character at most that the other lacks, both are
    equal without it: these pairs meet by hashes of what is left, which hardly any others share.

    The others share c 2-grams or more. With grams in one order, rarest first, the first
    n - c + 1 of each then hold a common one, so only these are posted, for each length of the
    other text that its side has; longer texts than `LONG` post all for all. Texts so short or a
    ratio so low that they may share none have no such index: an error."""
    need = {n: least_shared(n, least, ratio) for n in range(least, LONG)}
    if min(need.values()) < 1:
        raise ValueError(f"texts of {least} characters may share no 2-gram at a ratio of {ratio}; raise one of them")
    sides = {"left": _texts(left, scope, text, "left"), "right": _texts(right, scope, text, "right")}
    sides = {name: df.where(F.length(name) >= least) for name, df in sides.items()}
    sizes = {name: df.select(*scope, F.least(F.length(name), F.lit(LONG)).alias("size")).distinct() for name, df in sides.items()}
    # What a text of a characters posts for one of b; nothing where one character tells them apart.
    table = {(a, b): a - 1 - c + 1 for a in range(least, LONG) for b in _reach(a, least, ratio) if b < LONG and not one_off(a, b, ratio) and (c := shared_least(a, b, ratio)) is not None}
    meet = left.sparkSession.createDataFrame([(a, b, n) for (a, b), n in table.items()] + [(a, LONG, a) for a in range(least, LONG) if LONG <= _reach(a, least, ratio)[-1]] + [(LONG, b, 1 << 30) for b in (*range(least, LONG), LONG) if b == LONG or LONG <= _reach(b, least, ratio)[-1]], "size int, other int, most int")

    def asked(name: str, other: str) -> DataFrame:
        """A side's texts with the lengths of the other side that they may meet by grams."""
        partner = sizes[other].withColumnRenamed("size", "other")
        both = sizes[name].join(partner, scope) if scope else sizes[name].crossJoin(partner)
        pairs = both.join(F.broadcast(meet), ["size", "other"]).groupBy(*scope, "size").agg(F.collect_list(F.struct("other", "most")).alias("meets"))
        return sides[name].withColumn("size", F.least(F.length(name), F.lit(LONG))).join(pairs, [*scope, "size"])

    open_ = {"left": asked("left", "right"), "right": asked("right", "left")}
    own = {name: _numbered(df.select(*scope, name), scope, name) for name, df in open_.items()}
    counts = own["left"].drop("left").unionByName(own["right"].drop("right")).groupBy(*scope, "gram").agg(F.count("*").alias("n"))

    def posted(name: str, mine: str, theirs: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*scope, name).orderBy("n", "gram"))
        ranked = own[name].join(counts, [*scope, "gram"]).withColumn("k", rank).join(open_[name], [*scope, name])
        each = ranked.select(*scope, name, "gram", "k", F.col("size").alias(mine), F.explode("meets").alias("m"))
        return each.where(F.col("k") <= F.col("m.most")).select(*scope, name, "gram", mine, F.col("m.other").alias(theirs))

    by_gram = posted("left", "_a", "_b").join(posted("right", "_b", "_a"), [*scope, "gram", "_a", "_b"]).select(*scope, "left", "right")
    by_rest = _less_one(sides["left"], scope, "left").join(_less_one(sides["right"], scope, "right"), [*scope, "rest"]).select(*scope, "left", "right")
    return by_gram.unionByName(by_rest).where(may_reach(F.col("left"), F.col("right"), ratio)).distinct()
