"""Scalar functions on names, relations and model output, as Column expressions."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

#: Relations that carry no answer, by prefix and by last part.
NOISY_PREFIXES = ("type.", "common.", "freebase.", "kg.", "user.", "base.ontologies.")
NOISY_SHORTS = ("type", "types", "instance", "instances", "notable_types", "topic_equivalent_webpage", "webpage", "mid", "guid", "key", "keys", "permission", "is_reviewed")
#: Answers that say nothing.
EMPTY_ANSWERS = ("", "none", "n/a", "na", "null", "maybe", "yes", "no", "unknown")
EMPTY_PHRASES = ("no answer", "no valid answer", "not found", "\\boxed", "boxed{")


def normalize(text: Column) -> Column:
    """Lower case, runs of anything but a-z 0-9 % . ' and space to one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9%.' ]+", " "), r"\s+", " "))


def relation_short(rel: Column) -> Column:
    """The last two parts of a dotted name, underscores as spaces."""
    return F.translate(F.substring_index(rel, ".", -2), "._", "  ")


def tag(text: Column, name: str) -> Column:
    """The trimmed inside of the first <name>...</name>; null if there is none."""
    pattern = f"(?s)<{name}>(.*?)</{name}>"
    return F.when(F.regexp_like(text, F.lit(pattern)), F.trim(F.regexp_extract(text, pattern, 1)))


def is_cvt(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[mg]\.[A-Za-z0-9_]+$"), F.lit(False))


def is_noisy(rel: Column, shorts: tuple[str, ...] = NOISY_SHORTS) -> Column:
    rel = F.coalesce(rel, F.lit(""))
    starts = F.lit(False)
    for p in NOISY_PREFIXES:
        starts = starts | rel.startswith(p)
    return starts | F.substring_index(rel, ".", -1).isin(*shorts)


def is_noisy_attribute(rel: Column) -> Column:
    return is_noisy(rel, NOISY_SHORTS[:-1])


def token_set(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(normalize(text), " ")), lambda x: x != "")


def token_overlap(q: Column, e: Column) -> Column:
    """Share of e's tokens that q has; 0 if e has none."""
    return F.when(F.size(token_set(e)) > 0, F.size(F.array_intersect(token_set(q), token_set(e))) / F.size(token_set(e))).otherwise(0.0)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def has_latin(text: Column) -> Column:
    return text.rlike("[a-zA-Z]")


@pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """difflib's similarity ratio; prefilter with `may_reach` first."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def may_reach(a: Column, b: Column, ratio: float) -> Column:
    """Whether lengths alone allow a sequence ratio of at least `ratio`."""
    return 2 * F.least(F.length(a), F.length(b)) >= ratio * (F.length(a) + F.length(b))


def subquestions(raw: Column) -> Column:
    """Numbered lines of the <answer>, at least three characters each."""
    lines = F.transform(F.split(F.coalesce(tag(raw, "answer"), F.lit("")), "\n"), lambda x: F.trim(F.regexp_extract(F.trim(x), r"^\d+\.\s*(.+)", 1)))
    return F.filter(lines, lambda x: F.length(x) >= 3)


def analysis(raw: Column) -> Column:
    """What a reply says before its sub-questions; empty without the tag."""
    return F.coalesce(tag(raw, "analysis"), F.lit(""))


TRIPLES = "struct<triples:array<struct<source_subquestion:string,subject:string,predicate:string,object:string>>,entity_roles:array<struct<entity:string,role:string,reason:string>>,num_triples:int>"


def _mended(body: Column, quotes: bool = False) -> Column:
    straight = F.translate(body, "\u201c\u201d\u2018\u2019", "\"\"''")
    plain = F.regexp_replace(straight, r",\s*([}\]])", "$1")
    return F.translate(plain, "'", '"') if quotes else plain


def plan_json(raw: Column) -> Column:
    """(triples, entity_roles, num_triples, error) of the <answer>'s JSON. Curly quotes are set
    straight; a second try drops commas before a closing bracket, a third takes single quotes
    for double ones. error has the reply's first 200 characters if no try reads triples."""
    body = F.coalesce(tag(raw, "answer"), raw)
    straight = F.translate(body, "\u201c\u201d\u2018\u2019", "\"\"''")
    tries = [F.from_json(x, TRIPLES) for x in (straight, _mended(body), _mended(body, True))]
    best = F.coalesce(*(F.when(t["triples"].isNotNull(), t) for t in tries))
    return F.struct(best["triples"].alias("triples"), best["entity_roles"].alias("entity_roles"), best["num_triples"].alias("num_triples"), F.when(best.isNull(), F.substring(F.coalesce(raw, F.lit("")), 1, 200)).alias("error"))


def triples_json(raw: Column) -> Column:
    """The triples of the <answer>'s JSON."""
    return plan_json(raw)["triples"]


def relation_choices(raw: Column) -> Column:
    """map step -> numbers of a JSON object such as {"step_1": [3, 1]}, single quotes allowed;
    of `step_1: [3, 1]` lines where there is no such JSON."""
    body = F.coalesce(tag(raw, "selected"), tag(raw, "answer"), raw)
    kind = "map<string,array<int>>"
    said = F.coalesce(F.from_json(body, kind), F.from_json(_mended(body, True), kind))
    keyed = F.filter(F.map_entries(said), lambda e: F.lower(e["key"]).startswith("step_") & e["value"].isNotNull())
    of_json = F.transform(keyed, lambda e: F.struct(F.substring(e["key"], 6, 9).try_cast("int").alias("step"), e["value"].alias("numbers")))
    of_lines = F.transform(step_choices(raw), lambda x: F.struct(F.substring_index(x, ":", 1).cast("int").alias("step"), F.transform(F.filter(F.split(F.substring_index(x, ":", -1), ","), lambda n: n != ""), lambda n: n.cast("int")).alias("numbers")))
    return F.when(F.size(of_json) > 0, of_json).otherwise(of_lines)


def step_choices(raw: Column) -> Column:
    """Lines `step_N: [i, j]` as 'N:i,j' strings."""
    found = F.regexp_extract_all(raw, F.lit(r"step_\d+\s*:\s*\[[^\]]*\]"), F.lit(0))
    return F.transform(found, lambda x: F.concat(F.regexp_extract(x, r"step_(\d+)", 1), F.lit(":"), F.array_join(F.regexp_extract_all(F.regexp_extract(x, r"\[(.*)\]", 1), F.lit(r"\d+"), F.lit(0)), ",")))


def selected(raw: Column) -> Column:
    """Distinct numbers of <selected>, in order."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(tag(raw, "selected"), F.lit("")), F.lit(r"\d+"), F.lit(0)))


def final_answer(raw: Column) -> Column:
    """The last <answer>: its boxed entries joined by ' | ', else its text; null without one."""
    last = F.try_element_at(F.regexp_extract_all(raw, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1)), F.lit(-1))
    boxed = F.filter(F.transform(F.regexp_extract_all(last, F.lit(r"\\boxed\{([^}]*)\}"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(boxed) > 0, F.array_join(boxed, " | ")).otherwise(F.trim(last))


def answer_status(raw: Column) -> Column:
    """'incomplete_xml' without a closed <answer>, 'malformed_content' if it says nothing, else 'ok'."""
    answer = final_answer(raw)
    return F.when(answer.isNull(), "incomplete_xml").when(is_empty_answer(answer), "malformed_content").otherwise("ok")


def is_empty_answer(answer: Column) -> Column:
    """Null, a word that says nothing, a refusal, or what is left of an answer's mark-up."""
    a = F.lower(F.trim(answer))
    says_no = [F.contains(a, F.lit(x)) for x in EMPTY_PHRASES]
    starts = [a.startswith(x) for x in ("is there", "boxed")]
    out = answer.isNull() | a.isin(*EMPTY_ANSWERS)
    for x in [*says_no, *starts]:
        out = out | x
    return out


def is_bare_date(answer: Column) -> Column:
    return answer.rlike(r"^\d{4}(-\d{2}-\d{2}.*|-08:00)?$")


def is_trivial(sub: Column, question: Column) -> Column:
    """Whether a single sub-question says no more than the question."""

    def clean(x: Column) -> Column:
        plain = F.translate(normalize(x), "\"'.%", "")
        first = F.substring_index(plain, " ", 1)
        return F.trim(F.when(first.isin("who", "what", "where", "when", "which", "how", "name"), F.substring(plain, F.length(first) + 1, F.length(plain))).otherwise(plain))

    a, b = clean(sub), clean(question)
    return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))


def _among(layer: list[str]):
    return lambda r: r.isin(*layer)


def coverage(rels: Column, layers: list[list[str]]) -> Column:
    """Greedy in-order coverage as a bit mask: each layer takes the first position at or
    after the cursor whose relation it holds; a missed layer leaves the cursor."""
    state = F.struct(F.lit(0).cast("long").alias("mask"), F.lit(1).alias("at"))
    for i, layer in enumerate(layers):
        hit = F.transform(rels, _among(layer))
        rest = F.array_position(F.slice(hit, state["at"], F.greatest(F.size(rels) - state["at"] + 1, F.lit(0))), F.lit(True))
        state = F.struct(F.when(rest > 0, state["mask"].bitwiseOR(F.lit(1 << i).cast("long"))).otherwise(state["mask"]).alias("mask"), F.when(rest > 0, (state["at"] + rest).cast("int")).otherwise(state["at"]).alias("at"))
    return state["mask"]


def causal_tier(mask: Column, depth: Column) -> Column:
    """(steps covered, last step covered or -1, -hops): larger is better."""
    return F.struct(F.bit_count(mask).alias("covered"), F.when(mask > 0, F.floor(F.log2(mask.cast("double"))).cast("int")).otherwise(-1).alias("last"), (-depth).alias("near"))


def register(spark: SparkSession) -> None:
    """SQL names for what SQL has no function for."""
    spark.udf.register("sequence_ratio", sequence_ratio)


def cvt_sql(name: str) -> str:
    """`is_cvt` as SQL text, for views."""
    return f"coalesce({name} rlike '^[mg]\\\\.[A-Za-z0-9_]+$', false)"
