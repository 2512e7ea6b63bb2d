"""The line and chain grammars of model-written plans, as Column expressions.

Lines are read piece by piece: up to a mark, between two marks, `key: value` pairs split at
`;`. A line that lacks a piece it must have is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.text import tag

#: Nodes that name nothing, kinds of steps.
UNNAMED = ("", "unknown", "the", "a")
STEP_TYPES = ("find", "verify")


def _strip(text: Column, extra: str = "") -> Column:
    return F.btrim(text, F.lit(" \t\r" + extra))


def _lines(raw: Column) -> Column:
    return F.transform(F.split(F.coalesce(raw, F.lit("")), "\n"), lambda x: _strip(x))


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark, in any case of letters; null without one."""
    at = F.instr(F.lower(text), mark.lower())
    return F.when(at > 0, F.substring(text, at + F.lit(len(mark)), F.length(text)))


def _before(text: Column, mark: str) -> Column:
    """What comes before the first mark; all of it without one."""
    return F.substring_index(text, mark, 1)


def _labelled(lines: Column, label: str) -> Column:
    """What follows `label:` in each line that starts with it."""
    start = label.lower() + ":"
    return F.transform(F.filter(lines, lambda x: F.lower(x).startswith(start)), lambda x: _strip(F.substring(x, F.lit(len(start) + 1), F.length(x))))


def _named(text: Column) -> tuple[Column, Column]:
    """Name and query of `x (entity_query: y)`; both the text if it has no query."""
    query = _strip(_before(_after(text, "(entity_query:"), ")"))
    whole = query.isNotNull() & (query != "")
    return F.when(whole, _strip(_before(text, "("))).otherwise(text), F.when(whole, query).otherwise(text)


def endpoint(text: Column) -> Column:
    """(name, query) of an endpoint; both nulls for 'none'."""
    none = F.lower(text) == "none"
    return F.struct(*(F.when(~none, x).alias(n) for x, n in zip(_named(text), ("name", "query"), strict=True)))


def plan_anchor(raw: Column) -> Column:
    """(name, query, answer_type): the last anchor line with a query, else the first without."""
    lines = _lines(raw)
    said = F.filter(_labelled(lines, "anchor"), lambda x: x != "")
    full = F.filter(said, lambda x: F.contains(F.lower(x), F.lit("(entity_query:")))
    best = F.coalesce(F.try_element_at(full, F.lit(-1)), F.get(said, F.lit(0)))
    name, query = _named(best)
    kind = F.get(F.filter(_labelled(lines, "answer_type"), lambda x: x != ""), F.lit(0))
    return F.struct(name.alias("name"), query.alias("query"), kind.alias("answer_type"))


def plan_steps(raw: Column) -> Column:
    """array of (step, question, type, relation_query, endpoint) of the numbered lines, such as
    `1. "question" (type: find; relation_query: r; endpoint: none)`; the type may be missing."""

    def step(x: Column) -> Column:
        number, rest = _before(x, "."), _after(x, ".")
        inside = F.coalesce(_after(rest, "(type:"), _after(rest, "(relation_query:"))
        typed = _after(rest, "(type:").isNotNull()
        question = F.when(typed, F.substring(rest, F.lit(1), F.instr(F.lower(rest), "(type:") - 1)).otherwise(F.substring(rest, F.lit(1), F.instr(F.lower(rest), "(relation_query:") - 1))
        closed = F.when(inside.endswith(")"), F.substring(inside, F.lit(1), F.length(inside) - 1))
        pairs = F.split(F.concat(F.when(typed, F.lit("type:")).otherwise(F.lit("relation_query:")), closed), ";")

        def value(key: str) -> Column:
            return F.get(F.filter(F.transform(pairs, lambda p: F.when(F.lower(_strip(_before(p, ":"))) == key, _strip(_after(p, ":")))), lambda v: v.isNotNull() & (v != "")), F.lit(0))

        return F.struct(F.when(number.rlike("^[0-9]+$"), number.try_cast("int")).alias("step"), _strip(question, '"“”').alias("question"), F.coalesce(F.lower(value("type")), F.lit("find")).alias("type"), value("relation_query").alias("relation_query"), endpoint(value("endpoint")).alias("endpoint"), value("endpoint").isNotNull().alias("ended"))

    whole = F.filter(F.transform(_lines(raw), step), lambda s: s["step"].isNotNull() & (s["question"] != "") & s["relation_query"].isNotNull() & s["ended"] & s["type"].isin(*STEP_TYPES))
    return F.transform(whole, lambda s: s.dropFields("ended"))


def chain(raw: Column) -> Column:
    """(anchor, hops, endpoints, answer_type, reasoning) of 'A -(rel)-> node ...'; null without
    a hop. Keyword, Definition and Sub-question lines belong to hops by position."""
    lines = _lines(raw)
    text = F.array_join(lines, "\n")
    body = _before(_before(_after(text, "Chain:"), "\nAnalysis:"), "\nEndpoints:")
    line = F.try_element_at(F.filter(F.split(body, "\n"), lambda x: F.contains(x, F.lit("-("))), F.lit(-1))
    pieces = F.split(line, r"-\(")
    anchor = _strip(F.get(pieces, F.lit(0)))
    bodies = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.contains(p, F.lit(")")) & F.contains(p, F.lit("->")) & (_strip(_before(p, ")")) != "") & (_strip(_after(p, "->")) != ""))
    told = F.split(F.coalesce(_after(text, "\nAnalysis:"), F.lit("")), "\n")

    def said(label: str, i: Column) -> Column:
        return F.coalesce(F.get(_labelled(F.transform(told, lambda x: _strip(x, "-")), label), i), F.lit(""))

    def hop(p: Column, i: Column) -> Column:
        node = _strip(_after(p, "->"))
        return F.struct(_strip(_before(p, ")")).alias("relation"), F.when(F.lower(node).isin(*UNNAMED), "node").otherwise(node).alias("endpoint"), said("keyword", i).alias("keyword"), said("definition", i).alias("definition"), said("sub-question", i).alias("subquestion"))

    hops = F.transform(bodies, hop)
    listed = F.split(F.coalesce(F.get(_labelled(lines, "endpoints"), F.lit(0)), F.lit("")), r"\[")
    ends = F.filter(F.slice(listed, F.lit(2), F.greatest(F.size(listed) - 1, F.lit(0))), lambda p: F.contains(p, F.lit("]")))
    named = F.transform(ends, lambda p: F.struct(_strip(_before(p, "]")).alias("entity"), _strip(_after(_after(p, "]"), "hop"), ",;.").try_cast("int").alias("hop")))
    kind = F.coalesce(tag(raw, "answer_type"), F.get(_labelled(lines, "answer_type"), F.lit(0)))
    reasoning = _strip(_before(_after(text, "Reasoning:"), "\nChain:"), "\n")
    return F.when((anchor != "") & (F.size(hops) > 0), F.struct(anchor.alias("anchor"), hops.alias("hops"), named.alias("endpoints"), kind.alias("answer_type"), reasoning.alias("reasoning")))


def start_end(raw: Column) -> Column:
    """(start, ends, steps) of an entity reading: `Start:` and `End:` lines, and numbered steps
    `1. text (relation: r)`."""
    lines = _lines(raw)
    ends = F.filter(F.flatten(F.transform(_labelled(lines, "end"), lambda x: F.transform(F.split(x, "[;,]"), lambda e: _strip(e)))), lambda e: (e != "") & (F.lower(e) != "none"))
    numbered = F.filter(lines, lambda x: _before(x, ".").rlike("^[0-9]+$"))
    steps = F.transform(numbered, lambda x: F.struct(_strip(_before(_after(x, "."), "(relation:")).alias("question"), _strip(_before(_after(x, "(relation:"), ")")).alias("relation")))
    return F.struct(F.get(F.filter(_labelled(lines, "start"), lambda x: x != ""), F.lit(0)).alias("start"), ends.alias("ends"), steps.alias("steps"))
