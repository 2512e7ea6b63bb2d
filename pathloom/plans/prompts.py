"""Prompts for each stage, in our own words, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "subquestions": "Split the question into the fewest single-fact questions, in the order they are answered.\nQuestion: {question}\nReply as <analysis>why</analysis><answer>1. first\n2. second</answer>",
    "triples": "Write one triple for each sub-question. Unknowns are ?x, ?y. Say which entity the search starts at.\nQuestion: {question}\nSub-questions:\n{subquestions}\n{problem}Reply as <answer>{{\"triples\": [{{\"source_subquestion\": 1, \"subject\": \"\", \"predicate\": \"\", \"object\": \"\"}}], \"entity_roles\": [{{\"entity\": \"\", \"role\": \"anchorentity or pathentity\"}}]}}</answer>",
    "analysis": "Say what the question names and asks for.\nEntities: {entities}\nQuestion: {question}\nReply as <interpretation>what is asked</interpretation><anchor>where to start</anchor><endpoints>other named entities, or none</endpoints><answer_type>kind of answer</answer_type><rewritten>the question in plain words</rewritten>",
    "chain": "Write the chain of relations from the start to the answer.\nEntities: {entities}\nStart: {anchor}\nOther entities: {endpoints}\nKind of answer: {answer_type}\nMeaning: {interpretation}\nIn plain words: {rewritten}\nQuestion: {question}\n{problem}Reply as\nChain: start -(relation)-> node -(relation)-> node\nAnalysis:\n- Keyword: of each hop\n- Definition: of each hop\n- Sub-question: of each hop\nEndpoints: [entity] hop 2",
    "prune": "For each step choose the relations that can answer it, best first.\nQuestion: {question}\n{candidates}\nReply as <selected>step_1: [numbers]\nstep_2: [numbers]</selected>",
    "select": "Choose the patterns whose ends answer the question, best first.\nQuestion: {question}\n{patterns}\nReply as <selected>numbers</selected>",
    "direct": "Answer the question from what you know.\nQuestion: {question}\nReply as <answer>\\boxed{{name}}</answer>",
    "default": "Answer from the evidence only, with names as they stand there.\nQuestion: {question}\n{evidence}\nReply as <answer>\\boxed{{name}}</answer>",
    "check": "Answer from the evidence, then check each name against every condition of the question.\nQuestion: {question}\n{evidence}\nReply as <answer>\\boxed{{name}}</answer>",
    "ecot": "Reason step by step; cite the evidence line for each step, then answer.\nQuestion: {question}\n{evidence}\nReply as <answer>\\boxed{{name}}</answer>",
    "entity": "Go through the candidates one by one; keep those that the evidence supports.\nQuestion: {question}\nCandidates: {candidates}\n{evidence}\nReply as <answer>\\boxed{{name}}</answer>",
    "entity-lite": "Which of the candidates answer the question?\nQuestion: {question}\nCandidates: {candidates}\nReply as <answer>\\boxed{{name}}</answer>",
    "v2": "Follow the patterns from the start entity to their ends, apply the question's conditions, and answer with names from the evidence.\nQuestion: {question}\nAnswer type: {answer_type}\n{evidence}\nReply as <answer>\\boxed{{name}} \\boxed{{name}}</answer>",
    "v3": "Evidence first, question last. Answer with names from the evidence.\n{evidence}\nCandidates: {candidates}\nQuestion: {question}\nReply as <answer>\\boxed{{name}}</answer>",
    "retry": "Your last reply held no usable answer: {problem}\nQuestion: {question}\nCandidates: {candidates}\nReply with the tag alone: <answer>\\boxed{{name}}</answer>",
    "not_in_graph": "These names are not in the graph: {problem}\nQuestion: {question}\nCandidates: {candidates}\nReply with names from the candidates: <answer>\\boxed{{name}}</answer>",
}
STYLES = ("default", "check", "ecot", "entity", "entity-lite", "v2", "v3")


def prompt(name: str, **parts: Column) -> Column:
    """A template with its {parts} in place; a missing or null part is empty."""
    pieces: list[Column] = []
    text, at = TEMPLATES[name].replace("{{", "\x00").replace("}}", "\x01"), 0
    while at < len(text):
        lo = text.find("{", at)
        fixed = text[at : lo if lo >= 0 else len(text)].replace("\x00", "{").replace("\x01", "}")
        pieces.append(F.lit(fixed))
        if lo < 0:
            break
        hi = text.index("}", lo)
        pieces.append(F.coalesce(parts.get(text[lo + 1 : hi], F.lit("")).cast("string"), F.lit("")))
        at = hi + 1
    return F.concat(*pieces)


def numbered(items: Column) -> Column:
    """Lines '1. item' of an array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def graph_evidence(stored: Column) -> Column:
    """The evidence part of a stored prompt: what stands between its question and the reply line."""
    after = F.regexp_extract(stored, r"(?s)Question: [^\n]*\n(.*?)\nReply ", 1)
    return F.when(after != "", after)
