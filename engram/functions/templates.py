"""What outside models are shown: prompts and payloads as JSON text, built by columns.

Text is written as it is, not escaped to ASCII.  ``spaced`` JSON has a space after commas and colons,
compact JSON has none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(c: Column) -> Column:
    """A JSON string literal, or null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(_inner(F.to_json(F.array(c))))


def _inner(array: Column) -> Column:
    return array.substr(F.lit(2), F.length(array) - 2)


def listed(items: Column, one=quoted, spaced: bool = True) -> Column:
    """A JSON list; ``one`` writes an element."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")) if one is quoted else items, one), ", " if spaced else ","), F.lit("]"))


def record(fields: dict[str, Column], spaced: bool = True) -> Column:
    """A JSON object of columns that are JSON already, in the order given; a null column's field is left out."""
    colon = ": " if spaced else ":"
    parts = F.array(*(F.concat(F.lit(f'"{name}"{colon}'), value) for name, value in fields.items()))
    return F.concat(F.lit("{"), F.array_join(F.filter(parts, lambda p: p.isNotNull()), ", " if spaced else ","), F.lit("}"))


def span(c: Column) -> Column:
    """A time span (start, end) as a list, or null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), quoted(c["start"]), F.lit(", "), quoted(c["end"]), F.lit("]")))


def chat(system: Column, user: Column) -> Column:
    """A prompt of a system turn and a user turn, which asks for no thinking."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", system), turn("user", F.concat(user, F.lit("\n\n/no_think"))))


def attacker_payload(evidence: Column, mode: Column, dimension: Column, known: Column) -> Column:
    """What a question writer sees of a route: evidence memories, a comparison's dimension, contents of known memories."""
    shown = F.when((mode == "comparison") & (F.coalesce(dimension, F.lit("")) != ""), quoted(dimension))
    return record({"target": listed(evidence), "dimension": shown, "known": listed(known)})


def oracle_context(mode: Column, dimension: Column, sources: Column) -> Column:
    """The raw evidence, as columns: mode, dimension, source_records."""
    return F.struct(mode.alias("attack_mode"), dimension.alias("mode_dimension"), sources.alias("source_records"))


def oracle_payload(mode: Column, sources: Column, items: Column, dimension: Column) -> Column:
    """An oracle's request: sources (role, chat_time, content) by place, items (id, question)."""
    source = lambda s, i: record({"id": i.cast("string"), "role": quoted(s["role"]), "time": quoted(s["chat_time"]), "content": quoted(s["content"])}, spaced=False)
    item = lambda x: record({"id": x["id"].cast("string"), "question": quoted(x["question"])}, spaced=False)
    shown = F.when(F.coalesce(dimension, F.lit("")) != "", quoted(dimension))
    return record({"mode": quoted(mode), "sources": listed(sources, source, spaced=False), "items": listed(items, item, spaced=False), "dimension": shown}, spaced=False)


def neighbourhood(nodes: Column) -> Column:
    """Memories (content, linked_questions, tags, time_span) as an edit writer addresses them: by place."""
    one = lambda n, i: record({"index": i.cast("string"), "content": quoted(n["content"]), "linked_questions": listed(n["linked_questions"]), "tags": listed(n["tags"]), "time_span": span(n["time_span"])})
    return listed(nodes, one)


def protected(questions: Column) -> Column:
    one = lambda q: record({"id": quoted(q["question_id"]), "question": quoted(q["question"]), "canonical_answer": quoted(q["canonical_answer"])})
    return listed(questions, one)


def builder_payload(question: Column, evidence: Column, nodes: Column, questions: Column) -> Column:
    """What an edit writer sees: the question, evidence (quote, chat_time, role), memories nearby, questions to keep."""
    shown = lambda e: record({"text": quoted(e["quote"]), "time": quoted(e["chat_time"]), "role": quoted(e["role"])})
    return record({"question": quoted(question), "new_evidence": listed(evidence, shown), "memory_neighborhood": neighbourhood(nodes), "protected_questions": protected(questions)})


def compaction_payload(nodes: Column, questions: Column) -> Column:
    return record({"memory_neighborhood": neighbourhood(nodes), "protected_questions": protected(questions)})


def plain_values(columns: list[tuple[str, str]]) -> list[Column]:
    """Columns (name, type) with times and dates as ISO text, so that they can be written as JSON anywhere."""
    iso = {"timestamp": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestamp_ntz": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "date": "yyyy-MM-dd"}
    return [(F.date_format(name, iso[kind]) if kind in iso else F.col(f"`{name}`")).alias(name) for name, kind in columns]


def _blocks(rows: Column, head) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(head(r), F.lit("\n"), F.coalesce(r["content"], F.lit("")))), "\n\n")


def _or_none(c: Column, quote: str = "") -> Column:
    """A text, in quotes if asked, or the word None."""
    return F.coalesce(F.concat(F.lit(quote), c, F.lit(quote)), F.lit("None"))


def source_block(sources: Column) -> Column:
    """Sources (source_id, chat_time, role, content) as the context of an answer."""
    return _blocks(sources, lambda s: F.concat(F.lit("["), s["source_id"], F.lit("] time="), _or_none(s["chat_time"]), F.lit(" role="), _or_none(s["role"])))


def memory_block(memories: Column) -> Column:
    """Memories (id, time_span, content) as the context of an answer; a span is a pair of quoted times."""
    span = lambda t: F.coalesce(F.when(t.isNotNull(), F.concat(F.lit("("), _or_none(t["start"], "'"), F.lit(", "), _or_none(t["end"], "'"), F.lit(")"))), F.lit("None"))
    return _blocks(memories, lambda m: F.concat(F.lit("["), m["id"], F.lit("] time="), span(m["time_span"])))


def answer_prompt(question: Column, context: Column, system: str = "") -> Column:
    """The turns that ask for an answer from a context; ``system`` is the caller's instruction."""
    user = F.concat(F.lit("Context:\n"), context, F.lit("\n\nQuestion:\n"), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
