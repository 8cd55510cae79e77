"""JSON rules: sources encoded more than once, objects in free text, action and oracle checks."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from engram.functions.text import strip

SOURCE = "role string, chat_time string, content string"


def decoded_source(c: Column, depth: int = 3) -> Column:
    """A source object from JSON text that may be a JSON string of JSON text, up to ``depth`` times."""
    for _ in range(depth):
        c = F.when(F.ltrim(c).startswith('"'), F.get_json_object(c, "$")).otherwise(c)
    return F.from_json(c, SOURCE)


def is_object(c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))


def object_in(text: str | None, required: set[str]) -> dict | None:
    """The first JSON object in free text that has the required keys."""
    decode = json.JSONDecoder().raw_decode
    at = -1 if text is None else text.find("{")
    while at >= 0:
        try:
            value, _ = decode(text, at)
        except ValueError:
            value = None
        if isinstance(value, dict) and required <= value.keys():
            return value
        at = text.find("{", at + 1)
    return None


def first_object(required: tuple[str, ...]):
    """A function for a text column: the first JSON object in it that has the required keys, as JSON, else null."""
    need = set(required)

    @F.pandas_udf("string")
    def find(texts):
        found = (object_in(text, need) for text in texts)
        return texts.__class__([None if v is None else json.dumps(v, ensure_ascii=False) for v in found], dtype=object)

    return find


def action_error(c: Column, neighbourhood: Column) -> Column:
    """Why an edit action (JSON: operation, targets, content) is not well formed, or null.

    Targets are places in the neighbourhood.  Types are strict: true, 1.0 and "1" are no places, a number is no content.
    """
    v = F.try_parse_json(c)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit(""))
    operation = F.when(kind("$.operation") == "STRING", F.try_variant_get(v, "$.operation", "string"))
    raw = F.when(kind("$.targets").startswith("ARRAY"), F.try_variant_get(v, "$.targets", "array<variant>"))
    targets = F.when(F.forall(raw, lambda t: F.coalesce(F.schema_of_variant(t) == "BIGINT", F.lit(False))), F.transform(raw, lambda t: F.try_variant_get(t, "$", "long")))
    content = F.when(kind("$.content") == "STRING", F.try_variant_get(v, "$.content", "string"))
    n = F.size(targets)
    keys = F.array_sort(F.json_object_keys(F.to_json(v)))
    has, empty = strip(content) != "", content == ""
    return (
        F.when(~is_object(c) | ~F.coalesce(keys == F.array(*map(F.lit, ("content", "operation", "targets"))), F.lit(False)), "keys")
        .when(targets.isNull(), "targets")
        .when(content.isNull(), "content")
        .when(~F.coalesce(operation.isin("add", "merge", "delete", "noop"), F.lit(False)), "operation")
        .when(F.size(F.array_distinct(targets)) != n, "repeated")
        .when(F.exists(targets, lambda t: (t < 0) | (t >= neighbourhood)), "range")
        .when((operation == "add") & ((n > 0) | ~has), "shape")
        .when((operation == "merge") & ((n == 0) | ~has), "shape")
        .when((operation == "delete") & ((n == 0) | ~empty), "shape")
        .when((operation == "noop") & ((n > 0) | ~empty), "shape")
    )
