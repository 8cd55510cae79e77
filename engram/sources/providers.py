"""Outside models as columns: embedders, rerankers, answerers, judges.

A provider is a factory, called once in each task, for a function from a list of
requests to a list of results.  Failures become values: a batch that fails is
halved until the items that fail stand alone, each with its error.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.functions.jsonx import object_in
from engram.functions.text import document_text, normal_question, strip
from engram.session import checkpointed


def resolved(call: Callable[[list], list], items: list, alone: int = 1, shared: int = 1) -> list[tuple[object, str | None, int]]:
    """(result, error, requests made) of each item; the requests of a batch are booked on its first item.

    A batch is asked for up to ``shared`` times, each time for those of its items that have no result yet, a batch of one item
    up to ``alone`` times.  What is left is halved, and each half is asked for likewise, until single items fail by
    themselves.  A call fails whole if it raises or returns another number of results; a result that is an exception is
    that item's failure.
    """
    results: list[object] = [None] * len(items)
    errors: list[str | None] = [None] * len(items)
    parts, requests = deque([list(range(len(items)))]), 0
    while parts:
        left = whole = parts.popleft()
        for _ in range(alone if len(items) == 1 else shared):
            if not left:
                break
            requests += 1
            try:
                found = call([items[i] for i in left])
                if len(found) != len(left):
                    raise ValueError(f"{len(found)} results for {len(left)} items")
            except Exception as error:
                found = [error] * len(left)
            for i, value in zip(left, found, strict=True):
                failed = isinstance(value, Exception)
                results[i], errors[i] = (None, f"{type(value).__name__}: {value}") if failed else (value, None)
            left = [i for i in left if errors[i] is not None]
        if len(left) > 1:
            parts.extendleft([left[len(left) // 2 :], left[: len(left) // 2]])
        elif left and len(whole) > 1:
            parts.appendleft(left)
    return [(r, e, requests * (k == 0)) for k, (r, e) in enumerate(zip(results, errors, strict=True))]


def with_results(rows: DataFrame, column: str, factory: Callable[[], Callable[[list], list]], result_type: str, batch: int = 4, alone: int = 1, shared: int = 1, open_requests: int = 1, skip_null: bool = False) -> DataFrame:
    """``rows`` with result, error and requests of an outside function over ``column``.

    A task has up to ``open_requests`` batches under way at once, so the function must allow calls from as many threads; rows
    keep their order.  With ``skip_null``, a null is not asked for: no result, no error, no request.  ``alone`` and
    ``shared`` are as for ``resolved``.  A task that is lost asks again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = factory()
        with ThreadPoolExecutor(max_workers=open_requests) as pool:
            for frame in frames:
                items = [list(x) if isinstance(x, np.ndarray) else x for x in frame[column]]
                asked = [k for k, x in enumerate(items) if not (skip_null and x is None)]
                found = [(None, None, 0)] * len(items)
                dealt = [asked[lo : lo + batch] for lo in range(0, len(asked), batch)]
                for places, said in zip(dealt, pool.map(lambda ks: resolved(call, [items[k] for k in ks], alone, shared), dealt), strict=True):
                    for k, one in zip(places, said, strict=True):
                        found[k] = one
                add = {name: pd.Series([x[at] for x in found], index=frame.index, dtype=kind) for at, (name, kind) in enumerate((("result", object), ("error", object), ("requests", int)))}
                yield frame.assign(**add)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, result {result_type}, error string, requests int")


def with_retry(call: Callable[[object], str], required: tuple[str, ...], attempts: int = 3) -> Callable[[object], dict]:
    """Ask until the answer has a JSON object with the keys in it; the last error is raised."""

    def ask(item):
        last: Exception = ValueError("no attempt")
        for _ in range(attempts):
            try:
                value = object_in(call(item), set(required))
                if value is None:
                    raise ValueError("keys")
                return value
            except ValueError as error:
                last = error
        raise ValueError(f"no valid answer in {attempts} attempts: {last}")

    return ask


def hashed_embedder(size: int = 64) -> Callable[[], Callable[[list], list]]:
    """A deterministic stand-in: word hashes summed in ``size`` places."""

    def factory():
        def embed(texts):
            out = []
            for t in texts:
                v = [0.0] * size
                for w in (t or "").lower().split():
                    d = hashlib.md5(w.encode()).digest()
                    v[d[0] % size] += 1.0 if d[1] % 2 else -1.0
                out.append(v)
            return out

        return embed

    return factory


def embedded(nodes: DataFrame, cache: DataFrame | None, factory=None, batch: int = 10) -> DataFrame:
    """id, text_hash, vector of ``nodes`` (id, content and, if there are any, tags, which belong to the text).

    Only texts that the cache lacks are embedded; a text whose request failed has no row, so that the next call asks again.
    """
    whole = document_text(F.col("content"), F.col("tags")) if "tags" in nodes.columns else F.col("content")
    keyed = nodes.select("id", whole.alias("text")).withColumn("text_hash", F.sha2("text", 256))
    missing = keyed if cache is None else keyed.join(cache, ["id", "text_hash"], "left_anti")
    made = with_results(missing, "text", factory or hashed_embedder(), "array<double>", batch).where("error is null").select("id", "text_hash", F.col("result").alias("vector"))
    return made if cache is None else cache.join(keyed, ["id", "text_hash"], "left_semi").select("id", "text_hash", "vector").unionByName(made)


def cached_results(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with a cached result, those without) by key."""
    return requests.join(cache, "key"), requests.join(cache, "key", "left_anti")


def through_cache(requests: DataFrame, cache: DataFrame, ask) -> tuple[DataFrame, DataFrame]:
    """(``requests`` with result and error, the cache with what is new) by key; ``cache`` has key and result.

    ``ask(rows)`` gives key, result, error; it gets one row for each key that the cache lacks.  A failure is no entry.  A null
    key is asked for by itself, and never kept.
    """
    known, missing = cached_results(requests.where("key is not null"), cache)
    fresh = checkpointed(ask(missing.dropDuplicates(["key"])).select("key", "result", "error"))
    keyless = requests.where("key is null").withColumn("key", F.uuid())
    keyless = checkpointed(keyless)
    alone = keyless.join(ask(keyless).select("key", "result", "error"), "key", "left").withColumn("key", F.lit(None).cast(requests.schema["key"].dataType))
    out = known.withColumn("error", F.lit(None).cast("string")).unionByName(missing.join(fresh, "key", "left")).unionByName(alone)
    return out, cache.select("key", "result").unionByName(fresh.where("error is null").select("key", "result"))


def identity_plan(queries: DataFrame) -> DataFrame:
    """The query plan without a parser: the query itself, no keywords, no tags."""
    return parsed_plan(queries.withColumn("response", F.lit(None).cast("string")))


def parsed_plan(queries: DataFrame) -> DataFrame:
    """Plans from a parser's answers: ``queries`` (query_id, query, response).

    The response is JSON with rewritten_query, retrieval_queries, keywords and tags; items are trimmed and blank ones
    dropped.  What is missing has its default; a malformed response, or none, is the query itself.
    """
    v = F.try_parse_json("response")
    said = F.try_variant_get(v, "$.rewritten_query", "string")
    rewritten = strip(F.when(F.coalesce(said, F.lit("")) == "", F.col("query")).otherwise(said))
    listed = lambda name, default: F.filter(F.transform(F.coalesce(F.try_variant_get(v, f"$.{name}", "array<string>"), default), strip), lambda x: x != "")
    none = F.array().cast("array<string>")
    return queries.select("query_id", "query", rewritten.alias("rewritten_query"), listed("retrieval_queries", F.array(rewritten)).alias("retrieval_queries"), listed("keywords", none).alias("keywords"), listed("tags", none).alias("tags"))


def cached_plans(queries: DataFrame, cache: DataFrame, ask) -> DataFrame:
    """Plans of ``queries`` (query_id, query): those that ``cache`` (query, response) has, and for others what ``ask`` (query to
    query, response) says; a query that repeats is asked once."""
    missing = queries.select("query").distinct().join(cache, "query", "left_anti")
    known = cache.select("query", "response").unionByName(ask(missing).select("query", "response"))
    return parsed_plan(queries.join(known, "query", "left"))


def oracle_key(route_signature: Column, question: Column) -> Column:
    """The key of an oracle's answer in a cache: route and normal form of the question."""
    return F.concat_ws("|", route_signature, normal_question(question))


def request_accounting(results: DataFrame, batch: int = 4) -> DataFrame:
    """requests, fallbacks (beyond one for each batch of ``batch`` items), first_error and errors of ``results`` (id, requests, error)."""
    beyond = F.sum("requests") - F.ceil(F.count("*") / batch)
    return results.agg(F.sum("requests").alias("requests"), beyond.cast("long").alias("fallbacks"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("id"))).alias("first_error"), F.count_if(F.col("error").isNotNull()).alias("errors"))
