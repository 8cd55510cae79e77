"""Operator 4: repeated lines removed by digest, with the original offsets kept.

Units are lines, paragraphs (runs of text between blank lines) or, as the query
has them, the pieces of lines: a long line also ends a unit where a punctuation
mark and a space follow ``PIECE`` characters without a mark, if as many are left
on the line.  Whether a unit ends at a place depends on its neighbourhood alone,
so a passage that stands in the midst of two different lines is cut alike in
both, but for its ends.  A line that repeats whole repeats in all its pieces.

A unit is normalised (ASCII lower case, white space runs as one space, ends
trimmed) and, if anything is left, hashed to 128 bits; ``min_chars`` sets a higher
floor.  Digests are grouped over all documents with partial aggregation; only
those that occur twice go on, with their earliest occurrence by (doc_id, unit
number).  Their occurrences are joined back on the digest, a plain join that
adaptive execution may split where one line stands in a third of all documents.
Each document then loses the spans found for it.

Spans are character offsets in the original text, end exclusive, and take the
unit's break with them, so the kept text is what lies between.  Null texts
stay null, without units; a blank unit is none and stays.  Rows that share a doc_id
are ranked by their text's hash; rows equal in both are one document, of which each
gets the same result.  A null doc_id ranks last.  An empty table gives no rows.  Other
columns of the documents are returned as they were, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, slices, staged

PIECE = 30
_TO_LOWER = {c: c + 32 for c in range(65, 91)}
_SPACES = re.compile(r"[ \t\r\n\f\v]+")
_BREAKS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n(?:[ \t\r]*\n)+")}
_MARKS = re.compile(r"\n|[.!?,;:]([ \t]*)")


def breaks(text: str, unit: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what ends each unit but the last."""
    if unit != "piece":
        yield from (m.span() for m in _BREAKS[unit].finditer(text))
        return
    since = 0  # where the characters without a mark begin
    for m in _MARKS.finditer(text):
        at, end = m.span()
        if m.group(1) is None:
            since = end
        elif m.group(1) and at - since >= PIECE - 1 and len(text) - end >= PIECE and text.find("\n", end, end + PIECE) < 0:
            at, since = at + 1, end
        else:
            since = at + 1
            continue
        yield at, end


def units(text: str, unit: str) -> Iterator[tuple[int, int, str]]:
    """(start, end with the break, normal form) of each unit."""
    at = 0
    for start, end in breaks(text, unit):
        yield at, end, _SPACES.sub(" ", text[at:start].translate(_TO_LOWER)).strip(" ")
        at = end
    yield at, len(text), _SPACES.sub(" ", text[at:].translate(_TO_LOWER)).strip(" ")


def _hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text and text_hash, which tells rows of one doc_id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def digests(docs: DataFrame, unit: str = "piece", min_chars: int = 1) -> DataFrame:
    """doc_id, text_hash, and for each unit of at least ``min_chars`` hi, lo, k (unit number), start, end."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            row, found = [], []
            for r, text in enumerate(batch["text"].to_pylist()):
                for k, (start, end, normal) in enumerate(units(text, unit) if text else ()):
                    if len(normal) >= min_chars:
                        d = xxhash.xxh128_intdigest(normal)
                        row.append(r)
                        found.append(((d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63), k, start, end))
            columns = list(zip(*found, strict=True)) or [()] * 5
            kinds = [*[pa.int64()] * 2, *[pa.int32()] * 3]
            own = [batch[c].take(pa.array(row, pa.int64())) for c in ("doc_id", "text_hash")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["doc_id", "text_hash", "hi", "lo", "k", "start", "end"])

    kind = dict(docs.dtypes)["doc_id"]
    return _hashed(docs).mapInArrow(cut, f"doc_id {kind}, text_hash long, hi long, lo long, k int, start int, end int")


def removed_spans(docs: DataFrame, unit: str = "piece", min_chars: int = 1) -> DataFrame:
    """doc_id, text_hash, spans (sorted array of start, end): units that stand earlier in the corpus."""
    found = staged(digests(docs, unit, min_chars), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "k")
    # a digest of one place has one rank, however many equal rows hold it
    firsts = found.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.max(rank).alias("last")).where("first < last").drop("last")
    again = found.join(staged(firsts, "first-units"), ["hi", "lo"]).where(rank > F.col("first"))
    return again.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))


def dedup_units(docs: DataFrame, unit: str = "piece", min_chars: int = 1) -> DataFrame:
    """``docs`` with text cut, and spans (what was removed) added; if ``docs`` has a column spans, its name is ``fresh``."""
    (added,) = fresh(docs.columns, "spans")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("text").alias("h"))
    gone = removed_spans(docs, unit, min_chars).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("x"), F.col("spans").alias("gone"))
    both = rows.join(gone, F.col("row.doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("x")), "left")
    kept = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(_cut()(F.col("row.text"), F.col("gone")))
    spans = F.coalesce("gone", F.array().cast("array<struct<start:int,end:int>>"))
    return both.select(*[(kept if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns], spans.alias(added))


def _cut():
    @F.arrow_udf("string")
    def cut(text, spans):
        out = []
        for t, gone in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            parts, at = [], 0
            for span in gone or ():
                parts.append(t[at : span["start"]])
                at = span["end"]
            out.append(None if t is None else "".join(parts) + t[at:])
        return pa.array(out, pa.string())

    return cut


def _op4(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    out = dedup_units(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), unit)
    return out.select(
        "doc_id",
        F.size("spans").cast("long").alias("n_removed"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"])).alias("removed_chars"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and their pieces over ``documents``: one row a document with what was removed and a digest of what is left."""
    return _op4(spark, sf_dir, "piece")


def op4_line_dedup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole lines as units."""
    return _op4(spark, sf_dir, "line")


#: The query's result by window functions, for either kind of unit (``@UNITS@`` gives a line's units with their breaks).
OP4_UNITS = r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, j, line || CASE WHEN j < max(j) OVER (PARTITION BY doc_id) THEN chr(10) ELSE '' END AS line FROM l),
c AS (SELECT doc_id, j, @UNITS@ AS units FROM b),
u AS (SELECT doc_id, j, unnest(units) AS unit, generate_subscripts(units, 1) AS i FROM c),
p AS (
  SELECT doc_id, j, i, unit, length(unit) AS n,
    coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY j, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\n\f\v]+', ' ', 'g'), ' ') AS normal FROM u),
d AS (SELECT *, normal <> '' AND row_number() OVER (PARTITION BY normal ORDER BY doc_id, j, i) > 1 AS gone FROM p),
s AS (
  SELECT doc_id, count(*) AS n_removed, CAST(sum(n) AS BIGINT) AS removed_chars,
    string_agg(CAST(start AS BIGINT) || '-' || CAST(start + n AS BIGINT), ',' ORDER BY j, i) AS spans
  FROM d WHERE gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(unit, '' ORDER BY j, i) AS rest FROM d WHERE NOT gone GROUP BY doc_id)
SELECT t.doc_id, coalesce(s.n_removed, 0) AS n_removed, coalesce(s.removed_chars, 0) AS removed_chars, coalesce(s.spans, '') AS spans,
  sha256(coalesce(kept.rest, '')) AS kept_sha256
FROM documents t LEFT JOIN s ON t.doc_id = s.doc_id LEFT JOIN kept ON t.doc_id = kept.doc_id
"""
OP4_WHOLE_SQL = OP4_UNITS.replace("@UNITS@", "[line]")
_MARKED = rf"string_split(regexp_replace(line, '([^.!?,;:\n]{{{PIECE - 1},}}[.!?,;:][ \t]+)', '\1' || chr(1), 'g'), chr(1))"
#: A last piece that is too short belongs to the one before it.
_JOINED = f"CASE WHEN len(m) > 1 AND length(rtrim(m[-1], chr(10))) < {PIECE} THEN list_append(m[:-3], m[-2] || m[-1]) ELSE m END"
OP4_SQL = OP4_UNITS.replace("c AS (SELECT doc_id, j, @UNITS@ AS units FROM b)", f"c AS (SELECT doc_id, j, {_JOINED} AS units FROM (SELECT doc_id, j, {_MARKED} AS m FROM b))")
