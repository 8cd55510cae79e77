"""Operator 7: benchmark decontamination with a distributed positional inverted index.

The index holds the postings of every training term: a row for each term and
block of documents with the places where it stands.  A block is a slice of about
``BLOCK_BYTES`` of text, so the list of a word that all documents use stands in as
many rows as there are blocks, none longer than a block.  Places number a block's
words, with ``GAP`` left out after each document, so that no window crosses
documents; the table of documents has each one's first place.  Building it is one pass
over the texts without a shuffle; any benchmark can be looked up in it afterwards.

Test items are cut into windows of ``width`` consecutive words.  The index counts
the test terms, and each window's terms are taken from the rarest on.

*Phrases*: the list of the rarest term, shifted back by its offset, gives the
candidate starts; they are intersected with the list of the second rarest term,
shifted by its own, and what is left with those of all others.  A window with a
term that no document has is dropped.

*Proximity*: of a window's d different terms m must be met within ``width`` - 1
places of one of them.  Its d - m + 1 rarest include one that is there, and its
d - m + 2 rarest two: places of the former with another of the latter nearby are
candidates, whose neighbourhood is then sought for all terms.  A place of a term that
the window is entered under is a proximity match if m different terms are met and
the window doesn't stand there word for word.  ``contaminated`` goes by phrases alone.

Lists meet candidates in equi-joins on (term, block), which an adaptive join may
split; a side is broadcast only if it has few rows (``small_side``).  Terms are
64-bit hashes of words; a window matches if all its hashes do.

Null and empty texts have no words.  An item without words has no window.
Repeated rows, rows that share a doc_id and rows without one are documents of
their own with a row each in the result.  Equal windows of several
items count for each of them; null item_ids are left out.  Empty tables give no
hits.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_side, staged

WIDTH = 10
#: Part of a window's different terms that a proximity match has.
SHARE = 0.8
BLOCK_BYTES = 2 << 20
#: Places between documents; windows are no wider.
GAP = 1000
#: Ascending numbers are written as differences.
DELTAS = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "false"}
#: What stands between words, before lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit term hashes of all words, offsets of each text in them)."""
    plain = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), BETWEEN, " "))
    lists = pc.split_pattern(pc.ascii_trim_whitespace(plain), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = pc.dictionary_encode(lists.flatten())
    codes = coded.indices.to_numpy()
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct)).view(np.int64)
    real = np.fromiter((w != "" for w in distinct), bool, len(distinct))[codes]
    return hashes[codes[real]], np.concatenate([[0], np.cumsum(real)])[bounds]


def windows_of(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """terms (array of hashes) and items (sorted distinct item_ids) of each different window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, bounds = words(batch["text"])
            items, windows = [], []
            for item, a, b in zip(batch["item_id"].to_pylist(), bounds, bounds[1:], strict=False):
                for k in range(a, max(a + 1, b - width + 1)) if b > a else ():
                    items.append(item), windows.append(found[k : min(b, k + width)])
            yield pa.RecordBatch.from_pydict({"item_id": pa.array(items, batch.schema.field("item_id").type), "terms": pa.array(windows, pa.list_(pa.int64()))})

    kind = dict(benchmark.dtypes)["item_id"]
    cuts = benchmark.select("item_id", "text").where("item_id is not null").mapInArrow(cut, f"item_id {kind}, terms array<long>")
    return cuts.groupBy("terms").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


class Index(NamedTuple):
    """``postings``: term, block, n, places; ``documents``: doc_id, block, doc (its number there), first (its first place), n_words."""

    postings: DataFrame
    documents: DataFrame


def build_index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Index:
    """The written index of ``docs`` (doc_id, text)."""
    schema = f"block long, doc int, doc_id {dict(docs.dtypes)['doc_id']}, first int, n_words long, term long, n int, places array<int>"

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", block_bytes):
            found, bounds = words(batch["text"])
            n = np.diff(bounds)
            skipped = GAP * np.arange(len(n))
            place = (np.arange(len(found)) + np.repeat(skipped, n)).astype(np.int32)
            order = np.argsort(found, kind="stable")
            terms = found[order]
            begins = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(terms) else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(terms)), pa.int32()), pa.array(place[order]))
            none = lambda kind, rows: pa.nulls(rows, kind)
            names = ["block", "doc", "doc_id", "first", "n_words", "term", "n", "places"]
            kind, rows = batch.schema.field("doc_id").type, len(begins)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), block)), pa.array(np.arange(len(n), dtype=np.int32)), batch["doc_id"], pa.array((bounds[:-1] + skipped).astype(np.int32)), pa.array(n), none(pa.int64(), len(n)), none(pa.int32(), len(n)), none(lists.type, len(n))], names)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, block)), none(pa.int32(), rows), none(kind, rows), none(pa.int32(), rows), none(pa.int64(), rows), pa.array(terms[begins]), pa.array(np.diff(np.append(begins, len(terms))).astype(np.int32)), lists], names)
            block += 1

    both = staged(docs.select("doc_id", "text").mapInArrow(post, schema), "index", **DELTAS)
    return Index(both.where("term is not null").select("term", "block", "n", "places"), both.where("doc is not null").select("doc_id", "block", "doc", "first", "n_words"))


def ranked_windows(windows: DataFrame, index: Index) -> DataFrame:
    """w (the window's number), items, terms, and its terms from the rarest on as (n, at, term): ``pairs`` with
    every place in the window, ``different`` with the first place of each.  Written."""
    numbered = staged(windows.withColumn("w", F.monotonically_increasing_id()), "windows")
    each = numbered.select("w", F.posexplode("terms").alias("at", "term"))
    sought = staged(each.select("term").distinct(), "test-terms")
    counts = index.postings.join(small_side(sought), "term").groupBy("term").agg(F.sum("n").alias("n"))
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "at", "term")
    counted = each.join(counts, "term", "left")
    pairs = counted.groupBy("w").agg(F.array_sort(F.collect_list(rank)).alias("pairs"))
    first = counted.groupBy("w", "term").agg(F.min(rank).alias("r")).groupBy("w").agg(F.array_sort(F.collect_list("r")).alias("different"))
    return staged(numbered.join(pairs, "w").join(first, "w"), "ranked")


def _entries(ranked: DataFrame, chosen) -> DataFrame:
    """w, term, at of the chosen (n, at, term) of each window; written, as few rows may be broadcast."""
    return staged(ranked.select("w", F.explode(chosen).alias("e")).select("w", "e.term", "e.at"), "entries")


def _probed(index: Index, entries: DataFrame, probes: DataFrame, met) -> DataFrame:
    """``probes`` (term, block and more) whose list fulfils ``met``; their terms are among the ``entries``'."""
    sought = small_side(staged(entries.select("term").distinct(), "terms"))
    return index.postings.select("term", "block", "places").join(sought, "term", "left_semi").join(probes, ["term", "block"]).where(met).drop("places")


def phrase_matches(index: Index, ranked: DataFrame) -> DataFrame:
    """w, block, start, size of each place where a window stands word for word."""
    known = ranked.where(F.col("pairs")[0]["n"] > 0).withColumn("size", F.size("pairs"))
    sizes = known.select("w", "size")
    stands = F.array_contains("places", F.col("start") + F.col("at"))
    rarest = small_side(_entries(known, F.slice("pairs", 1, 1)).join(sizes, "w"))
    found = index.postings.join(rarest, "term").select("w", "size", "block", F.explode("places").alias("place"), "at").select("w", "size", "block", (F.col("place") - F.col("at")).alias("start"))
    second = _entries(known, F.slice("pairs", 2, 1))
    two = staged(_probed(index, second, found.where("size > 1").join(small_side(second), "w"), stands).select("w", "size", "block", "start"), "candidates")
    rest = _entries(known, F.slice("pairs", F.lit(3), F.greatest(F.size("pairs") - 2, F.lit(0))))
    probes = small_side(staged(two.where("size > 2").join(small_side(rest), "w").select("term", "block", "w", "size", "start", "at"), "probes"))
    whole = _probed(index, rest, probes, stands).groupBy("w", "size", "block", "start").agg(F.count("*").alias("met")).where("met = size - 2").drop("met")
    return found.where("size = 1").unionByName(two.where("size = 2")).unionByName(whole).select("w", "block", "start", "size")


def needed(share: float):
    """How many of a window's different terms are ``share`` of them, rounded up."""
    return F.ceil(F.lit(share) * F.size("different") - 1e-9).cast("int")


def entered(share: float):
    """The (n, at, term) a window is entered under for proximity: its rarest, one of which is there wherever it matches."""
    return F.filter(F.slice("different", F.lit(1), F.size("different") - needed(share) + 1), lambda e: e["n"] > 0)


def proximity_matches(index: Index, ranked: DataFrame, phrases: DataFrame, share: float = SHARE, width: int = WIDTH) -> DataFrame:
    """w, block, place, found: places of a term that a window is entered under with at least ``share`` of the window's
    different terms around them, but not the phrase (``phrases``, of the same windows)."""
    near = lambda p: F.abs(p - F.col("place")) < width
    sizes = ranked.select("w", needed(share).alias("m"))
    seeds = small_side(_entries(ranked, entered(share)).join(sizes, "w"))
    found = index.postings.join(seeds, "term").select("w", "m", "block", F.col("term").alias("own"), F.explode("places").alias("place"))
    rarest = F.filter(F.slice("different", F.lit(1), F.size("different") - needed(share) + 2), lambda e: e["n"] > 0)
    rare = _entries(ranked, rarest)
    others = found.where("m > 1").join(small_side(rare), "w").where("term <> own").select("term", "block", "w", "m", "own", "place")
    two = staged(_probed(index, rare, others, F.exists("places", near)).select("w", "m", "block", "own", "place").distinct(), "near-candidates")
    every_term = _entries(ranked, F.filter("different", lambda e: e["n"] > 0))
    rest = two.join(small_side(every_term), "w").where("term <> own").select("term", "block", "w", "m", "place")
    met = _probed(index, every_term, small_side(staged(rest, "near-probes")), F.exists("places", near)).groupBy("w", "m", "block", "place").agg((F.count("*") + 1).alias("found")).where("found >= m")
    every = met.select("w", "block", "place", "found").unionByName(found.where("m <= 1").select("w", "block", "place", F.lit(1).cast("long").alias("found")))
    over = F.explode(F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda k: F.col("start") + k))
    return every.join(phrases.select("w", "block", over.alias("place")), ["w", "block", "place"], "left_anti")


def _placed(matches: DataFrame, index: Index, place: str) -> DataFrame:
    """``matches`` with the number of the document that ``place`` is in; a block's documents meet its matches only."""
    inside = (F.col(place) >= F.col("first")) & (F.col(place) < F.col("first") + F.col("n_words"))
    return matches.join(index.documents.select("block", "doc", "first", "n_words").where("n_words > 0"), "block").where(inside).drop("first", "n_words")


def _items(matches: DataFrame, ranked: DataFrame, name: str) -> DataFrame:
    """block, doc and the sorted item_ids (as strings) of the windows matched."""
    each = matches.select("block", "doc", "w").distinct().join(ranked.select("w", F.explode("items").alias("item")), "w")
    return each.groupBy("block", "doc").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float | None = None, index: Index | None = None) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items, contaminated; with ``share`` also n_near (places of
    proximity matches), n_near_items and near_items.  An ``index`` made before saves building it from ``docs``."""
    if not 0 < width <= GAP:
        raise ValueError(f"windows have 1 to {GAP} words")
    index = index or build_index(docs)
    ranked = ranked_windows(windows_of(benchmark, width), index)
    matches = staged(_placed(phrase_matches(index, ranked), index, "start"), "matches")
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach"))
    more = lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], s["end"]).alias("reach"))
    hits = matches.groupBy("block", "doc").agg(F.aggregate(spans, nothing, more)["n"].cast("long").alias("n_hit"))
    none = F.array().cast("array<string>")
    found = index.documents.join(hits, ["block", "doc"], "left").join(_items(matches, ranked, "items"), ["block", "doc"], "left")
    columns = ["doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), F.col("n_hit").isNotNull().alias("contaminated")]
    if share is not None:
        close = staged(_placed(proximity_matches(index, ranked, matches, share, width), index, "place"), "near-matches")
        near = close.groupBy("block", "doc").agg(F.count_distinct("place").alias("n_near"))
        found = found.join(near, ["block", "doc"], "left").join(_items(close, ranked, "near_items"), ["block", "doc"], "left")
        columns += [F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.coalesce(F.size("near_items"), F.lit(0)).cast("long").alias("n_near_items"), F.coalesce("near_items", none).alias("near_items")]
    return found.select(*columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents`` and ``benchmark``."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op7_decontamination``, and for each document its proximity matches."""
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), share=SHARE)
    digest = lambda c: F.sha2(F.array_join(c, ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest("items").alias("items_sha256"), "contaminated", "n_near", "n_near_items", digest("near_items").alias("near_items_sha256"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
run AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT r.doc_id, r.s, r.n, win.item_id FROM run r JOIN win ON r.t = win.t AND r.n = win.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
