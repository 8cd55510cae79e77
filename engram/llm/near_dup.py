"""Operator 2: near-duplicate documents from bottom-k sketches of one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; its sketch
is the ``K`` smallest.  Documents with equal sets form a class, and only the
class's smallest doc_id goes on.  Inverted lists are kept on runs of values that
follow one another in a sketch: four, or three and two in sets of up to 15 and 5.
Of two sets with a Jaccard similarity of 0.8 at most a fifth of the union is not
shared, so it cuts the shared values into few runs, and one of them is that long.
For sets that fit their sketch this is certain at any union's size (13 shared and
3 others leave a run of four, and so on); for larger ones it fails with a chance
of about 2e-9.  Lists on runs rather than values stay short for words and passages
that many documents share.

A list links its members to its smallest, never to each other; a task does so for
the members that it holds itself, so that a list of very many documents is a few
rows of each task.  Connected lists
are clusters; only inside a cluster can links be.  A passage that many short texts
share can tie them all into one, so clusters of more than ``FEW`` documents are
taken apart: a set that is linked shares ``percent`` of its values at least, so one
more than it may lack of its rarest in the cluster hold a shared one, for any order
of values.  Only documents that share such a value stay together, and this misses
no link.

Clusters are compared in blocks of at most ``BLOCK`` documents: the similarity
estimated from the union's
sketch drops pairs that are far off, the full sets decide the others exactly, and
pairs that are joined already are passed over.  In clusters of more than ``BLOCKS``
blocks one block, with the smallest document, is compared with all others first;
the most documents that this joins are not compared among themselves.  A block
emits a spanning forest of its links, so rows grow with documents and not with
pairs.

A null or empty text has an empty set, linked with nothing.  A null doc_id is
linked with nothing and has a null component.  Rows that share a doc_id are
separate documents under one id.  An empty table gives no rows.  Columns other
than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import MIX, Earliest, finish, parts_of, slices, staged
from .components import components

#: Values that a sketch retains.
K = 96
#: (values in a run, set sizes from, to) of list keys.
RUNS = ((2, 2, 5), (3, 5, 15), (4, 13, None))
#: Documents of a block.
BLOCK = 256
#: Blocks of a cluster up to which all pairs of blocks are compared at once.
BLOCKS = 4
#: Documents of a cluster up to which it is compared as it is.
FEW = 16
SPACES = r"[\x20\x09-\x0D]+"


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes (int64)."""
    plain = pc.ascii_lower(pc.replace_substring_regex(pc.fill_null(texts.cast(pa.large_string()), ""), SPACES, " "))
    lists = pc.split_pattern(pc.utf8_trim(plain, " "), " ")
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = pc.dictionary_encode(lists.flatten())
    distinct = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in distinct), np.uint64, len(distinct))
    words = hashes[coded.indices.to_numpy()]
    empty = np.fromiter((w == "" for w in distinct), bool, len(distinct))[coded.indices.to_numpy()]
    run = words.copy()
    for k in range(1, size):
        most = max(len(run) - k, 0)
        run[:most] = run[:most] * MIX + words[k:]
    run = finish(run).view(np.int64)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a == 1 and empty[a]:
            out.append(np.zeros(0, np.int64))
        elif b - a < size:
            whole = np.uint64(b - a)
            for w in words[a:b]:
                whole = whole * MIX + w
            out.append(finish(np.array([whole])).view(np.int64))
        else:
            out.append(np.unique(run[a : b - size + 1]))
    return out


def list_keys(values: np.ndarray) -> np.ndarray:
    """Keys of the runs of retained values; ``values`` is sorted."""
    v, keys = values[:K].view(np.uint64), []
    for length, least, most in RUNS:
        if len(values) >= least and (most is None or len(values) <= most):
            h = v[: len(v) - length + 1].copy()
            for k in range(1, length):
                h = h * MIX + v[k : len(v) - length + 1 + k]
            keys.append(finish(h + np.uint64(length)))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def set_hash(values: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh128_intdigest(values.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, hi and lo (128-bit hash of the set), keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text"):
                sets = shingle_sets(batch["text"], size)
                hashes = [set_hash(s) for s in sets]
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "hi": pa.array([h for h, _ in hashes], pa.int64()), "lo": pa.array([x for _, x in hashes], pa.int64()), "keys": pa.array([list_keys(s) for s in sets], pa.list_(pa.int64()))})

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, hi long, lo long, keys array<long>")


def list_rows(classes: DataFrame) -> DataFrame:
    """rep, key, least: a row for each list that a document is in.

    Where the task has met a smaller document of the list, ``least`` is that and the row needs no list: its key is a number of
    its own.  A list that many documents share is thus a row or so of each task.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = Earliest()
        with np.errstate(over="ignore"):
            for whole in batches:
                for lo in range(0, whole.num_rows, 2048):
                    batch = whole.slice(lo, 2048)
                    lists = batch["keys"]
                    rep = np.repeat(batch["rep"].to_numpy(), np.diff(lists.offsets.to_numpy()))
                    key = lists.flatten().to_numpy()
                    least = met.of(key, np.zeros(len(key), np.int64), rep)
                    done = least < rep
                    key = np.where(done, finish(key.view(np.uint64) + rep.view(np.uint64) * MIX).view(np.int64), key)
                    yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(key), pa.array(least, mask=~done)], ["rep", "key", "least"])

    return classes.select("rep", "keys").mapInArrow(rows, "rep long, key long, least long")


def block_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among documents of one block (all of one side), or between two."""
    n = len(ids)
    flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    kept = np.full((n, K), np.iinfo(np.int64).max)
    slot = np.full((n, K), len(flat))
    for i, s in enumerate(sets):
        m = min(K, len(s))
        kept[i, :m], slot[i, :m] = s[:m], inverse[starts[i] : starts[i] + m]
    last = np.where(sizes > K, kept[:, -1], np.iinfo(np.int64).max - 1)
    tree, links, mark = np.arange(n), [], np.zeros(len(flat) + 1, bool)
    two = side.any() and not side.all()
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        j = j[(tree[j] != tree[i]) & (100 * np.minimum(sizes[j], sizes[i]) >= percent * np.maximum(sizes[j], sizes[i]))]
        j = j[side[j] != side[i]] if two else j
        if not len(j):
            continue
        mark[slot[i]] = True
        mark[-1] = False
        shared = mark[slot[j]].sum(axis=1)
        mark[slot[i]] = False
        cut = np.minimum(last[j], last[i])
        union = (kept[j] <= cut[:, None]).sum(axis=1) + (kept[i] <= cut[:, None]).sum(axis=1) - shared
        slack = np.where((sizes[j] > K) | (sizes[i] > K), 0.35, 0.0)
        j = j[shared >= (percent / 100 - slack) * union - 1e-9]
        if not len(j):
            continue
        mark[inverse[starts[i] : starts[i] + sizes[i]]] = True
        for k in j:
            both = int(mark[inverse[starts[k] : starts[k] + sizes[k]]].sum())
            if 100 * both >= percent * (sizes[i] + sizes[k] - both) and tree[k] != tree[i]:
                links.append((int(ids[i]), int(ids[k])))
                tree[tree == tree[k]] = tree[i]
        mark[inverse[starts[i] : starts[i] + sizes[i]]] = False
    return links


def sized(clusters: DataFrame) -> DataFrame:
    """``clusters`` (rep, cluster) with n, the number of documents of the cluster."""
    return clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")


def apart(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` (rep, lo, cluster, s) to (rep, cluster): the clusters taken apart; documents that can have no link are left out."""
    values = sets.select("rep", "lo", "cluster", F.size("s").alias("m"), F.explode("s").alias("value"))
    counts = values.groupBy("cluster", "value").agg(F.count("*").alias("n"))
    # documents under one id have sets of their own
    place = F.row_number().over(Window.partitionBy("rep", "lo").orderBy("n", "value"))
    firsts = values.join(counts, ["cluster", "value"]).withColumn("place", place).where(f"place <= m - ({percent} * m + 99) div 100 + 1")
    shared = staged(firsts.where("n > 1").select("rep", "cluster", "value"), "firsts")
    least = shared.groupBy("cluster", "value").agg(F.min("rep").alias("least"))
    links = shared.join(least, ["cluster", "value"]).where("rep > least").select(F.col("least").alias("u"), F.col("rep").alias("v"))
    return components(links).withColumnsRenamed({"node": "rep", "component": "cluster"})


def compared(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) of ``pairs`` (rep, cluster, s, own, other), a row for each block ``other`` that a document of block ``own`` meets:
    a spanning forest for each pair of blocks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None

        def done():
            ids, sets, side = np.array([h[0] for h in held]), [h[1] for h in held], np.array([h[2] for h in held])
            found = block_links(ids, sets, side, percent) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

        for batch in batches:
            keys = zip(*(batch[c].to_pylist() for c in ("cluster", "i", "j")), strict=True)
            for key, own_, rep, s in zip(keys, batch["own"].to_pylist(), batch["rep"].to_pylist(), batch["s"], strict=True):
                if key != last and held:
                    yield done()
                    held = []
                last = key
                held.append((rep, s.values.to_numpy(), own_ == key[2]))
        if held:
            yield done()

    rows = pairs.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "s")
    dealt = rows.repartition(parts_of(pairs.sparkSession), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "rep")
    return dealt.mapInArrow(compare, "u long, v long")


def blocks(n: str) -> Column:
    return F.ceil(F.col(n) / BLOCK).cast("int")


def block(n: Column) -> Column:
    return F.pmod(F.xxhash64("rep"), n).cast("int")


def verified(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (u, v) among ``members`` (rep, hi, lo, cluster, n): a spanning forest for each pair of blocks."""
    # a shuffle of both at any size: members grow with the corpus, too far for a broadcast
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(members.hint("merge"), "rep")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in slices(batches, "text"):
                sets = shingle_sets(batch["text"], size)
                own = np.array([set_hash(s) == (a, b) for s, a, b in zip(sets, batch["hi"].to_pylist(), batch["lo"].to_pylist(), strict=True)], bool)
                out = pa.RecordBatch.from_arrays([batch["rep"], batch["lo"], batch["cluster"], batch["n"], pa.array(sets, pa.list_(pa.int64()))], ["rep", "lo", "cluster", "n", "s"])
                yield out.filter(pa.array(own))

    whole = staged(texts.select("rep", "text", "hi", "lo", "cluster", "n").mapInArrow(full_sets, "rep long, lo long, cluster long, n long, s array<long>"), "sets")
    many = whole.where(F.col("n") > FEW)
    sets = whole.where(F.col("n") <= FEW).unionByName(many.drop("cluster", "n").join(sized(apart(many, percent)), "rep")).drop("lo")

    large = F.col("n") > BLOCKS * BLOCK
    small = sets.where(~large).withColumn("own", block(blocks("n"))).withColumn("other", F.explode(F.sequence(F.lit(0), blocks("n") - 1)))
    links = staged(compared(small.drop("n"), percent), "links")
    sets = staged(sets.where(large), "large")
    if sets.isEmpty():
        return links

    own = F.when(F.col("rep") == F.col("cluster"), 0).otherwise(block(blocks("n")))
    first = sets.withColumn("own", own).withColumn("other", F.explode(F.when(F.col("own") == 0, F.sequence(F.lit(0), blocks("n") - 1)).otherwise(F.array(F.lit(0)))))
    links = links.unionByName(found := staged(compared(first.drop("n"), percent), "links"))
    joined = sets.select("rep", "cluster").distinct().join(components(found).withColumnRenamed("node", "rep"), "rep")
    parts = joined.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    most = parts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("component"), F.max("n").alias("home"))
    homes = joined.join(most, ["cluster", "component"]).select("rep", F.lit(True).alias("at_home"))
    rest = sets.join(homes, "rep", "left").join(most.drop("component"), "cluster", "left").fillna(False, "at_home").fillna(0, "home")
    rest = rest.withColumn("others", F.col("n") - F.col("home")).where("others > 0")
    # blocks of the other documents come first, those of the joined ones after them
    own = F.when(F.col("at_home"), blocks("others") + block(blocks("home"))).otherwise(block(blocks("others")))
    met = F.when(F.col("at_home"), blocks("others")).otherwise(blocks("others") + blocks("home"))
    rest = rest.select("rep", "cluster", "s", own.alias("own"), F.explode(F.sequence(F.lit(0), met - 1)).alias("other"))
    return links.unionByName(compared(rest, percent))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; ``size`` words a shingle, ``percent`` similarity."""
    rows = staged(sketches(docs, size), "sketches")
    real = rows.where("n_shingles > 0 and doc_id is not null")
    classes = staged(real.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys")), "classes")
    least = F.coalesce("least", F.min("rep").over(Window.partitionBy("key")))
    met = list_rows(classes).withColumn("least", least).where("rep > least").groupBy("rep").agg(F.min("least").alias("v"), F.collect_set("least").alias("firsts"))
    # a document's lists start with at most as many others as it has keys; all are tied to the smallest of them
    stars = met.select("v", F.explode(F.array_append("firsts", F.col("rep"))).alias("u")).where("u <> v").distinct()
    clusters = components(stars).withColumnsRenamed({"node": "rep", "component": "cluster"})
    members = classes.select("rep", "hi", "lo").join(sized(clusters), "rep")
    linked = components(staged(verified(staged(members, "members"), docs, size, percent), "links"))
    joined = classes.select("hi", "lo", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left")
    known = joined.select("hi", "lo", F.coalesce("component", "rep").alias("least"))
    out = rows.select("doc_id", "n_shingles", "hi", "lo").join(known, ["hi", "lo"], "left")
    alone = F.col("doc_id").isNull() | (F.col("n_shingles") == 0)
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("least"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query: two-word shingles over ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=2, percent=80)
