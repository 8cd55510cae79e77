"""Operator 8: quality by hashed word n-grams, logistic regression and FTRL-proximal updates.

A text's words are its runs between white space.  Features are hashed words and
word pairs, and the same for the words' shapes (runs of lower case, upper case
and digits folded to one sign each, other characters kept), as most words of a
corpus are too rare to have a weight of their own.  Each feature counts by its
share of the text's n-grams, so a score is the mean weight found at a text's
hashes: one gather and one sum, whatever its length.

Training sees at most ``max_rows`` labelled documents, those of smallest hash of
doc_id, in one task and a fixed order; the model is ``1 << bits`` floats.  Scoring
reads every document where it lies, without a shuffle.

Empty and null texts have no n-grams and score by the bias.  Without labelled
documents of both classes every score is 0.5.  A doc_id that labels repeat with
different marks counts with its smallest.  Null labels are no labels.  Repeated
rows are scored each; a null doc_id is not held out.  An empty table gives no rows.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

BITS = 18
#: Labelled documents that training sees at most.
MAX_ROWS = 6000

_LOWER, _UPPER, _DIGIT = re.compile(r"[^\W\d_A-Z]+"), re.compile(r"[A-Z]+"), re.compile(r"\d+")


@lru_cache(maxsize=100_000)
def word_hashes(word: str) -> tuple[int, int]:
    """32-bit hashes of a word and of its shape."""
    shape = re.sub(r"[^\W\d_]+", "A", word) if word.isupper() else word
    shape = _LOWER.sub("a", _UPPER.sub("A", _DIGIT.sub("0", shape)))
    return zlib.crc32(word.encode()), zlib.crc32(b"shape " + shape.encode())


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, offsets of each text in them)."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = pc.dictionary_encode(lists.flatten())
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" in words:  # white space at an end, or nothing else, is no word
        real = codes != words.index("")
        codes, bounds = codes[real], np.concatenate([[0], np.cumsum(real)])[bounds]
    table = np.array([word_hashes(w) for w in words] or np.zeros((0, 2)), np.uint64)
    own = table[codes]  # words x (word, shape)
    mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    single = own * mix
    pair = np.zeros_like(own)
    pair[:-1] = (own[:-1] * np.uint64(1_000_003) + own[1:] + np.uint64(1)) * mix
    last = bounds[1:][np.diff(bounds) > 0] - 1
    pair[last] = (own[last] + np.uint64(7)) * mix  # the last word pairs with the text's end
    found = np.concatenate([single, pair], axis=1) >> shift
    return found.reshape(-1).astype(np.int32), bounds * 4


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4) -> np.ndarray:
    """FTRL-proximal over (features, shares, label) in the order given; the last weight is the bias."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    positive = max(1, sum(y for _, _, y in rows))
    weight = {1: len(rows) / 2 / positive, 0: len(rows) / 2 / max(1, len(rows) - positive)}

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for i, x, y in rows:
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x * weight[y]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(size + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS) -> np.ndarray:
    """Weights from ``labels`` (doc_id, y) of ``docs``; zeros if a class is missing."""
    size = 1 << bits
    marks = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = marks.withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found, bounds = features(batch["text"], bits)
            ids, counts, n = [], [], []
            for a, b in zip(bounds, bounds[1:], strict=False):
                i, c = np.unique(found[a:b], return_counts=True)
                ids.append(i.astype(np.int32)), counts.append((c / max(1, b - a)).astype(np.float32)), n.append(len(i))
            yield pa.RecordBatch.from_pydict({"o": batch["_o"], "doc_id": batch["doc_id"].cast(pa.int64()), "y": batch["y"].cast(pa.int32()), "i": pa.array(ids, pa.list_(pa.int32())), "x": pa.array(counts, pa.list_(pa.float32()))})

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for i, x, y in zip(batch["i"], batch["x"], batch["y"].to_pylist(), strict=True):
                rows.append((np.append(i.values.to_numpy(), size), np.append(x.values.to_numpy(), np.float32(1)), y))
        both = len({y for _, _, y in rows}) > 1
        w = ftrl(rows, size) if both else np.zeros(size + 1, np.float32)
        yield pa.RecordBatch.from_pydict({"w": pa.array([w.tobytes()], pa.binary())})

    extracted = texts.mapInArrow(extract, "o long, doc_id long, y int, i array<int>, x array<float>")
    row = extracted.repartition(1).sortWithinPartitions("o", "doc_id").mapInArrow(fit, "w binary").first()
    return np.frombuffer(row.w, np.float32) if row else np.zeros(size + 1, np.float32)


def scored(docs: DataFrame, weights: np.ndarray, bits: int = BITS, keep: tuple[str, ...] = (), score: str = "score") -> DataFrame:
    """doc_id, the columns in ``keep`` and the score under the name given."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # 1 << bits floats

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in slices(batches, "text"):
            found, bounds = features(batch["text"], bits)
            sums = np.concatenate([[0.0], np.cumsum(w[found], dtype=np.float64)])
            n = np.maximum(np.diff(bounds), 1)
            logit = (sums[bounds[1:]] - sums[bounds[:-1]]) / n + float(w[-1])
            p = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(p)], [*kept, score])
        word_hashes.cache_clear()  # the worker lives on

    kept = ["doc_id", *(c for c in keep if c != "doc_id")]
    needed = list(dict.fromkeys([*kept, "text"]))
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*kept).dtypes)
    return docs.select(*needed).mapInArrow(judge, f"{schema}, {score} double")


def held_out():
    """The rows that learning never sees."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_on(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights from quality marks outside the held-out fifth."""
    return train(docs, labels.where(~held_out()).select("doc_id", F.col("quality").alias("y")), max_rows)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents`` and ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, weights)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
