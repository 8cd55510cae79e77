"""The corpus pipeline: five stages, each a corpus operator over what the stage before kept.

1. quality: documents that the classifier rejects go.
2. near_dup: of each group of near-duplicates (five-word shingles, Jaccard 0.8) the smallest doc_id stays.
3. substrings: 50-byte strings that stand in an earlier document are cut out of the text.
4. decontaminate: documents that hold an exact benchmark window go.
5. pack: the rest is packed into sequences of 2048 tokens.

Each stage takes (spark, docs, sf_dir) and returns the documents' columns, but
for the last, which returns the packed pieces.  Rows without a doc_id pass the
first four stages, as a document by itself.  Columns that ``documents`` has
besides the usual ones are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engram.llm.common import fresh, new_folder, staged, written
from engram.llm.decontaminate import contamination
from engram.llm.near_dup import near_duplicates
from engram.llm.packing import pack_documents
from engram.llm.quality import scored, train_on
from engram.llm.substring_dedup import added, dedup_substrings
from engram.session import ship

#: A document stays if its chance of being good is at least this.
LEAST_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8."""
    weights = train_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = fresh(docs.columns, "score")
    out = scored(docs, weights, keep=tuple(docs.columns), score=score)
    return out.where(F.col(score) >= LEAST_SCORE).select(*(f"`{c}`" for c in docs.columns))


def _keep(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose doc_id is not in ``ids``; those without one stay."""
    return docs.join(ids.where("doc_id is not null").distinct(), "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2."""
    return _keep(docs, staged(near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id"), "dropped"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1.  A cut through a character drops what is left of it; n_chars follows the text."""
    cut = dedup_substrings(docs, as_text=True)
    kept, _, n_removed, _ = added(docs.columns)
    text = F.when(F.col(n_removed) == 0, F.col("text")).otherwise(F.col(kept))
    changed = {"text": text.alias("text")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        changed["n_chars"] = F.when(F.col(n_removed) == 0, F.col("n_chars")).otherwise(F.length(text)).cast(kind).alias("n_chars")
    return cut.select(*(changed.get(c, F.col(f"`{c}`")) for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _keep(docs, staged(found.where("contaminated").select("doc_id"), "contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _shipped(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return run_stage


STAGES = [(f.__name__, _shipped(f)) for f in (quality, near_dup, substrings, decontaminate, pack)]

#: SQL expresses neither the classifier nor the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
