"""Operator 12: quality rules whose cutoffs carry a proven limit on falsely rejected documents.

A document is measured once: words, their code points, symbols, repeated lines and
words of repeated three-word windows.  ``RULES`` turn these into values of which
larger is worse, each with a fixed row of cutoffs from the mildest to the
strictest; a rule rejects a document whose value is over its cutoff.  Very short
and very repetitive documents fail a base test that no cutoff changes.

Labelled documents are the holdouts that choose the cutoffs; nothing else is
fitted.  Of the good ones of a stratum that pass the base test, n, a cutoff
rejects k.  It is certified if the chance of k or fewer at a true rate of
``risk / rules`` is at most ``doubt / chains``, which is the exact (Clopper and
Pearson) upper bound of the rate being below that rate.  Cutoffs of a rule and
stratum are tested from the mildest on until one fails (a fixed sequence, which
needs no further correction), and all such chains share ``doubt`` (Bonferroni).
So with a chance of at least 1 - doubt, in every stratum at once, no more than
``risk`` of the good documents are rejected by all rules together.  The last
certified cutoff counts; a chain whose first cutoff fails has none and rejects
nothing, as in a stratum with few labels.  The stratum is the language; null is
one too.

Copies of a text are one holdout of its stratum (by a 64-bit hash), good if all its
labels say so, since the bound asks for independent draws.  A doc_id with several
labels counts as good if none says otherwise; labels that are null or of no document
count nowhere.  A null or empty text has no words and fails the base test.  Repeated
rows return one row each.  Without labels only the base test decides.  An empty table
gives no rows.  Other columns are ignored.

All work is DataFrame functions.  Texts are read once and never shuffled: windows
are compared within their row.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side, staged

WORDS, SYMBOLS = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Share of a stratum's good documents that may be rejected, and the chance that this fails anywhere.
RISK, DOUBT = 0.02, 0.05
WINDOW = 3
#: Bits of a place in a text.
PLACE = 31


class Rule(NamedTuple):
    name: str
    #: SQL of a whole number, larger is worse; for documents with a word.
    value: str
    #: From the mildest on.
    cutoffs: list[int]


RULES = [
    Rule("symbols", "n_symbols * 1000 {div} n_words", [1000, 500, 300, 200, 100, 50, 20, 10, 5]),
    Rule("lines", "n_dup_lines * 1000 {div} n_lines", list(range(900, 50, -50))),
    Rule("repeats", "n_repeat_words * 1000 {div} n_words", list(range(500, 0, -25))),
    Rule("long_words", "word_chars * 1000 {div} n_words", list(range(12000, 5000, -200))),
    Rule("short_words", "10000 - word_chars * 1000 {div} n_words", list(range(7500, 5000, -100))),
]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words"]


def covered(starts: Column) -> Column:
    """Words in windows that begin at ascending ``starts``."""
    step = lambda a, s: F.struct((a["n"] + s + WINDOW - F.greatest(s, a["end"])).alias("n"), (s + WINDOW).alias("end"))
    return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda a: a["n"])


def measured(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum (null as an empty text), unit (hash of the text), COUNTS and base_failed of each row.

    Sorting a text's windows finds the repeated ones beside one another; only texts whose windows' hashes repeat are sorted.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.concat(F.lit(":"), F.col(stratum).cast("string")), F.lit("")).alias("stratum"), F.xxhash64("text").alias("unit"), text.alias("text"), F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1)).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORDS)).alias("lines"))
    n, hashes = F.size("words"), F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select("*", hashes.alias("h"))
    later = lambda k: F.slice("h", F.lit(k + 1), F.greatest(n - WINDOW + 1, F.lit(0)))
    marks = later(0)
    for k in range(1, WINDOW):
        marks = F.zip_with(marks, later(k), lambda a, b: F.xxhash64(a, b))
    rows = rows.select("*", marks.alias("marks"))

    def beside(column: str, value, place) -> Column:
        """Places whose value stands twice or more in a sorted column."""
        equal = lambda x, k: F.coalesce(value(x) == value(F.get(column, k)), F.lit(False))
        return F.filter(F.transform(column, lambda x, k: F.when(equal(x, k - 1) | equal(x, k + 1), place(x))), F.isnotnull)

    # Windows of different hashes are different.  Where hashes repeat, a part of each is sorted with its place in the low
    # bits, and only windows that are equal in it are sorted as texts.
    packed = F.sort_array(F.transform("marks", lambda h, i: F.shiftleft(h, PLACE).bitwiseOR(i.cast("long"))))
    rows = rows.withColumn("packed", F.when(F.size(F.array_distinct("marks")) < F.size("marks"), packed).otherwise(F.array().cast("array<long>")))
    some = beside("packed", lambda x: F.shiftright(x, PLACE), lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))
    window = lambda i: F.struct(F.concat_ws(" ", *(F.get("words", i + k) for k in range(WINDOW))).alias("v"), i.alias("i"))
    rows = rows.withColumn("ordered", F.when(F.size("packed") > 0, F.sort_array(F.transform(some, window))).otherwise(F.array().cast("array<struct<v:string,i:int>>")))
    starts = F.sort_array(beside("ordered", lambda x: x["v"], lambda x: x["i"]))
    counts = rows.select(
        "doc_id", "stratum", "unit", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").cast("long").alias("n_lines"), covered(starts).cast("long").alias("n_repeat_words"),
    )
    return counts.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def ln_factorial(n: Column) -> Column:
    """Natural logarithm of n!: by the factorial itself or, beyond it, Stirling's series (to about 1e-13)."""
    x = n.cast("double")
    series = x * F.ln(x) - x + F.ln(2 * math.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.ln(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def at_most(k: Column, n: Column, rate: float) -> Column:
    """The chance of ``k`` or fewer among ``n`` at ``rate``; 1 from the mean on, where it is a half or more.

    The terms below k are summed from k down, as factors of the first; those beyond twelve standard deviations are nothing.
    """
    last = ln_factorial(n) - ln_factorial(k) - ln_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    steps = F.least(k, F.ceil(12 * F.sqrt(n * (rate * (1 - rate)))) + 60)
    step = lambda a, j: F.struct((a["t"] * (k - j) * (1 - rate) / ((n - k + j + 1) * rate)).alias("t"), (a["s"] + a["t"]).alias("s"))
    factor = F.aggregate(F.sequence(F.lit(0).cast("long"), steps), F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), step, lambda a: a["s"])
    return F.when(k < n * rate, F.exp(last) * factor).otherwise(F.lit(1.0))


def holdouts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Good holdouts of ``measured`` rows: stratum and COUNTS, one row for each text of a stratum."""
    said = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    met = rows.where("not base_failed").join(said, "doc_id")
    return met.groupBy("stratum", "unit").agg(F.min("quality").alias("quality"), *(F.max(c).alias(c) for c in COUNTS)).where("quality > 0").select("stratum", *COUNTS)


def tested(good: DataFrame, rules: list[Rule] = RULES, risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """stratum, rule, step, cutoff, n, k, chance, certified: every cutoff's test, a row for each of few."""
    place = lambda r: F.size(F.filter(F.array(*map(F.lit, r.cutoffs)), lambda c: c >= F.expr(r.value.format(div="div"))))  # noqa: E731  of the first cutoff that rejects
    met = good.select("stratum", F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), place(r).alias("step")) for r in rules))).alias("m"))
    counted = staged(met.select("stratum", "m.*").groupBy("stratum", "rule", "step").agg(F.count("*").alias("c")), "rule-counts")  # a row for each cutoff at most
    sizes = counted.groupBy("stratum", "rule").agg(F.sum("c").alias("n"))
    grid = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(k).alias("step"), F.lit(c).alias("cutoff")) for r in rules for k, c in enumerate(r.cutoffs))))
    every = sizes.select("stratum", "n").distinct().select("stratum", "n", grid.alias("g")).select("stratum", "n", "g.*")
    so_far = Window.partitionBy("stratum", "rule").orderBy("step")
    filled = every.join(counted, ["stratum", "rule", "step"], "left").withColumn("k", F.sum(F.coalesce("c", F.lit(0))).over(so_far))
    chains = max(1, sizes.count())
    chance = at_most(F.col("k"), F.col("n"), risk / len(rules))
    passed = F.min((chance <= doubt / chains).cast("int")).over(so_far) == 1
    return filled.select("stratum", "rule", "step", "cutoff", "n", "k", chance.alias("chance"), passed.alias("certified"))


def cutoffs(tests: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """stratum and, for each rule, its strictest certified cutoff; null where there is none."""
    return tests.where("certified").groupBy("stratum").agg(*(F.min(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"most_{r.name}") for r in rules))


def judged(docs: DataFrame, labels: DataFrame, rules: list[Rule] = RULES, risk: float = RISK, doubt: float = DOUBT, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, COUNTS, base_failed, rejected_by (names of rules) and kept of each row of ``docs``."""
    rows = staged(measured(docs, stratum), "rule-counts-of-documents")
    limits = staged(cutoffs(tested(holdouts(rows, labels), rules, risk, doubt), rules), "rule-cutoffs")
    both = rows.join(small_side(limits), "stratum", "left")
    over = F.array_compact(F.array(*(F.when(F.expr(r.value.format(div="div")) > F.col(f"most_{r.name}"), F.lit(r.name)) for r in rules)))
    found = both.withColumn("rejected_by", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(over))
    return found.select("doc_id", "stratum", *COUNTS, "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's query over ``documents``."""
    out = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_values = ", ".join(f"{r.value.format(div='//')} AS v_{r.name}" for r in RULES)
_grid = ", ".join(f"('{r.name}', {k}, {c})" for r in RULES for k, c in enumerate(r.cutoffs))
_over = " OR ".join(f"coalesce(v_{r.name} > most_{r.name}, false)" for r in RULES)
_rate = RISK / len(RULES)
OP12_SQL = rf"""
WITH t AS (SELECT row_number() OVER () AS i, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM t),
g AS (SELECT i, p, words FROM (SELECT i, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS words FROM (SELECT i, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) > 2)) QUALIFY count(*) OVER (PARTITION BY i, words) > 1),
r AS (SELECT i, count(DISTINCT q) AS n_repeat_words FROM (SELECT i, unnest(range(p, p + 3)) AS q FROM g) GROUP BY i),
c AS (SELECT w.i, doc_id, lang, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON w.i = r.i),
b AS MATERIALIZED (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_values} FROM c),
said AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
good AS (SELECT lang, text, {", ".join(f"any_value(v_{r.name}) AS v_{r.name}" for r in RULES)} FROM b JOIN said ON b.doc_id = said.doc_id WHERE NOT base_failed GROUP BY lang, text HAVING min(quality) > 0),
long AS (SELECT lang, unnest([{", ".join(f"{{'rule': '{r.name}', 'v': v_{r.name}}}" for r in RULES)}], recursive := true) FROM good),
grid AS (SELECT * FROM (VALUES {_grid}) x(rule, step, cutoff)),
k AS (SELECT lang, grid.rule, step, cutoff, count(*) AS n, count(*) FILTER (v > cutoff) AS k FROM long JOIN grid ON long.rule = grid.rule GROUP BY ALL),
p AS (SELECT *, CASE WHEN k < n * {_rate} THEN list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_rate}) + (n - j) * ln(1 - {_rate})))) ELSE 1 END AS chance FROM k),
ok AS (SELECT *, min(CASE WHEN chance <= {DOUBT} / (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM k)) THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY step) AS certified FROM p),
cut AS (SELECT lang, {", ".join(f"min(cutoff) FILTER (rule = '{r.name}') AS most_{r.name}" for r in RULES)} FROM ok WHERE certified = 1 GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_over}) AS kept
FROM b LEFT JOIN cut ON b.lang IS NOT DISTINCT FROM cut.lang
"""
