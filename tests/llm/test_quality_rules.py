"""Quality rules against plain counts and exact fractions."""

import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from engram.llm import quality_rules as qr
from tests.compare import same

DOCS = "doc_id long, text string, lang string, source string"


def brute(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words)."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for k in range(len(w) - 2):
        at.setdefault(tuple(w[k : k + 3]), []).append(k)
    hit = {k + j for places in at.values() if len(places) > 1 for k in places for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(lines), len(hit)


def texts():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé漢\U0001f600") for _ in range(r.randrange(1, 6)))
    some = ["", None, " \t\r\n", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\n\nx\n x\nx\r\n", "#*$ %&|<> a#b", "\x0b\x0ca\x0bb\x0c", "a b c", "b a a a b a a a a", "s t u\n" * 400]
    for _ in range(60):
        w = [word() for _ in range(r.randrange(1, 400))]
        for _ in range(r.randrange(4)):
            k = r.randrange(len(w))
            w += w[k : k + r.randrange(1, 9)]
        some.append("".join(x + r.choice([" ", "\n", "  ", "\t"]) for x in w))
    some.append(" ".join(f"w{k % 20011}" for k in range(60000)))  # very long
    return some


def test_counts(spark):
    rows = [(k, t, "en" if k % 2 else None, None) for k, t in enumerate(texts())] + [(None, "a b", "x", None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"Words": F.lit(1), "packed": F.lit(2), "stratum": F.lit("q")}).repartition(4)
    got = {r.doc_id: r for r in qr.measured(df).collect()}
    for k, t, lang, _ in rows:
        want, r = brute(t), got[k]
        assert tuple(r[c] for c in qr.COUNTS) == want and r.stratum == (f":{lang}" if lang else "")
        assert r.base_failed == (want[0] < 50 or 100 * want[5] > 50 * want[0])


@pytest.mark.parametrize("rate", [0.004, 0.05, 0.3])
def test_chances_are_exact(spark, rate):
    pairs = [(k, n) for n in (1, 2, 15, 20, 21, 22, 60, 333, 1200) for k in sorted({0, 1, 2, int(n * rate), int(n * rate / 2), n}) if k <= n]
    df = spark.createDataFrame(pairs, "k long, n long")
    p = Fraction(rate)
    for r in df.withColumn("p", qr.at_most(F.col("k"), F.col("n"), rate)).collect():
        if r.k < r.n * rate:
            want = float(sum(math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) for i in range(r.k + 1)))
            assert abs(r.p - want) <= 1e-9 * want
        else:
            assert r.p == 1.0


def test_chance_of_large_counts(spark):
    (row,) = spark.createDataFrame([(99_000, 10_000_000)], "k long, n long").select(qr.at_most(F.col("k"), F.col("n"), 0.01).alias("p")).collect()
    sigma = math.sqrt(1e7 * 0.01 * 0.99)
    assert abs(row.p - 0.5 * math.erfc((1e5 - 99_000.5) / sigma / math.sqrt(2))) < 0.05 * row.p


def good_and_bad(n, bad):
    """``n`` good documents of plain words and ``bad`` ones full of symbols, their texts all different."""
    text = lambda k, mark: " ".join(f"w{k}x{j}{mark}" for j in range(60))
    docs = [(k, text(k, ""), "en", "s") for k in range(n)] + [(n + k, text(n + k, "|"), "en", "s") for k in range(bad)]
    return docs, [(k, int(k < n), 0) for k in range(n + bad)]


def test_enough_labels_certify_and_too_few_do_not(spark):
    rule = qr.Rule("symbols", "n_symbols * 1000 {div} n_words", [800, 500])
    need = math.ceil(math.log(0.05) / math.log(0.98))  # good holdouts without a false rejection
    for n, rejected in ((need, 5), (need - 1, 0)):
        docs, labels = good_and_bad(n, 5)
        out = qr.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), [rule]).collect()
        assert sum(not r.kept for r in out) == rejected and all(r.rejected_by == ["symbols"] for r in out if not r.kept)


def test_copies_are_one_holdout_and_odd_labels_count_nowhere(spark):
    rule = qr.Rule("symbols", "n_symbols * 1000 {div} n_words", [800])
    docs, labels = good_and_bad(100, 3)
    copies = [(5000 + k, docs[0][1], "en", "s") for k in range(400)]
    labels += [(5000 + k, 1, 0) for k in range(400)] + [(None, 1, 0), (99999, 1, 0), (7, None, 0)]
    df, said = spark.createDataFrame(docs + copies, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tests = qr.tested(qr.holdouts(qr.measured(df), said), [rule]).collect()
    assert [(t.n, t.k) for t in tests] == [(100, 0)]
    assert qr.holdouts(qr.measured(df), said.unionByName(spark.createDataFrame([(1, 0, 0)], said.schema))).count() == 99
    assert all(r.kept for r in qr.judged(df, said, [rule]).collect())


def test_a_chain_ends_at_its_first_failure(spark):
    rows = [(":a", k) for k in [0] * 900 + [30] * 100] + [(":b", 0)] * 20
    good = spark.createDataFrame([(s, 100, 500, v, 0, 1, 0) for s, v in rows], "stratum string, " + ", ".join(f"{c} long" for c in qr.COUNTS))
    rule = qr.Rule("symbols", "n_symbols * 1000 {div} n_words", [400, 350, 250, 200])
    tests = {(t.stratum, t.cutoff): (t.n, t.k, t.certified) for t in qr.tested(good, [rule]).collect()}
    assert tests[":a", 400] == (1000, 0, True) and tests[":a", 350] == (1000, 0, True) and tests[":a", 250] == (1000, 100, False) and not tests[":a", 200][2]
    assert not any(tests[":b", c][2] for c in rule.cutoffs)
    assert {r.stratum: r.most_symbols for r in qr.cutoffs(qr.tested(good, [rule]), [rule]).collect()} == {":a": 350}


def test_no_rows_and_no_labels(spark):
    none, said = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert qr.judged(none, said).count() == 0
    docs, _ = good_and_bad(3, 2)
    assert all(r.kept for r in qr.judged(spark.createDataFrame(docs, DOCS), said).collect())


def test_same_as_sql_where_cutoffs_are_certified(spark):
    folder = "/root/testdata/sf0.1"
    same(spark, qr.op12_quality_rules, qr.OP12_SQL, folder)
    out = qr.judged(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    marks = out.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed")
    r = marks.agg(F.avg(F.when(F.col("quality") == 1, (~F.col("kept")).cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, (~F.col("kept")).cast("int"))).alias("bad")).first()
    assert r.good <= qr.RISK and r.bad > 0.5
