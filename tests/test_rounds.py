from pyspark.sql import functions as F

from engram.operators import rounds


def test_rounds_go_on_from_the_checkpoint(spark, tmp_path):
    folder = f"file://{tmp_path}/rounds"
    state = {"cases": spark.createDataFrame([(1, 0, False), (2, 0, False)], "case_id int, n int, stopped boolean")}

    def step(tables, number):
        cases = tables["cases"].withColumn("n", F.col("n") + 1)
        return {"cases": cases.withColumn("stopped", F.col("n") >= 3)}

    first = rounds.run_rounds(spark, folder, state, step, 2)
    assert {r.n for r in first["cases"].collect()} == {2}
    last = rounds.run_rounds(spark, folder, state, step, 5)
    assert {(r.n, r.stopped) for r in last["cases"].collect()} == {(3, True)}


def test_outcomes(spark):
    df = spark.createDataFrame([("a", 0.8, None), ("b", 0.79, None), ("c", 0.9, "down"), ("d", None, None)], "question_id string, correctness double, error string")
    assert {r.question_id: r.outcome for r in rounds.defended(df).collect()} == {"a": "success", "b": "pending", "c": "unavailable", "d": "unavailable"}
    edits = spark.createDataFrame([("a", True, 0.1, 1), ("b", True, 0.0, 1), ("c", False, 1.0, 1), ("d", True, 1.0, 0), ("e", None, 1.0, 1)], "question_id string, commit_valid boolean, score double, n_retrieved int")
    assert {r.question_id: r.pool for r in rounds.committed(edits).collect()} == {"a": "success", "b": "high_priority", "c": "high_priority", "d": "high_priority", "e": "high_priority"}


def test_ledgers(spark):
    df = spark.createDataFrame([("r", "single_fact", "q?", "a", ["s1", "s2"], 3)], "route string, mode string, question string, answer string, source_ids array<string>, version int")
    assert [(r.place, r.source_id) for r in rounds.evidence_rows(df).collect()] == [(0, "s1"), (1, "s2")]
    assert rounds.capability_rows(df).first().question_id == rounds.evidence_rows(df).first().question_id
