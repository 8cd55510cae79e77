"""Short lines in operator 4, which its SQL leaves alone."""

from engram.llm import line_dedup, registry

DATA = "/root/testdata/sf0.001"


def test_short_lines_are_removed(spark, tmp_path):
    rows = [(1, "Home\nA long line that stands once only\n\nHome"), (2, "home \n\n  x\nunique"), (None, "X"), (3, None), (4, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_removed, r.spans) for r in registry.queries()["op4_line_dedup_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, "40-44"), 2: (1, "0-6"), None: (1, "0-1"), 3: (0, ""), 4: (0, "")}


def test_short_lines_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    seen, want = set(), {}
    for i, text in sorted((r.doc_id, r.text) for r in docs.collect() if r.text is not None):
        gone = []
        for start, end, normal in line_dedup.units(text, "line"):
            if normal and normal in seen:
                gone.append(f"{start}-{end}")
            seen.add(normal)
        want[i] = ",".join(gone)
    got = {r.doc_id: r.spans for r in registry.queries()["op4_line_dedup_whole"](spark, DATA).collect()}
    assert {i: got[i] for i in want} == want
