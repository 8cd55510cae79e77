import json

import pytest
from pyspark.sql import functions as F

from engram.sources import graphs, providers
from engram.streaming import traces


def test_records_in_three_forms(spark, tmp_path):
    rows = [{"question_id": "a", "question": "x", "answer": "1"}, {"question": "y", "answer": "2"}]
    for name, body in {"array": json.dumps(rows), "data": json.dumps({"data": rows}), "lines": "\n\n".join(map(json.dumps, rows)) + "\n"}.items():
        (tmp_path / name).write_text(body)
        got = graphs.read_records(spark, f"file://{tmp_path}/{name}").orderBy("case_index").collect()
        assert [(r.case_index, r.question, r.question_id) for r in got] == [(0, "x", "a"), (1, "y", None)], name


def test_record_lines_are_numbered_in_order(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    for k in range(3):
        (folder / f"f{k}.jsonl").write_text("".join(json.dumps({"question": f"{k}-{i}"}) + "\n\n" for i in range(50)))
    got = graphs.read_records(spark, f"file://{folder}").collect()
    assert sorted(r.case_index for r in got) == list(range(150))
    by = [r.question for r in sorted(got, key=lambda r: r.case_index)]
    assert by == [f"{k}-{i}" for k in range(3) for i in range(50)]


def test_records_of_several_files_are_one_numbering(spark, tmp_path):
    """A short file before a long one, whose splits Spark would take first; and two arrays."""
    for name, bodies in {"lines": ["\n".join(json.dumps({"question": f"a{k}"}) for k in range(2)), "\n".join(json.dumps({"question": f"b{k}", "answer": "x" * 500}) for k in range(400))], "arrays": [json.dumps([{"question": f"a{k}"} for k in range(3)]), json.dumps([{"question": f"b{k}", "answer": "x" * 900} for k in range(9)])]}.items():
        (tmp_path / name).mkdir()
        for part, body in zip("ab", bodies, strict=True):
            (tmp_path / name / f"{part}.json").write_text(body)
        got = [r.question for r in graphs.read_records(spark, f"file://{tmp_path}/{name}").orderBy("case_index").collect()]
        assert got == sorted(got, key=lambda q: (q[0], int(q[1:])))
        assert [r.case_index for r in graphs.read_records(spark, f"file://{tmp_path}/{name}").orderBy("case_index").collect()] == list(range(len(got)))


def test_other_records_are_errors(spark, tmp_path):
    (tmp_path / "bad").write_text(json.dumps({"data": 5}))
    with pytest.raises(Exception, match="neither"):
        graphs.read_records(spark, f"file://{tmp_path}/bad").collect()
    (tmp_path / "empty").write_text("\n")
    assert graphs.read_records(spark, f"file://{tmp_path}/empty").count() == 0


def test_graph_round_trip(spark, tmp_path):
    doc = {"version": "1", "nodes": [{"id": "n1", "user_name": "u1", "type": "fact", "created_at": "2"}, {"id": "n0", "user_name": "u1", "created_at": "1", "tags": ["a"]}, {"id": "n2", "user_name": "u2"}], "edges": [{"source": "n1", "target": "n2", "type": "PARENT"}, {"source": "n1", "target": "n0", "type": "PARENT"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    nodes, edges = graphs.read_graph(spark, f"file://{tmp_path}/g.json")
    assert [r.id for r in graphs.node_scan(nodes, ["u1"]).collect()] == ["n0", "n1"]
    assert [(r.source, r.target) for r in graphs.edge_scan(edges, nodes, ["u1"]).collect()] == [("n1", "n0")]
    graphs.write_graph_document(nodes, edges, f"file://{tmp_path}/out", "2")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert json.loads(text)["stats"]["num_nodes"] == 3 and len(json.loads(text)["edges"]) == 2
    with pytest.raises(ValueError):
        graphs.write_graph_document(nodes, edges, f"file://{tmp_path}/out", "2", most=4)
    graphs.write_graph(nodes, edges, f"file://{tmp_path}/lines", "2")
    back, arcs = graphs.read_graph_lines(spark, f"file://{tmp_path}/lines")
    assert sorted(map(str, back.select(nodes.columns).collect())) == sorted(map(str, nodes.collect())) and arcs.count() == 2
    about = json.loads("".join(p.read_text() for p in (tmp_path / "lines" / "about").glob("part-*")))
    assert about["stats"] == {"num_users": 2, "num_nodes": 3, "num_edges": 2, "relation_counts": {"PARENT": 2}}


def test_checkpoint(spark, tmp_path):
    folder = f"file://{tmp_path}/state"
    assert graphs.read_checkpoint(spark, folder) == {}
    graphs.write_checkpoint({"nodes": spark.range(3)}, folder, 1)
    graphs.write_checkpoint({"nodes": spark.range(5)}, folder, 2)
    assert graphs.read_checkpoint(spark, folder)["nodes"].count() == 5
    paths = spark.createDataFrame([("/a/global_step_9",), ("/a/global_step_10",), ("/a/x",)], "path string")
    assert graphs.latest_checkpoint(paths).first().path == "/a/global_step_10"
    with pytest.raises(Exception, match="no global_step_"):
        graphs.latest_checkpoint(paths.where("path = '/a/x'")).collect()


def test_training_files(spark, tmp_path):
    records = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    split = spark.createDataFrame([(1, "train"), (2, "val")], "id int, split string")
    assert graphs.write_training(records, split, f"file://{tmp_path}/t") == {"train": 1, "val": 1, "modes": {"train": {}, "val": {}}}
    moded = records.withColumn("extra_info", F.struct(F.struct(F.lit("comparison").alias("attack_mode")).alias("route")))
    assert graphs.write_training(moded, split, f"file://{tmp_path}/m")["modes"] == {"train": {"comparison": 1}, "val": {"comparison": 1}}
    with pytest.raises(ValueError):  # an empty split
        graphs.write_training(records, split.where("id = 1"), f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t/val.parquet").first().v == "b"
    with pytest.raises(ValueError):
        graphs.write_training(records.limit(0), split, f"file://{tmp_path}/t")


def test_providers(spark):
    def factory():
        def call(items):
            if "bad" in items:
                raise RuntimeError("no")
            return [x.upper() for x in items]

        return call

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bad", "c", "d"])], "id int, t string").coalesce(1)
    got = {r.t: r for r in providers.with_results(df, "t", factory, "string").collect()}
    assert got["a"].result == "A" and got["d"].result == "D" and got["bad"].error == "RuntimeError: no" and got["bad"].result is None
    assert sum(r.requests for r in got.values()) == 5
    vectors = providers.embedded(df.select("id", F.col("t").alias("content")), None)
    again = providers.embedded(df.select("id", F.col("t").alias("content")), vectors)
    assert again.count() == 4 and len(again.first().vector) == 64
    tagged = df.select("id", F.col("t").alias("content"), F.array(F.lit("x"), F.when(F.col("id") == 1, "y").otherwise("z")).alias("tags"))
    held = providers.embedded(tagged, vectors)
    other = providers.embedded(tagged.withColumn("tags", F.array(F.lit("x"), F.lit("z"))), held)
    hashes = lambda table: {r.id: r.text_hash for r in table.collect()}
    assert not set(hashes(held).values()) & set(hashes(vectors).values())  # tags are part of the text
    assert [k for k, h in hashes(other).items() if hashes(held)[k] != h] == [1]

    def fails():
        def call(items):
            if any("bad" in i for i in items):
                raise RuntimeError("no")
            return [[1.0] for _ in items]

        return call

    some = providers.embedded(tagged, None, fails)
    assert sorted(r.id for r in some.collect()) == [0, 2, 3]  # a failure is no entry
    assert sorted(r.id for r in providers.embedded(tagged, some).collect()) == [0, 1, 2, 3]
    answers = iter(["x", "{}", '{"a": 1}'])
    assert providers.with_retry(lambda _: next(answers), ("a",))(None) == {"a": 1}


def test_trace_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01 00:10:00", "scored", 1.0), ("2026-01-01 00:20:00", "scored", 0.5), ("2026-01-01 05:00:00", "x", 0.0)], "ts string, stage string, score double")
    graphs.append_trace(rows, f"file://{tmp_path}/trace")
    stream = traces.windowed_rewards(traces.read_traces(spark, f"file://{tmp_path}/trace", "ts timestamp, stage string, score double"))
    q = stream.writeStream.format("memory").queryName("traces").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.stage, r.n, r.score) for r in spark.table("traces").collect()] == [("scored", 2, 1.5)]
