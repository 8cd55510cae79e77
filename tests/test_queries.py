import pytest

from engram.plans.oracle import SQL
from engram.plans.queries import queries

from .compare import same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same(spark, queries()[name], SQL[name], DATA)


def test_weighted_sample_draws_two_of_each_topic(spark):
    rows = queries()["weighted_sample"](spark, DATA).collect()
    by = {}
    for r in rows:
        by.setdefault((r.case_id, r.topic), []).append(r.fact)
    assert all(len(f) == len(set(f)) <= 2 for f in by.values())
    assert rows == queries()["weighted_sample"](spark, DATA).collect() or sorted(map(tuple, rows)) == sorted(map(tuple, queries()["weighted_sample"](spark, DATA).collect()))


def test_drawn_routes(spark):
    rows = queries()["drawn_routes"](spark, DATA).collect()
    assert rows and all(2 <= len(set(r.facts)) == len(r.facts) <= 3 and r.walk[1] == r.topic and len(r.walk) == 2 * len(r.facts) - 1 for r in rows)
    assert {len(r.facts) for r in rows} == {2, 3} and len({r.signature for r in rows}) == len(rows)
    assert sorted(map(str, rows)) == sorted(map(str, queries()["drawn_routes"](spark, DATA).collect()))


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
