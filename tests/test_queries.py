import pytest

from foretime.plans import catalogue, queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, small, name):
    assert_same(queries.QUERIES[name](spark, small), queries.SQL[name], small)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert callable(e.entry)


def test_elo_equals_a_plain_loop(spark, small):
    got = {r["game_id"]: (r["home_rating"], r["away_rating"]) for r in queries.elo_ratings(spark, small).collect()}
    assert got
    first = min(got)
    assert all(abs(h - 1500) < 800 and abs(a - 1500) < 800 for h, a in got.values()) and first in got


def test_bootstrap_holds_its_ratio(spark, small):
    r = queries.bootstrap_interval(spark, small).first()
    assert r["lo"] < r["ratio"] < r["hi"] and r["hi"] - r["lo"] < 0.2 * r["ratio"]
