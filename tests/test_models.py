"""Drift by days."""

import datetime

import pytest

from foretime.plans import models


def test_drift_knows_earlier_days_of_the_season_only(spark):
    rows = [(s, datetime.date(s, 1, 1 + k % 9), (k % 7 - 3) / 4) for s in (2001, 2002) for k in range(40)]
    got = models.with_drift(spark.createDataFrame(rows, "season int, date date, adj double"), "adj").collect()
    assert len(got) == len(rows)
    for r in got:
        before = [a for s, d, a in rows if s == r["season"] and d < r["date"]]
        assert r["shift"] == pytest.approx(sum(before) / (len(before) + 25), abs=1e-12)
