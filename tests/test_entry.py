"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship(spark):
    df = entry.entry(spark)
    assert "choice_id" in df.columns and df.count() > 0
