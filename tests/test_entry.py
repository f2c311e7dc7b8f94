"""The driver contract: entry, queries and oracles line up."""

from __future__ import annotations

import __spark_entry__ as entry
from tidewater.plans.registry import load_all


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["product", "date", "sale"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    qs, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(qs)
    assert len(qs) >= 50
    missing = {name for name in qs if name in load_all()} - set(sqls)
    assert not missing, f"queries without an oracle: {missing}"
