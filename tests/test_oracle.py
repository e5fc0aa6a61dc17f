"""Every registered query against its DuckDB oracle on the smallest tables."""

from __future__ import annotations

import os

import pytest

from tests.oracle_check import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_all_queries_match_oracle(spark):
    plans: dict[str, str] = {}
    res = compare(spark, SF, plans=plans)
    bad = {k: v for k, v in res.items() if not v.get("hash", v.get("oracle") == "rows-only")}
    assert not bad, bad
    # No registered query plans a cross join or a row-at-a-time Python UDF.
    for name, plan in plans.items():
        for node in ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython"):
            assert node not in plan, (name, node)


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
