import duckdb
import pytest

import __spark_entry__ as entry
from veilspark import registry

SF = "/root/testdata/sf0.001"
SOME = ["detect_counts_by_type", "verdict_fusion", "suite_results", "rate_limit_bucket", "budget_decisions", "fingerprint_repeats", "epsilon_by_subject"]


def test_registry():
    assert set(registry.ORACLE) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    frame = registry.QUERIES[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "events", "conversations", "orders"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    other = con.execute(registry.ORACLE[name]).df()
    cols = sorted(frame.columns)
    assert cols == sorted(other.columns)
    text = lambda x: sorted(tuple("" if v is None or v != v else str(v) for v in row) for row in x[cols].itertuples(index=False))
    assert text(frame) == text(other)
