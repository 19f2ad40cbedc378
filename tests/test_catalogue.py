import os

import duckdb
import pytest

from seqspark.plans import catalogue

SF = "/root/testdata/sf0.001"
SLOW = {"neighbor_words"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(catalogue.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(catalogue.oracle_sql()[name])
    cols = sorted(want.columns)
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == cols
    assert sorted(map(repr, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(repr, want.select(",".join(cols)).fetchall()))
