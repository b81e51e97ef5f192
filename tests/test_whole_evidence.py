"""Profiles over all evidence and guarded steps 1 to 5, against their SQL."""

import duckdb
import pytest

from checks import load_all
from checks.compare import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["application_profile_whole", "profile_candidates_whole", "profile_contributions_whole", "guard_all_steps"])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    reg = load_all()
    result, _ = compare(spark, con, name, reg.QUERIES[name], reg.ORACLES[name], SF)
    assert result.startswith("ok"), result
