from pathlib import Path

import duckdb
import pytest

from tidewell.llm.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
def test_the_list_decides_pages_that_no_rule_fits(spark):
    got = QUERIES["op3_junk_urls"](spark, DATA).select("page_id", "host", "path", "rule", "verdict").collect()
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{DATA}/pages.parquet'")
    want = con.execute(ORACLES["op3_junk_urls"]).fetchall()
    assert "adult-x" in ORACLES["op3_junk_urls"] and sorted(map(tuple, got), key=str) == sorted(want, key=str)
    by_list = {r.host for r in got if r.rule is None and r.verdict == "block"}
    assert by_list == {"blog.adult-x.example.net"}
    assert any(r.rule is None and r.verdict == "allow" for r in got)
