"""The corpus queries that have SQL against it, on whole tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from paceline.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = QUERIES[name](spark, DIR)
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(cur.fetchall())
    have = Counter(tuple(r[c] for c in names) for r in got.collect())
    assert len(want) > 0
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
