"""Every registered tracking query against its SQL, on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from paceline.plans.registry import ORACLES, QUERIES

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    want = Counter(tuple(plain(dict(zip(names, r))[c]) for c in order) for r in cur.fetchall())
    have = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert sum(want.values()) > 0
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
