import math

import duckdb
import pytest

from specloom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want), key=repr)
