"""Every registered query with SQL against DuckDB on the smallest tables."""

import random

import duckdb
import pytest

from girder.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: None if v is None or v != v else v if isinstance(v, (bool, str)) else round(float(v), 9)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())
    else:
        assert df.columns


def test_measure_standing_adds_up_by_event_id(spark, tmp_path):
    """Means that lie just the tolerance apart, over rows that come in any order and in several partitions."""
    rnd, rows = random.Random(3), []
    for user in range(1500):
        low = [rnd.randint(1, 9_999) for _ in range(3)]
        high = [x + 500 for x in low]
        rnd.shuffle(high)
        rows += [(0, user, "view", x / 100) for pair in zip(low, high, strict=True) for x in pair]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    fields = "event_id long, user_id long, event_type string, value double"
    spark.createDataFrame(rows, fields).coalesce(1).write.parquet(f"{tmp_path}/ordered.parquet")
    rnd.shuffle(rows)
    spark.createDataFrame(rows, fields).repartition(5).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/ordered.parquet/*.parquet'")
    want = con.execute(ORACLE_SQL["measure_standing"]).fetchall()
    got = [tuple(r) for r in QUERIES["measure_standing"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {r[2] for r in want} == {"within", "breached"}
