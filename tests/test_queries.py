"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quarry.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 8) + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in oracle_sql():
        got = duck.execute(oracle_sql()[name])
        names = [d[0] for d in got.description]
        assert sorted(names) == cols
        assert rows == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_stream_of_events(spark, tmp_path):
    from quarry.streaming import ledger

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").write_bytes(Path(f"{SF}/events.parquet").read_bytes())
    spend = ledger.spend_by_window(ledger.read_events(spark, str(tmp_path / "in")))
    q = spend.writeStream.format("memory").queryName("spend").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("spend").agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
