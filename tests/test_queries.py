"""Every registered query of the traffic engine against its SQL, and the contract of the entry."""

import os
import shutil
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from wirelake import queries

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", queries.QUERIES)
def test_same_as_sql(name, spark, duck):
    if name not in queries.ORACLE_SQL:
        assert queries.QUERIES[name](spark, SF).count() > 0
        return
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_entry_without_the_optional_part(tmp_path):
    """A copy of the repository without the optional folders serves the engine's own queries."""
    skip = shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    code = "import __spark_entry__ as e; print(e.__file__, len(e.queries()), len(e.oracle_sql()))"
    env = os.environ | {"PYTHONPATH": str(tmp_path / "copy")}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert out == [str(tmp_path / "copy" / "__spark_entry__.py"), str(len(queries.QUERIES)), str(len(queries.ORACLE_SQL))]


def test_stream_pairing_with_a_long_queue(spark, tmp_path):
    """1,500 requests of one connection wait at once, of which 1,024 may: stream and batch pair as their SQL does."""
    n = "CASE WHEN id < 1500 THEN"
    values = {"event_id": "id", "user_id": "7", "event_type": f"{n} 'view' ELSE 'error' END", "ts": "timestamp_seconds(1704067200 + id)", "value": "1.0"}
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    rows = spark.range(3000).selectExpr(*(f"CAST({values.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    for name in ("stream_pairing", "fifo_pairing"):
        got, want = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
        assert len(want) == 1024 and plain(got) == plain(want)


def test_stream_filter_swap_deals_its_parts_out(spark, tmp_path, monkeypatch):
    """A part of the entries, which lie together in one file, is handled by all cores and not by one."""
    monkeypatch.setattr(queries, "scratch_folder", lambda spark, label: f"file://{tmp_path}/{label}")
    queries.QUERIES["stream_filter_swap"](spark, SF)
    kept = spark.read.parquet(f"file://{tmp_path}/switchboard/history").filter("timestamp IS NOT NULL")
    files = kept.groupBy("batch", F.input_file_name()).count().collect()
    assert sum(r["count"] for r in files) == 1000
    for batch in range(4):
        mine = [r["count"] for r in files if r.batch == batch]
        assert sum(mine) == 250 and len(mine) >= 4 and max(mine) < 125


def test_port_labels_beyond_the_small_tables(spark, tmp_path):
    """A user whose number makes a port with a name: query and SQL both name it, as the reference does."""
    values = {"event_id": "id", "user_id": "7015 + id", "event_type": "'view'", "ts": "timestamp_seconds(1704067200 + id)", "value": "1.0"}
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    spark.range(4).selectExpr(*(f"CAST({values.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}" for f in schema)).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got, want = queries.QUERIES["port_labels"](spark, str(tmp_path)).toPandas(), con.execute(queries.ORACLE_SQL["port_labels"]).df()
    assert plain(got) == plain(want) == [("0", "tcp https"), ("1", "udp postgres"), ("2", "tcp mongodb"), ("3", "udp/27018")]
