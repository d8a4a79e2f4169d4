"""Every named query against its SQL."""

import math

import pytest
from pyspark.sql import functions as F

from tessella import queries


def rows(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple("nan" if isinstance(v, float) and math.isnan(v) else str(v) for v in r) for r in pdf[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert rows(got) == rows(want)
    assert len(got) > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tessella", tmp_path / "tessella", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True, timeout=60)


def test_reduce_nan_keeps_the_order_without_a_key(spark, sf_dir, tmp_path):
    import duckdb

    con = duckdb.connect()
    key = "CASE WHEN o_orderkey = 7 THEN NULL ELSE o_orderkey END AS o_orderkey"
    for table, columns in (("orders", f"* REPLACE ({key})"), ("lineitem", "*")):
        con.execute(f"COPY (SELECT {columns} FROM '{sf_dir}/{table}.parquet') TO '{tmp_path}/{table}.parquet'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = queries.reduce_nan(spark, str(tmp_path)).withColumn("sid", F.col("sid").cast("string")).toPandas()
    want = con.execute(f"SELECT * REPLACE (CAST(sid AS VARCHAR) AS sid) FROM ({queries.SQL['reduce_nan']})").df()
    assert rows(got.fillna("none")) == rows(want.fillna("none"))
    assert got["sid"].isna().sum() == 1
