"""Queries against their DuckDB text on the smallest tables, and what belongs to no query."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from codeloom.functions import scalars
from codeloom.operators.search import search_terms
from codeloom.sources import extract
from verify import TABLES, norm

SF = "/root/testdata/sf0.001"
NAMES = [name for part in entry.PARTS for name in part.ORACLE]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    assert mine == sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_segments(spark):
    df = spark.createDataFrame([("parseHTTPServer_v2",), ("__init__",), ("",), (None,), ("a1B2",)], "name string")
    rows = [r[0] for r in df.select(scalars.segments(df["name"])).collect()]
    assert rows[0] == ["parse", "http", "server", "v2"] and rows[1] == ["init"] and rows[2] == [] and rows[3] is None


def test_search_terms():
    assert search_terms('Foo::bar "baz*" AND NOT qux') == ["foo", "bar", "baz", "qux"]


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/a.py").write_text("class A:\n    def m(self):\n        def inner(): pass\n")
    (tmp_path / "pkg/b.go").write_text("package b\nfunc (r *T) Run() {\n}\n")
    (tmp_path / "pkg/bad.bin").write_bytes(b"\xff\xfe\x00")
    files = extract.scan(spark, str(tmp_path), ["skip/"]).withColumn("language", scalars.language_of(extract.F.col("path")))
    rows = {(r["kind"], r["name"], r["file_path"].rsplit("/", 1)[-1]) for r in extract.extract(files).collect()}
    assert rows == {("class", "A", "a.py"), ("method", "m", "a.py"), ("function", "inner", "a.py"), ("method", "Run", "b.go")}
