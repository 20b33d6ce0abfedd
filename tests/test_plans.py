"""Plans: what is read from the tables, and how often."""

import re

import pytest

from codeloom.operators import readers, search, traversal

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def scans(text: str, table: str) -> list[set[str]]:
    """The columns of every scan of a table in a plan."""
    out = []
    for m in re.finditer(r"Scan parquet[^\n]*\n(?:[^\n]+\n)*?", text):
        part = text[m.start() :].split("\n\n")[0]
        if f"/{table}.parquet" in part:
            schema = re.search(r"ReadSchema: struct<(.*)>", part)
            out.append(set(re.findall(r"(?:^|,)(\w+):", re.sub(r"(?:array|struct)<[^<>]*>", "x", schema.group(1)))) if schema else set())
    return out


@pytest.mark.parametrize("name,most", [("f18_exported_symbols", 7), ("sc11_nodes_of_kind", 8), ("a08_unreferenced", 8)])
def test_only_needed_columns_of_nodes_are_read(spark, name, most):
    query = (readers.QUERIES | search.QUERIES | traversal.QUERIES)[name]
    found = scans(plan(query(spark, SF)), "nodes")
    assert found and all(len(columns) <= most and "docstring" not in columns for columns in found)


def test_located_edges_scan_nodes_once_per_end(spark):
    text = plan(readers.QUERIES["a06_file_dependents"](spark, SF))
    assert len(scans(text, "nodes")) <= 2 and len(scans(text, "edges")) == 1
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
