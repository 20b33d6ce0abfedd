import pytest

from codeloom.api import CodeGraph


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("graph"))
    node = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, docstring string, signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean, decorators array<string>, return_type string, updated_at long"
    rows = [(i, k, n, None, f, "python", 1, 3, 0, 0, d, None, None, e, False, False, False, None, None, u) for i, k, n, f, d, e, u in [
        ("A", "class", "Walker", "a.py", None, True, 1), ("b", " Method", "walk_tree", "a.py", "Walks.", False, 1), ("c", "function", "helper", "b.py", None, False, 1), ("c", "function", "stale", "b.py", None, False, 0),
        ("t", "function", "test_it", "tests/test_b.py", None, False, 1), ("d", "function", "unused", "b.py", None, False, 1), (None, "function", "x", "b.py", None, False, 1)]]
    spark.createDataFrame(rows, node).write.parquet(f"{folder}/nodes.parquet")
    edges = [("A", "b", "contains", None, None, None, None), ("b", "c", "calls", 2, 1, '{"confidence":0.9}', None), ("b", "c", " CALLS", 2, 1, '{"confidence":', None), ("t", "b", "calls", 3, 1, None, None), ("c", "c", "calls", 1, 1, None, None), ("b", "ghost", "calls", 1, 1, None, None)]
    spark.createDataFrame(edges, "source string, target string, kind string, line int, col int, metadata string, provenance string").write.parquet(f"{folder}/edges.parquet")
    files = [("a.py", "h", "Python", 1, 1, 5, 2, False), ("a.py", "old", "python", 1, 1, 4, 2, True), ("b.py", "h", "python", 1, 1, 5, 2, None), ("tests/test_b.py", "h", "python", 1, 1, 5, 1, None)]
    spark.createDataFrame(files, "path string, content_hash string, language string, size long, modified_at long, indexed_at long, node_count int, generated boolean").write.parquet(f"{folder}/files.parquet")
    refs = [("c", "walk_tree", "calls", 1, 1, None, "b.py", "python", "pending", None)]
    spark.createDataFrame(refs, "from_node_id string, reference_name string, reference_kind string, line int, col int, candidates array<string>, file_path string, language string, status string, name_tail string").write.parquet(f"{folder}/unresolved_refs.parquet")
    return CodeGraph(spark, folder)


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_reads(graph):
    assert ids(graph.nodes()) == ["A", "b", "c", "d", "t"] and ids(graph.nodes(kinds=["method"])) == ["b"]
    assert ids(graph.nodes_by_name("helper")) == ["c"] and graph.nodes_by_name("stale").count() == 0
    assert [r["kind"] for r in graph.outgoing(["b"]).collect()] == ["calls"] and graph.incoming(["c"]).count() == 2
    assert ids(graph.files("**/test_*.py"), "path") == ["tests/test_b.py"] and graph.files().count() == 3


def test_traversals(graph):
    assert ids(graph.callers(["c"], 2)) == ["b", "t"] and ids(graph.callees(["t"], 1)) == ["b"]
    assert ids(graph.ancestors(["b"])) == ["A"] and graph.shortest("t", "c").collect()[0]["depth"] == 2
    assert ids(graph.affected_tests(["b.py"]), "path") == ["tests/test_b.py"]
    assert ids(graph.dead_code()) == ["d", "t"] and graph.circular_files().count() == 0
    assert {tuple(r) for r in graph.hierarchy().collect()} == {("A", "A", 0), ("b", "A", 1)}


def test_search_and_changes(graph):
    assert ids(graph.search("walk")) == ["A", "b"] and graph.search('AND "').count() == 5
    assert [(r["source"], r["target"]) for r in graph.resolve().collect()] == [("c", "b")]
    left = graph.without_files(["b.py"])
    assert ids(left["nodes"]) == ["A", "b", "t"] and left["edges"].count() == 2 and left["refs"].count() == 0
