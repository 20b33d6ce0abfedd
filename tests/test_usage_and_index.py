"""Token usage, the index of version control, the search index."""

import subprocess

from codeloom.operators.index import SearchIndex
from codeloom.operators.search import bm25, search_terms
from codeloom.plans.scratch import Scratch
from codeloom.sources.worktree import index_entries, tracked_files
from codeloom.streaming import usage
from codeloom.streaming.jobs import drained


def event(seq, kind, turn=None, model=None, scope=None, tokens=(0, 0, 0, 0), session="s"):
    return (session, seq, kind, model, turn, scope, *tokens)


EVENTS = [
    event(1, "turn_context", "t1", "m"), event(2, "task_started", "t1"), event(3, "token_count", tokens=(10, 2, 5, 15)), event(3, "token_count", tokens=(99, 9, 9, 99)), event(4, "task_complete", "t1"),
    event(5, "task_started", "t2"), event(6, "token_count", tokens=(30, 6, 9, 39)), event(7, "token_usage_record", scope="turn", tokens=(7, 1, 1, 8)), event(8, "task_complete", "t2"),
    event(9, "task_started", "t3"), event(10, "token_count", tokens=(4, 0, 1, 5)), event(11, "task_complete", "t3"), event(1, "task_complete", "x", session="empty"),
]
TURNS = {("s", "t1", "m", 10, 2, 5, 15, False), ("s", "t2", "m", 7, 1, 1, 8, False), ("s", "t3", "m", 4, 0, 1, 5, True), ("empty", "x", None, 0, 0, 0, 0, False)}


def test_turns_over_several_batches(spark, tmp_path):
    folder = str(tmp_path / "events")
    for part in (EVENTS[:4], EVENTS[4:7], EVENTS[7:] + EVENTS[:3]):
        spark.createDataFrame(part, usage.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", "1").parquet(folder)
    assert {tuple(r) for r in drained(usage.completed_turns(stream), Scratch(spark, "t"), "append").collect()} == TURNS


def test_tracked_files(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "copy"), *a], check=True, capture_output=True)
    (tmp_path / "copy/src").mkdir(parents=True)
    (tmp_path / "copy/a.py").write_text("x = 1\n")
    (tmp_path / "copy/src/long_name_of_a_file.py").write_text("")
    (tmp_path / "copy/other.txt").write_text("not added")
    git("init", "-q")
    git("add", "a.py", "src")
    for version in ("2", "4"):
        git("update-index", "--index-version", version)
        entries = {p: s for p, _, s, _ in index_entries((tmp_path / "copy/.git/index").read_bytes())}
        assert entries == {"a.py": 6, "src/long_name_of_a_file.py": 0}
    assert {(r["copy"], r["path"]) for r in tracked_files(spark, str(tmp_path / "copy")).collect()} == {("copy", "a.py"), ("copy", "src/long_name_of_a_file.py")}


def test_index_equals_scan(spark):
    rows = [(str(k), n, f"f::{n}", d, s) for k, (n, d, s) in enumerate([("walkCache", "Walks the cache.", "(a)"), ("queue", None, None), ("cacheWalker", "walk walk", ""), ("other", "", "cache")])]
    nodes = spark.createDataFrame(rows, "id string, name string, qualified_name string, docstring string, signature string")
    index = SearchIndex.build(nodes, Scratch(spark, "t"))
    for text in ("walk", "walk cache", "que*", "none", ""):
        mine = {r["id"]: round(r["score"], 9) for r in index.search(text).collect()}
        terms = search_terms(text)
        assert mine == ({r["id"]: round(r["score"], 9) for r in bm25(nodes, terms).collect()} if terms else {})
    assert "StringStartsWith(term,walk)" in index.search("walk")._jdf.queryExecution().toString()
