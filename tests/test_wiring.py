"""Passes, imports, searches and usage on small hand-made cases."""

import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.operators import evaluation as E
from codeloom.operators import imports as I
from codeloom.operators import passes as P
from codeloom.operators import retrieval as R
from codeloom.operators import walks as W
from codeloom.plans.scratch import Scratch
from codeloom.streaming import jobs


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_overriding_takes_the_last_overload(spark):
    types = spark.createDataFrame([("S", "B"), ("S", "B"), ("B", "B"), (None, "B")], "sub string, base string")
    held = spark.createDataFrame([("B", "b1", "f", 1), ("B", "b2", "f", 9), ("S", "s1", "f", 3), ("S", "s2", "g", 4)], "owner string, member string, name string, start_line int")
    assert rows(P.overriding(types, held)) == {("b2", "s1")}
    assert P.overriding(types.where("false"), held).count() == 0


def test_structural_needs_every_name(spark):
    interfaces = spark.createDataFrame([("I", "a"), ("I", "b"), ("J", "a"), ("J", "a")], "owner string, name string")
    structs = spark.createDataFrame([("S", "a"), ("S", "b"), ("S", "c"), ("T", "a"), ("I", "a")], "owner string, name string")
    assert rows(P.structural(interfaces, structs)) == {("S", "I"), ("S", "J"), ("T", "J"), ("I", "J")}
    many = spark.createDataFrame([(f"s{k}", "a") for k in range(50)], "owner string, name string")
    assert P.structural(interfaces.where("owner = 'J'"), many).count() == 40 and P.structural(interfaces.where("owner = 'J'"), many, None).count() == 50


def test_emitters_and_their_caps(spark):
    emitted = spark.createDataFrame([("f", "x"), ("f", "x"), ("g", "y"), ("h", "x")] + [(f"m{k}", "z") for k in range(7)], "fn string, event string")
    registered = spark.createDataFrame([("x", "on"), ("y", "g_name"), ("z", "on"), ("x", "nobody")], "event string, handler string")
    functions = spark.createDataFrame([("h", "on"), ("z9", "on"), ("g", "g_name")], "id string, name string")
    assert rows(P.emitters(emitted, registered, functions)) == {("f", "h")}


def test_bus_patterns(spark):
    dispatches = spark.createDataFrame([("f", "user.created"), ("g", "user.card.paid"), ("h", "order")], "source string, event string")
    handlers = spark.createDataFrame([("a", "user.*"), ("b", "user.**"), ("c", "order"), ("d", "*.created"), ("h", "order"), ("e", "use.*")], "target string, pattern string")
    assert rows(P.bus_matches(dispatches, handlers)) == {("f", "a"), ("f", "b"), ("f", "d"), ("g", "b"), ("h", "c")}


def test_queue_tiers(spark):
    producers = spark.createDataFrame([("p", "mail", "q1"), ("r", "mail", None), ("s", "sms", "q2"), ("t", "none", None)], "source string, job string, queue string")
    consumers = spark.createDataFrame([("a", "mail", "q1"), ("b", "mail", None), ("c", None, "q2"), ("d", None, "q1")], "target string, job string, queue string")
    assert rows(P.queue_matches(producers, consumers)) == {("p", "a"), ("r", "a"), ("r", "b"), ("s", "c")}


def test_http_routes(spark):
    calls = spark.createDataFrame([("c1", "get", "/users/7"), ("c2", "POST", "/users/7"), ("c3", "GET", "/users/me"), ("c4", "GET", "/files/a/b"), ("c5", "GET", "/tie/x"), ("c6", "GET", "/")], "source string, method string, path string")
    routes = spark.createDataFrame([("r1", "GET", "/users/:id"), ("r2", "GET", "/users/me"), ("r3", "ALL", "/files/*"), ("r4", "GET", "/tie/:a"), ("r5", "GET", "/tie/{b}"), ("r6", "ANY", "/:any/x/y/z")], "target string, method string, path string")
    assert rows(P.http_matches(calls, routes)) == {("c1", "r1"), ("c3", "r2"), ("c4", "r3")}


def test_mappers_and_merging(spark):
    statements = spark.createDataFrame([("x", "com.a.UserMapper.find"), ("y", "UserMapper.all"), ("z", "alone")], "id string, name string")
    methods = spark.createDataFrame([("m", "file::UserMapper.find"), ("n", "a::UserMapper::all"), ("o", "b::UserMapper::all")], "id string, qualified_name string")
    assert rows(P.mapper_matches(statements, methods)) == {("x", "m")}
    one, two = (spark.createDataFrame(x, "source string, target string") for x in ([("a", "b")], [("a", "b"), ("a", "c")]))
    assert rows(P.merged([("first", one), ("second", two)])) == {("a", "b", "first"), ("a", "c", "second")}


def test_imports(spark):
    paths = spark.createDataFrame([(p,) for p in ("r/src/a/m.ts", "r/src/a/n/index.ts", "r/src/b.ts", "r/pkg/x/y.py", "r/pkg/x/__init__.py", "r/src/c/t.h", "r/j/org/k/T.java", "r/rs/w/mod.rs", "r/go/store/s.go", "other/src/a/m.ts")], "path string")
    refs = [
        ("r/src/a/q.ts", "typescript", "./m", 1), ("r/src/a/q.ts", "TypeScript", "../b", 2), ("r/src/a/q.ts", "typescript", "./n", 3), ("r/src/a/q.ts", "typescript", "./none", 4),
        ("r/pkg/x/z.py", "python", ".y", 5), ("r/main.py", "python", "pkg.x.y", 6), ("r/main.py", "python", "pkg.x", 7), ("r/src/c/t.c", "c", "t.h", 8), ("r/j/A.java", "java", "org.k.T", 9),
        ("r/rs/l.rs", "rust", "crate::w", 10), ("r/go/m.go", "go", "example.org/kit/store", 11), (None, "go", "x", 12), ("r/a.py", None, None, 13),
    ]
    refs = spark.createDataFrame(refs, "file_path string, language string, module string, line int")
    found = {r["line"]: (r["target"], r["what"], r["confidence"]) for r in I.resolve_imports(refs, paths).collect()}
    assert found == {
        1: ("r/src/a/m.ts", "file", 1.0), 2: ("r/src/b.ts", "file", 1.0), 3: ("r/src/a/n/index.ts", "file", 1.0), 5: ("r/pkg/x/y.py", "file", 1.0), 6: ("r/pkg/x/y.py", "file", 0.9),
        7: ("r/pkg/x/__init__.py", "file", 0.9), 8: ("r/src/c/t.h", "file", 1.0), 9: ("r/j/org/k/T.java", "file", 0.9), 10: ("r/rs/w/mod.rs", "file", 0.9), 11: ("r/go/store", "folder", 0.5),
    }
    assert I.resolve_imports(refs.where("false"), paths).count() == 0


def test_calls_through_supertypes(spark):
    calls = spark.createDataFrame([("f", "A", "m"), ("f", "A", "n"), ("f", "A", "none")], "caller string, type_name string, member string")
    types = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "id string, name string")
    supers = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    members = spark.createDataFrame([("a", "a.m", "m"), ("b", "b.m", "m"), ("c", "c.n", "n")], "owner string, id string, name string")
    assert rows(I.through_supertypes(calls, types, supers, members, Scratch(spark, "t"))) == {("f", "A", "m", "a.m", 0), ("f", "A", "n", "c.n", 2)}


def test_queries_taken_apart():
    assert R.parse_query('kind:class lang:Go path:"a b" name:x find it kind:nonsense foo: :bar') == {"kind": ["class"], "language": ["go"], "path": ["a b"], "name": ["x"], "text": "find it kind:nonsense foo: :bar"}
    assert R.parse_query("") == {"kind": [], "language": [], "path": [], "name": [], "text": ""}
    assert R.normal_spelling("gen_server:call run/2, kind:class a/b") == "gen_server.call run, kind:class a/b"
    assert R.named_symbols("why does parseHeader call `walk` and http.Server::start or snake_case?") == ["parseHeader", "walk", "http.Server::start", "start", "snake_case"]


def test_routes_and_walks(spark):
    df = spark.createDataFrame([("POST /v1/users",), ("/plain path",), ("nonsense /x",), ("get /a b",)], "name string")
    method, path = W.split_route(F.col("name"))
    assert [tuple(r) for r in df.select(method, path).collect()][:3] == [("POST", "/v1/users"), (None, "/plain path"), (None, "nonsense /x")]
    assert W.depth_first([("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")], "a", 9) == [("a", 0), ("b", 1), ("c", 2)]
    assert W.depth_first([("a", "b"), ("a", "c")], "a", 2) == [("a", 0), ("b", 1)] and W.depth_first([], "a", 5) == [("a", 0)]


def test_rules(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), ([],), (None,)], "t array<string>")
    holds = lambda text: [r[0] for r in df.select(E.rule(text, lambda n: F.array_contains("t", n))).collect()]
    assert holds("a and not b") == [True, False, False, None] and holds("not (a or b)") == [False, False, True, None] and holds("b or not a and a") == [False, True, False, None]
    for wrong in ("", "a and", "(a", "a b", "or a"):
        with pytest.raises(ValueError):
            E.rule(wrong, lambda n: F.array_contains("t", n))


def test_costs(spark):
    df = spark.createDataFrame([("VIEW", 499, 100, 10), ("view", 500, 600, 0), ("none", 5, 0, 0)], "m string, i long, c long, o long")
    band, cost = E.usage_cost(F.col("m"), F.col("i"), F.col("c"), F.col("o"))
    assert [(r[0], None if r[1] is None else float(r[1])) for r in df.select(band, cost).collect()] == [("short", 0.00061125), ("long", 0.00015), (None, None)]
    _, missing = E.usage_cost(F.col("m"), F.col("i"), F.col("c"), F.col("o"), {"view": {"threshold": None, "short": {"input": "1", "cached": None, "output": "1"}}})
    assert [r[0] for r in df.select(missing).collect()] == [None, None, None]


def test_texts_for_readers():
    assert E.render_tree(["a/b.py", "a/c/d.py", "e.py", "a/b.py"]) == "a/\n  c/\n    d.py\n  b.py\ne.py"
    assert E.render_markdown([{"x": "a|b", "y": None}], "T").split("\n")[-1] == "| a\\|b |  |" and "Nothing" in E.render_markdown([], "T")
    assert [E.format_bytes(n) for n in (0, 1023, 1024, 5 << 20)] == ["0 B", "1023 B", "1.0 KB", "5.0 MB"]
    assert E.number_lines("a\nb", 9) == " 9  a\n10  b"
    assert [E.freshness(*x) for x in ((False, True, None, None, False), (True, False, {}, "h", False), (True, True, None, "h", False), (True, True, {"head": "g"}, "h", False), (True, True, {"head": "h"}, "h", True), (True, True, {"head": "h"}, "h", False))] == ["MISSING", "INVALID", "UNKNOWN", "STALE", "STALE", "FRESH"]
    assert [E.backoff(k) for k in (0, 1, 5, 99)] == [1000, 2000, 30_000, 30_000]


def test_watch_and_bucketed_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.py").write_text("x")
    stream = jobs.watch(spark, str(tmp_path / "in"), "*.py").select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length")
    assert rows(jobs.drained(stream, Scratch(spark, "t"), "append")) == {("a.py", 1)}
    newest = lambda df: df.groupBy("k").agg(F.max("v").alias("v"))
    kept = jobs.BucketedTable(Scratch(spark, "t"), "k", newest, 4)
    assert kept.rows() is None
    for batch in ([("a", 1), ("b", 1)], [("a", 3), ("c", 1)], [("b", 0)], [("a", 2), (None, 1)]):
        kept.merge(spark.createDataFrame(batch, "k string, v int"))
    assert rows(kept.rows()) == {("a", 3), ("b", 1), ("c", 1), (None, 1)}
