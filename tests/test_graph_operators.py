"""Operators of the core against brute force on small random inputs."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from codeloom.operators import resolve
from codeloom.operators.components import connected_components
from codeloom.operators.hierarchy import hierarchy, traverse
from codeloom.operators.skew import skewed_key_counts
from codeloom.operators.store import GraphStore
from codeloom.plans.scratch import Scratch


def brute_roots(links):
    links = {x for x in links if x[0] is not None and x[1] is not None}
    children, parents, nodes = defaultdict(set), defaultdict(set), set()
    for s, t in links:
        children[s].add(t)
        parents[t].add(s)
        nodes |= {s, t}

    def reach(start):
        seen, queue = {}, deque([(start, 0)])
        while queue:
            x, d = queue.popleft()
            for c in children[x]:
                if c not in seen:
                    seen[c] = d + 1
                    queue.append((c, d + 1))
        return seen

    below = {x: reach(x) for x in nodes}
    bad = {x for x in nodes if x in below[x]}
    bad |= {y for x in bad for y in below[x]}
    out = {(x, "", -1) for x in bad}
    for root in nodes:
        if not parents[root]:
            out.add((root, root, 0))
            out |= {(x, root, d) for x, d in below[root].items() if x not in bad}
    return out


def random_links(rng, n, m):
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]


@pytest.mark.parametrize("seed", range(40))
def test_traversal_of_components(seed):
    rng = random.Random(seed)
    links = random_links(rng, rng.randint(1, 14), rng.randint(0, 16))
    assert set(traverse(links, "roots")) == brute_roots(links)
    paths = list(traverse(links, "paths"))
    assert {p[:3] for p in paths} == brute_roots(links)
    for node, root, depth, path in paths:
        if depth >= 0:
            assert path[0] == root and path[-1] == node and len(path) == depth + 1
            assert all(link in set(links) for link in zip(path, path[1:]))


@pytest.mark.parametrize("max_links", [1_000_000, 0, 5])
def test_hierarchy_small_and_huge_components_agree(spark, max_links):
    rng = random.Random(7)
    links = random_links(rng, 25, 22) + [(f"c{i}", f"c{i + 1}") for i in range(30)] + [("x", "x"), (None, "n1"), ("n1", None), ("c0", "c1")]
    df = spark.createDataFrame(links, "source string, target string").withColumn("comp", F.lit("clash")).withColumn("v", F.lit(1))
    found = {tuple(r) for r in hierarchy(df, Scratch(spark, "t"), "roots", max_links).collect()}
    assert found == brute_roots(links)
    paths = {r["node_id"]: r["path"] for r in hierarchy(df, Scratch(spark, "t"), "paths", max_links).where("node_id = 'c30'").collect()}
    assert paths["c30"] == [f"c{i}" for i in range(31)]


def test_descendants_agree(spark):
    links = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("z", "z"), ("y", "z")]
    df = spark.createDataFrame(links, "source string, target string")
    rows = [{tuple(r) for r in hierarchy(df, Scratch(spark, "t"), "descendants", m).collect()} for m in (100, 0)]
    assert rows[0] == rows[1] == {("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)}


def test_cycles_are_reported(spark):
    links = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "e")]
    df = spark.createDataFrame(links, "source string, target string")
    for m in (100, 0):
        found = {tuple(r) for r in hierarchy(df, Scratch(spark, "t"), "cycles", m).collect()}
        assert ("c", "c") in found and len(found & {("a", "b"), ("b", "a")}) == 1 and ("d", "e") not in found


def test_hierarchy_of_nothing(spark):
    df = spark.createDataFrame([], "source string, target string")
    assert hierarchy(df, Scratch(spark, "t"), "roots").count() == 0


def test_components_against_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(None, 3), (5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            parent[find(a)] = find(b)
    rows = connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()
    assert {r["v"] for r in rows} == set(parent)
    groups = defaultdict(set)
    for r in rows:
        groups[r["comp"]].add(r["v"])
    want = defaultdict(set)
    for x in parent:
        want[find(x)].add(x)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in want.values()}


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_skewed_counts(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.choice(["k", None]), rng.choice([None, *map(str, range(9))])) for _ in range(800)]
    rows += [("hot", "k", "same")] * 300
    df = spark.createDataFrame(rows, "target string, kind string, source string").repartition(5).withColumn("part", F.lit(1)).withColumn("first", F.lit("x"))
    found = {(r[0], r[1]): (r[2], r[3]) for r in skewed_key_counts(df, "target", "kind", "source", parts).collect()}
    want = {}
    for t, k, s in rows:
        n, d = want.setdefault((t, k), [0, set()])
        want[t, k][0] += 1
        if s is not None:
            d.add(s)
    assert found == {key: (n, len(d)) for key, (n, d) in want.items()}


def test_skewed_counts_of_nothing(spark):
    df = spark.createDataFrame([], "target string, kind string, source string")
    assert skewed_key_counts(df, "target", "kind", "source").count() == 0


def write_graph(spark, path, nodes, edges=(), refs=()):
    made = [
        ("nodes", "id kind name qualified_name file_path language", nodes, ["start_line int", "updated_at long", "is_exported boolean"]),
        ("edges", "source target kind provenance", edges, ["line int", "col int", "metadata string"]),
        ("unresolved_refs", "from_node_id reference_name reference_kind file_path language", refs, ["line int", "col int", "status string", "name_tail string"]),
    ]
    absent = [*"end_line start_column end_column docstring signature visibility is_async is_static is_abstract decorators return_type".split()]
    for name, columns, rows, more in made:
        df = spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in columns.split()))
        for c in [*more, *(f"{a} string" for a in absent if name == "nodes")]:
            df = df.withColumn(c.split()[0], F.lit(1 if c == "updated_at long" else None).cast(c.split()[1]))
        df.write.parquet(f"{path}/{name}.parquet")
    return GraphStore(spark, str(path))


def test_ladder_resolves_more_than_exact_names(spark, tmp_path):
    nodes = [
        ("a", "function", "main", "main", "x.py", "python"), ("b", "function", "loadAll", "loadAll", "y.py", "python"),
        ("c", "method", "run", "Job::run", "y.py", "python"), ("d", "method", "run", "Other::run", "z.py", "python"),
        ("e", "function", "hook", "hook", "x.py", "python"), ("f", "function", "hook", "hook", "y.py", "python"), ("g", "function", "goOnly", "goOnly", "w.go", "go"),
    ]
    refs = [("a", n, k, "x.py", "python") for n, k in (("loadall", "calls"), ("Job::run", "calls"), ("hook", "function_ref"), ("goonly", "calls"), ("nothing", "calls"))]
    g = write_graph(spark, tmp_path, nodes, refs=refs)
    found = {(r["reference_name"], r["id"], r["confidence"], r["rung"]) for r in resolve.ladder_matches(g).collect()}
    assert found == {("loadall", "b", 0.5, 5), ("Job::run", "c", 0.95, 2), ("hook", "e", 0.95, 1), ("goonly", "g", 0.3, 5)}
    edges = {(r["target"], r["kind"]) for r in resolve.ladder_edges(g).collect()}
    assert edges == {("b", "calls"), ("c", "calls"), ("e", "references")}
    assert {tuple(r) for r in resolve.ladder_admission(g).collect()} == {("resolved", 3), ("failed", 2)}


def test_rebind_counts_edges_of_a_name(spark, tmp_path):
    nodes = [(f"n{i}", "function", "many", "many", "x.py", "python") for i in range(25)] + [(f"h{i}", "function", "hub", "hub", "x.py", "python") for i in range(2)]
    nodes += [(f"s{i}", "function", f"s{i}", f"s{i}", "x.py", "python") for i in range(resolve.CEILING + 1)]
    edges = [("s0", f"n{i}", "contains" if i else "calls", "heuristic" if i == 1 else None) for i in range(25)]
    edges += [(f"s{i}", "h0", "calls", None) for i in range(resolve.CEILING + 1)] + [("s0", "h1", "calls", "heuristic")]
    found = {(r["source"], r["target"], r["kind"]) for r in resolve.rebind_edges(write_graph(spark, tmp_path, nodes, edges)).collect()}
    assert found == {e[:3] for e in edges[:25] if e[3] is None}


def test_cycles_do_not_depend_on_size(spark):
    rng = random.Random(11)
    links = random_links(rng, 14, 20) + [("c", "b"), ("b", "a"), ("a", "c"), ("c", "d"), ("d", "n1"), ("y", "y"), ("y", "c")]
    below = defaultdict(set)
    for s, t in links:
        below[s].add(t)
    for _ in links:
        for s in list(below):
            below[s] |= {y for x in list(below[s]) for y in below[x]}
    want = {(s, t) for s, t in links if s >= t and s in below[t]}
    assert {("c", "b"), ("b", "a"), ("y", "y")} <= want
    df = spark.createDataFrame(links, "source string, target string")
    for m in (1000, 0):
        assert sorted(tuple(r) for r in hierarchy(df, Scratch(spark, "t"), "cycles", m).collect()) == sorted(want)
