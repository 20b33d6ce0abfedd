"""Extraction: symbols with ends, containment, references, of broken files too; hierarchies of any size alike."""

import random

import pytest

from codeloom.operators.hierarchy import hierarchy
from codeloom.operators.imports import receiver_calls
from codeloom.plans.scratch import Scratch
from codeloom.sources import structure as S
from codeloom.sources.extract import extract, extract_containment, extract_references

PY = 'import a.b, c\nfrom x import y\nclass A(B, metaclass=M):\n    """class Z(: text"""\n    def f(self,\n          k={}):\n        g(1); self.h("z(")\n\n    # def no(): pass\ndef last(): return 1\n'
TS = 'import {x} from "./m";\nexport class A extends B implements C, D {\n  private async f<T>(a: T): Promise<void> {\n    new E(); this.g(`${h("}")}`); // k()\n  }\n  if (x) { y(); }\n}\nconst k = (a) => l(a);\nnamespace N { function q() {} }\n'
GO = 'package p\nimport "x/y"\ntype T struct {\n\ta int\n}\nfunc (t *T) Run(a int) error {\n\treturn act(a)\n}\nfunc F() {\n'


def names(text, language):
    return [(s.kind, s.name, s.start, s.end) for s in S.symbols(text, language)]


def test_symbols():
    assert names(PY, "python") == [("class", "A", 3, 7), ("method", "f", 5, 7), ("function", "last", 10, 10)]
    assert names(TS, "typescript") == [("class", "A", 2, 7), ("method", "f", 3, 5), ("function", "k", 8, 8), ("namespace", "N", 9, 9)]
    assert names(GO, "go") == [("struct", "T", 3, 5), ("method", "Run", 6, 8), ("function", "F", 9, 9)]
    assert names("class A {\n  int f(int a) {\n    g(a);\n  }\n  A() { }\n", "java") == [("class", "A", 1, 5), ("method", "f", 2, 4), ("method", "A", 5, 5)]
    assert names("impl<T> X for Y {\n    pub fn f(&self) -> u8 { 'a' as u8 }\n}\nfn g() {}\n", "rust")[1:] == [("method", "f", 2, 2), ("function", "g", 4, 4)]
    assert names("struct S {\n  int a;\n};\nint f(int a);\nstatic int *g(int a)\n{\n}\n", "c") == [("struct", "S", 1, 3), ("function", "g", 5, 7)]
    assert names("", "python") == names("x", "cobol") == []


def test_references():
    def found(text, language):
        symbols = S.symbols(text, language)
        return {(symbols[r.owner].name if r.owner is not None else None, r.name, r.kind, r.line) for r in S.references(text, language, symbols)}

    assert found(PY, "python") == {(None, "a.b", "imports", 1), (None, "c", "imports", 1), (None, "x", "imports", 2), ("A", "B", "extends", 3), ("f", "g", "calls", 7), ("f", "self.h", "calls", 7)}
    assert found(GO, "go") == {(None, "x/y", "imports", 2), ("Run", "act", "calls", 7)}
    assert {("A", "B", "extends", 2), ("A", "C", "implements", 2), ("A", "D", "implements", 2), ("f", "E", "instantiates", 4), ("f", "this.g", "calls", 4), ("k", "l", "calls", 8), (None, "./m", "imports", 1)} <= found(TS, "typescript")


def test_rows(spark):
    rows = [("a/m.py", "Python", PY), ("a/m.py", "python", None), (None, "python", "x"), ("b.x", "cobol", "y"), ("c.go", "go", "func F( {\n" * 3)]
    files = spark.createDataFrame(rows, "path string, language string, content string").selectExpr("*", "'clash' AS kind")
    nodes, edges, refs = extract(files).collect(), extract_containment(files).collect(), extract_references(files).collect()
    ids = {n["id"]: n["name"] for n in nodes}
    assert {(ids.get(e["source"], "file"), ids[e["target"]]) for e in edges if ids[e["target"]] in ("A", "f", "last")} == {("file", "A"), ("A", "f"), ("file", "last")}
    assert all(r["from_node_id"] in ids or r["from_node_id"].startswith("file:") for r in refs) and len(refs) >= 6
    assert extract_references(files.where("false")).count() == 0


@pytest.mark.parametrize("what", ["roots", "paths", "descendants", "cycles"])
def test_components_of_any_size_give_the_same_rows(spark, what):
    rng = random.Random(7)
    links = [(f"t{rng.randrange(k)}", f"t{k}") for k in range(1, 30)]  # a tree
    links += [(f"d{a}", f"d{b}") for a, b in ((rng.randrange(18), rng.randrange(18)) for _ in range(26)) if a < b]  # several parents
    links += [(f"g{rng.randrange(16)}", f"g{rng.randrange(16)}") for _ in range(22)]  # cycles
    links += [(f"c{k}", f"c{k + 1}") for k in range(25)] + [("s", "s"), ("c3", "x"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "u")]
    df = spark.createDataFrame(links + [(None, "a"), ("b", None)] + links[:9], "source string, target string")
    small = sorted(map(str, hierarchy(df, Scratch(spark, "t"), what).collect()))
    huge = sorted(map(str, hierarchy(df, Scratch(spark, "t"), what, 0).collect()))
    assert small == huge and small


def test_receivers(spark):
    ts = "class B {\n  g() {}\n}\nclass A extends B {\n  f() {}\n  h() { this.g(); this.none(); }\n}\nfunction k(p: A) {\n  const x = new A(); x.f(); x.g(); p.f(); q.f();\n}\n"
    py = "class C:\n    def m(self):\n        self.n()\n    def n(self): pass\ndef t(c: C, d):\n    e = C()\n    c.m(); e.n(); d.m()\n"
    files = spark.createDataFrame([("a.ts", "typescript", ts), ("b.py", "python", py), ("c.go", "go", None)], "path string, language string, content string")
    names = {r["id"]: r["name"] for r in extract(files).collect()}
    found = {(names[r["caller"]], r["type_name"], names[r["target"]], r["depth"]) for r in receiver_calls(files, Scratch(spark, "t")).collect()}
    assert found == {("h", "A", "g", 1), ("k", "A", "f", 0), ("k", "A", "g", 1), ("m", "C", "n", 0), ("t", "C", "m", 0), ("t", "C", "n", 0)}
