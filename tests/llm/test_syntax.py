import pytest

from codeloom.llm import syntax
from codeloom.llm.parsing import judge, parse_files

GOOD = {
    "python": ["", "def f(a, *, b=1):\n    return [x for x in a if x]\n", "x = '''<<<<<<< HEAD\n'''\n", "class A:\r\n    pass"],
    "javascript": ["", "const a = `x ${b}`; // }\nexport default class A { b = null; get c() { return /[}/]/.test(d) ? 1 : 2 } }", "for (const [k, v] of m) if (k) go(v); else stop()\nlet a = b\nlet c = async (x) => { await x }", "!function(a,b){'use strict';a=[1,2];if(b>1){c()}}(1)", "import x, { y as z } from './q';\ndo { i++ } while (i < 3)\nswitch (a) { case 1: b(); break; default: c() }"],
    "typescript": ["", "export class A<T extends B> implements C { private x?: Map<string, number[]>; constructor(private readonly y: T) {} async f(a: string = 'b', ...c: any[]): Promise<Map<string, number>> { return c as unknown as Map<string, number> } }", "namespace N { export namespace M { type X = { a: string; b?: number } | null } }", "interface A { f(x: number): void; [k: string]: unknown }\nenum E { A = 1, B }\nfunction g<T>(x: T): x is T { return a < b }"],
    "java": ["", "package a.b;\nimport static a.b.*;\n@X(y = 1) public class A<T> extends B<T> implements C { private final Map<String, List<int[]>> m = new HashMap<>(); A(int x) throws E { this.x = x; } @Override public <R> R f(T... t) { for (String s : r(t)) { g(s); } try { a(); } catch (B | C e) { } finally { } return (R) t[0]; } enum D { X(1), Y { void z() {} }; int q; } static class E {} }", "class A { Runnable r = () -> { }; int f(int a) { return switch (a) { case 1 -> 2; default -> { yield 3; } }; } String s = \"\"\"\n }}{ \"\"\"; }"],
    "go": ["", "package a\nimport (\n\t\"x\"\n\ty \"z\"\n)\ntype T struct {\n\ta, b int `json:\"a\"`\n\t*E\n}\nfunc (t *T) F(a map[string][]int, b ...func(int) error) (int, error) {\n\tif x, ok := a[\"b\"]; ok && !t.c {\n\t\treturn 1, nil\n\t} else if y {\n\t}\n\tfor i, v := range a {\n\t\tgo func() { ch <- v }()\n\t}\n\tswitch z := t.(type) {\n\tcase int:\n\tdefault:\n\t\tt.a++\n\t}\n\treturn T{a: 1}.a, nil\n}\n"],
    "rust": ["", "use a::{b, c as d};\n#[derive(Debug)]\npub struct S<'a, T: Clone> { pub a: &'a str, b: Vec<Option<T>> }\nimpl<'a, T> Tr for S<'a, T> where T: Clone { fn f(&mut self, x: &[u8]) -> Result<(), E> { let y = match x { Some(z) if z > 1 => { g(z); } None => {} _ => return Ok(()) }; for i in 0..n { if let Some(q) = i { continue; } } vec![1, 2].iter().map(|x| x + 1).collect::<Vec<_>>()?; Ok(()) } }\nconst A: &str = \"a\n}\";\n/* x /* y */ */"],
    "c": ["", "#include <a.h>\n#define X(a) \\\n  {a\nstatic const char *n[] = {\"a\", \"b\"};\ntypedef struct { int a; unsigned b : 3; } T;\nint f(const char *a, int (*g)(int)) {\n  for (int i = 0; i < 3; i++) { if (a[i] == '{') break; else continue; }\n  do { x->y++; } while (z);\n  switch (q) { case 1: return (int) sizeof(T); default: ; }\n  return a ? 1 : -1;\n}\n"],
}
BAD = {
    "python": ["def f(:\n", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b\n", "x = (1\n", "class A:\n"],
    "javascript": ["function f( {", "let x: string = 1;", "<<<<<<< HEAD\na();\n=======\nb();\n>>>>>>> c", "def f():\n    return 1", "a = {b: 1", "/* open", "if (a {\n}"],
    "typescript": ["class A { f( }", "function f(a: ) {}", "package a\nfunc f() {}", "let a = 9f3c;"],
    "java": ["class A { void f() { return } }", "class A { int x }", "def f(): pass", "class A {", "public class A { void f() { a() } }"],
    "go": ["func f() {}", "package a\nfunc f() {\n\tx := \n}\n", "package a\nfunc f( {\n}\n", "package a\n/* x"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "struct S { a: }", "def f(): pass"],
    "c": ["int f( {", "int f(void) { return 1 }", "# notes\n\ntext here", "int a[ = {1};"],
}


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_valid(language, text):
    assert syntax.grammar(language).valid(text)


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BAD.items() for t in v])
def test_invalid(language, text):
    assert not syntax.grammar(language).valid(text)


def test_depth_needs_no_stack():
    assert syntax.grammar("c").valid("int f(void) {" + "{" * 20_000 + "}" * 20_000 + "}")
    assert not syntax.grammar("typescript").valid("namespace A {" * 5000)


def test_causes():
    assert list(judge("a.go", "go", "def f(x):\n    return x\n"))[0][2:] == (False, "python", "wrong language", ["python"])
    assert list(judge("a.go", "Go", "package a\n<<<<<<< x\n"))[0][2:] == (False, None, "merge conflict", [])
    assert list(judge("a", "cobol", "x"))[0][2] is None
    assert list(judge(None, "go", "x")) == list(judge("a", "go", None)) == []


def test_rows(spark):
    rows = [("a.py", "python", "x = ("), ("a.py", "python", "x = ("), ("b.py", None, "x"), ("c.py", "python", ""), ("d.py", "python", None), (None, "python", "x"), ("e.py", "PYTHON", "y = 1\n" * 200_000)]
    df = spark.createDataFrame(rows, "path string, language string, content string").withColumn("valid", __import__("pyspark").sql.functions.lit("clash"))
    found = {r["path"]: r["valid"] for r in parse_files(df).collect()}
    assert found == {"a.py": False, "b.py": None, "c.py": True, "e.py": True}
    assert parse_files(df.where("false")).count() == 0


def test_all_grammars_read_every_file():
    assert list(judge("a.js", "javascript", "const a = 1;\n"))[0][2:] == (True, None, None, ["javascript", "typescript"])
    assert list(judge("a", "cobol", "def f(x):\n    return x\n"))[0][2:] == (None, None, None, ["python"])
    assert set(list(judge("a.go", "go", ""))[0][5]) == set(syntax.LANGUAGES)


@pytest.mark.parametrize("language,text", [(k, t) for k, v in GOOD.items() for t in v])
def test_first_tokens_never_rule_out_a_valid_text(language, text):
    for name in syntax.LANGUAGES:
        if syntax.grammar(name).valid(text):
            assert all(syntax.grammar(name).plausible(text, first) for first in range(1, 80))


def test_python_beyond_the_limits_of_its_parser():
    valid = syntax.grammar("python").valid
    deep = "x = " + "(" * 300 + "1" + ")" * 300 + "\n"
    assert valid(deep) and not valid(deep + "def f(:\n") and not valid(deep.replace("1", "1 +"))
    assert valid("x = " + "f(" * 300 + "*a, k=[1, {2: 3}][0:1]" + ")" * 300) and not valid("x = " + "f(" * 300 + "a b" + ")" * 300)
    blocks = "".join(" " * k + f"if a{k}:\n" for k in range(150))
    assert valid(blocks + " " * 150 + "pass\ny = \"(\"\n") and not valid(blocks + " " * 150 + "pass pass\n")
    assert not valid(blocks) and not valid(blocks + " " * 150 + "pass\n" + " " * 149 + "  b\n" + "else x\n")
    assert valid("x = 1" + " + 1" * 50_000) and valid("x = " + "-" * 100_000 + "1") is None
