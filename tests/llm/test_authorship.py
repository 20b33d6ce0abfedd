from codeloom.llm.authorship import classify

CODE = "def walk(rows):\n    for row in rows:\n        if row.depth > 3:\n            emit(row)\n    return rows\n" * 6
CASES = {
    "r/src/a.py": (CODE, "python", False, None),
    "r/src/flag.py": (CODE, "python", True, "flag"),
    "r/src/a_pb2.py": (CODE, "python", None, "name"),
    "r/src/__generated__/a.py": (CODE, "python", None, "tool folder"),
    "r/Vendor/a.py": (CODE, "python", None, "dependency folder"),
    "r/src/vendors/distribution/generator/a.py": (CODE, "python", None, None),
    "r/src/notice.py": ("# Code generated by idl. DO NOT EDIT.\n" + CODE, "python", False, "notice"),
    "r/src/late.go": ("/**\n * Copyright (c) 2020 X.\n */\n\n/*\n * This file was automatically generated by x.\n */\n" + CODE, "go", False, "notice"),
    "r/src/banner.js": ('const BANNER = "// Code generated by x. DO NOT EDIT.";\n' + CODE, "javascript", False, None),
    "r/src/mention.py": ("# Writes the banner of generated files, but is itself maintained by hand.\n" + CODE, "python", False, None),
    "r/src/data.ts": ("export const x = [\n" + "  1, 2, 3, -4, 0x1f, 5.5,\n" * 60 + "];\n", "typescript", False, "data"),
    "r/src/blob.js": ('window.x = "' + "Ab9/" * 900 + '";\n', "javascript", False, "data"),
    "r/src/table.py": ("SIZES = [1, 2, 3, 4, 5]\n" + CODE, "python", False, None),
    "r/static/a.js": ("!function(a,b){" + "a.walk=function(c){return c&&c.sort(b)};" * 40 + "}(1);", "javascript", False, "minified"),
    "r/src/copy.c": ("/* other head */\r\n" + "int walk(int a) {\r\n\treturn a + other_function(a);\r\n}\r\n" * 3, "c", False, "third-party text"),
    "r/src/empty.py": ("", "python", False, None),
    "r/src/null.py": (None, None, None, None),
}
UPSTREAM = "/* lib 1.0 */\n" + "int walk(int a) {\n    return a + other_function(a);\n}\n" * 3


def test_reasons(spark):
    files = [(p, 100, l, g, 5) for p, (_, l, g, _) in CASES.items()] + [("r/src/a.py", 100, "python", True, 1), ("r/src/big.ts", 1 << 21, "typescript", False, 5), (None, 1, "c", True, 5)]
    files = spark.createDataFrame(files, "path string, size long, language string, generated boolean, indexed_at long").selectExpr("*", "'clash' AS content", "'clash' AS reason")
    texts = [(p, c) for p, (c, *_) in CASES.items()] + [("r/src/a.py", CODE), (None, "x")]
    texts = spark.createDataFrame(texts, "path string, content string")
    upstream = spark.createDataFrame([(1, UPSTREAM), (2, None), (3, "")], "item_id long, content string")
    found = {r["path"]: r["reason"] for r in classify(files, texts, upstream).collect()}
    assert found == {p: r for p, (*_, r) in CASES.items() if r} | {"r/src/big.ts": "size"}
    assert classify(files.where("false"), texts.where("false"), upstream.where("false")).count() == 0


def test_long_comments_and_literals(spark):
    rows = [("a.c", "/*" + " * x\n" * 60_000 + "*/\nint a;\n"), ("b.c", 'char *a = "' + "\\n" * 60_000 + '";\n'), ("c.py", "# x\n" * 60_000)]
    files = spark.createDataFrame([(p, 1, "c", False, 1) for p, _ in rows], "path string, size long, language string, generated boolean, indexed_at long")
    texts = spark.createDataFrame(rows, "path string, content string")
    classify(files, texts, texts.selectExpr("1 AS item_id", "content")).collect()


def test_heads_short_copies_and_marks_in_text(spark):
    licence = "/*\n" + " * Redistribution and use are permitted.\n" * 300 + " */\n"
    apostrophes = "export function f(a) {\n  // the caller's batch\n  walk(a, b);\n" + "  emit(rows, depth, scope);\n" * 40 + "  // don't\n}\n"
    rows = [
        ("a.ts", "typescript", licence + "// Code generated by idl. DO NOT EDIT.\n" + CODE, "notice"),
        ("b.c", "c", "#include <a.h>\nint b;\n", "third-party text"),
        ("c.c", "c", "#include <b.h>\nint b;\n", None),
        ("d.ts", "typescript", apostrophes, None),
        ("e.js", "unknown", "const URLS = [\n" + "  'http://a.example/b/c/d/e/f/g',\n" * 60 + "];\n", "data"),
        ("f.go", "go", "package f\nvar x = `" + ("Ab9+" * 40 + "\n") * 20 + "`\n", "data"),
        ("g.py", "python", '"""' + "A long description of the module.\n" * 40 + '"""\nimport x\n', None),
    ]
    files = spark.createDataFrame([(p, 1, l, False, 1) for p, l, *_ in rows], "path string, size long, language string, generated boolean, indexed_at long")
    texts = spark.createDataFrame([(p, l, c) for p, l, c, _ in rows], "path string, language string, content string")
    upstream = spark.createDataFrame([(1, "x/b.h", "c", "// head\n  #include <a.h>\r\n\r\nint b;")], "item_id long, path string, language string, content string")
    found = {r["path"]: r["reason"] for r in classify(files, texts, upstream).collect()}
    assert found == {p: r for p, *_, r in rows if r}
