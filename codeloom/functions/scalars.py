"""Column functions over identifiers, paths and kinds; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
# Names and folders of tests: file names of any case, file names in humps, folders below another, folders at the
# root, source sets in humps, folders of test support.
TEST_RULES = (
    r"(?i:(?:^|/)test[_.][^/]*$|[._-](?:test|tests|spec|specs)\.[a-z0-9]+$)",
    r"(?:Test|Tests|TestCase|Tester|Spec|Specs)\.[A-Za-z0-9]+$",
    r"(?i:/(?:tests|test|__tests__|spec|specs|testlib|testing|e2e)/)",
    r"(?i:^(?:test|tests|spec|specs|e2e)/)",
    r"(?:^|/)[A-Za-z0-9]*(?:Test|Tests|Spec)/",
    r"(?i:(?:^|/)(?:[\w.]+[-_]test(?:s|ing)?|testdata|testutils?|test[-_]utils?|fakes?|mocks?|__mocks__|stubs)/)",
)
TEST_PATH = "|".join(TEST_RULES)
NON_PRODUCTION = r"(?:^|/)(?:integration|samples?|examples?|fixtures?|benchmarks?|demos?)/"
EXTENSIONS = {"ts": "typescript", "tsx": "typescript", "mts": "typescript", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "py": "python", "pyi": "python", "go": "go", "java": "java", "rs": "rust", "c": "c", "h": "c", "rb": "ruby", "php": "php", "cs": "csharp", "kt": "kotlin", "swift": "swift", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "scala": "scala", "lua": "lua", "sql": "sql"}
KIND_WEIGHTS = {
    "function": 10, "method": 10,
    "interface": 9, "trait": 9, "protocol": 9, "route": 9,
    "class": 8, "component": 8,
    "type_alias": 6, "struct": 6, "union": 6,
    "enum": 5,
    "module": 4, "namespace": 4,
    "property": 3, "field": 3, "constant": 3, "enum_member": 3,
    "variable": 2,
    "import": 1, "export": 1,
    "parameter": 0, "file": 0,
}
VENDORED = ("vendor", "vendored", "third_party", "third-party", "thirdparty", "external", "externals", "node_modules", "bower_components", "site-packages", "godeps", "pods", ".venv", "venv")
HEADER_SUFFIXES = (".h", ".hh", ".hpp", ".hxx", ".h++", ".inc", ".d.ts", ".d.mts", ".d.cts", ".pyi", ".pxd")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """The folder of a path; '.' for a file of the root."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column) -> Column:
    """The language that a path's extension names; 'unknown' for others."""
    table = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[extension(path)], F.lit("unknown"))


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_test_file(path: Column) -> Column:
    """The wide reading: also examples, fixtures, benchmarks and demos, but for folders below a src folder."""
    low = F.lower(path)
    above = F.when(F.instr(low, "/src/") > 0, F.concat(F.substring_index(low, "/src/", 1), F.lit("/"))).when(low.startswith("src/"), "").otherwise(low)
    return is_test_path(path) | above.rlike(NON_PRODUCTION)


def is_header(path: Column) -> Column:
    low = F.lower(path)
    out = low.endswith(HEADER_SUFFIXES[0])
    for suffix in HEADER_SUFFIXES[1:]:
        out = out | low.endswith(suffix)
    return out


def is_vendored(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, VENDORED)))


def name_tail(name: Column) -> Column:
    """A reference name without /arity, after its last '.' or ':'."""
    return F.regexp_extract(F.regexp_replace(name, r"/\d+$", ""), r"([^.:]*)$", 1)


def segments(name: Column) -> Column:
    """The distinct words of an identifier in any script: humps and separators cut, lower case, 2 to 32 characters, no bare numbers, twelve at most."""
    humps = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    parts = F.split(F.lower(F.regexp_replace(humps, r"[^\p{L}\p{N}]+", " ")), " ")
    return F.slice(F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & (F.length(w) <= 32) & ~w.rlike(r"^\p{N}+$"))), 1, 12)


def segment_sql(name: str) -> str:
    """DuckDB's text of ``segments``."""
    humps = rf"regexp_replace(regexp_replace({name}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}}+)(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return rf"list_slice(list_distinct(list_filter(string_split(lower(regexp_replace({humps}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' '), lambda w: length(w) >= 2 AND length(w) <= 32 AND NOT regexp_matches(w, '^\p{{N}}+$'))), 1, 12)"


def plurals(word: Column) -> Column:
    """A word with its singular or plural forms."""
    return F.array_distinct(F.array(word, F.regexp_replace(word, "ies$", "y"), F.regexp_replace(word, "(?<!s)s$", ""), F.concat(word, F.lit("s"))))


def stems(word: Column) -> Column:
    """A word with its forms without a known ending, those of three letters and more."""
    cuts = [F.when(word.rlike(f"^.{{3,}}{suffix}$"), F.regexp_replace(word, f"{suffix}$", tail)) for suffix, tail in (("ations?", ""), ("ing", ""), ("ers?", ""), ("ed", ""), ("ly", ""), ("ies", "y"), ("s", ""))]
    return F.array_distinct(F.filter(F.array(word, *cuts), lambda w: w.isNotNull() & (F.length(w) >= 3)))


def kind_weight(kind: Column) -> Column:
    table = F.create_map(*[x for k, v in KIND_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(table[kind], F.lit(0))


def glob_pattern(glob: str) -> str:
    """A file glob (** over folders, * within one, ?) as an anchored pattern."""
    import re

    out, k = "", 0
    while k < len(glob):
        if glob[k : k + 3] == "**/":
            out, k = out + "(?:.*/)?", k + 3
        elif glob[k : k + 2] == "**":
            out, k = out + ".*", k + 2
        elif glob[k] == "*":
            out, k = out + "[^/]*", k + 1
        elif glob[k] == "?":
            out, k = out + "[^/]", k + 1
        else:
            out, k = out + re.escape(glob[k]), k + 1
    return f"^{out}$"


def name_glob_pattern(glob: str) -> str:
    """A glob over names (* any run, ? any character) as an anchored pattern."""
    import re

    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def proximity(a: Column, b: Column) -> Column:
    """15 for every leading folder that two paths share, 80 at most."""
    fa, fb = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(fa), F.size(fb)) - 1
    same = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.array_join(F.slice(fa, 1, i), "/") == F.array_join(F.slice(fb, 1, i), "/")))
    return F.least(F.size(F.filter(same, lambda x: x)) * 15, F.lit(80))
