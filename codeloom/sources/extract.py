"""From a folder of source files to graph rows: scan, admission, ignore rules, symbols, containment, references.

Extractors are registered by language; each takes (path, text) and yields (kind, name,
start_line, end_line, parent). Seven languages share ``structure``, which reads broken files too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.sources import structure
from codeloom.operators.store import current_nodes, with_sql
from codeloom.sources.tables import table

MAX_SIZE = 1 << 20
Extractor = Callable[[str, str], Iterator[tuple[str, str, int, int, str | None]]]
REGISTRY: dict[str, Extractor] = {}


def extractor(*languages: str):
    def register(function: Extractor) -> Extractor:
        REGISTRY.update(dict.fromkeys(languages, function))
        return function

    return register


def _structured(language: str) -> Extractor:
    def run(path: str, text: str):
        found = structure.symbols(text, language)
        for s in found:
            if s.kind != "impl":
                yield s.kind, s.name, s.start, s.end, found[s.parent].name if s.parent is not None else None

    return run


for _language in structure.LANGUAGES:
    REGISTRY[_language] = _structured(_language)


def scan(spark: SparkSession, folder: str, ignore: list[str] | None = None) -> DataFrame:
    """path, size, content of the files below a folder that are admitted: UTF-8, at most 1 MiB, not ignored."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = folder.rstrip("/")
    rows = raw.where(F.col("length") <= MAX_SIZE).select(F.regexp_replace("path", rf"^(?:file:/*)?/?{re.escape(base.lstrip('/'))}/", "").alias("path"), F.col("length").alias("size"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    return rows.where("content is not null").where(~ignored(F.col("path"), ignore or []))


def ignored(path, rules: list[str]):
    """Whether the last matching rule ignores a path; rules are globs, '!' takes back, a trailing '/' is a folder."""
    out = F.lit(False)
    for rule in rules:
        keep, body = rule.startswith("!"), rule.lstrip("!")
        anchored, body = "/" in body.rstrip("/"), body.lstrip("/")
        pattern = X.glob_pattern(body.rstrip("/"))[1:-1]
        pattern = ("^" if anchored else "(?:^|/)") + pattern + ("/" if body.endswith("/") else "(?:/|$)")
        out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


_SCHEMA = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int"
_ARROW = pa.schema([(n, pa.string()) for n in ("id", "kind", "name", "qualified_name", "file_path", "language")] + [("start_line", pa.int32()), ("end_line", pa.int32())])


def symbol_id(kind: str, path: str, name: str, start: int) -> str:
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{start}'.encode()).hexdigest()[:32]}"


def _map_files(files: DataFrame, function, schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows of ``function(path, language, text)`` over all files with a text."""

    def run(batches):
        for batch in batches:
            out = []
            for path, language, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if path is not None and text is not None:
                    out += function(path, (language or "").strip().lower(), text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return files.select("path", "language", "content").mapInArrow(run, schema)


def extract(files: DataFrame) -> DataFrame:
    """Symbols of files (path, language, content). The id is the kind and a hash of path, kind, name and line."""

    def rows(path, language, text):
        stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        for kind, name, start, end, parent in REGISTRY.get(language, lambda p, t: iter(()))(path, text):
            yield symbol_id(kind, path, name, start), kind, name, f"{stem}::{parent}.{name}" if parent else f"{stem}::{name}", path, language, start, end

    return _map_files(files, rows, _SCHEMA, _ARROW)


def extract_containment(files: DataFrame) -> DataFrame:
    """(source, target, kind, line): files contain their outermost symbols, symbols those inside them."""

    def rows(path, language, text):
        found = structure.symbols(text, language)
        for s in found:
            up = s.parent
            while up is not None and found[up].kind == "impl":
                up = found[up].parent
            if s.kind != "impl":
                source = symbol_id(found[up].kind, path, found[up].name, found[up].start) if up is not None else symbol_id("file", path, path.rsplit("/", 1)[-1], 1)
                yield source, symbol_id(s.kind, path, s.name, s.start), "contains", s.start

    arrow = pa.schema([("source", pa.string()), ("target", pa.string()), ("kind", pa.string()), ("line", pa.int32())])
    return _map_files(files, rows, "source string, target string, kind string, line int", arrow)


def extract_references(files: DataFrame) -> DataFrame:
    """(from_node_id, reference_name, reference_kind, line, col, file_path, language) of imports, supertypes and calls."""

    def rows(path, language, text):
        found = structure.symbols(text, language)
        for r in structure.references(text, language, found):
            at = found[r.owner] if r.owner is not None else None
            yield symbol_id(at.kind, path, at.name, at.start) if at else symbol_id("file", path, path.rsplit("/", 1)[-1], 1), r.name, r.kind, r.line, r.col, path, language

    arrow = pa.schema([(n, pa.string()) for n in ("from_node_id", "reference_name", "reference_kind")] + [("line", pa.int32()), ("col", pa.int32()), ("file_path", pa.string()), ("language", pa.string())])
    return _map_files(files, rows, "from_node_id string, reference_name string, reference_kind string, line int, col int, file_path string, language string", arrow)


def extract_receivers(files: DataFrame) -> DataFrame:
    """(from_node_id, variable, type_name) of variables whose type a function or the symbol round it tells."""

    def rows(path, language, text):
        found = structure.symbols(text, language)
        for at, variable, kind in set(structure.typed_variables(text, language, found)):
            if at is not None:
                yield symbol_id(found[at].kind, path, found[at].name, found[at].start), variable, kind

    arrow = pa.schema([(n, pa.string()) for n in ("from_node_id", "variable", "type_name")])
    return _map_files(files, rows, "from_node_id string, variable string, type_name string", arrow)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "source_files").select("path", "language", "content").distinct()


def sc07_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many functions of the nodes table, by language, the extraction finds at the same lines of their files."""
    nodes = current_nodes(table(spark, sf_dir, "nodes")).where("kind in ('function', 'method') and end_line > start_line")
    nodes = nodes.select("file_path", "name", "start_line", "end_line", "language").distinct()
    found = extract(_texts(spark, sf_dir)).where("kind in ('function', 'method')").select("file_path", "name", "start_line", "end_line")
    return nodes.join(found, ["file_path", "name", "start_line", "end_line"], "left_semi").groupBy("language").agg(F.count(F.lit(1)).alias("n_functions"))


def sc07_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_containment(_texts(spark, sf_dir))


def sc10_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_references(_texts(spark, sf_dir))


def sc07_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "source_files").select("path", "language", "content").distinct())


def sc04_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files").where(F.col("size") <= MAX_SIZE).select("path").distinct()


def sc03_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["vendor/", "node_modules/", "*.min.js", "!src/**", "tests/"]
    return table(spark, sf_dir, "files").select("path").distinct().where(ignored(F.col("path"), rules))


QUERIES = {"sc03_ignored": sc03_ignored, "sc04_admitted": sc04_admitted, "sc07_symbols": sc07_symbols, "sc07_agreement": sc07_agreement, "sc07_containment": sc07_containment, "sc10_references": sc10_references}
ORACLE = {
    "sc07_agreement": with_sql("SELECT language, count(*) AS n_functions FROM (SELECT DISTINCT file_path, name, start_line, end_line, language FROM n WHERE kind IN ('function', 'method') AND end_line > start_line AND file_path IN (SELECT path FROM source_files WHERE content IS NOT NULL)) GROUP BY language"),
    "sc04_admitted": "SELECT DISTINCT path FROM files WHERE size <= 1048576",
    "sc03_ignored": "SELECT path FROM (SELECT DISTINCT path FROM files WHERE path IS NOT NULL) WHERE CASE WHEN regexp_matches(path, '(^|/)tests/') THEN true WHEN regexp_matches(path, '^src/.*(/|$)') THEN false WHEN regexp_matches(path, '(^|/)[^/]*\\.min\\.js(/|$)') THEN true WHEN regexp_matches(path, '(^|/)node_modules/') THEN true WHEN regexp_matches(path, '(^|/)vendor/') THEN true ELSE false END",
}
