"""The full report on unused symbols: every candidate in one of 17 buckets that spare it, or dead."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows
from codeloom.operators.store import GraphStore, with_sql
from codeloom.operators.traversal import reach
from codeloom.plans.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KINDS = ("function", "method", "class")
OVERRIDABLE = ("method", "property", "field")
# Names that something outside of the code calls, folders and scopes of tests, languages of markup.
IMPLICIT = ("constructor", "main", "init", "deinit", "finalize", "destructor", "dispose", "drop", "default", "tostring", "equals", "gethashcode", "hashcode")
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs", "testing")
MARKUP = ("svelte", "vue", "astro", "liquid", "html", "razor", "twig", "blade", "erb", "handlebars")


def implicit_name(name: Column) -> Column:
    return F.lower(name).isin(*IMPLICIT) | name.rlike("(?i)^__[a-z0-9_]+__$")


def report(g: GraphStore, scratch: Scratch, kinds=KINDS, mentions: int = 2) -> DataFrame:
    """(id, reason) of every symbol of the kinds that nothing uses; the first reason that holds, 'dead' where none does.

    Reasons in order: tests, generated, exported, exportsUnknown, declarations, implicit, vendored, testScope,
    markup, unreachableFile, decorated, overriding, unresolvedName, ambiguousName, unreadable, mentioned, nested.
    """
    used = g.edges.where("kind <> 'contains' and source <> target").select(F.col("target").alias("id"))
    rows = g.nodes.where(F.col("kind").isin(*kinds)).join(used, "id", "left_anti").select("id", "name", "qualified_name", "file_path", "language", "is_exported", "is_abstract", "decorators")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    rows = rows.join(g.files.select(F.col("path").alias("file_path"), "generated"), "file_path", "left")
    rows = rows.join(flag(g.nodes.where("is_exported").select("language"), "exporting"), "language", "left")
    across = g.located().where("kind <> 'contains' and s_file_path <> t_file_path").select(F.col("t_file_path").alias("file_path"))
    rows = rows.join(flag(across, "reached"), "file_path", "left")
    inside = g.edges.where("kind = 'contains' and source <> target").select(F.col("source").alias("owner"), F.col("target").alias("id")).distinct()
    members = inside.join(g.nodes.where(F.col("kind").isin(*OVERRIDABLE)).select("id", "name"), "id")
    links = g.edges.where("kind in ('extends', 'implements') and source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    above = reach(inside.select(F.col("owner").alias("id")).distinct(), links, 8, scratch).where("depth > 0 and root <> id")
    inherited = above.join(members.select(F.col("owner").alias("up"), "name"), above["id"] == F.col("up")).select(F.col("root").alias("owner"), "name")
    overriding = members.join(inherited, ["owner", "name"], "left_semi").select("id").unionByName(g.edges.where("kind = 'overrides'").select(F.col("source").alias("id")))
    rows = rows.join(flag(overriding, "overriding"), "id", "left")
    rows = rows.join(flag(g.refs.where("name_tail is not null").select(F.col("name_tail").alias("name")), "unresolved"), "name", "left")
    rows = rows.join(flag(g.nodes.groupBy("name").agg(count_rows().alias("n")).where("n > 1").select("name"), "ambiguous"), "name", "left")
    texts = g.raw("source_files").where("path is not null and content is not null").select("path", "content").distinct()
    rows = rows.join(flag(texts.select(F.col("path").alias("file_path")), "readable"), "file_path", "left")
    words = texts.select(F.explode(F.regexp_extract_all("content", F.lit("([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1))).alias("name")).groupBy("name").agg(count_rows().alias("said"))
    rows = rows.join(words, "name", "left")
    scope = F.arrays_overlap(F.split(F.lower("qualified_name"), r"::|[.]"), F.array(*map(F.lit, TEST_SEGMENTS)))
    reason = (
        F.when(X.is_test_file(F.col("file_path")), "tests").when(F.col("generated"), "generated")
        .when(F.coalesce("is_exported", F.lit(False)) | X.is_header(F.col("file_path")), "exported").when(F.col("exporting").isNull(), "exportsUnknown")
        .when(F.col("is_abstract"), "declarations").when(implicit_name(F.col("name")), "implicit").when(X.is_vendored(F.col("file_path")), "vendored").when(scope, "testScope")
        .when(F.lower("language").isin(*MARKUP), "markup").when(F.col("reached").isNull(), "unreachableFile")
        .when(F.size(F.coalesce("decorators", F.array().cast("array<string>"))) > 0, "decorated").when(F.col("overriding"), "overriding")
        .when(F.col("unresolved"), "unresolvedName").when(F.col("ambiguous"), "ambiguousName").when(F.col("readable").isNull(), "unreadable")
        .when(F.col("said") >= mentions, "mentioned").otherwise("dead")
    )
    judged = scratch.spool(rows.select("id", reason.alias("reason")))
    owners = judged.where("reason = 'dead'").select(F.col("id").alias("owner"))
    nested = inside.join(owners, "owner", "left_semi").select("id").distinct().withColumn("inner", F.lit(True))
    return judged.join(nested, "id", "left").select("id", F.when((F.col("reason") == "dead") & F.col("inner"), "nested").otherwise(F.col("reason")).alias("reason"))


_LEDGER = """used AS (SELECT DISTINCT target AS id FROM e WHERE kind <> 'contains' AND source <> target),
inside AS (SELECT DISTINCT source AS owner, target AS id FROM e WHERE kind = 'contains' AND source <> target),
mem AS (SELECT i.owner, i.id, n.name FROM inside i JOIN n ON n.id = i.id AND n.kind IN ('method', 'property', 'field')),
up AS (SELECT owner AS root, owner AS id, 0 AS depth FROM inside UNION SELECT up.root, l.b, up.depth + 1 FROM up JOIN (SELECT source AS a, target AS b FROM e WHERE kind IN ('extends', 'implements') AND source <> target) l ON l.a = up.id WHERE up.depth < 8),
ovr AS (SELECT m.id FROM mem m JOIN up ON up.root = m.owner AND up.id <> up.root JOIN mem b ON b.owner = up.id AND b.name = m.name UNION SELECT source FROM e WHERE kind = 'overrides'),
said AS (SELECT w AS name, count(*) AS c FROM (SELECT unnest(regexp_extract_all(content, '[A-Za-z_$][A-Za-z0-9_$]*')) AS w FROM (SELECT DISTINCT path, content FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL)) GROUP BY w),
judged AS (SELECT n.id, CASE WHEN regexp_matches(n.file_path, '""" + X.TEST_PATH + """') OR CASE WHEN contains(lower(n.file_path), '/src/') THEN regexp_matches(lower(n.file_path)[1:strpos(lower(n.file_path), '/src/')], '(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/') WHEN starts_with(lower(n.file_path), 'src/') THEN false ELSE regexp_matches(lower(n.file_path), '(^|/)(integration|samples?|examples?|fixtures?|benchmarks?|demos?)/') END THEN 'tests'
  WHEN f.generated THEN 'generated' WHEN coalesce(n.is_exported, false) OR regexp_matches(lower(n.file_path), '[.](h|hh|hpp|hxx|h[+][+]|inc|d[.]ts|d[.]mts|d[.]cts|pyi|pxd)$') THEN 'exported' WHEN n.language NOT IN (SELECT language FROM n WHERE is_exported) THEN 'exportsUnknown'
  WHEN n.is_abstract THEN 'declarations' WHEN lower(n.name) IN ('constructor', 'main', 'init', 'deinit', 'finalize', 'destructor', 'dispose', 'drop', 'default', 'tostring', 'equals', 'gethashcode', 'hashcode') OR regexp_matches(lower(n.name), '^__[a-z0-9_]+__$') THEN 'implicit'
  WHEN list_has_any(string_split(lower(n.file_path), '/'), ['vendor', 'vendored', 'third_party', 'third-party', 'thirdparty', 'external', 'externals', 'node_modules', 'bower_components', 'site-packages', 'godeps', 'pods', '.venv', 'venv']) THEN 'vendored'
  WHEN list_has_any(string_split_regex(lower(n.qualified_name), '::|[.]'), ['test', 'tests', '__tests__', 'spec', 'specs', 'testing']) THEN 'testScope' WHEN lower(n.language) IN ('svelte', 'vue', 'astro', 'liquid', 'html', 'razor', 'twig', 'blade', 'erb', 'handlebars') THEN 'markup'
  WHEN n.file_path NOT IN (SELECT t_file FROM x WHERE kind <> 'contains' AND s_file <> t_file) THEN 'unreachableFile' WHEN len(coalesce(n.decorators, [])) > 0 THEN 'decorated' WHEN n.id IN (SELECT id FROM ovr) THEN 'overriding'
  WHEN n.name IN (SELECT name_tail FROM r WHERE name_tail IS NOT NULL) THEN 'unresolvedName' WHEN n.name IN (SELECT name FROM n GROUP BY name HAVING count(*) > 1) THEN 'ambiguousName' WHEN n.file_path NOT IN (SELECT path FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL) THEN 'unreadable'
  WHEN said.c >= 2 THEN 'mentioned' ELSE 'dead' END AS reason FROM n LEFT JOIN f ON f.path = n.file_path LEFT JOIN said ON said.name = n.name WHERE n.kind IN ('function', 'method', 'class') AND n.id NOT IN (SELECT id FROM used))"""


def g15_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each reason spares, and how many are dead."""
    return report(GraphStore(spark, sf_dir), Scratch(spark, "g15_ledger")).groupBy("reason").agg(count_rows().alias("n_nodes"))


QUERIES["g15_ledger"] = g15_ledger
ORACLE["g15_ledger"] = with_sql("SELECT CASE WHEN reason = 'dead' AND id IN (SELECT i.id FROM inside i JOIN judged o ON o.id = i.owner AND o.reason = 'dead') THEN 'nested' ELSE reason END AS reason, count(*) AS n_nodes FROM judged GROUP BY 1", True, _LEDGER)
