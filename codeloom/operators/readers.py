"""Reads over the graph: lookups, filters, joins, aggregates and rankings, all as DataFrame programs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.store import GraphStore, current_nodes, delete_files, mark_failed, upsert, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
MIN_CONFIDENCE = 0.6
HUB = 40


def count_rows() -> Column:
    return F.count(F.lit(1))


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    """Registers a function of a GraphStore as a query, with its DuckDB text over the clean tables."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


# Scans and lookups


@query("sc05_language_detection", "SELECT path, CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust' WHEN 'c' THEN 'c' ELSE 'unknown' END AS detected FROM f")
def language_detection(g):
    return g.files.select("path", X.language_of(F.col("path")).alias("detected"))


@query("sc11_nodes_of_kind", "SELECT id, name, file_path, start_line FROM n WHERE kind = 'class'")
def nodes_of_kind(g, kind: str = "class"):
    return g.nodes.where(F.col("kind") == kind).select("id", "name", "file_path", "start_line")


@query("sc12_nodes_by_ids", "SELECT id, kind, name FROM n WHERE id IN (SELECT from_node_id FROM r)")
def nodes_by_ids(g):
    return g.nodes.join(g.refs.select(F.col("from_node_id").alias("id")), "id", "left_semi").select("id", "kind", "name")


@query("f01_exact_name", "SELECT id, name, file_path, start_line FROM n WHERE name IN (SELECT name_tail FROM r WHERE name_tail IS NOT NULL)")
def exact_names(g):
    wanted = g.refs.where("name_tail is not null").select(F.col("name_tail").alias("name"))
    return g.nodes.join(wanted, "name", "left_semi").select("id", "name", "file_path", "start_line")


@query("f02_name_prefix", "SELECT id, name FROM n WHERE starts_with(name, 'walk') ORDER BY name, id LIMIT 20")
def name_prefix(g, prefix: str = "walk", limit: int = 20):
    return g.nodes.where(F.col("name").startswith(prefix)).orderBy("name", "id").limit(limit).select("id", "name")


@query("f03_folded_name", "SELECT n.id, n.name FROM n WHERE lower(n.name) IN (SELECT lower(name) FROM n GROUP BY lower(name) HAVING count(DISTINCT name) > 1)")
def folded_names(g):
    """Names that differ from another only by case."""
    low = F.lower("name").alias("low")
    twice = g.nodes.groupBy(low).agg(F.countDistinct("name").alias("forms")).where("forms > 1").select("low")
    return g.nodes.withColumn("low", F.lower("name")).join(twice, "low", "left_semi").select("id", "name")


@query("f05_decorated", "SELECT id, language FROM n WHERE language = 'python' AND list_contains(decorators, 'deprecated')")
def decorated(g, language: str = "python", decorator: str = "deprecated"):
    return g.nodes.where((F.col("language") == language) & F.array_contains("decorators", decorator)).select("id", "language")


@query("f06_nodes_of_files", "SELECT id, file_path FROM n WHERE file_path IN (SELECT path FROM f WHERE generated)")
def nodes_of_files(g):
    return g.nodes.join(g.files.where("generated").select(F.col("path").alias("file_path")), "file_path", "left_semi").select("id", "file_path")


@query("f07_names_of_files", "SELECT DISTINCT file_path, name FROM n WHERE kind <> 'import'")
def names_of_files(g):
    return g.nodes.where("kind <> 'import'").select("file_path", "name").distinct()


@query("f08_kind_language_filter", "SELECT id FROM n WHERE kind IN ('function', 'method') AND language IN ('go', 'rust')")
def kind_language(g, kinds=("function", "method"), languages=("go", "rust")):
    return g.nodes.where(F.col("kind").isin(*kinds) & F.col("language").isin(*languages)).select("id")


@query("f09_qualified_glob", "SELECT id, qualified_name FROM n WHERE kind IN ('function','method','class','struct','interface','enum','type_alias','constant') AND regexp_matches(qualified_name, '^.*::.*Session[.].*$')")
def qualified_glob(g, glob: str = "*::*Session.*"):
    named = ("function", "method", "class", "struct", "interface", "enum", "type_alias", "constant")
    return g.nodes.where(F.col("kind").isin(*named) & F.col("qualified_name").rlike(X.name_glob_pattern(glob))).select("id", "qualified_name")


@query("f10_file_glob", "SELECT path FROM f WHERE regexp_matches(path, '^(?:.*/)?src/(?:.*/)?[^/]*\\.py$')")
def file_glob(g, glob: str = "**/src/**/*.py"):
    return g.files.where(F.col("path").rlike(X.glob_pattern(glob))).select("path")


@query("f11_under_prefix", "SELECT path FROM f WHERE path = 'atlas-core/packages' OR starts_with(path, 'atlas-core/packages/')")
def under_prefix(g, prefix: str = "atlas-core/packages"):
    return g.files.where((F.col("path") == prefix) | F.col("path").startswith(prefix + "/")).select("path")


@query("f13_contains_fold", "SELECT id, name FROM n WHERE contains(lower(name), 'cache')")
def contains_fold(g, text: str = "cache"):
    return g.nodes.where(F.lower("name").contains(text)).select("id", "name")


@query("f14_test_paths", """SELECT path, regexp_matches(lower(regexp_extract(path, '[^/]*$')), '^test[_.]|[._-](test|tests|spec|specs)[.][a-z0-9]+$') OR regexp_matches(path, '(Test|Tests|TestCase|Tester|Spec|Specs)[.][A-Za-z0-9]+$')
  OR regexp_matches(lower(path), '/(tests|test|__tests__|spec|specs|testlib|testing|e2e)/|^(test|tests|spec|specs|e2e)/') OR regexp_matches(path, '(^|/)[A-Za-z0-9]*(Test|Tests|Spec)/')
  OR regexp_matches(lower(path), '(^|/)([a-z0-9_.]+[-_]test(s|ing)?|testdata|testutils?|test[-_]utils?|fakes?|mocks?|__mocks__|stubs)/') AS is_test FROM f""")
def test_paths(g):
    return g.files.select("path", X.is_test_path(F.col("path")).alias("is_test"))


@query("f15_vendored_paths", "SELECT path FROM f WHERE list_has_any(string_split(lower(path), '/'), ['vendor', 'vendored', 'third_party', 'third-party', 'thirdparty', 'external', 'externals', 'node_modules', 'bower_components', 'site-packages', 'godeps', 'pods', '.venv', 'venv'])")
def vendored_paths(g):
    return g.files.where(X.is_vendored(F.col("path"))).select("path")


@query("f17_ambient_files", """SELECT path FROM decl WHERE path NOT IN (SELECT t_file FROM x WHERE s_file <> t_file AND kind IN ('calls', 'instantiates'))""", more="decl AS (SELECT file_path AS path FROM n WHERE kind NOT IN ('file', 'import', 'namespace', 'module') GROUP BY file_path HAVING bool_and(kind IN ('interface', 'type_alias', 'enum', 'property', 'constant', 'struct', 'field', 'class')))")
def ambient_files(g):
    """Files that only declare, with no call into them from another file."""
    declared = g.nodes.where("kind not in ('file', 'import', 'namespace', 'module')").groupBy(F.col("file_path").alias("path")).agg(F.bool_and(F.col("kind").isin("interface", "type_alias", "enum", "property", "constant", "struct", "field", "class")).alias("only")).where("only").select("path")
    used = g.located().where("s_file_path <> t_file_path and kind in ('calls', 'instantiates')").select(F.col("t_file_path").alias("path"))
    return declared.join(used, "path", "left_anti")


@query("f18_exported_symbols", "SELECT file_path, id FROM n WHERE is_exported")
def exported_symbols(g):
    return g.nodes.where("is_exported").select("file_path", "id")


@query("f20_definition_groups", "SELECT name, count(DISTINCT (file_path, qualified_name)) AS definitions, count(DISTINCT (file_path, qualified_name)) > 1 AS ambiguous FROM n WHERE kind IN ('function', 'method', 'class') GROUP BY name")
def definition_groups(g):
    named = g.nodes.where("kind in ('function', 'method', 'class')").select("name", "file_path", "qualified_name").distinct()
    return named.groupBy("name").agg(count_rows().alias("definitions"), (count_rows() > 1).alias("ambiguous"))


@query("f21_distinctive_names", "SELECT DISTINCT name FROM n WHERE regexp_matches(name, '[_0-9]|^.+[A-Z]')")
def distinctive_names(g):
    return g.nodes.where(F.col("name").rlike("[_0-9]|^.+[A-Z]")).select("name").distinct()


@query("f22_stale_files", "SELECT f.path FROM f JOIN (SELECT DISTINCT path, content FROM source_files WHERE content IS NOT NULL) s ON s.path = f.path WHERE sha256(s.content) <> f.content_hash")
def stale_files(g):
    """Files whose stored hash is not the hash of their text."""
    observed = g.raw("source_files").where("content is not null").select("path", F.sha2("content", 256).alias("now")).distinct()
    return g.files.join(observed, "path").where("content_hash <> now").select("path")


@query("f23_recent_files", "SELECT path, indexed_at, (SELECT count(*) FROM f WHERE indexed_at > (SELECT max(indexed_at) - 86400000 FROM f)) AS total FROM f WHERE indexed_at > (SELECT max(indexed_at) - 86400000 FROM f) ORDER BY indexed_at DESC, path LIMIT 50")
def recent_files(g, window_ms: int = 86_400_000, limit: int = 50):
    """The files indexed last, and how many there are in the window."""
    newest = g.files.agg(F.max("indexed_at").alias("m")).first()["m"] or 0
    rows = g.files.where(F.col("indexed_at") > newest - window_ms)
    total = rows.count()
    return rows.orderBy(F.desc("indexed_at"), "path").limit(limit).select("path", "indexed_at", F.lit(total).cast("long").alias("total"))


@query("f24_structural_subgraph", "SELECT source, target, kind, line, col FROM x WHERE s_kind IN ('file', 'module', 'class', 'struct', 'union', 'interface', 'trait', 'function', 'method', 'variable', 'constant', 'enum', 'type_alias') AND t_kind IN ('file', 'module', 'class', 'struct', 'union', 'interface', 'trait', 'function', 'method', 'variable', 'constant', 'enum', 'type_alias')")
def structural_subgraph(g, kinds=("file", "module", "class", "struct", "union", "interface", "trait", "function", "method", "variable", "constant", "enum", "type_alias")):
    """Edges induced by the nodes of structural kinds."""
    ids = g.nodes.where(F.col("kind").isin(*kinds)).select("id")
    inside = g.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    return inside.select("source", "target", "kind", "line", "col")


# Writes


@query("sk01_node_upsert", "SELECT id, kind, name, updated_at FROM n")
def node_upsert(g):
    """The later half of the rows written over the earlier half by id: the same as all rows at once."""
    raw = g.raw("nodes")
    cut = raw.agg(F.median("updated_at")).first()[0] or 0
    early, late = (current_nodes(raw.where(c)) for c in (F.col("updated_at") <= cut, F.col("updated_at") > cut))
    return upsert(early, late, "id").select("id", "kind", "name", "updated_at")


@query("sk02_edge_dedup", "SELECT source, target, kind, line, col, metadata, provenance FROM e")
def edge_dedup(g):
    return g.edges.select("source", "target", "kind", "line", "col", "metadata", "provenance")


@query("sk04_mark_failed", "SELECT from_node_id, reference_name, line, col, CASE WHEN hit THEN 'failed' ELSE status END AS status, CASE WHEN hit THEN regexp_extract(regexp_replace(reference_name, '/\\d+$', ''), '([^.:]*)$', 1) ELSE name_tail END AS name_tail FROM (SELECT *, regexp_extract(regexp_replace(reference_name, '/\\d+$', ''), '([^.:]*)$', 1) NOT IN (SELECT name FROM n) AS hit FROM r)")
def failing_refs(g):
    """References to names that no node has become failed."""
    names = g.nodes.select("name").distinct()
    unknown = g.refs.withColumn("name", X.name_tail(F.col("reference_name"))).join(names, "name", "left_anti")
    return mark_failed(g.refs, unknown).select("from_node_id", "reference_name", "line", "col", "status", "name_tail")


@query("sk05_name_tail", "SELECT DISTINCT reference_name, regexp_extract(regexp_replace(reference_name, '/\\d+$', ''), '([^.:]*)$', 1) AS tail FROM r")
def name_tails(g):
    return g.refs.select("reference_name", X.name_tail(F.col("reference_name")).alias("tail")).distinct()


@query("sk06_delete_cascade", "SELECT 'nodes' AS part, count(*) AS n_rows FROM n WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'edges', count(*) FROM e WHERE source NOT IN (SELECT id FROM gone) AND target NOT IN (SELECT id FROM gone) UNION ALL SELECT 'refs', count(*) FROM r WHERE from_node_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'files', count(*) FROM f WHERE generated IS NOT TRUE", more="gone AS (SELECT id FROM n WHERE file_path IN (SELECT path FROM f WHERE generated))")
def delete_cascade(g):
    """Rows left after the generated files are deleted."""
    left = delete_files(g, g.files.where("generated").select("path"))
    parts = [left[p].agg(count_rows().alias("n_rows")).select(F.lit(p).alias("part"), "n_rows") for p in ("nodes", "edges", "refs", "files")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("sk07_reopened_refs", "SELECT source AS from_node_id, target, kind AS reference_kind, line, col FROM e WHERE resolved_by IS NOT NULL")
def reopened(g):
    return g.edges.where("resolved_by is not null").select(F.col("source").alias("from_node_id"), "target", F.col("kind").alias("reference_kind"), "line", "col")


# Joins


@query("j02_files_of_nodes", "SELECT n.id, coalesce(f.generated, false) AS generated FROM n LEFT JOIN f ON f.path = n.file_path")
def files_of_nodes(g):
    return g.nodes.join(g.files.select(F.col("path").alias("file_path"), "generated"), "file_path", "left").select("id", F.coalesce("generated", F.lit(False)).alias("generated"))


@query("j04_interface_members", "SELECT m.id FROM n m WHERE EXISTS (SELECT 1 FROM e JOIN n o ON o.id = e.source WHERE e.kind = 'contains' AND e.target = m.id AND o.kind IN ('interface', 'class'))")
def interface_members(g):
    owners = g.nodes.where("kind in ('interface', 'class')").select(F.col("id").alias("source"))
    members = g.edges.where("kind = 'contains'").join(owners, "source", "left_semi").select(F.col("target").alias("id"))
    return g.nodes.join(members, "id", "left_semi").select("id")


@query("j11_edge_attachments", "SELECT source, s_name, target, t_name, kind, line, col FROM x WHERE kind = 'extends'")
def edge_attachments(g, kind: str = "extends"):
    return g.located("name").where(F.col("kind") == kind).select("source", "s_name", "target", "t_name", "kind", "line", "col")


LINE_BIN = 64


@query("j14_enclosing_symbols", "SELECT r.from_node_id, r.reference_name, r.line, r.col, n.id AS enclosing_id FROM r JOIN n ON n.file_path = r.file_path AND n.kind IN ('function', 'method') AND r.line BETWEEN n.start_line AND n.end_line")
def enclosing_symbols(g):
    """Functions that enclose the line of a reference: an interval join over bins of lines."""
    bins = F.explode(F.sequence(F.floor(F.col("start_line") / LINE_BIN), F.floor(F.col("end_line") / LINE_BIN)))
    spans = g.nodes.where("kind in ('function', 'method') and start_line <= end_line").select(F.col("id").alias("enclosing_id"), "file_path", "start_line", "end_line", bins.alias("bin"))
    refs = g.refs.where("line is not null").withColumn("bin", F.floor(F.col("line") / LINE_BIN))
    return refs.join(spans, ["file_path", "bin"]).where("line between start_line and end_line").select("from_node_id", "reference_name", "line", "col", "enclosing_id")


@query("j15_path_suffixes", "SELECT DISTINCT suffix, min(path) AS path FROM (SELECT path, array_to_string(list_slice(string_split(path, '/'), -2, -1), '/') AS suffix FROM f) GROUP BY suffix HAVING count(*) = 1")
def path_suffixes(g):
    """Two-part suffixes that name one file only."""
    suffix = F.array_join(F.slice(F.split("path", "/"), -2, 2), "/")
    return g.files.select("path", suffix.alias("suffix")).groupBy("suffix").agg(count_rows().alias("n"), F.min("path").alias("path")).where("n = 1").select("suffix", "path")


# Aggregates


@query("a01_totals", "SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM f) AS files")
def totals(g):
    parts = [df.agg(count_rows().alias("v")).select(F.lit(k).alias("k"), "v") for k, df in (("nodes", g.nodes), ("edges", g.edges), ("files", g.files))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy().pivot("k", ["nodes", "edges", "files"]).agg(F.first("v"))


@query("a02_distributions", "SELECT 'node' AS dimension, kind AS label, count(*) AS total FROM n GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind UNION ALL SELECT 'language', language, count(*) FROM f GROUP BY language")
def distributions(g):
    part = lambda df, name, col: df.groupBy(F.col(col).alias("label")).agg(count_rows().alias("total")).select(F.lit(name).alias("dimension"), "label", "total")
    return part(g.nodes, "node", "kind").unionByName(part(g.edges, "edge", "kind")).unionByName(part(g.files, "language", "language"))


@query("a03_fan_counts", "SELECT id, sum(fan_in) AS fan_in, sum(fan_out) AS fan_out FROM (SELECT target AS id, count(*) AS fan_in, 0 AS fan_out FROM e GROUP BY target UNION ALL SELECT source, 0, count(*) FROM e GROUP BY source) GROUP BY id")
def fan_counts(g):
    ins = g.edges.groupBy(F.col("target").alias("id")).agg(count_rows().alias("fan_in")).withColumn("fan_out", F.lit(0).cast("long"))
    outs = g.edges.groupBy(F.col("source").alias("id")).agg(count_rows().alias("fan_out")).withColumn("fan_in", F.lit(0).cast("long"))
    return ins.unionByName(outs).groupBy("id").agg(F.sum("fan_in").alias("fan_in"), F.sum("fan_out").alias("fan_out"))


@query("a04_top_depended_on", "SELECT target AS id, count(DISTINCT source) AS dependents FROM e WHERE kind <> 'contains' AND source <> target GROUP BY target ORDER BY dependents DESC, id LIMIT 50")
def top_depended_on(g, limit: int = 50):
    pairs = g.edges.where("kind <> 'contains' and source <> target").select("source", "target").distinct()
    return pairs.groupBy(F.col("target").alias("id")).agg(count_rows().alias("dependents")).orderBy(F.desc("dependents"), "id").limit(limit)


@query("a05_top_calling_files", "SELECT s_file AS path, count(*) AS calls, count(DISTINCT CASE WHEN t_file <> s_file THEN t_file END) AS reaches, count(*) * (1 + count(DISTINCT CASE WHEN t_file <> s_file THEN t_file END)) AS score FROM x WHERE kind = 'calls' AND s_kind IN ('file', 'variable', 'constant') GROUP BY s_file")
def top_calling_files(g):
    """Calls that stand at the top of files, in file nodes, variables and constants."""
    calls = g.located("file_path", "kind").where("kind = 'calls' and s_kind in ('file', 'variable', 'constant')")
    agg = calls.groupBy(F.col("s_file_path").alias("path")).agg(count_rows().alias("calls"), F.countDistinct(F.when(F.col("t_file_path") != F.col("s_file_path"), F.col("t_file_path"))).alias("reaches"))
    return agg.withColumn("score", F.col("calls") * (1 + F.col("reaches")))


@query("a06_file_dependents", "SELECT t_file AS path, count(DISTINCT s_file) AS dependents FROM x WHERE kind <> 'contains' AND s_file <> t_file GROUP BY t_file")
def file_dependents(g):
    return file_pairs(g).groupBy(F.col("t_file_path").alias("path")).agg(count_rows().alias("dependents"))


def file_pairs(g) -> DataFrame:
    """The distinct pairs of files that an edge other than containment links."""
    return g.located().where("kind <> 'contains' and s_file_path <> t_file_path").select("s_file_path", "t_file_path").distinct()


@query("a07_file_reach", "SELECT s_file AS path, count(DISTINCT t_file) AS reach, count(*) AS n_refs FROM x WHERE kind <> 'contains' AND s_file <> t_file GROUP BY s_file")
def file_reach(g):
    links = g.located().where("kind <> 'contains' and s_file_path <> t_file_path")
    pairs = links.groupBy("s_file_path", "t_file_path").agg(count_rows().alias("n"))
    return pairs.groupBy(F.col("s_file_path").alias("path")).agg(count_rows().alias("reach"), F.sum("n").alias("n_refs"))


@query("a08_unreferenced", "SELECT n.id, coalesce(f.generated, false) AS generated FROM n LEFT JOIN f ON f.path = n.file_path WHERE n.kind IN ('function', 'method', 'class') AND NOT EXISTS (SELECT 1 FROM e WHERE e.target = n.id AND e.kind <> 'contains' AND e.source <> e.target)")
def unreferenced(g):
    used = g.edges.where("kind <> 'contains' and source <> target").select(F.col("target").alias("id"))
    lonely = g.nodes.where("kind in ('function', 'method', 'class')").join(used, "id", "left_anti")
    return lonely.join(g.files.select(F.col("path").alias("file_path"), "generated"), "file_path", "left").select("id", F.coalesce("generated", F.lit(False)).alias("generated"))


@query("a09_ambiguous_names", "SELECT name, count(*) AS n_nodes FROM n GROUP BY name HAVING count(*) > 1 AND count(*) FILTER (WHERE id IN (SELECT target FROM e WHERE kind IN ('calls', 'references'))) > 0")
def ambiguous_names(g):
    used = g.edges.where("kind in ('calls', 'references')").select(F.col("target").alias("id")).distinct().withColumn("used", F.lit(1))
    return g.nodes.select("id", "name").join(used, "id", "left").groupBy("name").agg(count_rows().alias("n_nodes"), F.sum("used").alias("u")).where("n_nodes > 1 and u > 0").select("name", "n_nodes")


@query("a10_languages_with_exports", "SELECT language, bool_or(coalesce(is_exported, false)) AS has_exports FROM n GROUP BY language")
def languages_with_exports(g):
    return g.nodes.groupBy("language").agg(F.bool_or(F.coalesce("is_exported", F.lit(False))).alias("has_exports"))


_SURE = "coalesce(confidence, 1.0) >= 0.6"
_DECLARED = "(coalesce(resolved_by, '') in ('import', 'qualified-name') or kind in ('extends', 'implements') or (coalesce(resolved_by, '') = 'instance-method' and coalesce(confidence, 1.0) >= 0.9))"


def module_of(path):
    """The module of a file: repository and first folder."""
    return F.array_join(F.slice(F.split(path, "/"), 1, 2), "/")


@query("a11_module_links", f"SELECT from_module, to_module, sum(CASE WHEN {_SURE} THEN 1 ELSE 0 END)::BIGINT AS confident, sum(CASE WHEN {_SURE} AND {_DECLARED} THEN 1 ELSE 0 END)::BIGINT AS declared, sum(CASE WHEN NOT {_SURE} THEN 1 ELSE 0 END)::BIGINT AS uncertain FROM (SELECT *, array_to_string(list_slice(string_split(s_file, '/'), 1, 2), '/') AS from_module, array_to_string(list_slice(string_split(t_file, '/'), 1, 2), '/') AS to_module FROM x WHERE kind <> 'contains') WHERE from_module <> to_module GROUP BY ALL")
def module_links(g):
    rows = g.located().where("kind <> 'contains'").withColumn("from_module", module_of("s_file_path")).withColumn("to_module", module_of("t_file_path")).where("from_module <> to_module")
    when = lambda c: F.sum(F.expr(f"case when {c} then 1 else 0 end"))
    return rows.groupBy("from_module", "to_module").agg(when(_SURE).alias("confident"), when(f"{_SURE} and {_DECLARED}").alias("declared"), when(f"not {_SURE}").alias("uncertain"))


@query("w01_top_pairs_per_link", f"SELECT from_module, to_module, s_file, t_file, n_declared, n_edges FROM (SELECT *, row_number() OVER (PARTITION BY from_module, to_module ORDER BY n_declared DESC, n_edges DESC, s_file, t_file) AS rank FROM (SELECT array_to_string(list_slice(string_split(s_file, '/'), 1, 2), '/') AS from_module, array_to_string(list_slice(string_split(t_file, '/'), 1, 2), '/') AS to_module, s_file, t_file, count_if({_SURE} AND {_DECLARED}) AS n_declared, count(*) AS n_edges FROM x WHERE kind <> 'contains' GROUP BY ALL) WHERE from_module <> to_module) WHERE rank <= 3")
def top_pairs(g, k: int = 3):
    """The pairs of files behind each link of modules, those with the most declared edges first."""
    declared = F.count_if(F.expr(f"{_SURE} and {_DECLARED}"))
    pairs = g.located().where("kind <> 'contains'").groupBy("s_file_path", "t_file_path").agg(declared.alias("n_declared"), count_rows().alias("n_edges"))
    pairs = pairs.withColumn("from_module", module_of("s_file_path")).withColumn("to_module", module_of("t_file_path")).where("from_module <> to_module")
    rank = F.row_number().over(Window.partitionBy("from_module", "to_module").orderBy(F.desc("n_declared"), F.desc("n_edges"), "s_file_path", "t_file_path"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("from_module", "to_module", F.col("s_file_path").alias("s_file"), F.col("t_file_path").alias("t_file"), "n_declared", "n_edges")


@query("a12_confident_file_pairs", f"SELECT DISTINCT s_file, t_file FROM x WHERE kind <> 'contains' AND s_file <> t_file AND {_SURE}")
def confident_file_pairs(g):
    return g.located().where(f"kind <> 'contains' and s_file_path <> t_file_path and {_SURE}").select(F.col("s_file_path").alias("s_file"), F.col("t_file_path").alias("t_file")).distinct()


@query("a14_dominant_file", "SELECT s_file AS path, count(*) AS n_edges FROM x WHERE kind <> 'contains' AND s_file = t_file GROUP BY s_file ORDER BY n_edges DESC, path LIMIT 20")
def dominant_files(g, limit: int = 20):
    return g.located().where("kind <> 'contains' and s_file_path = t_file_path").groupBy(F.col("s_file_path").alias("path")).agg(count_rows().alias("n_edges")).orderBy(F.desc("n_edges"), "path").limit(limit)


@query("a14_dominant_pick", "SELECT path, n_edges, coalesce(next, 0) AS next_edges FROM (SELECT path, n_edges, lead(n_edges) OVER (ORDER BY n_edges DESC, path) AS next, row_number() OVER (ORDER BY n_edges DESC, path) AS place FROM (SELECT * FROM (SELECT s_file AS path, count(*) AS n_edges FROM x WHERE s_file = t_file GROUP BY s_file ORDER BY n_edges DESC, path LIMIT 20) c WHERE NOT regexp_matches(path, '" + X.TEST_PATH + "') AND path NOT IN (SELECT path FROM f WHERE generated))) WHERE place = 1 AND n_edges >= 20")
def dominant_pick(g, candidates: int = 20, floor: int = 20):
    """The file with the most edges inside itself that is neither a test nor generated, if it has enough, and the next one's count."""
    counts = g.located().where("s_file_path = t_file_path").groupBy(F.col("s_file_path").alias("path")).agg(count_rows().alias("n_edges"))
    top = counts.orderBy(F.desc("n_edges"), "path").limit(candidates)
    good = top.where(~X.is_test_path(F.col("path"))).join(g.files.where("generated").select("path"), "path", "left_anti")
    order = Window.orderBy(F.desc("n_edges"), "path")  # at most twenty rows
    ranked = good.select("path", "n_edges", F.coalesce(F.lead("n_edges").over(order), F.lit(0)).alias("next_edges"), F.row_number().over(order).alias("place"))
    return ranked.where((F.col("place") == 1) & (F.col("n_edges") >= floor)).drop("place")


@query("a17_segment_frequency", f"SELECT segment, count(*) AS n_names FROM (SELECT unnest({X.segment_sql('name')}) AS segment FROM (SELECT DISTINCT name FROM n WHERE kind NOT IN ('file', 'import'))) GROUP BY segment")
def segment_frequency(g):
    return vocabulary(g).groupBy("segment").agg(count_rows().alias("n_names"))


def vocabulary(g) -> DataFrame:
    """(segment, name) of all names but those of files and imports."""
    return g.nodes.where("kind not in ('file', 'import')").select("name").distinct().select("name", F.explode(X.segments(F.col("name"))).alias("segment"))


@query("a18_segment_cooccurrence", f"SELECT name, count(DISTINCT segment) AS n_words FROM (SELECT name, unnest({X.segment_sql('name')}) AS segment FROM (SELECT DISTINCT name FROM n WHERE kind NOT IN ('file', 'import'))) WHERE segment IN ('walk', 'cache', 'queue', 'scope') GROUP BY name HAVING count(DISTINCT segment) >= 2")
def cooccurrence(g, words=("walk", "cache", "queue", "scope"), least: int = 2):
    return vocabulary(g).where(F.col("segment").isin(*words)).groupBy("name").agg(F.countDistinct("segment").alias("n_words")).where(F.col("n_words") >= least)


@query("a19_node_metrics", "SELECT id, (SELECT count(*) FROM e WHERE target = n.id) AS in_edges, (SELECT count(*) FROM e WHERE source = n.id) AS out_edges, (SELECT count(*) FROM e WHERE source = n.id AND kind = 'calls') AS calls, (SELECT count(DISTINCT source) FROM e WHERE target = n.id AND kind = 'calls') AS callers, (SELECT count(*) FROM e WHERE source = n.id AND kind = 'contains') AS children FROM n WHERE kind = 'class'")
def node_metrics(g):
    ins = g.edges.groupBy(F.col("target").alias("id")).agg(count_rows().alias("in_edges"), F.countDistinct(F.when(F.col("kind") == "calls", F.col("source"))).alias("callers"))
    outs = g.edges.groupBy(F.col("source").alias("id")).agg(count_rows().alias("out_edges"), F.count_if(F.col("kind") == "calls").alias("calls"), F.count_if(F.col("kind") == "contains").alias("children"))
    rows = g.nodes.where("kind = 'class'").select("id").join(ins, "id", "left").join(outs, "id", "left")
    return rows.select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("in_edges", "out_edges", "calls", "callers", "children")))


@query("a20_ambient_summary", "SELECT file_path AS path, count(*) FILTER (WHERE kind IN ('class', 'interface', 'struct', 'enum', 'type_alias')) AS types, count(*) FILTER (WHERE kind IN ('function', 'method')) AS callables, count(*) FILTER (WHERE is_exported) AS exported FROM n GROUP BY file_path")
def ambient_summary(g):
    return g.nodes.groupBy(F.col("file_path").alias("path")).agg(F.count_if(F.col("kind").isin("class", "interface", "struct", "enum", "type_alias")).alias("types"), F.count_if(F.col("kind").isin("function", "method")).alias("callables"), F.count_if(F.col("is_exported")).alias("exported"))


@query("a21_index_revision", "SELECT max(indexed_at) AS revision, count(*) AS n_files FROM f")
def index_revision(g):
    return g.files.agg(F.max("indexed_at").alias("revision"), count_rows().alias("n_files"))


@query("a22_directory_layout", "SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory, count(*) AS n_files, min(path) AS first_file FROM f GROUP BY 1")
def directory_layout(g):
    return g.files.groupBy(X.dirname(F.col("path")).alias("directory")).agg(count_rows().alias("n_files"), F.min("path").alias("first_file"))


@query("a22_directory_files", "SELECT CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS directory, path, row_number() OVER (PARTITION BY CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END ORDER BY path) AS place FROM f")
def directory_files(g):
    """The files of every folder in the order of their paths; a row each, so a folder of any size is no single value."""
    folder = X.dirname(F.col("path"))
    return g.files.select(folder.alias("directory"), "path", F.row_number().over(Window.partitionBy(folder).orderBy("path")).cast("long").alias("place"))


@query("a23_modules", "SELECT array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') AS module, count(*) AS n_files FROM f GROUP BY 1")
def modules(g):
    return g.files.groupBy(module_of("path").alias("module")).agg(count_rows().alias("n_files"))


@query("a24_module_dependents", "SELECT to_module AS module, count(DISTINCT s_file) AS files, count(DISTINCT from_module) AS modules FROM (SELECT s_file, array_to_string(list_slice(string_split(s_file, '/'), 1, 2), '/') AS from_module, array_to_string(list_slice(string_split(t_file, '/'), 1, 2), '/') AS to_module FROM x WHERE kind <> 'contains') WHERE from_module <> to_module GROUP BY 1")
def module_dependents(g):
    rows = file_pairs(g).withColumn("from_module", module_of("s_file_path")).withColumn("to_module", module_of("t_file_path")).where("from_module <> to_module")
    return rows.groupBy(F.col("to_module").alias("module")).agg(F.countDistinct("s_file_path").alias("files"), F.countDistinct("from_module").alias("modules"))


@query("a25_relations", f"SELECT source, target, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, max(confidence) AS confidence, bool_or(coalesce(provenance, '') = 'heuristic') AS heuristic, bool_and(NOT {_SURE}) AS uncertain, count(*) AS n_edges FROM e WHERE kind <> 'contains' GROUP BY source, target")
def relations(g):
    return g.edges.where("kind <> 'contains'").groupBy("source", "target").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.max("confidence").alias("confidence"), F.bool_or(F.coalesce("provenance", F.lit("")) == "heuristic").alias("heuristic"), F.bool_and(~F.expr(_SURE)).alias("uncertain"), count_rows().alias("n_edges"))


@query("a27_outside_index", "SELECT reference_kind, status, count(*) AS n_refs, count(DISTINCT reference_name) AS n_names FROM r GROUP BY 1, 2")
def outside_index(g):
    return g.refs.groupBy("reference_kind", "status").agg(count_rows().alias("n_refs"), F.countDistinct("reference_name").alias("n_names"))


@query("a27_samples", "SELECT from_node_id, reference_name, reference_kind, line, col FROM r WHERE line IS NOT NULL ORDER BY line, col, from_node_id, reference_name, reference_kind LIMIT 40")
def outside_samples(g, most: int = 40):
    """The first references out of the index by line and column."""
    keys = ("line", "col", "from_node_id", "reference_name", "reference_kind")
    return g.refs.where("line is not null").orderBy(*(F.asc_nulls_last(k) for k in keys)).limit(most).select("from_node_id", "reference_name", "reference_kind", "line", "col")


@query("a29_call_groups", "SELECT source AS owner, target, count(*) AS n_calls, min(line) AS first_line FROM e WHERE kind = 'calls' GROUP BY 1, 2")
def call_groups(g):
    return g.edges.where("kind = 'calls'").groupBy(F.col("source").alias("owner"), "target").agg(count_rows().alias("n_calls"), F.min("line").alias("first_line"))


@query("a30_duplicate_edges", "SELECT lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')) AS kind, count(*) - count(DISTINCT (source, target, coalesce(line, -1), coalesce(col, -1))) AS repeated FROM edges WHERE kind IS NOT NULL GROUP BY 1")
def duplicate_edges(g):
    from codeloom.sources.tables import norm_kind

    rows = g.raw("edges").where("kind is not null").select(norm_kind(F.col("kind")).alias("kind"), "source", "target", F.coalesce("line", F.lit(-1)).alias("l"), F.coalesce("col", F.lit(-1)).alias("c"))
    groups = rows.groupBy("kind", "source", "target", "l", "c").agg(count_rows().alias("n"))
    return groups.groupBy("kind").agg((F.sum("n") - count_rows()).alias("repeated"))


# Rankings and sets


@query("w03_cap_per_directory", "SELECT id, directory FROM (SELECT *, row_number() OVER (PARTITION BY directory ORDER BY dependents DESC, id) AS rank FROM (SELECT n.id, CASE WHEN contains(n.file_path, '/') THEN regexp_replace(n.file_path, '/[^/]*$', '') ELSE '.' END AS directory, d.dependents FROM n JOIN (SELECT target, count(DISTINCT source) AS dependents FROM e WHERE kind <> 'contains' AND source <> target GROUP BY target) d ON d.target = n.id)) WHERE rank <= 2")
def cap_per_directory(g, cap: int = 2):
    """The most depended-on nodes, two of a folder at most."""
    dependents = g.edges.where("kind <> 'contains' and source <> target").select("source", "target").distinct().groupBy(F.col("target").alias("id")).agg(count_rows().alias("dependents"))
    rows = g.nodes.select("id", X.dirname(F.col("file_path")).alias("directory")).join(dependents, "id")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("directory").orderBy(F.desc("dependents"), "id"))).where(F.col("rank") <= cap).select("id", "directory")


@query("w09_best_candidate", "SELECT from_node_id, reference_name, line, col, id FROM (SELECT r.*, n.id, row_number() OVER (PARTITION BY r.from_node_id, r.reference_name, r.line, r.col ORDER BY (n.file_path = r.file_path) DESC, (n.language = r.language) DESC, n.id) AS rank FROM r JOIN n ON n.name = regexp_extract(regexp_replace(r.reference_name, '/\\d+$', ''), '([^.:]*)$', 1)) WHERE rank = 1")
def best_candidate(g):
    """The best node for every reference: same file, then same language, then the least id."""
    refs = g.refs.select("from_node_id", "reference_name", "line", "col", F.col("file_path").alias("file_path"), "language", X.name_tail(F.col("reference_name")).alias("name"))
    # One node per name and place is enough: no pairs of all references and all nodes of a common name.
    least = g.nodes.groupBy("name", "file_path", "language").agg(F.min("id").alias("i"))
    rungs = [("name", "file_path", "language"), ("name", "file_path"), ("name", "language"), ("name",)]
    for k, keys in enumerate(rungs):
        refs = refs.join(least.groupBy(*keys).agg(F.min("i").alias(f"i{k}")), [*keys], "left")
    return refs.withColumn("id", F.coalesce(*(f"i{k}" for k in range(len(rungs))))).where("id is not null").select("from_node_id", "reference_name", "line", "col", "id").distinct()


@query("u03_definition_delta", "(SELECT file_path, name FROM n WHERE updated_at > (SELECT median(updated_at) FROM n) EXCEPT SELECT file_path, name FROM n WHERE updated_at <= (SELECT median(updated_at) FROM n)) UNION ALL (SELECT file_path, name FROM n WHERE updated_at <= (SELECT median(updated_at) FROM n) EXCEPT SELECT file_path, name FROM n WHERE updated_at > (SELECT median(updated_at) FROM n))")
def definition_delta(g):
    """(file, name) pairs that only one half of the index by time has."""
    middle = g.nodes.agg(F.median("updated_at").alias("m")).first()["m"]
    sides = g.nodes.select("file_path", "name", (F.col("updated_at") > F.lit(middle)).alias("late")).groupBy("file_path", "name").agg(F.bool_and("late").alias("a"), F.bool_or("late").alias("b"))
    return sides.where("a = b").select("file_path", "name")


@query("u04_untracked_sources", "SELECT path FROM f WHERE path NOT IN (SELECT path FROM source_files WHERE path IS NOT NULL)")
def untracked_sources(g):
    return g.files.join(g.raw("source_files").select("path"), "path", "left_anti").select("path")


_LINES_SQL = "SELECT DISTINCT file_path, unnest(generate_series(start_line, end_line)) AS line FROM n WHERE kind IN ('{}') AND start_line <= end_line"


@query("u06_line_difference", "SELECT file_path, min(line)::INTEGER AS first_line, max(line)::INTEGER AS last_line FROM (SELECT file_path, line, line - row_number() OVER (PARTITION BY file_path ORDER BY line) AS island FROM (SELECT * FROM (" + _LINES_SQL.format("class', 'struct") + ") EXCEPT SELECT * FROM (" + _LINES_SQL.format("method") + "))) GROUP BY file_path, island")
def line_difference(g):
    """Ranges of lines of types outside of their methods: a sweep over the ends of both kinds of ranges, no line by line."""
    rows = g.nodes.where("kind in ('class', 'struct', 'method') and start_line <= end_line")
    step = F.when(F.col("kind") == "method", 0).otherwise(1)
    opening = rows.select("file_path", F.col("start_line").alias("at"), step.alias("a"), (1 - step).alias("b"))
    closing = rows.select("file_path", (F.col("end_line") + 1).alias("at"), (-step).alias("a"), (step - 1).alias("b"))
    events = opening.unionByName(closing).groupBy("file_path", "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy("file_path").orderBy("at")
    swept = events.select("file_path", "at", F.sum("a").over(order).alias("a"), F.sum("b").over(order).alias("b")).withColumn("inside", (F.col("a") > 0) & (F.col("b") == 0))
    turns = swept.withColumn("before", F.coalesce(F.lag("inside").over(order), F.lit(False))).where("inside <> before")
    ends = turns.withColumn("next", F.lead("at").over(order)).where("inside")
    return ends.select("file_path", F.col("at").alias("first_line"), (F.col("next") - 1).alias("last_line"))


@query("u06_line_coverage", "SELECT file_path, sum(last - first + 1)::BIGINT AS covered FROM (SELECT file_path, island, min(start_line) AS first, max(end_line) AS last FROM (SELECT *, sum(CASE WHEN start_line > coalesce(before, -1) + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id) AS island FROM (SELECT id, file_path, start_line, end_line, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, end_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM n WHERE kind IN ('function', 'method') AND start_line <= end_line)) GROUP BY ALL) GROUP BY file_path")
def line_coverage(g):
    """Lines of each file that functions cover: the union of their ranges by gaps and islands."""
    order = Window.partitionBy("file_path").orderBy("start_line", "end_line", "id")
    spans = g.nodes.where("kind in ('function', 'method') and start_line <= end_line").select("id", "file_path", "start_line", "end_line")
    spans = spans.withColumn("before", F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("start_line") > F.coalesce("before", F.lit(-1)) + 1, 1).otherwise(0)).over(order))
    islands = spans.groupBy("file_path", "island").agg(F.min("start_line").alias("first"), F.max("end_line").alias("last"))
    return islands.groupBy("file_path").agg(F.sum(F.col("last") - F.col("first") + 1).alias("covered"))


@query("g37_hubs", "SELECT target AS id, count(*) AS fan_in FROM e GROUP BY target HAVING count(*) >= 40")
def hubs(g, least: int = HUB):
    return g.edges.groupBy(F.col("target").alias("id")).agg(count_rows().alias("fan_in")).where(F.col("fan_in") >= least)
