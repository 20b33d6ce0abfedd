"""Retrieval for a task: merged channels, budgets, code blocks, flows, effects and boundaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows
from codeloom.operators.search import _BM25, TERMS, bm25
from codeloom.operators.store import GraphStore, with_sql
from codeloom.operators.traversal import _CALLERS, _SEEDS, _links, _reach_sql, busy_callers, reach, seeds
from codeloom.plans.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Effects by the words of a called name, the first that matches.
EFFECTS = (("network", "fetch|http|request|socket|publish|dispatch"), ("storage", "store|save|write|flush|persist|commit"), ("cache", "cache|evict|memo"), ("queue", "queue|enqueue|drain"), ("database", "query|select|insert|schema|ledger"), ("telemetry", "log|trace|metric|measure|probe"), ("auth", "auth|token|session|permit"))
# Forms of calls whose target shows only at run time.
DYNAMIC = (("getattr", r"\bgetattr\(|\bsetattr\("), ("reflection", r"\breflect\.|\.getMethod\(|Class\.forName\("), ("computed", r"\b\w+\[\w+\]\("), ("dynamic import", r"\bimport\(|\bimportlib\.|__import__\("), ("eval", r"\beval\(|\bexec\("))
PRODUCTION_SHARE = 0.15


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir), Scratch(spark, name))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


@query("f16_generated", f"SELECT path FROM f WHERE coalesce(generated, false) OR regexp_matches(path, '(_pb2(_grpc)?\\.py|\\.pb\\.[a-z]+|_pb\\.[jt]s|\\.(generated|gen)\\.[a-z]+)$')")
def generated_files(g, scratch):
    """The stored flag or the path's form; the flag never takes back."""
    return g.files.where(F.coalesce("generated", F.lit(False)) | F.col("path").rlike(r"(_pb2(_grpc)?\.py|\.pb\.[a-z]+|_pb\.[jt]s|\.(generated|gen)\.[a-z]+)$")).select("path")


@query("f19_symbol_lookup", "SELECT DISTINCT r.reference_name, n.id FROM r JOIN n ON n.name = regexp_extract(regexp_replace(r.reference_name, '/\\d+$', ''), '([^.:]*)$', 1) WHERE regexp_matches(r.reference_name, '[.:]') AND contains(lower(n.qualified_name), lower(regexp_extract(r.reference_name, '^([^.:]*)', 1)))")
def symbol_lookup(g, scratch):
    """Nodes that a spelled symbol (A.b, A::b, b/n) can mean: its tail is the name, its head stands in the qualified name."""
    refs = g.refs.where(F.col("reference_name").rlike("[.:]")).select("reference_name").distinct().withColumn("name", X.name_tail(F.col("reference_name"))).withColumn("head", F.lower(F.regexp_extract("reference_name", r"^([^.:]*)", 1)))
    return refs.join(g.nodes.select("id", "name", "qualified_name"), "name").where(F.lower("qualified_name").contains(F.col("head"))).select("reference_name", "id").distinct()


@query("sk03_file_bundles", "SELECT f.path, (SELECT count(*) FROM n WHERE n.file_path = f.path) AS n_nodes, (SELECT count(*) FROM x WHERE x.s_file = f.path) AS n_edges, (SELECT count(*) FROM r WHERE r.file_path = f.path) AS n_refs FROM f")
def file_bundles(g, scratch):
    """What one file brings along: the unit of a transactional write."""
    part = lambda df, key, name: df.groupBy(F.col(key).alias("path")).agg(count_rows().alias(name))
    rows = g.files.select("path").join(part(g.nodes, "file_path", "n_nodes"), "path", "left")
    rows = rows.join(part(g.edges.join(g.nodes.select(F.col("id").alias("source"), "file_path"), "source"), "file_path", "n_edges"), "path", "left").join(part(g.refs, "file_path", "n_refs"), "path", "left")
    return rows.select("path", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_nodes", "n_edges", "n_refs")))


@query("u05_channel_merge", "SELECT id, max(score) AS score FROM (SELECT id, round(score, 6) AS score FROM bm UNION ALL SELECT id, 12.0::DOUBLE FROM n WHERE lower(name) LIKE '%cache%') GROUP BY id", _BM25)
def channel_merge(g, scratch):
    """Ranked and substring hits in one list, the greater score of each node."""
    ranked = bm25(g.nodes, list(TERMS)).select("id", F.round("score", 6).alias("score"))
    plain = g.nodes.where(F.lower("name").contains("cache")).select("id", F.lit(12.0).alias("score"))
    return ranked.unionByName(plain).groupBy("id").agg(F.max("score").alias("score"))


@query("w02_colocated_names", "SELECT name, id, score FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, id) AS rank FROM (SELECT n.name, n.id, (CASE WHEN d.c BETWEEN 1 AND 9 THEN 20 ELSE 0 END)::INTEGER AS score FROM n JOIN (SELECT name, count(DISTINCT file_path) AS c FROM n GROUP BY name) d ON d.name = n.name WHERE n.name IN (SELECT name_tail FROM r WHERE name_tail IS NOT NULL))) WHERE rank <= 5")
def colocated_names(g, scratch, cap: int = 5):
    """Nodes of asked names, five of each, those of rare names first."""
    wanted = g.refs.where("name_tail is not null").select(F.col("name_tail").alias("name")).distinct()
    rows = g.nodes.select("id", "name", "file_path").join(wanted, "name", "left_semi")
    rare = rows.groupBy("name").agg(F.countDistinct("file_path").alias("c"))
    rows = rows.join(rare, "name").withColumn("score", F.when(F.col("c").between(1, 9), 20).otherwise(0))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("name", "id", "score")


@query("s18_reranked", f"SELECT bm.id, round(score * CASE WHEN regexp_matches(n.file_path, '{X.TEST_PATH}') THEN 0.3 ELSE 1 END, 6) AS score FROM bm JOIN n ON n.id = bm.id", _BM25)
def reranked(g, scratch):
    """BM25 with tests put down to three tenths."""
    rows = bm25(g.nodes, list(TERMS)).join(g.nodes.select("id", "file_path"), "id")
    return rows.select("id", F.round(F.col("score") * F.when(X.is_test_path(F.col("file_path")), 0.3).otherwise(1.0), 6).alias("score"))


@query("s22_budget", f"SELECT id FROM (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY score DESC, id) AS in_class FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS in_file FROM (SELECT bm.id, n.file_path, round(bm.score, 6) AS score, regexp_matches(n.file_path, '{X.TEST_PATH}') AS test FROM bm JOIN n ON n.id = bm.id)) WHERE in_file <= 5) WHERE NOT test OR in_class <= 6) WHERE place <= 40", _BM25)
def budget(g, scratch, limit: int = 40):
    """The best hits within a budget: five of a file, tests no more than 15 percent."""
    rows = bm25(g.nodes, list(TERMS)).join(g.nodes.select("id", "file_path"), "id").select("id", "file_path", F.round("score", 6).alias("score"), X.is_test_path(F.col("file_path")).alias("test"))
    in_file = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("score"), "id"))
    rows = rows.withColumn("in_file", in_file).where("in_file <= 5").select("id", "score", "test")
    top = lambda df, n: df.orderBy(F.desc("score"), "id").limit(n)
    return top(top(rows.where("test"), int(PRODUCTION_SHARE * limit)).unionByName(top(rows.where("not test"), limit)), limit).select("id")


@query("s23_code_blocks", "SELECT n.id, left(array_to_string(list_slice(string_split(s.content, chr(10)), n.start_line, n.end_line), chr(10)), 1500) AS code FROM n JOIN (SELECT DISTINCT path, content FROM source_files WHERE content IS NOT NULL) s ON s.path = n.file_path WHERE n.kind = 'function' AND n.start_line BETWEEN 1 AND n.end_line")
def code_blocks(g, scratch, most: int = 1500):
    """The lines of functions, cut to a block's size."""
    texts = g.raw("source_files").where("content is not null").select(F.col("path").alias("file_path"), "content").distinct().select("file_path", F.split("content", "\n").alias("lines"))
    rows = g.nodes.where("kind = 'function' and start_line between 1 and end_line").select("id", "file_path", "start_line", "end_line").join(texts, "file_path")
    code = F.array_join(F.slice("lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return rows.select("id", F.substring(code, 1, most).alias("code"))


@query("s26_allocation", "SELECT path, floor(13000 * score / (SELECT sum(score) FROM a WHERE score >= 0.15 * (SELECT max(score) FROM a)))::BIGINT AS chars FROM a WHERE score >= 0.15 * (SELECT max(score) FROM a)", _BM25 + ", a AS (SELECT n.file_path AS path, round(sum(bm.score), 4) AS score FROM bm JOIN n ON n.id = bm.id GROUP BY n.file_path)")
def allocation(g, scratch, budget_chars: int = 13_000, cliff: float = 0.15):
    """Shares of an output budget by the files' scores; files below the cliff get nothing."""
    files = scratch.spool(bm25(g.nodes, list(TERMS)).join(g.nodes.select("id", F.col("file_path").alias("path")), "id").groupBy("path").agg(F.round(F.sum("score"), 4).alias("score")))
    best = files.agg(F.max("score").alias("m")).first()["m"] or 0.0
    kept = files.where(F.col("score") >= cliff * best)
    total = kept.agg(F.sum("score").alias("s")).first()["s"] or 1.0
    return kept.select("path", F.floor(budget_chars * F.col("score") / total).alias("chars"))


@query("a26_blast_summary", "SELECT root, n.file_path, count(DISTINCT go.id) AS n_symbols FROM go JOIN n ON n.id = go.id WHERE root <> go.id GROUP BY root, n.file_path", _SEEDS + ", " + _reach_sql("SELECT target AS a, source AS b FROM e WHERE kind <> 'contains'", 2), recursive=True)
def blast_summary(g, scratch, depth: int = 2):
    """Symbols of each file that depend on a seed."""
    up = reach(seeds(g), _links(g.edges.where("kind <> 'contains'"), True), depth, scratch).where("root <> id")
    return up.join(g.nodes.select("id", "file_path"), "id").groupBy("root", "file_path").agg(F.countDistinct("id").alias("n_symbols"))


@query("a32_retrieval_metrics", "SELECT round(avg(CASE WHEN place IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS recall, round(avg(CASE WHEN place IS NOT NULL THEN 1.0 / place ELSE 0 END), 6) AS mrr FROM (SELECT w.id, p.place FROM (SELECT id FROM n WHERE starts_with(lower(name), 'walk')) w LEFT JOIN (SELECT id, row_number() OVER (ORDER BY round(score, 6) DESC, id) AS place FROM bm) p ON p.id = w.id AND p.place <= 100)", _BM25)
def retrieval_metrics(g, scratch, k: int = 100):
    """Recall and mean reciprocal rank of the first hundred hits for the nodes whose names start with a term."""
    ranked = bm25(g.nodes, list(TERMS)).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    ranked = ranked.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # k rows
    rows = g.nodes.where(F.lower("name").startswith("walk")).select("id").join(ranked, "id", "left")
    return rows.agg(F.round(F.avg(F.when(F.col("place").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("place"), F.lit(0.0))), 6).alias("mrr"))


@query("x12_mention_counts", "SELECT n.name, coalesce(sum(t.c), 0)::BIGINT AS mentions FROM (SELECT DISTINCT name FROM n WHERE kind = 'function') n LEFT JOIN (SELECT w, count(*) AS c FROM (SELECT unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_]*')) AS w FROM (SELECT DISTINCT path, content FROM source_files)) GROUP BY w) t ON t.w = n.name GROUP BY n.name")
def mention_counts(g, scratch):
    """How often each function's name stands in the texts, as a whole identifier."""
    words = g.raw("source_files").select("path", "content").distinct().select(F.explode(F.regexp_extract_all("content", F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))).alias("name"))
    counts = words.groupBy("name").agg(count_rows().alias("c"))
    return g.nodes.where("kind = 'function'").select("name").distinct().join(counts, "name", "left").select("name", F.coalesce("c", F.lit(0)).cast("long").alias("mentions"))


@query("g22_directed_flow", "SELECT a.root AS source, b.root AS target, min(a.depth + b.depth)::INTEGER AS hops FROM go a JOIN up b ON b.id = a.id GROUP BY a.root, b.root", _CALLERS.replace("seeds AS", "starts AS") + ", " + _SEEDS.replace("seeds AS", "goals AS") + ", " + _reach_sql("SELECT source AS a, target AS b FROM e WHERE kind IN ('calls', 'navigates')", 6, "starts") + ", " + _reach_sql("SELECT target AS a, source AS b FROM e WHERE kind IN ('calls', 'navigates')", 6, "goals").replace("go AS", "up AS").replace("go.", "up.").replace("FROM go ", "FROM up "), recursive=True)
def directed_flow(g, scratch, depth: int = 6):
    """Least hops, up to twelve, from busy callers to depended-on nodes, met in the middle: six levels from either side."""
    calls = g.edges.where("kind in ('calls', 'navigates')")
    out = reach(busy_callers(g), _links(calls), depth, scratch).select(F.col("root").alias("source"), "id", F.col("depth").alias("d1"))
    back = reach(seeds(g), _links(calls, True), depth, scratch).select(F.col("root").alias("target"), "id", F.col("depth").alias("d2"))
    return out.join(back, "id").groupBy("source", "target").agg(F.min(F.col("d1") + F.col("d2")).alias("hops"))


def _when(rules, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in rules) + " END"


@query("g29_dynamic_forms", "SELECT form, count(*) AS n_files FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS form FROM (SELECT DISTINCT path, content FROM source_files) WHERE regexp_matches(content, '{p}')" for n, p in DYNAMIC) + ") GROUP BY form")
def dynamic_forms(g, scratch):
    """Files with calls whose target shows only at run time, by form; one pass over the texts."""
    texts = g.raw("source_files").select("path", "content").distinct()
    forms = F.array(*(F.when(F.col("content").rlike(p), F.lit(n)) for n, p in DYNAMIC))
    return texts.select(F.explode(F.array_compact(forms)).alias("form")).groupBy("form").agg(count_rows().alias("n_files"))


@query("g34_effects", f"SELECT effect, count(*) AS n_calls FROM (SELECT {_when(EFFECTS, 'lower(t_name)')} AS effect FROM x WHERE kind = 'calls') WHERE effect IS NOT NULL GROUP BY effect")
def effects(g, scratch):
    """Calls by the effect that the called name tells; the first rule wins."""
    name = F.lower("name")
    effect = F.lit(None).cast("string")
    for label, pattern in reversed(EFFECTS):
        effect = F.when(name.rlike(pattern), label).otherwise(effect)
    calls = g.edges.where("kind = 'calls'").join(g.nodes.select(F.col("id").alias("target"), "name"), "target")
    return calls.groupBy(effect.alias("effect")).agg(count_rows().alias("n_calls")).where("effect is not null")


@query("t07_reattached", "SELECT x.source, x.target, min(m.id) AS candidate FROM x JOIN n m ON m.kind = x.t_kind AND m.name = x.t_name AND m.id <> x.target AND m.file_path <> x.t_file WHERE x.kind = 'calls' AND x.t_file IN (SELECT path FROM f WHERE generated) GROUP BY x.source, x.target")
def reattached(g, scratch):
    """Where calls into removed files go: the least node of the same kind and name in another file."""
    gone = g.files.where("generated").select(F.col("path").alias("t_file_path"))
    calls = g.located("file_path", "kind", "name").where("kind = 'calls'").join(gone, "t_file_path", "left_semi").select("source", "target", "t_file_path", F.col("t_kind").alias("kind"), F.col("t_name").alias("name")).distinct()
    # The least node of each file, and of those the two least: one of them lies in another file than the target.
    files = g.nodes.groupBy("kind", "name", "file_path").agg(F.min("id").alias("id"))
    place = F.row_number().over(Window.partitionBy("kind", "name").orderBy("id"))
    two = files.withColumn("place", place).where("place <= 2").groupBy("kind", "name").agg(F.sort_array(F.collect_list(F.struct("id", "file_path"))).alias("two"))
    other = F.filter("two", lambda c: c["file_path"] != F.col("t_file_path"))
    return calls.join(two, ["kind", "name"]).where(F.size(other) > 0).select("source", "target", other[0]["id"].alias("candidate"))
