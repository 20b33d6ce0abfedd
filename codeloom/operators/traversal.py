"""Graph traversals as frontier loops of joins.

A loop keeps the reached set as a scratch table of its own, joins only the frontier with the
edges, and cuts its lineage at every level. Depths are bounded by parameters. Where a depth-first
reference walk would mark nodes earlier, results here are those of a breadth-first walk, which
never miss a node within the depth.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.components import connected_components
from codeloom.operators.readers import count_rows, file_pairs
from codeloom.operators.store import GraphStore, with_sql
from codeloom.plans.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
_CALLERS = "seeds AS (SELECT source AS id FROM e WHERE kind = 'calls' AND source <> target GROUP BY source ORDER BY count(DISTINCT target) DESC, source LIMIT 5)"
USES = ("calls", "references", "imports", "instantiates", "navigates")
_USES = "('calls', 'references', 'imports', 'instantiates', 'navigates')"
_SEEDS = "seeds AS (SELECT target AS id FROM e WHERE kind <> 'contains' AND source <> target GROUP BY target ORDER BY count(DISTINCT source) DESC, target LIMIT 5)"


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = True):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir), Scratch(spark, name))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


def seeds(g: GraphStore, n: int = 5) -> DataFrame:
    """The most depended-on nodes."""
    pairs = g.edges.where("kind <> 'contains' and source <> target").select("source", "target").distinct()
    return pairs.groupBy(F.col("target").alias("id")).agg(count_rows().alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")


def busy_callers(g: GraphStore, n: int = 5) -> DataFrame:
    """The nodes that call the most others."""
    pairs = g.edges.where("kind = 'calls' and source <> target").select("source", "target").distinct()
    return pairs.groupBy(F.col("source").alias("id")).agg(count_rows().alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")


def reach(starts: DataFrame, links: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(root, id, depth): what each start reaches over links (a, b) within ``depth`` steps, itself with 0."""
    links = scratch.spool(links.select("a", "b").distinct())
    level = scratch.spool(starts.select(F.col("id").alias("root"), "id").distinct().withColumn("depth", F.lit(0)))
    known = level
    for step in range(1, depth + 1):
        wider = level.join(links, level["id"] == links["a"]).select("root", F.col("b").alias("id")).distinct()
        level = scratch.spool(wider.join(known, ["root", "id"], "left_anti").withColumn("depth", F.lit(step)))
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known


def _links(edges: DataFrame, backwards: bool = False) -> DataFrame:
    a, b = ("target", "source") if backwards else ("source", "target")
    return edges.select(F.col(a).alias("a"), F.col(b).alias("b"))


def _reach_sql(step: str, depth: int, starts: str = "seeds") -> str:
    return f"go AS (SELECT id AS root, id, 0 AS depth FROM {starts} UNION SELECT go.root, l.b, go.depth + 1 FROM go JOIN ({step}) l ON l.a = go.id WHERE go.depth < {depth})"


@query("g01_adjacency", "SELECT source, target, kind FROM e WHERE source IN (SELECT id FROM seeds) UNION ALL SELECT source, target, kind FROM e WHERE target IN (SELECT id FROM seeds) AND source NOT IN (SELECT id FROM seeds)", _SEEDS)
def adjacency(g, scratch):
    s = scratch.spool(seeds(g))
    out = g.edges.join(s.withColumnRenamed("id", "source"), "source", "left_semi")
    into = g.edges.join(s.withColumnRenamed("id", "target"), "target", "left_semi").join(s.withColumnRenamed("id", "source"), "source", "left_anti")
    return out.unionByName(into).select("source", "target", "kind")


@query("g02_edges_between", "SELECT source, target, kind FROM e WHERE source IN (SELECT id FROM n WHERE is_exported) AND target IN (SELECT id FROM n WHERE is_exported) AND kind = 'calls'")
def edges_between(g, scratch):
    ids = g.nodes.where("is_exported").select("id")
    calls = g.edges.where("kind = 'calls'")
    return calls.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target", "kind")


@query("g03_bfs", "SELECT root, id, min(depth)::INTEGER AS depth FROM go GROUP BY root, id", _CALLERS + ", " + _reach_sql("SELECT source AS a, target AS b FROM e", 3))
def breadth_first(g, scratch, depth: int = 3):
    return reach(busy_callers(g), _links(g.edges), depth, scratch)


@query("g05_callers", f"SELECT root, id, min(depth)::INTEGER AS depth FROM go WHERE root <> id GROUP BY root, id", _SEEDS + ", " + _reach_sql(f"SELECT target AS a, source AS b FROM e WHERE kind IN {_USES}", 2))
def callers(g, scratch, depth: int = 2):
    return reach(seeds(g), _links(g.edges.where(F.col("kind").isin(*USES)), True), depth, scratch).where("root <> id")


@query("g06_call_graph", f"SELECT DISTINCT root, id FROM (SELECT root, id FROM go UNION ALL SELECT root, id FROM back) WHERE root <> id", _SEEDS + ", " + _reach_sql(f"SELECT source AS a, target AS b FROM e WHERE kind IN {_USES}", 2) + ", " + _reach_sql(f"SELECT target AS a, source AS b FROM e WHERE kind IN {_USES}", 2).replace("go AS", "back AS").replace("go.", "back.").replace("FROM go", "FROM back"))
def call_graph(g, scratch, depth: int = 2):
    edges = g.edges.where(F.col("kind").isin(*USES))
    s = scratch.spool(seeds(g))
    return reach(s, _links(edges), depth, scratch).unionByName(reach(s, _links(edges, True), depth, scratch)).where("root <> id").select("root", "id").distinct()


@query("g07_usages", "SELECT target, source, kind, line FROM e WHERE target IN (SELECT id FROM seeds)", _SEEDS)
def usages(g, scratch):
    return g.edges.join(seeds(g).withColumnRenamed("id", "target"), "target", "left_semi").select("target", "source", "kind", "line")


@query("g08_supertypes", "SELECT root, id, min(depth)::INTEGER AS depth FROM go GROUP BY root, id", "types AS (SELECT id FROM n WHERE kind IN ('class', 'interface', 'struct')), " + _reach_sql("SELECT source AS a, target AS b FROM e WHERE kind IN ('extends', 'implements')", 8, "types"))
def supertypes(g, scratch, depth: int = 8):
    types = g.nodes.where("kind in ('class', 'interface', 'struct')").select("id")
    return reach(types, _links(g.edges.where("kind in ('extends', 'implements')")), depth, scratch)


@query("g09_impact", "SELECT root, id, min(depth)::INTEGER AS depth FROM go GROUP BY root, id", _SEEDS + """, go AS (SELECT id AS root, id, 0 AS depth FROM seeds
  UNION SELECT go.root, l.b, go.depth + l.w FROM go JOIN (SELECT target AS a, source AS b, 1 AS w FROM e WHERE kind <> 'contains' UNION ALL SELECT source, target, 0 FROM e JOIN n ON n.id = e.source WHERE e.kind = 'contains' AND n.kind IN ('class', 'interface', 'struct', 'enum', 'module', 'namespace')) l ON l.a = go.id WHERE go.depth + l.w <= 3)""")
def impact(g, scratch, depth: int = 3):
    """What changes with a node: its dependents a level up, members of containers at the same level."""
    containers = g.nodes.where("kind in ('class', 'interface', 'struct', 'enum', 'module', 'namespace')").select(F.col("id").alias("source"))
    up = scratch.spool(_links(g.edges.where("kind <> 'contains'"), True).distinct())
    down = scratch.spool(_links(g.edges.where("kind = 'contains'").join(containers, "source", "left_semi")).distinct())
    known = None
    level = seeds(g).select(F.col("id").alias("root"), "id")
    for step in range(depth + 1):
        fresh = scratch.spool(level if known is None else level.join(known, ["root", "id"], "left_anti"))
        inside = fresh
        while not inside.isEmpty():  # members of members stay at this level
            members = inside.join(down, inside["id"] == down["a"]).select("root", F.col("b").alias("id")).distinct()
            seen = fresh if known is None else fresh.unionByName(known.select("root", "id"))
            inside = scratch.spool(members.join(seen, ["root", "id"], "left_anti"))
            fresh = fresh.unionByName(inside)
        fresh = scratch.spool(fresh.withColumn("depth", F.lit(step)))
        known = fresh if known is None else known.unionByName(fresh)
        level = fresh.join(up, fresh["id"] == up["a"]).select("root", F.col("b").alias("id")).distinct()
    return known


@query("g10_shortest_lengths", f"SELECT root, id, min(depth)::INTEGER AS depth FROM go WHERE id IN (SELECT id FROM n WHERE kind = 'constant') GROUP BY root, id", _CALLERS + ", " + _reach_sql("SELECT source AS a, target AS b FROM e WHERE kind <> 'contains'", 4))
def shortest_lengths(g, scratch, depth: int = 4):
    """Lengths of the shortest ways from the seeds to constants."""
    goals = g.nodes.where("kind = 'constant'").select("id")
    return reach(busy_callers(g), _links(g.edges.where("kind <> 'contains'")), depth, scratch).join(goals, "id", "left_semi").select("root", "id", "depth")


@query("g11_ancestors", "SELECT id, count(*) AS n_ancestors FROM (SELECT DISTINCT root AS id, id AS ancestor FROM go WHERE depth > 0 AND id <> root) GROUP BY id", "methods AS (SELECT id FROM n WHERE kind = 'method'), first AS (SELECT target AS a, min(source) AS b FROM e WHERE kind = 'contains' AND source <> target GROUP BY target), " + _reach_sql("SELECT a, b FROM first", 12, "methods"))
def ancestors(g, scratch, depth: int = 12):
    """How many containers methods lie in, by the least parent at each step."""
    first = g.edges.where("kind = 'contains' and source <> target").groupBy(F.col("target").alias("a")).agg(F.min("source").alias("b"))
    up = reach(g.nodes.where("kind = 'method'").select("id"), first, depth, scratch)
    return up.where("depth > 0").groupBy(F.col("root").alias("id")).agg(count_rows().alias("n_ancestors"))


@query("g12_children", "SELECT source AS id, target AS child FROM e WHERE kind = 'contains' AND source IN (SELECT id FROM n WHERE kind = 'class')")
def children(g, scratch):
    return g.edges.where("kind = 'contains'").join(g.nodes.where("kind = 'class'").select(F.col("id").alias("source")), "source", "left_semi").select(F.col("source").alias("id"), F.col("target").alias("child")).distinct()


@query("g13_context", "SELECT n.id, (SELECT count(*) FROM e WHERE e.target = n.id AND kind NOT IN ('contains')) AS incoming, (SELECT count(*) FROM e WHERE e.source = n.id AND kind NOT IN ('contains')) AS outgoing, (SELECT count(*) FROM e WHERE e.source = n.id AND kind IN ('type_of', 'returns')) AS types FROM n WHERE n.id IN (SELECT id FROM seeds)", _SEEDS)
def context(g, scratch):
    s = scratch.spool(seeds(g))
    ins = g.edges.where("kind <> 'contains'").groupBy(F.col("target").alias("id")).agg(count_rows().alias("incoming"))
    outs = g.edges.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("kind") != "contains").alias("outgoing"), F.count_if(F.col("kind").isin("type_of", "returns")).alias("types"))
    return s.join(ins, "id", "left").join(outs, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("incoming", "outgoing", "types")))


@query("g14_simple_dead_code", "SELECT id FROM n WHERE kind IN ('function', 'method', 'class') AND NOT coalesce(is_exported, false) AND id NOT IN (SELECT target FROM e WHERE kind <> 'contains')")
def simple_dead_code(g, scratch):
    used = g.edges.where("kind <> 'contains'").select(F.col("target").alias("id"))
    return g.nodes.where("kind in ('function', 'method', 'class') and not coalesce(is_exported, false)").join(used, "id", "left_anti").select("id")


@query("g15_dead_code_report", f"""SELECT reason, count(*) AS n_nodes FROM (SELECT n.id, CASE WHEN coalesce(n.is_exported, false) THEN 'exported' WHEN regexp_matches(n.file_path, '{X.TEST_PATH}') THEN 'test' WHEN coalesce(f.generated, false) THEN 'generated' WHEN list_has_any(string_split(lower(n.file_path), '/'), ['vendor', 'vendored', 'third_party', 'third-party', 'thirdparty', 'external', 'externals', 'node_modules', 'bower_components', 'site-packages', 'godeps', 'pods', '.venv', 'venv']) THEN 'vendored' WHEN len(coalesce(n.decorators, [])) > 0 THEN 'decorated' WHEN n.id IN (SELECT source FROM e WHERE kind = 'overrides') THEN 'overriding' WHEN n.name IN (SELECT name_tail FROM r WHERE name_tail IS NOT NULL) THEN 'unresolved name' WHEN n.name IN (SELECT name FROM n GROUP BY name HAVING count(*) > 1) THEN 'ambiguous name' ELSE 'dead' END AS reason FROM n LEFT JOIN f ON f.path = n.file_path WHERE n.kind IN ('function', 'method', 'class') AND n.id NOT IN (SELECT target FROM e WHERE kind <> 'contains' AND source <> target)) GROUP BY reason""")
def dead_code_report(g, scratch):
    """Candidates by the first reason that spares them; the rest is dead."""
    used = g.edges.where("kind <> 'contains' and source <> target").select(F.col("target").alias("id"))
    rows = g.nodes.where("kind in ('function', 'method', 'class')").join(used, "id", "left_anti")
    flag = lambda df, name: df.distinct().withColumn(name, F.lit(True))
    rows = rows.join(g.files.select(F.col("path").alias("file_path"), "generated"), "file_path", "left")
    rows = rows.join(flag(g.edges.where("kind = 'overrides'").select(F.col("source").alias("id")), "overriding"), "id", "left")
    rows = rows.join(flag(g.refs.where("name_tail is not null").select(F.col("name_tail").alias("name")), "unresolved"), "name", "left")
    rows = rows.join(flag(g.nodes.groupBy("name").agg(count_rows().alias("n")).where("n > 1").select("name"), "ambiguous"), "name", "left")
    reason = (
        F.when(F.col("is_exported"), "exported").when(X.is_test_path(F.col("file_path")), "test").when(F.col("generated"), "generated").when(X.is_vendored(F.col("file_path")), "vendored")
        .when(F.size(F.coalesce("decorators", F.array().cast("array<string>"))) > 0, "decorated").when(F.col("overriding"), "overriding").when(F.col("unresolved"), "unresolved name").when(F.col("ambiguous"), "ambiguous name").otherwise("dead")
    )
    return rows.groupBy(reason.alias("reason")).agg(count_rows().alias("n_nodes"))


_FILE_SEEDS = "top AS (SELECT t_file AS id FROM x WHERE kind <> 'contains' AND s_file <> t_file GROUP BY t_file ORDER BY count(DISTINCT s_file) DESC, t_file LIMIT 5)"


def file_seeds(g, n: int = 5) -> DataFrame:
    return file_pairs(g).groupBy(F.col("t_file_path").alias("id")).agg(count_rows().alias("n")).orderBy(F.desc("n"), "id").limit(n).select("id")


@query("g16_file_dependents_walk", "SELECT root, id, min(depth)::INTEGER AS depth FROM go GROUP BY root, id", _FILE_SEEDS + ", fp AS (SELECT DISTINCT t_file AS a, s_file AS b FROM x WHERE kind <> 'contains' AND s_file <> t_file), " + _reach_sql("SELECT a, b FROM fp", 3, "top"))
def file_dependents_walk(g, scratch, depth: int = 3):
    return reach(file_seeds(g), file_pairs(g).select(F.col("t_file_path").alias("a"), F.col("s_file_path").alias("b")), depth, scratch)


@query("g17_affected_tests", f"SELECT DISTINCT id AS path FROM go WHERE regexp_matches(id, '{X.TEST_PATH}')", _FILE_SEEDS + ", fp AS (SELECT DISTINCT t_file AS a, s_file AS b FROM x WHERE kind <> 'contains' AND s_file <> t_file), " + _reach_sql("SELECT a, b FROM fp", 5, "top"))
def affected_tests(g, scratch, depth: int = 5):
    """Test files that depend on the most depended-on files."""
    return file_dependents_walk(g, scratch, depth).where(X.is_test_path(F.col("id"))).select(F.col("id").alias("path")).distinct()


_FP = "fp AS (SELECT DISTINCT s_file AS a, t_file AS b FROM x WHERE kind IN ('imports', 'extends', 'calls') AND s_file <> t_file), way AS (SELECT a, b FROM fp UNION SELECT way.a, fp.b FROM way JOIN fp ON fp.a = way.b)"


@query("g18_files_on_cycles", "SELECT DISTINCT a AS path FROM way WHERE a = b", _FP)
def files_on_cycles(g, scratch):
    """Files that depend on themselves over others."""
    return strong_components(g, scratch).where("n_files > 1").select("path")


@query("g19_strong_components", "SELECT w.a AS path, min(least(w.b, w.a)) AS component, count(*) AS n_files FROM way w JOIN way v ON v.a = w.b AND v.b = w.a WHERE w.a IN (SELECT a FROM way WHERE a = b) GROUP BY w.a", _FP)
def strong_components_query(g, scratch):
    return strong_components(g, scratch).where("n_files > 1")


def strong_components(g, scratch) -> DataFrame:
    """(path, component, n_files) of the file graph's strongly connected parts with a cycle.

    Files without a way in or out are peeled first; within what is left, weakly connected parts
    are colored forwards and backwards by their least file until every file is settled.
    """
    links = g.located().where("kind in ('imports', 'extends', 'calls') and s_file_path <> t_file_path").select(F.col("s_file_path").alias("a"), F.col("t_file_path").alias("b")).distinct()
    live, settled = scratch.spool(links), None
    while True:
        size = None
        while (now := live.count()) != size:
            size = now
            live = scratch.spool(live.join(live.select(F.col("a").alias("b")).distinct(), "b", "left_semi").join(live.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a", "b"))
        if not size:
            break
        nodes = scratch.spool(live.select("a").union(live.select("b")).distinct().withColumnRenamed("a", "v"))
        forward = _least_reaching(nodes, live, scratch)
        colors = scratch.spool(forward)
        same = live.join(colors.withColumnRenamed("v", "a").withColumnRenamed("color", "ca"), "a").join(colors.withColumnRenamed("v", "b").withColumnRenamed("color", "cb"), "b").where("ca = cb")
        back = scratch.spool(same.select(F.col("b").alias("a"), F.col("a").alias("b")))
        level = known = scratch.spool(colors.where("v = color").select("v", "color"))
        while not level.isEmpty():
            wider = level.join(back, level["v"] == back["a"]).select(F.col("b").alias("v"), "color").distinct()
            level = scratch.spool(wider.join(known, ["v", "color"], "left_anti"))
            known = known.unionByName(level)
        done = scratch.spool(known)
        settled = done if settled is None else settled.unionByName(done)
        ids = done.select("v")
        live = scratch.spool(live.join(ids.withColumnRenamed("v", "a"), "a", "left_anti").join(ids.withColumnRenamed("v", "b"), "b", "left_anti"))
    if settled is None:
        return g.spark.createDataFrame([], "path string, component string, n_files long")
    sizes = settled.groupBy("color").agg(count_rows().alias("n_files"), F.min("v").alias("component"))
    return settled.join(sizes, "color").select(F.col("v").alias("path"), "component", "n_files")


def _least_reaching(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, color): the least vertex from which v can be reached."""
    colors = scratch.spool(nodes.select("v", F.col("v").alias("color")))
    changed = True
    while changed:
        offers = links.join(colors.withColumnRenamed("v", "a"), "a").select(F.col("b").alias("v"), "color")
        later = scratch.spool(colors.unionByName(offers).groupBy("v").agg(F.min("color").alias("color")))
        changed = not later.exceptAll(colors).isEmpty()
        scratch.drop(colors)
        colors = later
    return colors


@query("g20_type_hierarchy", "SELECT target AS id, kind, count(DISTINCT source) AS subtypes, count(DISTINCT source) >= 8 AS dispatch FROM e WHERE kind IN ('extends', 'implements') GROUP BY target, kind")
def type_hierarchy(g, scratch):
    subtypes = g.edges.where("kind in ('extends', 'implements')").groupBy(F.col("target").alias("id"), "kind").agg(F.countDistinct("source").alias("subtypes"))
    return subtypes.withColumn("dispatch", F.col("subtypes") >= 8)


@query("g24_call_chains", "SELECT array_to_string(path, '>') AS path, len(path) AS n_nodes FROM walk WHERE len(path) >= 3", _CALLERS + ", k AS (SELECT DISTINCT source, target FROM e WHERE kind = 'calls'), walk AS (SELECT [id] AS path FROM seeds UNION ALL SELECT list_append(path, k.target) FROM walk JOIN k ON k.source = path[-1] WHERE len(path) < 6 AND NOT list_contains(path, k.target))")
def call_chains(g, scratch, shortest: int = 3, longest: int = 6):
    """Simple call paths of three to six nodes from the seeds."""
    calls = scratch.spool(g.edges.where("kind = 'calls'").select("source", "target").distinct())
    level = busy_callers(g).select(F.array("id").alias("path"))
    found = []
    for n in range(2, longest + 1):
        level = scratch.spool(level.withColumn("source", F.element_at("path", -1)).join(calls, "source").where(~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path")))
        found += [level] if n >= shortest else []
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.select(F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("n_nodes"))


RESTART, ROUNDS = 0.25, 25
RANKED = ("calls", "references", "extends", "implements", "overrides", "instantiates", "returns", "type_of", "imports", "navigates")


@query("g25_random_walk", f"""SELECT id, round(mass, 6) AS mass FROM w{ROUNDS} WHERE mass > 0.000001""", _CALLERS + ", und AS (SELECT source AS a, target AS b FROM e WHERE kind IN ('calls', 'references', 'extends', 'implements', 'overrides', 'instantiates', 'returns', 'type_of', 'imports', 'navigates') AND source <> target UNION ALL SELECT target, source FROM e WHERE kind IN ('calls', 'references', 'extends', 'implements', 'overrides', 'instantiates', 'returns', 'type_of', 'imports', 'navigates') AND source <> target), deg AS (SELECT a, count(*) AS d FROM und GROUP BY a), w0 AS (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM seeds) AS mass FROM seeds)" + "".join(f", w{i} AS MATERIALIZED (SELECT id, sum(mass) AS mass FROM (SELECT u.b AS id, {1 - RESTART} * w.mass / d.d AS mass FROM w{i - 1} w JOIN und u ON u.a = w.id JOIN deg d ON d.a = w.id UNION ALL SELECT w.id, {1 - RESTART} * w.mass FROM w{i - 1} w WHERE w.id NOT IN (SELECT a FROM deg) UNION ALL SELECT id, {RESTART}::DOUBLE / (SELECT count(*) FROM seeds) FROM seeds) GROUP BY id)" for i in range(1, ROUNDS + 1)))
def random_walk(g, scratch, rounds: int = ROUNDS):
    """Random walk with restart from the seeds; parallel edges count, dead ends keep their mass."""
    one = g.edges.where(F.col("kind").isin(*RANKED) & (F.col("source") != F.col("target")))
    both = _links(one).unionByName(_links(one, True))
    steps = both.groupBy("a", "b").agg(count_rows().alias("w"))
    degrees = both.groupBy("a").agg(count_rows().alias("d"))
    links = scratch.spool(steps.join(degrees, "a").select("a", "b", (F.col("w") / F.col("d")).alias("p")))
    ends = scratch.spool(degrees.select(F.col("a").alias("id")))
    s = scratch.spool(busy_callers(g))
    n = max(1, s.count())
    start = s.withColumn("mass", F.lit(1.0 / n))
    mass = start
    for _ in range(rounds):
        moved = mass.join(links, mass["id"] == links["a"]).select(F.col("b").alias("id"), (F.lit(1 - RESTART) * F.col("mass") * F.col("p")).alias("mass"))
        kept = mass.join(ends, "id", "left_anti").withColumn("mass", F.col("mass") * (1 - RESTART))
        mass = scratch.spool(moved.unionByName(kept).unionByName(start.withColumn("mass", F.col("mass") * RESTART)).groupBy("id").agg(F.sum("mass").alias("mass")))
    return mass.where("mass > 0.000001").select("id", F.round("mass", 6).alias("mass"))


@query("g27_tests_reaching", f"SELECT root, count(DISTINCT n.file_path) AS n_test_files FROM go JOIN n ON n.id = go.id WHERE regexp_matches(n.file_path, '{X.TEST_PATH}') GROUP BY root", _SEEDS + ", " + _reach_sql("SELECT target AS a, source AS b FROM e WHERE kind <> 'contains'", 3))
def tests_reaching(g, scratch, depth: int = 3):
    up = reach(seeds(g), _links(g.edges.where("kind <> 'contains'"), True), depth, scratch)
    return up.join(g.nodes.select("id", "file_path"), "id").where(X.is_test_path(F.col("file_path"))).groupBy("root").agg(F.countDistinct("file_path").alias("n_test_files"))


@query("g36_file_outline", "SELECT file_path, count(*) AS members, min(start_line) AS first_line, max(end_line) AS last_line FROM n WHERE kind NOT IN ('file', 'import') GROUP BY file_path")
def file_outline(g, scratch):
    return g.nodes.where("kind not in ('file', 'import')").groupBy("file_path").agg(count_rows().alias("members"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query("g39_weak_components", "SELECT comp AS component, count(*) AS n_nodes FROM (SELECT a, min(b) AS comp FROM way GROUP BY a) GROUP BY comp", "und AS (SELECT source AS a, target AS b FROM e WHERE kind IN ('extends', 'implements') UNION SELECT target, source FROM e WHERE kind IN ('extends', 'implements') UNION SELECT source, source FROM e WHERE kind IN ('extends', 'implements') UNION SELECT target, target FROM e WHERE kind IN ('extends', 'implements')), way AS (SELECT a, b FROM und UNION SELECT way.a, und.b FROM way JOIN und ON und.a = way.b)")
def weak_components(g, scratch):
    """Sizes of the connected parts of the type hierarchy, each named by its least node."""
    links = scratch.spool(g.edges.where("kind in ('extends', 'implements')").select("source", "target").distinct())
    ends = scratch.spool(links.select(F.col("source").alias("id")).union(links.select("target")).distinct())
    seed = 0
    number = lambda c: F.xxhash64(F.lit(seed), c)
    while ends.select(number("id").alias("v")).distinct().count() != ends.count():
        seed += 1  # two ids of one number would join their parts
    comps = connected_components(links.select(number("source").alias("a"), number("target").alias("b")), scratch)
    named = ends.withColumn("v", number("id")).join(comps, "v")
    return named.groupBy("comp").agg(F.min("id").alias("component"), count_rows().alias("n_nodes")).select("component", "n_nodes")


@query("w08_merged_impact", f"SELECT name, count(DISTINCT go.id) AS affected FROM go JOIN n ON n.id = go.root GROUP BY name", _SEEDS + ", named AS (SELECT id FROM n WHERE name IN (SELECT name FROM n WHERE id IN (SELECT id FROM seeds))), " + _reach_sql("SELECT target AS a, source AS b FROM e WHERE kind <> 'contains'", 2, "named"))
def merged_impact(g, scratch, depth: int = 2):
    """What depends on any of the definitions that share a seed's name."""
    names = g.nodes.join(seeds(g), "id", "left_semi").select("name").distinct()
    same = scratch.spool(g.nodes.join(names, "name", "left_semi").select("id", "name"))
    up = reach(same.select("id"), _links(g.edges.where("kind <> 'contains'"), True), depth, scratch)
    return up.join(same.withColumnRenamed("id", "root"), "root").groupBy("name").agg(F.countDistinct("id").alias("affected"))


