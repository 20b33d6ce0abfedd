"""Walks with their ways: depth-first order, shortest ways, named flows, hierarchies by level, routes, continuations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows, file_pairs
from codeloom.operators.store import GraphStore, with_sql
from codeloom.operators.traversal import _CALLERS, _FILE_SEEDS, _SEEDS, _reach_sql, busy_callers, file_seeds, reach, seeds
from codeloom.plans.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HTTP_METHODS = ("GET", "HEAD", "POST", "PUT", "DELETE", "CONNECT", "OPTIONS", "TRACE", "PATCH", "ALL", "ANY")
HANDLERS = ("function", "method", "class", "constant", "variable")
ROUTE_FLOOR, ROUTE_SHARE = 3, 0.3
DISPATCH = 8


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = True):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir), Scratch(spark, name))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


# Ways


def depth_first(links: list[tuple[str, str]], start: str, limit: int) -> list[tuple[str, int]]:
    """Nodes in the order in which a depth-first walk expands them, with the depth of each."""
    out: list[tuple[str, int]] = []
    follow: dict[str, list[str]] = {}
    for a, b in links:
        follow.setdefault(a, []).append(b)
    done, stack = set(), [(start, 0)]
    while stack and len(out) < limit:
        node, depth = stack.pop()
        if node in done:
            continue
        done.add(node)
        out.append((node, depth))
        stack += [(b, depth + 1) for b in reversed(follow.get(node, ())) if b not in done]
    return out


@query("g04_dfs")
def depth_first_query(g, scratch, depth: int = 3, limit: int = 200):
    """Pre-order of a depth-first walk over calls from each seed, within the nodes that ``depth`` steps reach; the first ``limit`` of each.

    The distributed walk bounds the neighbourhood; the order within it is inherently one after the other
    and found per seed. Links of a node are followed in the order of target ids.
    """
    calls = scratch.spool(g.edges.where("kind = 'calls' and source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    near = scratch.spool(reach(busy_callers(g), calls, depth, scratch))
    inner = near.where(F.col("depth") < depth).join(calls, near["id"] == calls["a"]).select("root", "a", "b")

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order = depth_first(sorted(zip(rows["a"], rows["b"])), key[0], limit)
        return pd.DataFrame([(key[0], n, k) for k, (n, _) in enumerate(order)], columns=["root", "id", "place"])

    return inner.groupBy("root").applyInPandas(walk, "root string, id string, place long")


@query("g10_shortest_paths", "SELECT root, id, array_to_string(path, '>') AS path FROM walk WHERE id IN (SELECT id FROM n WHERE kind = 'constant') QUALIFY row_number() OVER (PARTITION BY root, id ORDER BY len(path), path) = 1", _CALLERS + ", k AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE kind <> 'contains' AND source <> target), walk AS (SELECT id AS root, id, [id] AS path FROM seeds UNION ALL SELECT walk.root, k.b, list_append(path, k.b) FROM walk JOIN k ON k.a = walk.id WHERE len(path) <= 4 AND NOT list_contains(path, k.b))")
def shortest_paths(g, scratch, depth: int = 4):
    """The shortest ways from the seeds to constants, of equal ones the least; a node keeps the way it was first met by."""
    links = scratch.spool(g.edges.where("kind <> 'contains' and source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    level = scratch.spool(busy_callers(g).select(F.col("id").alias("root"), "id", F.array("id").alias("path")))
    known = level
    for _ in range(depth):
        wider = level.join(links, level["id"] == links["a"]).groupBy("root", F.col("b").alias("id")).agg(F.min(F.concat("path", F.array("b"))).alias("path"))
        level = scratch.spool(wider.join(known.select("root", "id"), ["root", "id"], "left_anti"))
        known = known.unionByName(level)
    goals = g.nodes.where("kind = 'constant'").select("id")
    return known.join(goals, "id", "left_semi").select("root", "id", F.array_join("path", ">").alias("path"))


FLOW_NAMES = ("walk", "cache", "queue")


@query("g21_named_flow", "SELECT array_to_string(names, '>') AS path, len(path) AS n_nodes FROM walk WHERE hits >= 2 AND tail = 0", "hot AS (SELECT id, name, regexp_matches(lower(name), 'walk|cache|queue') AS named FROM n WHERE kind IN ('function', 'method', 'component')), k AS (SELECT DISTINCT source AS a, target AS b FROM e WHERE kind IN ('calls', 'navigates') AND source <> target), walk AS (SELECT [id] AS path, [name] AS names, 1 AS hits, 0 AS tail FROM hot WHERE named UNION ALL SELECT list_append(path, k.b), list_append(names, h.name), hits + CASE WHEN h.named THEN 1 ELSE 0 END, CASE WHEN h.named THEN 0 ELSE tail + 1 END FROM walk JOIN k ON k.a = path[-1] JOIN hot h ON h.id = k.b WHERE len(path) < 5 AND NOT list_contains(path, k.b) AND (h.named OR tail = 0))")
def named_flow(g, scratch, names=FLOW_NAMES, hops: int = 4):
    """Call chains from one named callable to another, with at most one unnamed callable between two named ones."""
    named = F.lower("name").rlike("|".join(names))
    hot = scratch.spool(g.nodes.where(F.col("kind").isin("function", "method", "component")).select("id", "name", named.alias("named")))
    links = g.edges.where("kind in ('calls', 'navigates') and source <> target").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    steps = scratch.spool(links.join(hot.select(F.col("id").alias("b"), "name", "named"), "b"))
    level = hot.where("named").select(F.array("id").alias("path"), F.array("name").alias("names"), F.lit(1).alias("hits"), F.lit(0).alias("tail"))
    found = []
    for _ in range(hops):
        wider = level.withColumn("a", F.element_at("path", -1)).join(steps, "a").where(~F.array_contains("path", F.col("b")) & (F.col("named") | (F.col("tail") == 0)))
        level = scratch.spool(wider.select(F.concat("path", F.array("b")).alias("path"), F.concat("names", F.array("name")).alias("names"), (F.col("hits") + F.col("named").cast("int")).alias("hits"), F.when(F.col("named"), 0).otherwise(F.col("tail") + 1).alias("tail")))
        found.append(level)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.where("hits >= 2 and tail = 0").select(F.array_join("names", ">").alias("path"), F.size("path").cast("long").alias("n_nodes"))


@query("g23_distinct_paths", "SELECT path FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.path <> a.path AND contains('>' || b.path || '>', '>' || a.path || '>'))", _CALLERS + ", k AS (SELECT DISTINCT source, target FROM e WHERE kind = 'calls'), walk AS (SELECT [id] AS path FROM seeds UNION ALL SELECT list_append(path, k.target) FROM walk JOIN k ON k.source = path[-1] WHERE len(path) < 4 AND NOT list_contains(path, k.target)), p AS (SELECT DISTINCT array_to_string(path, '>') AS path FROM walk)")
def distinct_paths(g, scratch, longest: int = 4):
    """Call chains that are part of no other of the chains found. A part is looked up by its own text among the parts of longer chains."""
    calls = scratch.spool(g.edges.where("kind = 'calls'").select("source", "target").distinct())
    level = busy_callers(g).select(F.array("id").alias("path"))
    known = level
    for _ in range(longest - 1):
        level = scratch.spool(level.withColumn("source", F.element_at("path", -1)).join(calls, "source").where(~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path")))
        known = known.unionByName(level)
    known = scratch.spool(known.distinct())
    n = F.size("path")
    starts = known.where(n > 1).select("path", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    parts = starts.select("path", F.explode(F.transform(F.sequence(F.lit(1), n - F.col("i") + 1), lambda m: F.slice("path", F.col("i"), m))).alias("part")).where("size(part) < size(path)")
    return known.join(parts.select(F.col("part").alias("path")).distinct(), "path", "left_anti").select(F.array_join("path", ">").alias("path"))


@query("g30_continuations", "SELECT DISTINCT e.source, e.target, e.kind FROM e WHERE e.kind IN ('calls', 'references', 'navigates') AND e.source IN (SELECT id FROM ends)", _CALLERS + ", k AS (SELECT DISTINCT source, target FROM e WHERE kind = 'calls'), ends AS (SELECT b.target AS id FROM k a JOIN k b ON b.source = a.target WHERE a.source IN (SELECT id FROM seeds))")
def continuations(g, scratch):
    """Edges that lead on from the ends of chains of two calls."""
    calls = scratch.spool(g.edges.where("kind = 'calls'").select("source", "target").distinct())
    first = calls.join(busy_callers(g).withColumnRenamed("id", "source"), "source", "left_semi")
    ends = first.select(F.col("target").alias("source")).distinct().join(calls, "source").select(F.col("target").alias("source")).distinct()
    return g.edges.where("kind in ('calls', 'references', 'navigates')").join(ends, "source", "left_semi").select("source", "target", "kind").distinct()


# Types


@query("g20_type_levels", "SELECT root, id, direction, min(depth)::INTEGER AS depth, bool_or(true) AS known FROM (SELECT root, id, 'parents' AS direction, depth FROM go WHERE depth > 0 UNION ALL SELECT root, id, 'children', depth FROM back WHERE depth > 0) WHERE id <> root GROUP BY root, id, direction", "types AS (SELECT id FROM n WHERE kind IN ('class', 'interface', 'struct')), " + _reach_sql("SELECT source AS a, target AS b FROM e WHERE kind IN ('extends', 'implements')", 8, "types") + ", " + _reach_sql("SELECT target AS a, source AS b FROM e WHERE kind IN ('extends', 'implements')", 6, "types").replace("go AS", "back AS").replace("go.", "back.").replace("FROM go", "FROM back"))
def type_levels(g, scratch, up: int = 8, down: int = 6):
    """All parents up to 8 levels and all children down to 6 of every type, each at its least level."""
    types = g.nodes.where("kind in ('class', 'interface', 'struct')").select("id")
    links = scratch.spool(g.edges.where("kind in ('extends', 'implements')").select(F.col("source").alias("a"), F.col("target").alias("b")).distinct())
    parents = reach(types, links, up, scratch).withColumn("direction", F.lit("parents"))
    children = reach(types, links.select(F.col("b").alias("a"), F.col("a").alias("b")), down, scratch).withColumn("direction", F.lit("children"))
    return parents.unionByName(children).where("depth > 0 and id <> root").select("root", "id", "direction", "depth", F.lit(True).alias("known"))


@query("g20_type_relations", "SELECT source, target, CASE WHEN bool_or(kind = 'extends') THEN 'extends' ELSE 'implements' END AS relation, (count(DISTINCT CASE WHEN kind = 'implements' THEN kind END) > 0) AS implements, any_value(c) >= 8 AS dispatch FROM e JOIN (SELECT target AS t, count(DISTINCT CASE WHEN kind = 'implements' THEN source END) AS c FROM e WHERE kind IN ('extends', 'implements') GROUP BY target) d ON d.t = e.target WHERE kind IN ('extends', 'implements') AND source <> target GROUP BY source, target")
def type_relations(g, scratch):
    """One relation per pair of types, extends before implements; dispatch for types with 8 direct implementers."""
    rows = g.edges.where("kind in ('extends', 'implements')")
    sizes = rows.groupBy("target").agg(F.countDistinct(F.when(F.col("kind") == "implements", F.col("source"))).alias("c"))
    pairs = rows.where("source <> target").groupBy("source", "target").agg(F.bool_or(F.col("kind") == "extends").alias("ext"), F.bool_or(F.col("kind") == "implements").alias("implements"))
    return pairs.join(sizes, "target").select("source", "target", F.when(F.col("ext"), "extends").otherwise("implements").alias("relation"), "implements", (F.col("c") >= DISPATCH).alias("dispatch"))


_MEMBERS = "m AS (SELECT e.source AS owner, e.target AS t, n.name FROM e JOIN n ON n.id = e.target WHERE e.kind = 'contains' AND n.kind IN ('method', 'property', 'field') AND e.source <> e.target)"


@query("w06_nearest_override", "SELECT m.t AS member, b.t AS base, go.depth FROM m JOIN go ON go.root = m.owner AND go.depth > 0 AND go.id <> m.owner JOIN m b ON b.owner = go.id AND b.name = m.name QUALIFY row_number() OVER (PARTITION BY m.t ORDER BY go.depth, b.t) = 1", _MEMBERS + ", types AS (SELECT id FROM n WHERE kind IN ('class', 'interface', 'struct')), go0 AS (SELECT 1), " + _reach_sql("SELECT source AS a, target AS b FROM e WHERE kind IN ('extends', 'implements')", 8, "types"))
def nearest_overrides(g, scratch, depth: int = 8):
    """For members of types the member of that name in the nearest type above."""
    inside = g.edges.where("kind = 'contains' and source <> target").select(F.col("source").alias("owner"), F.col("target").alias("t"))
    members = scratch.spool(inside.join(g.nodes.where("kind in ('method', 'property', 'field')").select(F.col("id").alias("t"), "name"), "t").distinct())
    types = g.nodes.where("kind in ('class', 'interface', 'struct')").select("id")
    links = g.edges.where("kind in ('extends', 'implements')").select(F.col("source").alias("a"), F.col("target").alias("b"))
    above = reach(types, links, depth, scratch).where("depth > 0 and id <> root")
    mine = members.select(F.col("owner").alias("root"), F.col("t").alias("member"), "name").join(above, "root")
    both = mine.join(members.select(F.col("owner").alias("id"), F.col("t").alias("base"), "name"), ["id", "name"])
    return both.groupBy("member").agg(F.min(F.struct("depth", "base")).alias("m")).select("member", "m.base", "m.depth")


@query("w07_first_pass", "SELECT source, target, kind FROM e WHERE kind IN ('calls', 'references', 'instantiates') QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY CASE kind WHEN 'calls' THEN 0 WHEN 'instantiates' THEN 1 ELSE 2 END) = 1", recursive=False)
def first_pass(g, scratch, passes=("calls", "instantiates", "references")):
    """One edge per pair of ends over ordered passes: the first pass that has it."""
    place = F.coalesce(*(F.when(F.col("kind") == k, n) for n, k in enumerate(passes)))
    rows = g.edges.where(F.col("kind").isin(*passes))
    return rows.groupBy("source", "target").agg(F.min_by("kind", place).alias("kind"))


# Files and routes


@query("a13_file_neighbours", "SELECT f.id AS file, p.a AS neighbour, 'dependent' AS direction FROM top f JOIN fp p ON p.b = f.id UNION SELECT f.id, p.b, 'dependency' FROM top f JOIN fp p ON p.a = f.id", _FILE_SEEDS + ", fp AS (SELECT DISTINCT s_file AS a, t_file AS b FROM x WHERE kind <> 'contains' AND s_file <> t_file)", recursive=False)
def file_neighbours(g, scratch):
    """Files that depend on the most depended-on files, and files these depend on."""
    pairs = scratch.spool(file_pairs(g).select(F.col("s_file_path").alias("a"), F.col("t_file_path").alias("b")).distinct())
    top = scratch.spool(file_seeds(g))
    into = top.join(pairs, top["id"] == pairs["b"]).select(F.col("id").alias("file"), F.col("a").alias("neighbour"), F.lit("dependent").alias("direction"))
    out = top.join(pairs, top["id"] == pairs["a"]).select(F.col("id").alias("file"), F.col("b").alias("neighbour"), F.lit("dependency").alias("direction"))
    return into.unionByName(out).distinct()


@query("a28_blast_scale", "SELECT max(c) AS most FROM (SELECT root, count(DISTINCT id) AS c FROM go GROUP BY root)", "seeds AS (SELECT target AS id FROM e WHERE kind <> 'contains' AND source <> target GROUP BY target ORDER BY count(DISTINCT source) DESC, target LIMIT 24), " + _reach_sql("SELECT target AS a, source AS b FROM e WHERE kind <> 'contains'", 3))
def blast_scale(g, scratch, hubs: int = 24, depth: int = 3):
    """The most nodes that depend on one of the greatest hubs."""
    links = g.edges.where("kind <> 'contains'").select(F.col("target").alias("a"), F.col("source").alias("b"))
    return reach(seeds(g, hubs), links, depth, scratch).groupBy("root").agg(count_rows().alias("c")).agg(F.max("c").alias("most"))


def split_route(name: Column) -> tuple[Column, Column]:
    """(method, path) of a route's name: 'POST /v1/users'."""
    head, space = F.upper(F.substring_index(name, " ", 1)), F.instr(name, " ")
    known = (space > 1) & head.isin(*HTTP_METHODS)
    return F.when(known, head), F.when(known, F.ltrim(F.substring_index(name, " ", -1))).otherwise(name)


def routes(g: GraphStore, kinds=("route",), folder: str = "/") -> DataFrame:
    """Routes with their handlers: url, method, path, route_id, route_file, handler_id, handler_file."""
    method, path = split_route(F.col("url"))
    route = g.nodes.where(F.col("kind").isin(*kinds) & F.col("file_path").contains(folder)).select(F.col("id").alias("source"), F.col("name").alias("url"), F.col("file_path").alias("route_file"))
    handler = g.nodes.where(F.col("kind").isin(*HANDLERS)).select(F.col("id").alias("target"), F.col("name").alias("handler"), F.col("file_path").alias("handler_file"))
    links = g.edges.where("kind in ('references', 'calls')").select("source", "target").distinct()
    return links.join(route, "source").join(handler, "target").select("url", method.alias("method"), path.alias("path"), F.col("source").alias("route_id"), "route_file", F.col("target").alias("handler_id"), "handler", "handler_file")


_ROUTES = "rt AS (SELECT r.id AS route_id, r.name AS url, r.file_path AS route_file, h.id AS handler_id, h.file_path AS handler_file FROM (SELECT DISTINCT source, target FROM e WHERE kind IN ('references', 'calls')) e JOIN n r ON r.id = e.source AND r.kind = 'function' AND contains(r.file_path, '/api/') JOIN n h ON h.id = e.target AND h.kind IN ('function', 'method', 'class', 'constant', 'variable'))"


@query("j09_route_handlers", "SELECT route_id, handler_id, url, handler_file FROM rt", _ROUTES, recursive=False)
def route_handlers(g, scratch):
    """Entry nodes with what they refer to or call; here functions below api folders, as these data have no routes."""
    return routes(g, ("function",), "/api/").select("route_id", "handler_id", "url", "handler_file")


@query("a15_top_route_file", "SELECT route_file AS path, c AS n_routes, total FROM (SELECT route_file, c, sum(c) OVER () AS total, row_number() OVER (ORDER BY c DESC, route_file) AS place FROM (SELECT file_path AS route_file, count(*) AS c FROM n WHERE kind = 'module' GROUP BY file_path) g JOIN f ON f.path = g.route_file WHERE NOT coalesce(f.generated, false)) WHERE place = 1 AND total >= 3 AND c >= 3 AND c >= 0.0 * total", recursive=False)
def top_route_file(g, scratch, kinds=("module",), share: float = 0.0):
    """The file with the most routes, if there are enough in all and in it; here of modules, with no least share."""
    counts = g.nodes.where(F.col("kind").isin(*kinds)).groupBy(F.col("file_path").alias("path")).agg(count_rows().alias("n_routes"))
    counts = counts.join(g.files.where("not coalesce(generated, false)").select("path"), "path", "left_semi")
    total = counts.agg(F.sum("n_routes")).first()[0] or 0
    top = counts.orderBy(F.desc("n_routes"), "path").limit(1).withColumn("total", F.lit(total).cast("long"))
    return top.where((F.col("total") >= ROUTE_FLOOR) & (F.col("n_routes") >= ROUTE_FLOOR) & (F.col("n_routes") >= share * F.col("total")))


@query("a16_routing_manifest", "SELECT handler_file AS path, count(*) AS n_handlers FROM rt GROUP BY handler_file HAVING (SELECT count(*) FROM rt) >= 3 ORDER BY count(*) DESC, handler_file LIMIT 1", _ROUTES, recursive=False)
def leading_handler_file(g, scratch, kinds=("function",), folder: str = "/api/"):
    """The file that handles the most routes, of three and more in all."""
    rows = scratch.spool(routes(g, kinds, folder))
    found = rows.groupBy(F.col("handler_file").alias("path")).agg(count_rows().alias("n_handlers"))
    return found.orderBy(F.desc("n_handlers"), "path").limit(1 if rows.count() >= ROUTE_FLOOR else 0)


@query("j06_file_or_container", "SELECT n.id, coalesce(c.source, 'none') AS container FROM n LEFT JOIN (SELECT target, min(source) AS source FROM e WHERE kind = 'contains' AND source <> target GROUP BY target) c ON c.target = n.id WHERE n.kind IN ('variable', 'constant', 'field')", recursive=False)
def file_or_container(g, scratch):
    """Values with what contains them; 'none' where nothing does."""
    owner = g.edges.where("kind = 'contains' and source <> target").groupBy(F.col("target").alias("id")).agg(F.min("source").alias("source"))
    return g.nodes.where("kind in ('variable', 'constant', 'field')").select("id").join(owner, "id", "left").select("id", F.coalesce("source", F.lit("none")).alias("container"))


@query("g38_saved_trails", "SELECT s.source, s.target, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'gone' WHEN e2.source IS NULL THEN 'broken' ELSE 'kept' END AS state FROM (SELECT DISTINCT source, target FROM edges WHERE source IS NOT NULL AND target IS NOT NULL AND lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')) = 'calls') s LEFT JOIN n a ON a.id = s.source LEFT JOIN n b ON b.id = s.target LEFT JOIN (SELECT DISTINCT source, target FROM e WHERE kind = 'calls' AND coalesce(provenance, '') <> 'heuristic') e2 ON e2.source = s.source AND e2.target = s.target", recursive=False)
def saved_trails(g, scratch):
    """Hops saved earlier against the present graph: kept, broken where no sure call joins the ends now, gone where an end is."""
    saved = g.links.where("kind = 'calls'").select("source", "target").distinct()
    ids = g.nodes.select("id")
    now = g.edges.where("kind = 'calls' and coalesce(provenance, '') <> 'heuristic'").select("source", "target").distinct().withColumn("now", F.lit(True))
    rows = saved.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left").join(now, ["source", "target"], "left")
    return rows.select("source", "target", F.when(F.col("s").isNull() | F.col("t").isNull(), "gone").when(F.col("now").isNull(), "broken").otherwise("kept").alias("state"))
