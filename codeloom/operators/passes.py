"""Edges derived from how code is wired: overrides, structural interfaces, emitters, buses, queues, HTTP clients, mappers.

Each pass gives (source, target, pass) pairs; sites come from the text of functions by patterns, with
the innermost function that encloses the line. Fan-out above a cap is declined as a whole, never cut.
``merged`` keeps of passes in order the first edge of each pair of ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.operators.readers import count_rows
from codeloom.operators.store import GraphStore, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Most edges of a channel, most handlers or dispatchers of an event.
CHANNEL_CAP, FANOUT_CAP = 40, 6
LINE_BIN = 64


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


def merged(passes: list[tuple[str, DataFrame]]) -> DataFrame:
    """(source, target, synthesized_by) of all passes, of a pair of ends the edge of the first pass."""
    rows = None
    for place, (name, edges) in enumerate(passes):
        part = edges.select("source", "target", F.struct(F.lit(place).alias("place"), F.lit(name).alias("name")).alias("p"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("source", "target").agg(F.min("p")["name"].alias("synthesized_by"))


# Types


def members(g: GraphStore, kinds=("method",)) -> DataFrame:
    """owner, member, name, language of members that a type contains."""
    inside = g.edges.where("kind = 'contains' and source <> target").select(F.col("source").alias("owner"), F.col("target").alias("member")).distinct()
    return inside.join(g.nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("member"), "name", "language", "start_line"), "member")


def overriding(types: DataFrame, held: DataFrame, cap: int = CHANNEL_CAP) -> DataFrame:
    """Base method to the method of that name in a subtype; of overloads in the base the last by line; ``cap`` edges at most of a pair of types.

    ``types`` has sub, base; ``held`` owner, member, name, start_line.
    """
    last = held.groupBy("owner", "name").agg(F.max_by("member", F.struct("start_line", "member")).alias("member"))
    base = last.select(F.col("owner").alias("base"), F.col("member").alias("source"), "name")
    sub = held.select(F.col("owner").alias("sub"), F.col("member").alias("target"), "name")
    rows = types.where("sub <> base").distinct().join(base, "base").join(sub, ["sub", "name"]).where("source <> target")
    nth = F.row_number().over(Window.partitionBy("sub", "base").orderBy("name", "target"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= cap).select("source", "target").distinct()


@query("y03_inherited_overrides", """SELECT DISTINCT source, target FROM (SELECT *, row_number() OVER (PARTITION BY sub, base ORDER BY name, target) AS nth FROM (SELECT DISTINCT t.sub, t.base, b.member AS source, s.member AS target, s.name
  FROM (SELECT DISTINCT source AS sub, target AS base FROM e WHERE kind IN ('extends', 'implements', 'overrides', 'type_of') AND source <> target) t JOIN (SELECT owner, name, member FROM m QUALIFY row_number() OVER (PARTITION BY owner, name ORDER BY start_line DESC, member DESC) = 1) b ON b.owner = t.base JOIN m s ON s.owner = t.sub AND s.name = b.name WHERE b.member <> s.member)) WHERE nth <= 40""",
    "m AS (SELECT DISTINCT e.source AS owner, e.target AS member, n.name, n.start_line FROM e JOIN n ON n.id = e.target WHERE e.kind = 'contains' AND e.source <> e.target AND n.kind IN ('method', 'property', 'field'))")
def inherited_overrides(g, kinds=("extends", "implements", "overrides", "type_of")):
    """Members of types that stand for members of that name in a related type."""
    types = g.edges.where(F.col("kind").isin(*kinds)).select(F.col("source").alias("sub"), F.col("target").alias("base"))
    return overriding(types, members(g, ("method", "property", "field")))


def structural(interfaces: DataFrame, structs: DataFrame, cap: int | None = CHANNEL_CAP) -> DataFrame:
    """Struct to interface whose method names it all has: relational division, rarest name first.

    Both have owner, name. A struct is looked up by the interface's rarest method only, then the rest is
    checked, so a common name makes no pairs of its own; ``cap`` structs at most of an interface.
    """
    held = structs.select("owner", "name").distinct()
    common = held.groupBy("name").agg(count_rows().alias("c"))
    asked = interfaces.select(F.col("owner").alias("target"), "name").distinct()
    sizes = asked.groupBy("target").agg(count_rows().alias("size"))
    rarest = asked.join(common, "name", "left").groupBy("target").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "name")).alias("r")).select("target", F.col("r.name").alias("name"))
    pairs = rarest.join(held.withColumnRenamed("owner", "source"), "name").where("source <> target").select("source", "target")
    met = pairs.join(asked, "target").join(held.withColumnRenamed("owner", "source"), ["source", "name"]).groupBy("source", "target").agg(count_rows().alias("met"))
    met = met.join(sizes, "target").where("met = size")
    if cap is None:
        return met.select("source", "target")
    nth = F.row_number().over(Window.partitionBy("target").orderBy("source"))
    return met.withColumn("nth", nth).where(F.col("nth") <= cap).select("source", "target")


@query("y09_go_structural", """SELECT s.owner AS source, i.owner AS target FROM (SELECT DISTINCT owner, name FROM m WHERE language = 'go') i JOIN (SELECT DISTINCT owner, name FROM m WHERE language = 'go') s ON s.name = i.name AND s.owner <> i.owner
  JOIN (SELECT owner, count(DISTINCT name) AS size FROM m WHERE language = 'go' GROUP BY owner) z ON z.owner = i.owner GROUP BY s.owner, i.owner, z.size HAVING count(*) = z.size QUALIFY row_number() OVER (PARTITION BY i.owner ORDER BY s.owner) <= 40""",
    "m AS (SELECT DISTINCT e.source AS owner, n.name, n.language FROM e JOIN n ON n.id = e.target JOIN n o ON o.id = e.source WHERE e.kind = 'contains' AND e.source <> e.target AND n.kind IN ('method', 'field') AND o.kind IN ('struct', 'interface', 'class'))")
def go_structural(g):
    """Go types that have all members another one declares; here structs and interfaces alike, as these data declare no interface methods."""
    owners = g.nodes.where("kind in ('struct', 'interface', 'class')").select(F.col("id").alias("owner"))
    held = members(g, ("method", "field")).where("language = 'go'").join(owners, "owner", "left_semi")
    return structural(held, held)


# Sites in texts


def sites(g: GraphStore, pattern: str, groups: dict[str, int], languages: tuple[str, ...] = ()) -> DataFrame:
    """(fn, file_path, line, **groups) of every place in the texts where ``pattern`` stands, with the innermost function round it."""
    texts = g.raw("source_files").where("path is not null and content is not null")
    texts = texts.where(F.lower("language").isin(*languages)) if languages else texts
    texts = texts.where(F.col("content").rlike(pattern)).select("path", "content").distinct()
    lines = texts.select(F.col("path").alias("file_path"), F.posexplode(F.split("content", "\n")).alias("line", "text")).where(F.col("text").rlike(pattern))
    rows = lines.select("file_path", (F.col("line") + 1).alias("line"), *(F.regexp_extract("text", pattern, k).alias(n) for n, k in groups.items()))
    return enclosed(g, rows)


def enclosed(g: GraphStore, rows: DataFrame) -> DataFrame:
    """Rows with (file_path, line) and ``fn``, the function with the latest start among those round the line."""
    bins = F.explode(F.sequence(F.floor(F.col("start_line") / LINE_BIN), F.floor(F.col("end_line") / LINE_BIN)))
    spans = g.nodes.where("kind in ('function', 'method') and start_line <= end_line").select(F.col("id").alias("fn"), "file_path", "start_line", "end_line", bins.alias("bin"))
    keys = [c for c in rows.columns]
    found = rows.withColumn("bin", F.floor(F.col("line") / LINE_BIN)).join(spans, ["file_path", "bin"]).where("line between start_line and end_line")
    return found.groupBy(*keys).agg(F.max_by("fn", F.struct("start_line", "fn")).alias("fn"))


def emitters(emitted: DataFrame, registered: DataFrame, functions: DataFrame, cap: int = FANOUT_CAP) -> DataFrame:
    """Function that emits an event to the handler registered for it by name; events with more than ``cap`` on a side are declined.

    ``emitted`` has fn, event; ``registered`` event, handler (a name); ``functions`` id, name.
    """
    first = functions.groupBy(F.col("name").alias("handler")).agg(F.min("id").alias("target"))
    sources = emitted.select(F.col("fn").alias("source"), "event").distinct()
    targets = registered.select("event", "handler").distinct().join(first, "handler").select("event", "target").distinct()
    few = lambda df: df.groupBy("event").agg(count_rows().alias("c")).where(F.col("c") <= cap).select("event")
    sources, targets = sources.join(few(sources), "event", "left_semi"), targets.join(few(targets), "event", "left_semi")
    return sources.join(targets, "event").where("source <> target").select("source", "target").distinct()


@query("y04_event_emitters")
def event_emitters(g):
    """emit('x') in a function to the function that on('x', handler) names."""
    functions = g.nodes.where("kind in ('function', 'method')").select("id", "name")
    emitted = sites(g, r"\.\s*(?:emit|fire|dispatch|trigger)\(\s*['\"]([\w:.-]+)['\"]", {"event": 1}, ("javascript", "typescript"))
    registered = sites(g, r"\.\s*(?:on|once|addListener|addEventListener)\(\s*['\"]([\w:.-]+)['\"]\s*,\s*(?:this\.)?(\w+)", {"event": 1, "handler": 2}, ("javascript", "typescript"))
    return emitters(emitted, registered, functions)


def bus_matches(dispatches: DataFrame, handlers: DataFrame, cap: int = FANOUT_CAP) -> DataFrame:
    """Dispatch of an event to the handlers whose pattern fits: * for one dotted part, ** for any.

    ``dispatches`` has source, event; ``handlers`` target, pattern. Exact patterns meet by a join; patterns
    with stars meet events by their first part, or all events where that has a star itself.
    """
    named = dispatches.distinct()
    named = named.join(named.groupBy("event").agg(count_rows().alias("c")).where(F.col("c") <= cap).select("event"), "event", "left_semi")
    exact = named.join(handlers.where(~F.col("pattern").contains("*")).withColumnRenamed("pattern", "event"), "event").select("source", "event", "target")
    starred = handlers.where(F.col("pattern").contains("*"))
    quoted = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^${}()|\[\]\\])", r"\\$1"), r"\*\*", "\u0001")
    regex = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(quoted, r"\*", "[^.]+"), "\u0001", ".*"), F.lit("$"))
    head = F.split_part("pattern", F.lit("."), F.lit(1))
    starred = starred.withColumn("regex", regex).withColumn("head", F.when(~head.contains("*"), head).otherwise("*"))
    by_head = named.withColumn("head", F.explode(F.array(F.split_part("event", F.lit("."), F.lit(1)), F.lit("*"))))
    fuzzy = by_head.join(starred, "head").where(F.expr("event rlike regex")).select("source", "event", "target")
    rows = exact.unionByName(fuzzy).distinct()
    few = rows.groupBy("source", "event").agg(count_rows().alias("c")).where(F.col("c") <= cap).select("source", "event")
    return rows.join(few, ["source", "event"], "left_semi").where("source <> target").select("source", "target").distinct()


def queue_matches(producers: DataFrame, consumers: DataFrame, cap: int = FANOUT_CAP) -> DataFrame:
    """Producer of a job to its consumers: the job on the named queue, else the job by name, else the queue's own consumers.

    ``producers`` has source, job, queue; ``consumers`` target, job, queue; a null queue or a consumer's
    null job is open. A producer without a queue needs a consumer that names its job.
    """
    p = producers.distinct()
    c = consumers.select("target", F.col("job").alias("c_job"), F.col("queue").alias("c_queue")).distinct()
    by_job = p.join(c, p["job"] == c["c_job"]).where("queue is null or c_queue is null or queue = c_queue").withColumn("tier", F.when(F.col("queue") == F.col("c_queue"), 0).otherwise(1))
    by_queue = p.join(c.where("c_job is null"), p["queue"] == c["c_queue"]).withColumn("tier", F.lit(2))
    rows = by_job.unionByName(by_queue)
    key = ["source", "job", "queue"]
    safe = [F.coalesce(x, F.lit("\u0000")) for x in key]
    rows = rows.withColumn("key", F.concat_ws("\u0001", *safe))
    best = rows.groupBy("key").agg(F.min("tier").alias("best"))
    kept = rows.join(best, "key").where("tier = best").select("key", "source", "target").distinct()
    few = kept.groupBy("key").agg(count_rows().alias("c")).where(F.col("c") <= cap).select("key")
    return kept.join(few, "key", "left_semi").where("source <> target").select("source", "target").distinct()


def segment_score(client: Column, route: Column) -> Column:
    """3 for each literal segment, 2 for each parameter of a route; null where one doesn't fit."""
    parts = F.zip_with(client, route, lambda c, r: F.when(r.rlike(r"^[:{\[*]"), 2).when(c == r, 3))
    return F.when((F.size(client) == F.size(route)) & ~F.exists(parts, lambda x: x.isNull()), F.aggregate(parts, F.lit(0), lambda a, x: a + x))


CATCH_ALL = r"^(?:\*+\w*|\[\.\.\..*\]|\{\w+[:*].*\}|:\w+\*)$"


def http_matches(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Client call to the route it hits: same method or a route for all, best score of segments; a tie makes no edge.

    ``calls`` has source, method, path; ``routes`` target, method, path. A catch-all last segment takes the
    rest of the path, at a point each. Routes meet calls by the number of segments and the first literal one.
    """
    cut = lambda c: F.filter(F.split(c, "/"), lambda s: s != "")
    c = calls.select("source", F.upper("method").alias("c_method"), "path").distinct().withColumn("c_segs", cut(F.col("path"))).where(F.size("c_segs") > 0)
    r = routes.select("target", F.upper("method").alias("r_method"), F.col("path").alias("r_path")).distinct().withColumn("r_segs", cut(F.col("r_path"))).where(F.size("r_segs") > 0)
    last = F.element_at("r_segs", -1).rlike(CATCH_ALL)
    head = F.col("r_segs")[0]
    keyed = r.withColumn("open", last).withColumn("head", F.when(head.rlike(r"^[:{\[*]"), "*").otherwise(head))
    asked = c.withColumn("head", F.explode(F.array_distinct(F.array(F.col("c_segs")[0], F.lit("*")))))
    rows = asked.join(keyed, "head").where("r_method in ('ALL', 'ANY') or r_method = c_method")
    fixed = F.size("r_segs") - 1
    open_score = segment_score(F.slice("c_segs", 1, F.greatest(fixed, F.lit(0))), F.slice("r_segs", 1, F.greatest(fixed, F.lit(0)))) + F.size("c_segs") - fixed
    rows = rows.withColumn("score", F.when(F.col("open") & (F.size("c_segs") > fixed), open_score).when(~F.col("open"), segment_score(F.col("c_segs"), F.col("r_segs")))).where("score is not null")
    best = rows.groupBy("source", "c_method", "path").agg(F.max("score").alias("best"))
    top = rows.join(best, ["source", "c_method", "path"]).where("score = best")
    return top.groupBy("source", "c_method", "path").agg(F.countDistinct("target").alias("c"), F.min("target").alias("target")).where("c = 1 and source <> target").select("source", "target").distinct()


def mapper_matches(statements: DataFrame, methods: DataFrame) -> DataFrame:
    """Statement of a mapping file (id, name 'a.b.Class.method') to the method Class::method, where one alone fits."""
    parts = F.split("name", r"[.]")
    key = F.concat_ws("::", F.element_at(parts, -2), F.element_at(parts, -1))
    named = statements.where(F.size(parts) >= 2).select(F.col("id").alias("source"), key.alias("key"))
    tail = F.regexp_extract("qualified_name", r"(\w+::\w+)$", 1)
    dotted = F.regexp_replace("qualified_name", r"[.](\w+)$", "::$1")
    targets = methods.select(F.col("id").alias("target"), F.regexp_extract(dotted, r"(\w+::\w+)$", 1).alias("key")).where("key <> ''")
    one = targets.groupBy("key").agg(count_rows().alias("c"), F.min("target").alias("target")).where("c = 1")
    return named.join(one, "key").where("source <> target").select("source", "target").distinct()


@query("y02_structural_implements", "SELECT s.owner AS source, i.owner AS target FROM m s JOIN m i ON s.name = i.name AND s.owner <> i.owner JOIN size ON size.owner = i.owner WHERE s.language = i.language GROUP BY s.owner, i.owner, size.c HAVING count(DISTINCT i.name) = size.c AND size.c >= 1", "m AS (SELECT DISTINCT e.source AS owner, n.name, n.language FROM e JOIN n ON n.id = e.target JOIN n o ON o.id = e.source WHERE e.kind = 'contains' AND e.source <> e.target AND n.kind IN ('property', 'field', 'method') AND o.kind IN ('struct', 'class')), size AS (SELECT owner, count(*) AS c FROM m GROUP BY owner)")
def structural_implements(g):
    """Types whose members include all names of another type of their language."""
    owners = g.nodes.where("kind in ('struct', 'class')").select(F.col("id").alias("owner"))
    held = members(g, ("property", "field", "method")).join(owners, "owner", "left_semi").select("owner", F.concat_ws(":", "language", "name").alias("name"))
    return structural(held, held, None)


@query("y10_merged_passes")
def merged_passes(g):
    """All passes over these data in order, the first edge of each pair."""
    return merged([("override", inherited_overrides(g)), ("go-implements", go_structural(g)), ("event-emitter", event_emitters(g))])
