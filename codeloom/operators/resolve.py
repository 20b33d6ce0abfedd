"""Reference resolution: names of references to nodes, as joins with a rank; and derived edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows
from codeloom.operators.store import GraphStore, with_sql
from codeloom.plans.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
CALLABLE = ("function", "method", "class", "struct")
CEILING = 500
# Names that languages bring along.
BUILTINS = ("print", "len", "range", "str", "int", "list", "dict", "console", "require", "append", "make", "panic", "println", "format", "String", "Object", "Math", "printf", "malloc", "free")
_KEY = "from_node_id, reference_name, line, col"
_TAIL = "regexp_extract(regexp_replace(reference_name, '/\\d+$', ''), '([^.:]*)$', 1)"


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


def named_refs(g: GraphStore) -> DataFrame:
    """References with their name tail, without names that languages bring along."""
    refs = g.refs.select("from_node_id", "reference_name", "reference_kind", "line", "col", F.col("file_path").alias("r_file"), F.col("language").alias("r_language"), "status")
    return refs.withColumn("tail", X.name_tail(F.col("reference_name"))).where(~F.col("tail").isin(*BUILTINS))


_Q = f"q AS (SELECT *, {_TAIL} AS tail FROM r WHERE {_TAIL} NOT IN ({', '.join(repr(b) for b in BUILTINS)}))"


@query("r02_possible_names", f"SELECT {_KEY} FROM q WHERE tail IN (SELECT name FROM n)", _Q)
def possible_names(g):
    names = g.nodes.select(F.col("name").alias("tail"))
    return named_refs(g).join(names, "tail", "left_semi").select("from_node_id", "reference_name", "line", "col")


@query("r05_qualified", f"SELECT {_KEY}, id, 0.95::DOUBLE AS confidence FROM (SELECT q.*, n.id, count(*) OVER (PARTITION BY {_KEY.replace('line', 'q.line').replace('col', 'q.col')}) AS c FROM q JOIN n ON n.qualified_name = q.reference_name) WHERE c = 1", _Q)
def qualified(g):
    """References that spell one node's qualified name."""
    rows = named_refs(g).join(g.nodes.select("id", F.col("qualified_name").alias("reference_name")), "reference_name")
    one = rows.withColumn("c", F.count("id").over(Window.partitionBy("from_node_id", "reference_name", "line", "col"))).where("c = 1")
    return one.select("from_node_id", "reference_name", "line", "col", "id", F.lit(0.95).alias("confidence"))


_MATCH = f"""names AS (SELECT name, count(*) AS c FROM n WHERE kind IN ('function', 'method', 'class', 'struct') GROUP BY name HAVING count(*) <= {CEILING}),
cand AS (SELECT q.*, n.id, n.language AS n_language, n.file_path AS n_file, n.kind AS n_kind, n.start_line, coalesce(n.is_exported, false) AS exported, names.c,
  least(80, 15 * len(list_filter(range(1, least(len(string_split(q.file_path, '/')), len(string_split(n.file_path, '/')))::BIGINT), lambda i: array_to_string(list_slice(string_split(q.file_path, '/'), 1, i), '/') = array_to_string(list_slice(string_split(n.file_path, '/'), 1, i), '/'))))::INTEGER AS near
  FROM q JOIN names ON names.name = q.tail JOIN n ON n.name = q.tail AND n.kind IN ('function', 'method', 'class', 'struct')),
scored AS (SELECT *, CASE WHEN n_file = file_path THEN 100 ELSE 0 END + near + CASE WHEN n_language = language THEN 50 ELSE -50 END + CASE WHEN n_kind IN ('function', 'method') THEN 25 ELSE 15 END + CASE WHEN exported THEN 10 ELSE 0 END AS score FROM cand),
best AS (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY score DESC, id) AS rank FROM scored)"""


def exact_matches(g: GraphStore, refs: DataFrame | None = None) -> DataFrame:
    """The best node of a reference's name, with the confidence of the match; names of many nodes are declined."""
    targets = g.nodes.where(F.col("kind").isin(*CALLABLE)).select("id", "name", F.col("language").alias("n_language"), F.col("file_path").alias("n_file"), F.col("kind").alias("n_kind"), F.coalesce("is_exported", F.lit(False)).alias("exported"))
    names = targets.groupBy("name").agg(count_rows().alias("c")).where(F.col("c") <= CEILING)
    refs = named_refs(g) if refs is None else refs
    rows = refs.join(names, refs["tail"] == names["name"]).drop("name").join(targets, F.col("tail") == F.col("name"))
    near = X.proximity(F.col("r_file"), F.col("n_file"))
    score = F.when(F.col("n_file") == F.col("r_file"), 100).otherwise(0) + F.col("near") + F.when(F.col("n_language") == F.col("r_language"), 50).otherwise(-50) + F.when(F.col("n_kind").isin("function", "method"), 25).otherwise(15) + F.when(F.col("exported"), 10).otherwise(0)
    rows = rows.withColumn("near", near).withColumn("score", score)
    order = Window.partitionBy("from_node_id", "reference_name", "line", "col").orderBy(F.desc("score"), "id")
    best = rows.withColumn("rank", F.row_number().over(order)).where("rank = 1")
    confidence = F.when(F.col("c") == 1, F.when(F.col("n_language") == F.col("r_language"), 0.9).otherwise(0.5)).when(F.col("near") >= 30, 0.7).otherwise(0.4)
    return best.withColumn("confidence", confidence)


_CONF = "CASE WHEN c = 1 THEN CASE WHEN n_language = language THEN 0.9 ELSE 0.5 END WHEN near >= 30 THEN 0.7 ELSE 0.4 END::DOUBLE"


@query("r06_exact_match", f"SELECT {_KEY}, id, {_CONF} AS confidence FROM best WHERE rank = 1", _Q + ", " + _MATCH)
def exact_match(g):
    return exact_matches(g).select("from_node_id", "reference_name", "line", "col", "id", "confidence")


@query("r08_fuzzy_match", f"SELECT {_KEY}, n.id, 0.5::DOUBLE AS confidence FROM q JOIN (SELECT lower(name) AS low, min(id) AS id FROM n WHERE kind IN ('function', 'method', 'class', 'struct') GROUP BY lower(name) HAVING count(*) = 1) n ON n.low = lower(q.tail) WHERE q.tail NOT IN (SELECT name FROM n)", _Q)
def fuzzy_match(g):
    """Names that match one node only when case is ignored."""
    single = g.nodes.where(F.col("kind").isin(*CALLABLE)).groupBy(F.lower("name").alias("low")).agg(count_rows().alias("c"), F.min("id").alias("id")).where("c = 1")
    refs = named_refs(g).join(g.nodes.select(F.col("name").alias("tail")), "tail", "left_anti").withColumn("low", F.lower("tail"))
    return refs.join(single, "low").select("from_node_id", "reference_name", "line", "col", "id", F.lit(0.5).alias("confidence"))


@query("r11_function_refs", f"SELECT {_KEY}, min(n.id) AS id FROM q JOIN n ON n.name = q.tail AND n.file_path = q.file_path AND n.kind IN ('function', 'method') WHERE q.reference_kind = 'function_ref' GROUP BY ALL", _Q)
def function_refs(g):
    """Functions passed as values, in the file of the reference."""
    refs = named_refs(g).where("reference_kind = 'function_ref'")
    targets = g.nodes.where("kind in ('function', 'method')").select("id", F.col("name").alias("tail"), F.col("file_path").alias("r_file"))
    return refs.join(targets, ["tail", "r_file"]).groupBy("from_node_id", "reference_name", "line", "col").agg(F.min("id").alias("id"))


# Languages whose symbols reach one another, and those where a bare name is no method. Fixed values.
FAMILIES = {"java": "jvm", "kotlin": "jvm", "scala": "jvm", "swift": "apple", "objc": "apple", "typescript": "web", "tsx": "web", "javascript": "web", "jsx": "web", "arkts": "web", "c": "c", "cpp": "c", "csharp": "dotnet", "razor": "dotnet"}
BARE_FUNCTIONS = ("typescript", "tsx", "javascript", "jsx", "arkts", "cpp", "python", "php")
KEY = ("from_node_id", "reference_name", "line", "col")


def _family(language: str):
    return F.coalesce(*(F.when(F.col(language) == k, v) for k, v in FAMILIES.items()), F.col(language))


def ladder_matches(g: GraphStore) -> DataFrame:
    """The node of a reference by the first matcher that has one: functions as values (for their references
    alone), else qualified names, exact names, names without case."""
    refs = named_refs(g)
    value = F.coalesce(F.col("reference_kind") == "function_ref", F.lit(False))
    values, plain = refs.where(value), refs.where(~value)
    targets = g.nodes.select("id", "name", "qualified_name", F.col("language").alias("n_language"), F.col("file_path").alias("n_file"), F.col("kind").alias("n_kind"), F.coalesce("start_line", F.lit(0)).alias("start_line"))
    out, same = [*KEY, "reference_kind", "id", "n_kind", "confidence", "rung"], F.col("n_file") == F.col("r_file")
    scoped = F.col("reference_name").contains("::")

    def best(rows: DataFrame, order: tuple) -> DataFrame:
        counts = rows.groupBy(*KEY, "reference_kind").agg(count_rows().alias("c"), F.count_if(same).alias("c_same"), F.min(F.struct((~same).alias("far"), *order, "n_kind")).alias("m"))
        return counts.select(*KEY, "reference_kind", "c", "c_same", "m.id", "m.n_kind")

    allowed = (F.col("n_kind") == "function") | ((F.col("n_kind") == "method") & (scoped | ~F.col("r_language").isin(*BARE_FUNCTIONS))) | ((F.col("n_kind") == "class") & (F.col("r_language") == "python") & ~scoped)
    named = F.when(scoped, (F.col("qualified_name") == F.col("reference_name")) | F.expr("endswith(qualified_name, '::' || reference_name)")).otherwise(~F.col("reference_name").startswith("this."))
    functions = values.join(targets, values["tail"] == targets["name"]).where(allowed & named & (_family("n_language") == _family("r_language")) & (F.col("id") != F.col("from_node_id")))
    functions = best(functions, ("start_line", "id")).where("c_same > 0 or c = 1")
    functions = functions.withColumn("confidence", F.when(scoped, 0.9).when(F.col("c_same") == 1, 0.95).when(F.col("c_same") > 1, 0.9).otherwise(0.8)).withColumn("rung", F.lit(1))

    dotted = plain.where(F.col("reference_name").contains(".") | scoped)
    no_key = ~((F.col("reference_kind") == "calls") & (F.col("n_kind") == "constant") & F.col("n_language").isin("yaml", "properties"))
    whole = best(dotted.join(targets, dotted["reference_name"] == targets["qualified_name"]).where(no_key), ("id",)).where("c_same > 0 or c = 1").withColumn("confidence", F.lit(0.95)).withColumn("rung", F.lit(2))
    part = best(dotted.join(targets, dotted["tail"] == targets["name"]).where(no_key & F.expr("endswith(qualified_name, reference_name)")), ("id",)).withColumn("confidence", F.lit(0.85)).withColumn("rung", F.lit(3))
    exact = exact_matches(g, plain).withColumn("rung", F.lit(4))

    single = targets.where(F.col("n_kind").isin(*CALLABLE)).groupBy(F.lower("name").alias("low")).agg(count_rows().alias("c"), *(F.min(x).alias(x) for x in ("id", "n_kind", "n_language"))).where("c = 1")
    unknown = plain.join(targets.select(F.col("name").alias("tail")), "tail", "left_anti").withColumn("low", F.lower("tail"))
    fuzzy = unknown.join(single, "low").withColumn("confidence", F.when(F.col("n_language") == F.col("r_language"), 0.5).otherwise(0.3)).withColumn("rung", F.lit(5))

    rows = functions.select(out)
    for more in (whole, part, exact, fuzzy):
        rows = rows.unionByName(more.select(out))
    order = Window.partitionBy(*KEY).orderBy("rung", F.desc("confidence"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


@query("r03_ladder")
def ladder(g):
    """Matches of the whole ladder; rungs: 1 function as value, 2 and 3 qualified name and its end, 4 exact, 5 without case."""
    return ladder_matches(g).select(*KEY, "id", "confidence", "rung")


@query("r13_new_edges", f"SELECT from_node_id AS source, id AS target, CASE WHEN reference_kind = 'calls' AND n_kind IN ('class', 'struct') THEN 'instantiates' WHEN reference_kind = 'extends' AND n_kind = 'interface' THEN 'implements' WHEN reference_kind = 'function_ref' THEN 'references' ELSE reference_kind END AS kind, line, col, {_CONF} AS confidence FROM best WHERE rank = 1 AND {_CONF} >= 0.5", _Q + ", " + _MATCH)
def new_edges(g, least: float = 0.5, matches=exact_matches):
    """Edges that resolved references become; by the exact matcher alone, as the SQL has it."""
    kind = F.when((F.col("reference_kind") == "calls") & F.col("n_kind").isin("class", "struct"), "instantiates").when((F.col("reference_kind") == "extends") & (F.col("n_kind") == "interface"), "implements").when(F.col("reference_kind") == "function_ref", "references").otherwise(F.col("reference_kind"))
    return matches(g).where(F.col("confidence") >= least).select(F.col("from_node_id").alias("source"), F.col("id").alias("target"), kind.alias("kind"), "line", "col", "confidence")


@query("r14_admission", f"SELECT outcome, count(*) AS n_refs FROM (SELECT CASE WHEN b.id IS NOT NULL AND {_CONF.replace('c =', 'b.c =').replace('n_language', 'b.n_language').replace('= language', '= b.language').replace('near', 'b.near')} >= 0.5 THEN 'resolved' ELSE 'failed' END AS outcome FROM q LEFT JOIN best b ON b.rank = 1 AND b.from_node_id = q.from_node_id AND b.reference_name = q.reference_name AND b.line IS NOT DISTINCT FROM q.line AND b.col IS NOT DISTINCT FROM q.col) GROUP BY outcome", _Q + ", " + _MATCH)
def admission(g, least: float = 0.5, matches=exact_matches):
    done = matches(g).where(F.col("confidence") >= least).select("from_node_id", "reference_name", "line", "col").distinct().withColumn("ok", F.lit(True))
    refs, key = named_refs(g), ("from_node_id", "reference_name", "line", "col")
    same = [refs[k].eqNullSafe(done[k]) for k in key]
    joined = refs.join(done, same, "left")
    return joined.groupBy(F.when(F.col("ok"), "resolved").otherwise("failed").alias("outcome")).agg(count_rows().alias("n_refs"))


@query("r13_ladder_edges")
def ladder_edges(g):
    """Edges that references resolved by the whole ladder become."""
    return new_edges(g, matches=ladder_matches)


@query("r14_ladder_admission")
def ladder_admission(g):
    return admission(g, matches=ladder_matches)


@query("r17_retry_failed", f"SELECT {_KEY} FROM r WHERE status = 'failed' AND name_tail IN (SELECT name_tail FROM r WHERE status = 'failed' GROUP BY name_tail HAVING count(*) <= {CEILING}) AND name_tail IN (SELECT name FROM n)")
def retry_failed(g):
    """Failed references whose name has a node now."""
    failed = g.refs.where("status = 'failed' and name_tail is not null")
    few = failed.groupBy("name_tail").agg(count_rows().alias("c")).where(F.col("c") <= CEILING).select("name_tail")
    return failed.join(few, "name_tail", "left_semi").join(g.nodes.select(F.col("name").alias("name_tail")), "name_tail", "left_semi").select("from_node_id", "reference_name", "line", "col")


@query("r18_rebind", "SELECT source, target, kind, line, col FROM x WHERE kind <> 'contains' AND coalesce(provenance, '') <> 'heuristic' AND t_name IN (SELECT DISTINCT name FROM n GROUP BY name HAVING count(*) BETWEEN 2 AND 20)")
def rebind(g):
    """Edges whose target's name has 2 to 20 definitions, as the SQL has it; ``r18_rebind_edges`` has no such cut."""
    names = g.nodes.groupBy(F.col("name").alias("t_name")).agg(count_rows().alias("c")).where("c between 2 and 20").select("t_name")
    rows = g.located("name").where("kind <> 'contains' and coalesce(provenance, '') <> 'heuristic'")
    return rows.join(names, "t_name", "left_semi").select("source", "target", "kind", "line", "col")


@query("r18_rebind_edges")
def rebind_edges(g):
    """All edges but heuristic ones by target name, of names with at most ``CEILING`` such edges."""
    target = g.nodes.select(F.col("id").alias("target"), F.col("name").alias("t_name"))
    rows = g.edges.where("coalesce(provenance, '') <> 'heuristic'").select("source", "target", "kind", "line", "col").join(target, "target")
    rows = Scratch(g.spark, "r18_rebind_edges").spool(rows)
    names = rows.groupBy("t_name").agg(count_rows().alias("c")).where(F.col("c") <= CEILING).select("t_name")
    return rows.join(names, "t_name", "left_semi").select("source", "target", "kind", "line", "col")


@query("y01_override_edges", "SELECT DISTINCT b.t AS source, c.t AS target FROM e JOIN m b ON b.owner = e.target JOIN m c ON c.owner = e.source AND c.name = b.name WHERE e.kind IN ('extends', 'implements') AND e.source <> e.target", "m AS (SELECT e.source AS owner, e.target AS t, n.name FROM e JOIN n ON n.id = e.target WHERE e.kind = 'contains' AND n.kind = 'method')")
def override_edges(g):
    """Calls of a base method reach the methods of that name in its subtypes."""
    methods = g.edges.where("kind = 'contains'").join(g.nodes.where("kind = 'method'").select(F.col("id").alias("target"), "name"), "target").select(F.col("source").alias("owner"), F.col("target").alias("t"), "name")
    types = g.edges.where("kind in ('extends', 'implements') and source <> target").select(F.col("source").alias("sub"), F.col("target").alias("base")).distinct()
    base = methods.select(F.col("owner").alias("base"), F.col("t").alias("source"), "name")
    sub = methods.select(F.col("owner").alias("sub"), F.col("t").alias("target"), "name")
    return types.join(base, "base").join(sub, ["sub", "name"]).select("source", "target").distinct()
