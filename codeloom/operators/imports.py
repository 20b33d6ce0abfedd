"""Import resolution, gates on candidates, the two phases, and calls through supertypes.

An import names a file by a path (relative, or an end of one) or a folder; every language has its
ways to spell them. Ends of paths meet by equality with the ends of all files of the repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows
from codeloom.operators.resolve import _KEY, _Q, FAMILIES, named_refs
from codeloom.operators.store import GraphStore, with_sql
from codeloom.operators.traversal import reach
from codeloom.plans.scratch import Scratch
from codeloom.sources.extract import extract, extract_containment, extract_receivers, extract_references

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
# Extensions that an import leaves out, by language; the files that stand for a folder.
EXTENSIONS = {"typescript": ("ts", "tsx", "d.ts", "js", "jsx", "mjs"), "javascript": ("js", "jsx", "mjs", "cjs", "ts", "tsx"), "python": ("py", "pyi"), "java": ("java",), "rust": ("rs",), "c": ("c", "h"), "go": ("go",)}
INDEXES = {"typescript": ("index",), "javascript": ("index",), "python": ("__init__",), "rust": ("mod", "lib"), "java": (), "c": (), "go": ()}
# What a reference of a kind can mean.
TARGETS = {
    "calls": ("function", "method", "class", "struct", "component", "constant", "variable"),
    "instantiates": ("class", "struct", "interface", "enum", "type_alias"),
    "extends": ("class", "interface", "struct", "trait", "type_alias"),
    "implements": ("interface", "class", "trait", "protocol"),
    "type_of": ("class", "interface", "struct", "enum", "type_alias", "trait"),
    "function_ref": ("function", "method"),
}
FIRST_PHASE = ("imports", "extends", "implements")


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


def _walked(base: Column, steps: Column) -> Column:
    """The folders that a relative path leads to from those of ``base``."""
    return F.aggregate(steps, base, lambda at, s: F.when(s.isin(".", ""), at).when(s == "..", F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(s))))


def import_stems(file_path: Column, language: Column, module: Column) -> tuple[Column, Column]:
    """(path that a relative import means, end of a path that an absolute one means), without extension; null where it is the other kind."""
    folder = F.slice(F.split(file_path, "/"), 1, F.size(F.split(file_path, "/")) - 1)
    web = language.isin("typescript", "javascript")
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    own = F.split(F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/"), "/")
    relative = (
        F.when(web & module.startswith("."), _walked(folder, F.split(module, "/")))
        .when((language == "python") & module.startswith("."), F.concat(F.slice(folder, 1, F.greatest(F.size(folder) - dots + 1, F.lit(0))), F.filter(own, lambda s: s != "")))
        .when(language == "c", _walked(folder, F.split(F.regexp_replace(module, r"\.\w+$", ""), "/")))
    )
    cut = F.regexp_replace(module, r"^(?:crate|self|super)::", "")
    spelled = F.when(language.isin("python", "java"), F.regexp_replace(module, r"\.", "/")).when(language == "rust", F.regexp_replace(cut, "::", "/")).when(language == "c", F.regexp_replace(module, r"\.\w+$", "")).otherwise(module)
    absolute = F.when(~(module.startswith(".") & (web | (language == "python"))), F.regexp_replace(spelled, r"/\*$", ""))
    return F.array_join(relative, "/"), absolute


def _known(language: Column, table: dict[str, tuple[str, ...]]) -> Column:
    return F.coalesce(*(F.when(language == k, F.array(*map(F.lit, v)).cast("array<string>")) for k, v in table.items()), F.array().cast("array<string>"))


def resolve_imports(refs: DataFrame, paths: DataFrame) -> DataFrame:
    """file_path, line, module, target, what (file, folder), confidence of imports that lead to a file or a folder.

    ``refs`` has file_path, language, module, line; ``paths`` path. Relative paths and same-folder headers
    come first at 1.0, ends of paths in the repository then at 0.9 if one file has them, else 0.6 for the
    nearest; a folder, by the longest end that one folder of the repository has, at 0.5.
    """
    refs = refs.select("file_path", F.lower("language").alias("language"), "module", "line").distinct()
    relative, absolute = import_stems(F.col("file_path"), F.col("language"), F.col("module"))
    asked = refs.withColumn("repo", F.split_part("file_path", F.lit("/"), F.lit(1))).withColumn("relative", relative).withColumn("absolute", absolute)
    extensions, indexes = _known(F.col("language"), EXTENSIONS), _known(F.col("language"), INDEXES)
    names = lambda stem: F.concat(F.array(F.concat(stem, F.lit("")).cast("string")), F.transform(extensions, lambda e: F.concat(stem, F.lit("."), e)), F.flatten(F.transform(indexes, lambda i: F.transform(extensions, lambda e: F.concat(stem, F.lit("/"), i, F.lit("."), e)))))
    key = ["file_path", "line", "module"]
    files = paths.select("path").distinct()
    exact = asked.where("relative is not null").select(*key, F.posexplode(names(F.col("relative"))).alias("place", "path")).join(files, "path")
    first = exact.groupBy(*key).agg(F.min(F.struct("place", "path")).alias("m")).select(*key, F.col("m.path").alias("target"), F.lit("file").alias("what"), F.lit(1.0).alias("confidence"), F.lit(0).alias("rung"))
    parts = F.split("path", "/")
    ends = files.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, 999), "/"))).alias("end"))
    spelled = asked.where("absolute is not null and absolute <> ''").select(*key, "repo", F.posexplode(names(F.col("absolute"))).alias("place", "end"))
    near = X.proximity(F.col("file_path"), F.col("path"))
    found = spelled.join(ends, ["repo", "end"]).groupBy(*key).agg(count_rows().alias("c"), F.min(F.struct("place", (-near).alias("far"), "path")).alias("m"))
    second = found.select(*key, F.col("m.path").alias("target"), F.lit("file").alias("what"), F.when(F.col("c") == 1, 0.9).otherwise(0.6).alias("confidence"), F.lit(1).alias("rung"))
    folder = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    folders = files.select(folder.alias("path")).where("path <> ''").distinct()
    fparts = F.split("path", "/")
    fends = folders.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("repo"), F.explode(F.transform(F.sequence(F.lit(1), F.size(fparts)), lambda k: F.array_join(F.slice(fparts, k, 999), "/"))).alias("end"))
    unique = fends.groupBy("repo", "end").agg(count_rows().alias("c"), F.min("path").alias("path")).where("c = 1").drop("c")
    aparts = F.split("absolute", "/")
    cuts = asked.where("absolute is not null and absolute <> ''").select(*key, "repo", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(aparts)), lambda k: F.array_join(F.slice(aparts, k, 999), "/"))).alias("place", "end"))
    third = cuts.join(unique, ["repo", "end"]).groupBy(*key).agg(F.min(F.struct("place", "path")).alias("m")).select(*key, F.col("m.path").alias("target"), F.lit("folder").alias("what"), F.lit(0.5).alias("confidence"), F.lit(2).alias("rung"))
    rows = first.unionByName(second).unionByName(third)
    best = F.min(F.struct("rung", "target", "what", "confidence")).alias("b")
    return rows.groupBy(*key).agg(best).select(*key, "b.target", "b.what", "b.confidence")


@query("r10_imports")
def imports(g):
    """What the imports in the texts lead to."""
    refs = extract_references(g.raw("source_files").select("path", "language", "content").distinct()).where("reference_kind = 'imports'")
    return resolve_imports(refs.select("file_path", "language", F.col("reference_name").alias("module"), "line"), g.files.select("path"))


def family(language: Column) -> Column:
    return F.coalesce(*(F.when(language == k, v) for k, v in FAMILIES.items()), language)


def kind_gate(reference_kind: Column, kind: Column) -> Column:
    """Can a reference of a kind mean a node of a kind? Kinds without a list can mean anything."""
    out = F.lit(True)
    for k, allowed in TARGETS.items():
        out = F.when(reference_kind == k, kind.isin(*allowed)).otherwise(out)
    return out


_FAMILY_SQL = lambda c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + f" ELSE {c} END"
_KIND_SQL = "CASE q.reference_kind " + " ".join(f"WHEN '{k}' THEN n.kind IN {v}" for k, v in TARGETS.items()) + " ELSE true END"


@query("r12_gates", f"SELECT {_KEY}, count(*) AS n_candidates, count_if({_KIND_SQL} AND {_FAMILY_SQL('q.language')} = {_FAMILY_SQL('n.language')}) AS n_admitted FROM q JOIN n ON n.name = q.tail GROUP BY ALL".replace("line, col", "q.line, q.col"), _Q)
def gates(g):
    """Candidates of references by name, and how many pass the gates of kind and language family; counted by kind and language first, so a common name makes no pairs."""
    held = g.nodes.groupBy(F.col("name").alias("tail"), "kind", "language").agg(count_rows().alias("c"))
    refs = named_refs(g)
    rows = refs.join(held, "tail")
    admitted = kind_gate(F.col("reference_kind"), F.col("kind")) & (family(F.col("r_language")) == family(F.col("language")))
    return rows.groupBy("from_node_id", "reference_name", "line", "col").agg(F.sum("c").alias("n_candidates"), F.sum(F.when(admitted, F.col("c")).otherwise(0)).alias("n_admitted"))


@query("r15_phases", f"SELECT CASE WHEN reference_kind IN {FIRST_PHASE} THEN 1 ELSE 2 END AS phase, reference_kind, count(*) AS n_refs, count_if(tail IN (SELECT name FROM n)) AS n_possible FROM q GROUP BY ALL", _Q)
def phases(g):
    """References by the phase that resolves them: imports and supertypes first, as the rest looks through them."""
    names = g.nodes.select(F.col("name").alias("tail")).distinct().withColumn("hit", F.lit(1))
    rows = named_refs(g).join(names, "tail", "left")
    phase = F.when(F.col("reference_kind").isin(*FIRST_PHASE), 1).otherwise(2)
    return rows.groupBy(phase.alias("phase"), "reference_kind").agg(count_rows().alias("n_refs"), F.count("hit").alias("n_possible"))


def through_supertypes(calls: DataFrame, types: DataFrame, supers: DataFrame, members: DataFrame, scratch: Scratch, depth: int = 8) -> DataFrame:
    """Calls of a member on a type to the member in the type itself or the nearest type above that has it.

    ``calls`` has caller, type_name, member; ``types`` id, name; ``supers`` source, target; ``members`` owner, id, name.
    """
    own = types.select(F.col("id").alias("root"), F.col("name").alias("type_name"))
    above = reach(types, supers.select(F.col("source").alias("a"), F.col("target").alias("b")), depth, scratch)
    held = above.join(members.select(F.col("owner").alias("id"), F.col("id").alias("target"), F.col("name").alias("member")), "id").select("root", "depth", "target", "member")
    nearest = held.groupBy("root", "member").agg(F.min(F.struct("depth", "target")).alias("m")).select("root", "member", "m.depth", "m.target")
    return calls.join(own, "type_name").join(nearest, ["root", "member"]).select("caller", "type_name", "member", "target", "depth").distinct()


_TYPE_CALLS = "c AS (SELECT DISTINCT e.source AS caller, t.name AS type_name, m.name AS member FROM e JOIN n t ON t.id = e.target AND t.kind IN ('class', 'struct') JOIN e o ON o.kind = 'contains' AND o.source = t.id JOIN n m ON m.id = o.target AND m.kind = 'method' WHERE e.kind = 'instantiates')"


@query("r16_through_supertypes", "SELECT DISTINCT c.caller, c.type_name, c.member, min(mm.t) OVER (PARTITION BY c.caller, c.type_name, c.member, go.root, go.depth) AS target, go.depth FROM c JOIN n ty ON ty.name = c.type_name AND ty.kind IN ('class', 'struct', 'interface') JOIN (SELECT root, id, min(depth)::INTEGER AS depth FROM go GROUP BY root, id) go ON go.root = ty.id JOIN mm ON mm.owner = go.id AND mm.name = c.member QUALIFY go.depth = min(go.depth) OVER (PARTITION BY c.caller, c.type_name, c.member, go.root)",
    _TYPE_CALLS + ", mm AS (SELECT DISTINCT e.source AS owner, e.target AS t, n.name FROM e JOIN n ON n.id = e.target WHERE e.kind = 'contains' AND n.kind = 'method'), types AS (SELECT id FROM n WHERE kind IN ('class', 'struct', 'interface')), go AS (SELECT id AS root, id, 0 AS depth FROM types UNION SELECT go.root, l.b, go.depth + 1 FROM go JOIN (SELECT source AS a, target AS b FROM e WHERE kind IN ('extends', 'implements')) l ON l.a = go.id WHERE go.depth < 8)", recursive=True)
def deferred_calls(g):
    """Members called on types that a function creates, found in the type or the nearest one above."""
    inside = g.edges.where("kind = 'contains'").select(F.col("source").alias("owner"), F.col("target").alias("id"))
    members = inside.join(g.nodes.where("kind = 'method'").select("id", "name"), "id").distinct()
    types = g.nodes.where("kind in ('class', 'struct', 'interface')").select("id", "name")
    made = g.edges.where("kind = 'instantiates'").select(F.col("source").alias("caller"), F.col("target").alias("owner")).distinct()
    made = made.join(g.nodes.where("kind in ('class', 'struct')").select(F.col("id").alias("owner"), F.col("name").alias("type_name")), "owner")
    calls = made.join(members.select("owner", F.col("name").alias("member")), "owner").select("caller", "type_name", "member").distinct()
    return through_supertypes(calls, types, g.edges.where("kind in ('extends', 'implements')"), members, Scratch(g.spark, "r16"))


def receiver_calls(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Calls on a variable, or on the own object, whose type the function tells: to the member of that type or the nearest one above.

    ``files`` has path, language, content. caller, type_name, member, target, depth, all of the extracted graph.
    """
    nodes, refs = scratch.spool(extract(files)), scratch.spool(extract_references(files))
    inside = scratch.spool(extract_containment(files).select(F.col("source").alias("owner"), F.col("target").alias("id")))
    types = nodes.where("kind in ('class', 'struct', 'interface', 'trait', 'enum')").select("id", "name")
    members = inside.join(nodes.where("kind in ('method', 'function')").select("id", "name"), "id")
    named = types.groupBy(F.col("name").alias("reference_name")).agg(count_rows().alias("c"), F.min("id").alias("target")).where("c = 1")
    supers = refs.where("reference_kind in ('extends', 'implements')").join(named, "reference_name").select(F.col("from_node_id").alias("source"), "target")
    parts = F.split("reference_name", r"::|->|[.]")
    calls = refs.where("reference_kind = 'calls'").where(F.size(parts) == 2).select("from_node_id", parts[0].alias("variable"), parts[1].alias("member"))
    told = extract_receivers(files).groupBy("from_node_id", "variable").agg(F.count_distinct("type_name").alias("c"), F.min("type_name").alias("type_name")).where("c = 1")
    by_variable = calls.join(told, ["from_node_id", "variable"]).select(F.col("from_node_id").alias("caller"), "type_name", "member")
    owners = inside.select(F.col("id").alias("from_node_id"), F.col("owner").alias("id")).join(types, "id")
    by_self = calls.where("variable in ('self', 'this', 'Self')").join(owners, "from_node_id").select(F.col("from_node_id").alias("caller"), F.col("name").alias("type_name"), "member")
    return through_supertypes(by_variable.unionByName(by_self).distinct(), types, supers, members, scratch)


@query("r09_receiver_calls")
def receiver_call_query(g):
    """Calls in the texts that the type of their receiver leads to a member."""
    return receiver_calls(g.raw("source_files").select("path", "language", "content").distinct(), Scratch(g.spark, "r09"))
