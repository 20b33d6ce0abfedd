"""Retrieval as it is used: field filters, exact names, pinned paths, seeds, entry points, listings.

Queries are texts; the operators take them apart on the driver and join what they name with the
graph's tables. All of them look at whole tables; limits are those of a ranked list.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows
from codeloom.operators.search import _BM25, TERMS, bm25, search_terms
from codeloom.operators.store import GraphStore, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LIMIT = 20
# Fixed values.
DEFINITIONS = ("class", "interface", "struct", "union", "trait", "protocol", "enum", "type_alias")
CALLABLES = ("function", "method", "component")
NODE_KINDS = ("file", "module", "class", "struct", "union", "interface", "trait", "protocol", "function", "method", "property", "field", "variable", "constant", "enum", "enum_member", "type_alias", "namespace", "parameter", "import", "export", "route", "component")
STOP_WORDS = tuple("a an and are as at be but by do does for from has have how i in into is it its me my not of on or our show that the their them then there these they this those to was we what when where which who why will with you your".split())
CO_LOCATION = 20
BUDGETS = ((150, 13_000, 4), (500, 18_000, 5), (5_000, 24_000, 8), (15_000, 24_000, 8))


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


# Query texts


def parse_query(text: str, kinds: tuple[str, ...] = NODE_KINDS) -> dict[str, list[str] | str]:
    """The fields kind:, lang:, language:, path:, name: of a query and the text left over.

    Quotes hold white space together; a field with an empty value, an unknown field or an unknown
    kind is text.
    """
    out: dict[str, list[str]] = {"kind": [], "language": [], "path": [], "name": []}
    free = []
    for token in re.findall(r'(?:[^\s"]|"[^"]*"?)+', text):
        field, colon, value = token.partition(":")
        field = {"lang": "language"}.get(field.lower(), field.lower())
        value = value[1:-1] if len(value) >= 2 and value[0] == value[-1] == '"' else value
        if not (colon and value and field in out) or (field == "kind" and value not in kinds):
            free.append(token)
        else:
            out[field].append(value.lower() if field == "language" else value)
    return out | {"text": " ".join(free)}


def field_filter(fields: dict) -> Column:
    """The condition that the fields of a query set."""
    found = F.lit(True)
    for name, values in (("kind", fields["kind"]), ("language", fields["language"])):
        found = found & F.col(name).isin(*values) if values else found
    for name, values in (("file_path", fields["path"]), ("name", fields["name"])):
        for value in values:
            found = found & F.lower(name).contains(value.lower())
    return found


def normal_spelling(text: str) -> str:
    """module:function and function/arity as a reader writes them: module.function, function."""
    text = re.sub(r"\b([A-Za-z_][\w@]*)/\d{1,3}(?=$|[\s,()\[\]/])", r"\1", text)
    return re.sub(r"(^|[\s,()\[\]])(?!(?:kind|lang|language|path|name):)([a-z_][\w@]*):([A-Za-z_][\w@]*)(?=$|[\s,()\[\]])", r"\1\2.\3", text)


def named_symbols(text: str) -> list[str]:
    """What a text names as a symbol: compounds in humps or with underscores, dotted names and their tails, quoted code."""
    found = re.findall(r"`([^`\s]+)`|\b([A-Za-z_]\w*(?:(?:\.|::)[A-Za-z_]\w*)+)\b|\b([a-z]+[A-Z]\w*|[A-Z][a-z0-9]+[A-Z]\w*|\w+_\w+)\b", text)
    out: list[str] = []
    for name in (next(filter(None, f)) for f in found):
        for part in (name, re.split(r"\.|::", name)[-1].rstrip("()")):
            if part and part not in out:
                out.append(part)
    return out


def text_terms(text: Column) -> Column:
    """The distinct search terms of a text: words of three letters and more that are no stop words, and the parts of compounds."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([A-Za-z][A-Za-z0-9_]{2,})"), F.lit(1))
    parts = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.lower(w)), F.split(F.lower(F.regexp_replace(F.regexp_replace(w, r"([a-z0-9])([A-Z])", "$1 $2"), "_+", " ")), " "))))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS))))


# Lookups


@query("f04_qualified_name", "SELECT id, qualified_name, kind FROM n WHERE qualified_name IN (SELECT qualified_name FROM n WHERE kind = 'class')")
def qualified_names(g, kind: str = "class"):
    """Nodes by exact qualified names, here those of classes."""
    names = g.nodes.where(F.col("kind") == kind).select("qualified_name")
    return g.nodes.join(names, "qualified_name", "left_semi").select("id", "qualified_name", "kind")


@query("f12_field_filters", "SELECT id, kind, name FROM n WHERE kind IN ('method', 'function') AND language IN ('go', 'rust') AND contains(lower(file_path), 'src') AND contains(lower(name), 'cache')")
def field_filters(g, text: str = 'kind:method kind:function lang:Go language:rust path:SRC name:"Cache"'):
    return g.nodes.where(field_filter(parse_query(text))).select("id", "kind", "name")


@query("s05_filter_only", "SELECT id, name, 1.0::DOUBLE AS score FROM n WHERE kind = 'class' AND language = 'java' ORDER BY name, id LIMIT 100")
def filter_only(g, text: str = "kind:class lang:java", limit: int = LIMIT):
    rows = g.nodes.where(field_filter(parse_query(text))).select("id", "name", F.lit(1.0).alias("score"))
    return rows.orderBy("name", "id").limit(5 * limit)


_TOP = "top AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 100)"


@query("s06_exact_fold_in", f"SELECT id, score FROM top UNION ALL SELECT id, (SELECT max(score) FROM top) FROM (SELECT id, row_number() OVER (PARTITION BY name ORDER BY id) AS nth FROM n WHERE name IN {TERMS}) WHERE nth <= 20 AND id NOT IN (SELECT id FROM top)", _BM25 + ", " + _TOP)
def exact_fold_in(g, text: str = " ".join(TERMS), limit: int = 100, per_term: int = 20):
    """Ranked matches, and nodes whose name is a term of the query at the greatest score."""
    terms = search_terms(text)
    top = bm25(g.nodes, terms).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    best = top.agg(F.max("score")).first()[0]
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    exact = g.nodes.where(F.col("name").isin(*terms)).select("id", "name").withColumn("nth", nth).where(F.col("nth") <= per_term).join(top, "id", "left_anti")
    return top.unionByName(exact.select("id", F.lit(best).cast("double").alias("score")))


_SPANS = r"'([A-Za-z0-9_][A-Za-z0-9_.-]*(?:/[A-Za-z0-9_.-]+)+[.][A-Za-z]{1,4})'"


@query("s14_pinned_paths", f"""SELECT span, path FROM (SELECT span, path, k, min(k) OVER (PARTITION BY span) AS least, count(*) OVER (PARTITION BY span, k) AS c FROM
  (SELECT span, k, f.path FROM (SELECT span, unnest(range(0, least(8, len(string_split(span, '/'))))) AS k FROM spans) s JOIN f ON f.path = array_to_string(string_split(span, '/')[k + 1:], '/') OR ends_with(f.path, '/' || array_to_string(string_split(span, '/')[k + 1:], '/')))) WHERE k = least AND c <= 3""",
    f"spans AS (SELECT DISTINCT unnest(regexp_extract_all(text, {_SPANS}, 1)) AS span FROM documents)")
def pinned_paths(g, most: int = 3, drops: int = 8):
    """Files that the paths in texts name: the longest end of a path that up to three files have, leading folders dropped one by one."""
    pattern = F.lit(_SPANS[1:-1])
    spans = g.raw("documents").select(F.explode(F.regexp_extract_all("text", pattern, F.lit(1))).alias("span")).distinct()
    parts = F.split("span", "/")
    asked = spans.select("span", F.posexplode(F.transform(F.sequence(F.lit(1), F.least(F.lit(drops), F.size(parts))), lambda k: F.array_join(F.slice(parts, k, 99), "/"))).alias("k", "tail"))
    own = F.split("path", "/")
    ends = g.files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(own)), lambda k: F.array_join(F.slice(own, k, 99), "/"))).alias("tail"))
    found = asked.join(ends, "tail")
    best = found.groupBy("span").agg(F.min_by(F.struct("k"), "k").alias("b")).select("span", "b.k")
    hits = found.join(best, ["span", "k"])
    few = hits.groupBy("span").agg(count_rows().alias("c")).where(F.col("c") <= most).select("span")
    return hits.join(few, "span", "left_semi").select("span", "path")


# Ranking


def match_class(name: Column, text: str) -> Column:
    low = F.lower(name)
    return F.when(low == text, 0).when(low.startswith(text), 1).when(low.contains(text), 2).otherwise(3)


@query("s15_ui_search", """SELECT id, kind, row_number() OVER (ORDER BY cls, weight DESC, test, length(name), file_path, start_line, id) AS rank FROM (SELECT *, CASE WHEN lower(name) = 'cache' THEN 0 WHEN starts_with(lower(name), 'cache') THEN 1 WHEN contains(lower(name), 'cache') THEN 2 ELSE 3 END AS cls,
  CASE WHEN kind IN ('function', 'method') THEN 10 WHEN kind IN ('interface', 'trait', 'protocol', 'route') THEN 9 WHEN kind IN ('class', 'component') THEN 8 WHEN kind IN ('type_alias', 'struct', 'union') THEN 6 WHEN kind = 'enum' THEN 5 WHEN kind IN ('module', 'namespace') THEN 4 WHEN kind IN ('property', 'field', 'constant', 'enum_member') THEN 3 WHEN kind = 'variable' THEN 2 WHEN kind IN ('import', 'export') THEN 1 ELSE 0 END AS weight,
  regexp_matches(file_path, '""" + X.TEST_PATH + """') AS test FROM n WHERE contains(lower(name), 'cache') OR contains(lower(qualified_name), 'cache')) ORDER BY cls, weight DESC, test, length(name), file_path, start_line, id LIMIT 400""")
def ui_search(g, text: str = "cache", limit: int = 400):
    """Exact names, parts of names and qualified names in one ranked list."""
    rows = g.nodes.where(F.lower("name").contains(text) | F.lower("qualified_name").contains(text))
    order = (match_class(F.col("name"), text), F.desc("weight"), X.is_test_path(F.col("file_path")), F.length("name"), "file_path", "start_line", "id")
    top = rows.select("id", "kind", "name", "file_path", "start_line", X.kind_weight(F.col("kind")).alias("weight")).orderBy(*order).limit(limit)
    return top.select("id", "kind", F.row_number().over(Window.orderBy(*order)).alias("rank"))


@query("s16_name_seeds", f"SELECT m.id, 1.0::DOUBLE + CASE WHEN d.c > 1 THEN 20 * (d.c - 1) ELSE 0 END AS score FROM (SELECT * FROM n WHERE lower(name) IN {TERMS}) m JOIN (SELECT file_path, count(DISTINCT lower(name)) AS c FROM n WHERE lower(name) IN {TERMS} GROUP BY file_path) d USING (file_path)")
def name_seeds(g, names=TERMS):
    """Nodes that bear one of several names; a file that defines more of them lifts all of its own."""
    rows = g.nodes.where(F.lower("name").isin(*names)).select("id", "file_path", F.lower("name").alias("low"))
    files = rows.groupBy("file_path").agg(F.countDistinct("low").alias("c"))
    return rows.join(files, "file_path").select("id", (F.lit(1.0) + F.when(F.col("c") > 1, CO_LOCATION * (F.col("c") - 1)).otherwise(0)).alias("score"))


def _in_kinds() -> Column:
    return F.col("kind").isin(*DEFINITIONS, *CALLABLES)


_KINDS_SQL = "kind IN ('class', 'interface', 'struct', 'union', 'trait', 'protocol', 'enum', 'type_alias', 'function', 'method', 'component')"


@query("s17_hump_matches", "SELECT id, count(*) AS n_words, round(max(8 + greatest(0, 6 - (length(name) - length(w)) / 4.0)) * (1 + count(*)) + (count(*) - 1) * 30, 4) AS score FROM (SELECT id, name, unnest(['Walk', 'Cache', 'Queue']) AS w FROM n WHERE " + _KINDS_SQL + ") WHERE regexp_matches(name, '[A-Za-z]' || w) AND strpos(lower(name), lower(w)) > 1 AND substr(name, strpos(lower(name), lower(w)), 1) = upper(substr(w, 1, 1)) AND regexp_matches(substr(name, strpos(lower(name), lower(w)) - 1, 1), '[A-Za-z]') GROUP BY id")
def hump_matches(g, words=TERMS):
    """Definitions and callables with a query's word at a hump inside the name; several words raise the score steeply."""
    rows = g.nodes.where(_in_kinds()).select("id", "name", F.explode(F.array(*map(F.lit, words))).alias("word"))
    place = F.expr("locate(word, lower(name))")
    hump = (place > 1) & F.expr("substring(name, locate(word, lower(name)), 1)").rlike("[A-Z]") & F.expr("substring(name, locate(word, lower(name)) - 1, 1)").rlike("[A-Za-z]")
    hits = rows.where(hump).withColumn("s", 8 + F.greatest(F.lit(0.0), 6 - (F.length("name") - F.length("word")) / 4))
    score = F.max("s") * (1 + count_rows()) + (count_rows() - 1) * 30
    return hits.groupBy("id").agg(count_rows().alias("n_words"), F.round(score, 4).alias("score"))


@query("s17_compound_matches", "SELECT id, count(*) AS n_words, round(10 + (count(*) - 1) * 20 + max(greatest(0, 6 - length(name) / 8.0)), 4) AS score FROM (SELECT id, name, unnest(['walk', 'cache', 'queue', 'handler']) AS w FROM n WHERE " + _KINDS_SQL + ") WHERE contains(lower(name), w) GROUP BY id HAVING count(*) >= 2")
def compound_matches(g, words=(*TERMS, "handler")):
    """Definitions and callables whose name holds two and more words of a query."""
    rows = g.nodes.where(_in_kinds()).select("id", "name", F.explode(F.array(*map(F.lit, words))).alias("word")).where(F.lower("name").contains(F.col("word")))
    score = 10 + (count_rows() - 1) * 20 + F.max(F.greatest(F.lit(0.0), 6 - F.length("name") / 8))
    return rows.groupBy("id").agg(count_rows().alias("n_words"), F.round(score, 4).alias("score")).where("n_words >= 2")


_POOL = "pool AS (SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 60)"


def entry_points(g: GraphStore, ranked: DataFrame, limit: int = LIMIT, least: float = 0.0) -> DataFrame:
    """The best of a ranked list, import statements followed to what they import; those that lead nowhere go."""
    pool = ranked.orderBy(F.desc("score"), "id").limit(3 * limit).where(F.col("score") >= least)
    kinds = pool.join(g.nodes.select("id", "kind"), "id")
    definition = g.edges.where("kind in ('imports', 'exports')").select(F.col("source").alias("id"), "target")
    followed = kinds.where("kind in ('import', 'export')").join(definition, "id").select(F.col("target").alias("id"), "score")
    plain = kinds.where("kind not in ('import', 'export')").select("id", "score")
    return plain.unionByName(followed).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(limit)


@query("s19_entry_points", "SELECT id, max(score) AS score FROM (SELECT p.id, p.score FROM pool p JOIN n USING (id) WHERE kind NOT IN ('import', 'export') UNION ALL SELECT e.target, p.score FROM pool p JOIN n USING (id) JOIN e ON e.source = p.id AND e.kind IN ('imports', 'exports') WHERE n.kind IN ('import', 'export')) GROUP BY id ORDER BY max(score) DESC, id LIMIT 20", _BM25 + ", " + _POOL)
def entry_point_query(g):
    return entry_points(g, bm25(g.nodes, list(TERMS)).select("id", F.round("score", 6).alias("score")))


@query("s20_confidence", "SELECT CASE WHEN bool_or(hits >= 2) THEN 'high' ELSE 'low' END AS confidence, count(*) AS n_entries FROM (SELECT " + " + ".join(f"(contains(lower(name), '{t}') OR list_contains(string_split(lower(regexp_replace(file_path, '/?[^/]*$', '')), '/'), '{t}'))::INTEGER" for t in TERMS) + " AS hits FROM (SELECT id FROM bm ORDER BY round(score, 6) DESC, id LIMIT 20) JOIN n USING (id))", _BM25)
def confidence(g, terms=TERMS, limit: int = LIMIT):
    """High where one of the best matches holds two terms in its name or folders."""
    top = bm25(g.nodes, list(terms)).select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)
    rows = top.join(g.nodes.select("id", "name", "file_path"), "id")
    folders = F.split(F.lower(F.regexp_replace("file_path", "/?[^/]*$", "")), "/")
    hits = sum(((F.lower("name").contains(t) | F.array_contains(folders, t)).cast("int") for t in terms), F.lit(0))
    return rows.agg(F.when(F.bool_or(hits >= 2), "high").otherwise("low").alias("confidence"), count_rows().alias("n_entries"))


@query("s25_output_budget", "SELECT c AS n_files, CASE WHEN c < 150 THEN 13000 WHEN c < 500 THEN 18000 ELSE 24000 END AS max_chars, CASE WHEN c < 150 THEN 4 WHEN c < 500 THEN 5 ELSE 8 END AS max_files, CASE WHEN c < 500 THEN 1 WHEN c < 5000 THEN 2 WHEN c < 15000 THEN 3 WHEN c < 25000 THEN 4 ELSE 5 END AS calls FROM (SELECT count(*) AS c FROM f)")
def output_budget(g):
    """How much an answer about a project of this many files may hold."""
    n = F.col("n_files")
    chars = F.when(n < 150, 13_000).when(n < 500, 18_000).otherwise(24_000)
    files = F.when(n < 150, 4).when(n < 500, 5).otherwise(8)
    calls = F.when(n < 500, 1).when(n < 5_000, 2).when(n < 15_000, 3).when(n < 25_000, 4).otherwise(5)
    return g.files.agg(count_rows().alias("n_files")).select("n_files", chars.alias("max_chars"), files.alias("max_files"), calls.alias("calls"))


@query("s27_served_ranges", """SELECT file_path, start_line, end_line FROM (SELECT DISTINCT file_path, start_line, end_line, sha256(coalesce(signature, '')) AS print FROM n WHERE kind = 'class') QUALIFY row_number() OVER (PARTITION BY file_path, print ORDER BY start_line, end_line) = 1
  EXCEPT SELECT a.file_path, a.start_line, a.end_line FROM n a JOIN n b ON a.file_path = b.file_path AND a.kind = 'class' AND b.kind = 'class' AND a.id <> b.id AND b.start_line <= a.start_line AND b.end_line >= a.end_line AND (b.end_line - b.start_line) > (a.end_line - a.start_line)""")
def served_ranges(g, kind: str = "class"):
    """Ranges of a file that add something: one of each content, none that lies in another; by a sweep over starts."""
    rows = g.nodes.where((F.col("kind") == kind) & F.col("start_line").isNotNull() & F.col("end_line").isNotNull())
    rows = rows.select("file_path", "start_line", "end_line", F.sha2(F.coalesce("signature", F.lit("")), 256).alias("print")).distinct()
    before = Window.partitionBy("file_path").orderBy("start_line", F.desc("end_line"), "print").rowsBetween(Window.unboundedPreceding, -1)
    reach = rows.withColumn("reach", F.max("end_line").over(before))
    same = Window.partitionBy("file_path", "start_line", "end_line")
    outer = reach.withColumn("reach", F.min("reach").over(same)).withColumn("inside", F.coalesce(F.col("reach") >= F.col("end_line"), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("file_path", "print").orderBy("start_line", "end_line"))
    return outer.withColumn("nth", first).where("nth = 1 and not inside").select("file_path", "start_line", "end_line").distinct()


@query("s28_file_listing", "SELECT language, path, row_number() OVER (PARTITION BY language ORDER BY path) AS place, len(string_split(path, '/')) - 1 AS depth FROM f")
def file_listing(g):
    """Files grouped by language in the order of paths, with their depth in the tree."""
    place = F.row_number().over(Window.partitionBy("language").orderBy("path"))
    return g.files.select("language", "path", place.cast("long").alias("place"), (F.size(F.split("path", "/")) - 1).cast("long").alias("depth"))


# Words of texts


@query("x05_search_terms", "SELECT doc_id, unnest(list_distinct(list_filter(flatten(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z0-9_]{2,}'), lambda w: list_concat([lower(w)], string_split(lower(regexp_replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_+', ' ', 'g')), ' ')))), lambda w: length(w) >= 3 AND w NOT IN " + str(STOP_WORDS) + "))) AS term FROM documents")
def search_term_query(g):
    """The search terms of every document."""
    return g.raw("documents").select("doc_id", F.explode(text_terms(F.col("text"))).alias("term"))


@query("x02_prose_candidates", "SELECT doc_id, w AS word FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS place FROM (SELECT doc_id, w, min(k) AS k FROM (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS k FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS ws FROM documents)) WHERE length(w) BETWEEN 4 AND 24 AND w NOT IN " + str(STOP_WORDS) + " GROUP BY doc_id, w)) WHERE place <= 16")
def prose_candidates(g, most: int = 16):
    """The first sixteen distinct words of 4 to 24 letters of a text that are no stop words."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), F.lit(1))
    kept = F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & (F.length(w) <= 24) & ~w.isin(*STOP_WORDS))), 1, most)
    return g.raw("documents").select("doc_id", F.explode(kept).alias("word"))


@query("x03_plural_matches", "SELECT DISTINCT w AS word, v.segment FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS w FROM documents) d JOIN voc v ON v.segment IN (regexp_replace(w, 'ies$', 'y'), CASE WHEN ends_with(w, 'ss') THEN w ELSE regexp_replace(w, 's$', '') END, w || 's') AND v.segment <> w", "voc AS (SELECT DISTINCT unnest(" + X.segment_sql("name") + ") AS segment FROM n WHERE kind NOT IN ('file', 'import'))")
def plural_matches(g):
    """Words of documents that are the plural or singular of a segment of the vocabulary."""
    own = g.nodes.where("kind not in ('file', 'import')").select(F.explode(X.segments(F.col("name"))).alias("segment")).distinct()
    words = g.raw("documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("word")).distinct()
    forms = words.select("word", F.explode(X.plurals(F.col("word"))).alias("segment")).where("word <> segment")
    return forms.join(own, "segment", "left_semi").select("word", "segment").distinct()


@query("x04_stem_groups", "SELECT stem, count(DISTINCT segment) AS n_segments FROM (SELECT segment, unnest([segment, CASE WHEN regexp_matches(segment, '^.{3,}ations?$') THEN regexp_replace(segment, 'ations?$', '') END, CASE WHEN regexp_matches(segment, '^.{3,}ing$') THEN regexp_replace(segment, 'ing$', '') END, CASE WHEN regexp_matches(segment, '^.{3,}ers?$') THEN regexp_replace(segment, 'ers?$', '') END, CASE WHEN regexp_matches(segment, '^.{3,}ed$') THEN regexp_replace(segment, 'ed$', '') END, CASE WHEN regexp_matches(segment, '^.{3,}ly$') THEN regexp_replace(segment, 'ly$', '') END, CASE WHEN regexp_matches(segment, '^.{3,}ies$') THEN regexp_replace(segment, 'ies$', 'y') END, CASE WHEN regexp_matches(segment, '^.{3,}s$') THEN regexp_replace(segment, 's$', '') END]) AS stem FROM voc) WHERE length(stem) >= 3 GROUP BY stem HAVING count(DISTINCT segment) > 1", "voc AS (SELECT DISTINCT unnest(" + X.segment_sql("name") + ") AS segment FROM n WHERE kind NOT IN ('file', 'import'))")
def stem_groups(g):
    """Stems that several segments of the vocabulary share."""
    own = g.nodes.where("kind not in ('file', 'import')").select(F.explode(X.segments(F.col("name"))).alias("segment")).distinct()
    return own.select("segment", F.explode(X.stems(F.col("segment"))).alias("stem")).groupBy("stem").agg(F.countDistinct("segment").alias("n_segments")).where("n_segments > 1")


@query("x06_named_symbols", "SELECT doc_id, count(DISTINCT s) AS n_symbols FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '\\b([a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*|[A-Za-z0-9]+_[A-Za-z0-9_]+)\\b', 1)) AS s FROM documents) WHERE s IN (SELECT name FROM n) GROUP BY doc_id")
def named_symbol_counts(g):
    """How many symbols of the graph each document names."""
    pattern = F.lit(r"\b([a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z0-9]+[A-Z][A-Za-z0-9]*|[A-Za-z0-9]+_[A-Za-z0-9_]+)\b")
    said = g.raw("documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", pattern, F.lit(1)))).alias("name"))
    return said.join(g.nodes.select("name"), "name", "left_semi").groupBy("doc_id").agg(count_rows().alias("n_symbols"))
