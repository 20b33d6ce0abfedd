"""Text search over nodes: postings, BM25, fallbacks, rescoring, segment matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import scalars as X
from codeloom.operators.readers import count_rows, vocabulary
from codeloom.operators.store import GraphStore, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
K1, B = 1.2, 0.75
WEIGHTS = {"name": 20.0, "qualified_name": 5.0, "docstring": 1.0, "signature": 2.0}
TERMS = ("walk", "cache", "queue")
RESERVED = {"AND", "OR", "NOT", "NEAR"}


def query(name: str, sql: str | None = None, more: str = "", recursive: bool = False):
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(GraphStore(spark, sf_dir))
        if sql:
            ORACLE[name] = with_sql(sql, recursive, more)
        return function

    return register


def search_terms(text: str) -> list[str]:
    """The prefix terms of a query: operators and quotes go, '::' cuts."""
    cleaned = "".join(" " if c in "'\"*():^" else c for c in text.replace("::", " "))
    return [t.lower() for t in cleaned.split() if t not in RESERVED]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def _weighted_hits(term: str) -> Column:
    """Tokens that start with a term, by the weights of their fields."""
    starting = [F.size(F.filter(c, lambda w: w.startswith(term))) * weight for c, weight in WEIGHTS.items()]
    return sum(starting, F.lit(0.0))


def bm25(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of nodes that hold a token starting with a term, by BM25 over weighted fields."""
    fields = nodes.select("id", *(tokens(F.col(c)).alias(c) for c in WEIGHTS))
    sized = fields.withColumn("len", sum((F.size(c) for c in WEIGHTS), F.lit(0)).cast("double"))
    hits = [F.struct(F.lit(t).alias("term"), _weighted_hits(t).alias("tf")) for t in terms]
    found = sized.select("id", "len", F.explode(F.array(*hits)).alias("h")).select("id", "len", "h.term", "h.tf").where("tf > 0")
    corpus = sized.agg(count_rows().alias("n"), F.avg("len").alias("avg_len"))
    frequency = found.groupBy("term").agg(count_rows().alias("df"))  # a row per term of the query
    stats = corpus.first()
    n, avg_len = stats["n"], stats["avg_len"] or 1.0
    idf = F.greatest(F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg_len))
    return found.join(frequency, "term").groupBy("id").agg(F.sum(part).alias("score"))


_TOK = lambda c: f"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+')"
_BM25 = (
    "d AS (SELECT id, " + ", ".join(f"{_TOK(c)} AS {c}" for c in WEIGHTS) + " FROM n), dl AS (SELECT *, (" + " + ".join(f"len({c})" for c in WEIGHTS) + ")::DOUBLE AS l FROM d), "
    "hit AS (" + " UNION ALL ".join(f"SELECT id, l, '{t}' AS term, " + " + ".join(f"{w} * len(list_filter({c}, lambda v: starts_with(v, '{t}')))" for c, w in WEIGHTS.items()) + " AS tf FROM dl" for t in TERMS) + "), "
    "h AS (SELECT * FROM hit WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM h GROUP BY term), "
    f"bm AS (SELECT h.id, sum(greatest(ln(((SELECT count(*) FROM dl) - df.df + 0.5) / (df.df + 0.5)), 1e-6) * tf * {K1 + 1} / (tf + {K1} * ({1 - B} + {B} * l / (SELECT avg(l) FROM dl)))) AS score FROM h JOIN df USING (term) GROUP BY h.id)"
)


@query("s02_bm25", "SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 6) DESC, id LIMIT 100", _BM25)
def bm25_top(g, text: str = " ".join(TERMS), limit: int = 100):
    scored = bm25(g.nodes, search_terms(text)).select("id", F.round("score", 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


@query("s03_like_fallback", "SELECT id, CASE WHEN name = 'cac_e' THEN 1.0 WHEN name ILIKE 'cac_e%' THEN 0.9 WHEN name ILIKE '%cac_e%' THEN 0.8 WHEN qualified_name ILIKE '%cac_e%' THEN 0.7 ELSE 0.5 END::DOUBLE AS score FROM n WHERE name ILIKE '%cac_e%' OR qualified_name ILIKE '%cac_e%' ORDER BY 2 DESC, length(name), id LIMIT 100")
def like_fallback(g, text: str = "cac_e", limit: int = 20):
    """Substring hits where no word starts with the text; % and _ in it stand for any characters, as in LIKE."""
    name, qualified = F.col("name"), F.col("qualified_name")
    score = F.when(name == text, 1.0).when(name.ilike(f"{text}%"), 0.9).when(name.ilike(f"%{text}%"), 0.8).when(qualified.ilike(f"%{text}%"), 0.7).otherwise(0.5)
    rows = g.nodes.where(name.ilike(f"%{text}%") | qualified.ilike(f"%{text}%"))
    return rows.select("id", score.alias("score"), F.length("name").alias("len")).orderBy(F.desc("score"), "len", "id").limit(5 * limit).select("id", "score")


@query("s04_fuzzy", """SELECT name, d AS distance, 1.0 / (1 + d) AS score, id FROM (SELECT *, dense_rank() OVER (ORDER BY d, name) AS place, row_number() OVER (PARTITION BY name ORDER BY id) AS nth FROM
  (SELECT id, name, levenshtein(lower(name), 'ledgr') AS d FROM n) WHERE d <= 2) WHERE place <= 50 AND nth <= 5""")
def fuzzy(g, text: str = "ledgr", limit: int = 20):
    """Names within an edit distance of 1 (texts up to 4 characters) or 2: the nearest names, five nodes of each."""
    most = 1 if len(text) <= 4 else 2
    names = g.nodes.select("name").distinct().withColumn("distance", F.levenshtein(F.lower("name"), F.lit(text.lower()), most)).where("distance >= 0")
    nearest = names.orderBy("distance", "name").limit(max(2 * limit, 50))
    nth = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    return g.nodes.select("id", "name").join(nearest, "name").withColumn("nth", nth).where("nth <= 5").select("name", "distance", (1.0 / (1 + F.col("distance"))).alias("score"), "id")


@query("s08_name_bonus", "SELECT id, CASE WHEN lower(name) = 'walkcache' THEN 80 WHEN lower(name) IN ('walk', 'cache') THEN 60 WHEN starts_with(lower(name), 'walk') THEN 10 + floor(30.0 * 4 / length(name) + 0.5) WHEN contains(lower(name), 'walk') AND contains(lower(name), 'cache') THEN 15 WHEN contains(lower(name), 'walk') OR contains(lower(name), 'cache') THEN 10 ELSE 0 END::DOUBLE AS bonus FROM n WHERE contains(lower(name), 'walk') OR contains(lower(name), 'cache')")
def name_bonus_query(g):
    rows = g.nodes.withColumn("bonus", name_bonus(["walk", "cache"]))
    return rows.where("bonus > 0").select("id", "bonus")


def name_bonus(words: list[str]) -> Column:
    """The bonus of a node's name for the words of a query."""
    low = F.lower("name")
    has = [low.contains(w) for w in words]
    every, some = has[0], has[0]
    for h in has[1:]:
        every, some = every & h, some | h
    return F.when(low == "".join(words), 80.0).when(low.isin(*words), 60.0).when(low.startswith(words[0]), 10.0 + F.floor(30.0 * len(words[0]) / F.length("name") + 0.5)).when(every, 15.0).when(some, 10.0).otherwise(0.0)


@query("s07_rescored", f"""SELECT id, round(score + kind_bonus + path_bonus + bonus, 6) AS total FROM (SELECT bm.id, bm.score,
  CASE n.kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in X.KIND_WEIGHTS.items())} ELSE 0 END AS kind_bonus,
  CASE WHEN regexp_matches(n.file_path, '{X.TEST_PATH}') THEN -15 ELSE 0 END + CASE WHEN contains(lower(regexp_extract(n.file_path, '[^/]*$')), 'walk') THEN 10 WHEN contains(lower(n.file_path), 'walk') THEN 3 ELSE 0 END AS path_bonus,
  CASE WHEN lower(n.name) = 'walkcachequeue' THEN 80 WHEN lower(n.name) IN ('walk', 'cache', 'queue') THEN 60 WHEN starts_with(lower(n.name), 'walk') THEN 10 + floor(30.0 * 4 / length(n.name) + 0.5) WHEN contains(lower(n.name), 'walk') AND contains(lower(n.name), 'cache') AND contains(lower(n.name), 'queue') THEN 15 WHEN contains(lower(n.name), 'walk') OR contains(lower(n.name), 'cache') OR contains(lower(n.name), 'queue') THEN 10 ELSE 0 END AS bonus
  FROM bm JOIN n ON n.id = bm.id) ORDER BY total DESC, id LIMIT 50""", _BM25)
def rescored(g, limit: int = 50):
    """BM25 with bonuses for kind, path and name; tests are put back."""
    words = list(TERMS)
    path = F.when(X.is_test_path(F.col("file_path")), -15).otherwise(0) + F.when(F.lower(X.basename(F.col("file_path"))).contains(words[0]), 10).when(F.lower("file_path").contains(words[0]), 3).otherwise(0)
    rows = bm25(g.nodes, words).join(g.nodes.select("id", "kind", "name", "file_path"), "id")
    total = F.round(F.col("score") + X.kind_weight(F.col("kind")) + path + name_bonus(words), 6)
    return rows.select("id", total.alias("total")).orderBy(F.desc("total"), "id").limit(limit)


@query("s12_name_substring", "SELECT id, name FROM n WHERE contains(lower(name), 'queue') AND NOT starts_with(lower(name), 'queue') ORDER BY length(name), name, id LIMIT 40")
def name_substring(g, text: str = "queue", limit: int = 40):
    low = F.lower("name")
    return g.nodes.where(low.contains(text) & ~low.startswith(text)).orderBy(F.length("name"), "name", "id").limit(limit).select("id", "name")


@query("s13_segment_matches", f"SELECT segment, name FROM (SELECT *, count(*) OVER (PARTITION BY segment) AS n_names FROM (SELECT name, unnest({X.segment_sql('name')}) AS segment FROM (SELECT DISTINCT name FROM n WHERE kind NOT IN ('file', 'import')))) WHERE length(segment) >= 5 AND n_names BETWEEN 2 AND 25")
def segment_matches(g, least: int = 2, most: int = 25):
    """Words of five letters and more that stand in few names, with those names."""
    rows = vocabulary(g)
    few = rows.groupBy("segment").agg(count_rows().alias("n")).where((F.col("n").between(least, most)) & (F.length("segment") >= 5)).select("segment")
    return rows.join(few, "segment", "left_semi").select("segment", "name")


@query("w04_cap_per_file", "SELECT id, file_path FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY coalesce(end_line - start_line, 0) DESC, id) AS rank FROM n WHERE kind IN ('function', 'method')) WHERE rank <= 5")
def cap_per_file(g, cap: int = 5):
    """The five longest functions of each file."""
    order = Window.partitionBy("file_path").orderBy(F.desc(F.coalesce(F.col("end_line") - F.col("start_line"), F.lit(0))), "id")
    return g.nodes.where("kind in ('function', 'method')").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("id", "file_path")


@query("w05_search_rank", "SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY CASE WHEN lower(name) = 'walk' THEN 0 WHEN starts_with(lower(name), 'walk') THEN 1 ELSE 2 END, regexp_matches(file_path, '" + X.TEST_PATH + "'), length(name), file_path, start_line, id) AS rank FROM n WHERE contains(lower(name), 'walk')) WHERE rank <= 40")
def search_rank(g, text: str = "walk", limit: int = 40):
    match = F.when(F.lower("name") == text, 0).when(F.lower("name").startswith(text), 1).otherwise(2)
    top = g.nodes.where(F.lower("name").contains(text)).orderBy(match, X.is_test_path(F.col("file_path")), F.length("name"), "file_path", "start_line", "id").limit(limit)
    order = Window.orderBy(match, X.is_test_path(F.col("file_path")), F.length("name"), "file_path", "start_line", "id")
    return top.withColumn("rank", F.row_number().over(order)).select("id", "rank")


@query("x07_path_proximity", "SELECT path, other, least(80, 15 * (len(list_filter(range(1, least(len(string_split(path, '/')), len(string_split(other, '/')))::BIGINT), lambda i: array_to_string(list_slice(string_split(path, '/'), 1, i), '/') = array_to_string(list_slice(string_split(other, '/'), 1, i), '/')))))::INTEGER AS proximity FROM (SELECT DISTINCT s_file AS path, t_file AS other FROM x WHERE kind = 'imports' AND s_file <> t_file)")
def path_proximity(g):
    pairs = g.located().where("kind = 'imports' and s_file_path <> t_file_path").select(F.col("s_file_path").alias("path"), F.col("t_file_path").alias("other")).distinct()
    return pairs.withColumn("proximity", X.proximity(F.col("path"), F.col("other")).cast("int"))


@query("u07_name_overlap", f"SELECT a.name AS name, b.name AS other, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM sets a JOIN sets b ON a.owner = b.owner AND a.name < b.name WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) >= 0.5", f"sets AS (SELECT DISTINCT x.source AS owner, x.t_name AS name, {X.segment_sql('x.t_name')} AS s FROM x WHERE x.kind = 'contains' AND x.s_kind = 'class')")
def name_overlap(g, least: float = 0.5):
    """Members of one class whose names share half of their words."""
    members = g.located("name", "kind").where("kind = 'contains' and s_kind = 'class'").select(F.col("source").alias("owner"), F.col("t_name").alias("name")).distinct().withColumn("s", X.segments(F.col("name")))
    # Names that share half of all their words share one of the rarest of each: those looked up, not all pairs of a class.
    words = members.select("owner", "name", "s", F.explode("s").alias("word"))
    common = words.groupBy("word").agg(count_rows().alias("c"))
    rank = F.row_number().over(Window.partitionBy("owner", "name").orderBy("c", "word"))
    rare = words.join(common, "word").withColumn("rank", rank).where(F.col("rank") <= F.size("s") - F.ceil(least * F.size("s")) + 1).select("owner", "name", "s", "word")
    other = rare.select("owner", "word", F.col("name").alias("other"), F.col("s").alias("o"))
    pairs = rare.join(other, ["owner", "word"]).where("name < other").select("owner", "name", "s", "other", "o").distinct()
    jaccard = F.size(F.array_intersect("s", "o")) / F.size(F.array_union("s", "o"))
    return pairs.withColumn("jaccard", jaccard).where(F.col("jaccard") >= least).select("name", "other", F.round("jaccard", 6).alias("jaccard"))
