"""The queries p1_ and p2_ over the driver's tables, with their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.hierarchy import hierarchy
from codeloom.operators.skew import skewed_key_counts
from codeloom.plans.scratch import Scratch
from codeloom.sources.tables import norm_kind, table

HEAVY_SHARE = 0.01


def contains_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct ``contains`` pairs whose two ends occur as nodes.id."""
    ids = table(spark, sf_dir, "nodes").select("id").where("id is not null")
    pairs = table(spark, sf_dir, "edges").where(norm_kind(F.col("kind")) == "contains").select("source", "target")
    pairs = pairs.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return pairs.join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def _p1(what: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return hierarchy(contains_links(spark, sf_dir), Scratch(spark, f"p1_{what}"), what)

    return query


def p1_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _p1("paths")(spark, sf_dir)
    return rows.select("node_id", "root_id", "tree_depth", F.concat_ws("/", "path").alias("path"))


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links inside a strongly connected part with source >= target: every cycle has one, whatever the size."""
    return _p1("cycles")(spark, sf_dir)


def _edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "edges").select("target", norm_kind(F.col("kind")).alias("kind"), "source")


def p2_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = skewed_key_counts(_edge_keys(spark, sf_dir), "target", "kind", "source")
    return counts.select("target", "kind", F.col("n_rows").alias("n_edges"), F.col("n_distinct").alias("n_sources"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = skewed_key_counts(_edge_keys(spark, sf_dir), "target", "kind", "source")
    total = table(spark, sf_dir, "edges").count()  # from the Parquet footers
    return counts.where(F.col("n_rows") >= HEAVY_SHARE * total).select("target", "kind")


QUERIES = {"p1_found": _p1("roots"), "p1_paths": p1_paths, "p1_descendants": _p1("descendants"), "p1_cycles": p1_cycles, "p2_found": p2_found, "p2_key_counts": p2_key_counts}

_LINKS = """
links AS (
  SELECT DISTINCT source, target FROM edges
  WHERE lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')) = 'contains'
    AND source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes)),
ends AS (SELECT source AS id FROM links UNION SELECT target FROM links),
way AS (SELECT source AS a, target AS b FROM links UNION SELECT way.a, links.target FROM way JOIN links ON way.b = links.source),
looped AS (SELECT a AS id FROM way WHERE a = b),
bad AS (SELECT id FROM looped UNION SELECT b FROM way WHERE a IN (SELECT id FROM looped))"""
_P1 = f"""WITH RECURSIVE {_LINKS},
walk AS (
  SELECT id AS node_id, id AS root_id, 0 AS d FROM ends WHERE id NOT IN (SELECT target FROM links)
  UNION SELECT links.target, walk.root_id, walk.d + 1 FROM walk JOIN links ON links.source = walk.node_id
  WHERE links.target NOT IN (SELECT id FROM bad))
"""
_KINDS = "SELECT target, lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g')) AS kind, count(*) AS n_edges, count(DISTINCT source) AS n_sources FROM edges GROUP BY 1, 2"
ORACLE = {
    "p1_found": _P1 + "SELECT node_id, root_id, CAST(min(d) AS INTEGER) AS tree_depth FROM walk GROUP BY ALL UNION ALL SELECT id, '', -1 FROM bad",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS},
down AS (SELECT source AS node_id, target AS descendant_id, 1 AS d FROM links WHERE source NOT IN (SELECT id FROM bad) AND target NOT IN (SELECT id FROM bad)
  UNION SELECT down.node_id, links.target, down.d + 1 FROM down JOIN links ON links.source = down.descendant_id WHERE links.target NOT IN (SELECT id FROM bad))
SELECT node_id, descendant_id, CAST(min(d) AS INTEGER) AS distance FROM down GROUP BY ALL""",
    "p1_paths": f"""WITH RECURSIVE {_LINKS},
walk AS (
  SELECT id AS node_id, id AS root_id, 0 AS d, [id] AS path FROM ends WHERE id NOT IN (SELECT target FROM links)
  UNION SELECT links.target, walk.root_id, walk.d + 1, list_append(walk.path, links.target) FROM walk JOIN links ON links.source = walk.node_id
  WHERE links.target NOT IN (SELECT id FROM bad)),
best AS (SELECT *, row_number() OVER (PARTITION BY node_id, root_id ORDER BY d, path) AS r FROM walk)
SELECT node_id, root_id, CAST(d AS INTEGER) AS tree_depth, array_to_string(path, '/') AS path FROM best WHERE r = 1
UNION ALL SELECT id, '', -1, '' FROM bad""",
    "p2_key_counts": _KINDS,
    "p2_found": f"SELECT target, kind FROM ({_KINDS}) WHERE n_edges >= 0.01 * (SELECT count(*) FROM edges)",
}
