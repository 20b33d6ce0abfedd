"""The graph's tables in their clean form, and the changes to them.

nodes: rows without id, kind, name, file or language are ignored, the greatest updated_at of an
id counts. edges: both ends must be nodes; of rows with one identity (source, target, kind, line,
col) the least metadata and provenance stay. files: the greatest indexed_at of a path counts.
Kinds are trimmed and in lower case. Malformed metadata is no metadata.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.scalars import name_tail
from codeloom.sources.tables import norm_kind, table

NODE_COLUMNS = "kind name qualified_name file_path language start_line end_line start_column end_column docstring signature visibility is_exported is_async is_static is_abstract decorators return_type updated_at".split()


class GraphStore:
    """The clean tables of one dataset."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def nodes(self) -> DataFrame:
        return current_nodes(self.raw("nodes"))

    @cached_property
    def links(self) -> DataFrame:
        """Edges of one identity once, whether or not their ends are nodes."""
        return distinct_edges(self.raw("edges"))

    @cached_property
    def edges(self) -> DataFrame:
        return clean_edges(self.raw("edges"), self.raw("nodes"))

    @cached_property
    def files(self) -> DataFrame:
        return current_files(self.raw("files"))

    @cached_property
    def refs(self) -> DataFrame:
        return self.raw("unresolved_refs").distinct()

    def located(self, *columns: str) -> DataFrame:
        """Edges with the nodes at both ends; columns of ends get the prefixes s_ and t_."""
        columns = columns or ("file_path",)
        s = self.nodes.select(F.col("id").alias("source"), *(F.col(c).alias(f"s_{c}") for c in columns))
        t = self.nodes.select(F.col("id").alias("target"), *(F.col(c).alias(f"t_{c}") for c in columns))
        return self.links.join(s, "source").join(t, "target")


def usable_nodes(nodes: DataFrame) -> DataFrame:
    """Rows that make a node."""
    return nodes.where("id is not null and kind is not null and name is not null and file_path is not null and language is not null")


def current_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id. An aggregate per column: those that no later step asks for are neither read nor moved.

    All of them keep the value of the same row, as they compare the same updated_at in the same order.
    """
    good = usable_nodes(nodes).withColumn("kind", norm_kind(F.col("kind"))).withColumn("qualified_name", F.coalesce("qualified_name", "name"))
    return good.groupBy("id").agg(*(F.max_by(c, "updated_at").alias(c) for c in NODE_COLUMNS))


def distinct_edges(edges: DataFrame) -> DataFrame:
    rows = edges.select("source", "target", norm_kind(F.col("kind")).alias("kind"), "line", "col", "metadata", "provenance").where("source is not null and target is not null and kind is not null")
    first = rows.groupBy("source", "target", "kind", F.coalesce("line", F.lit(-1)).alias("l"), F.coalesce("col", F.lit(-1)).alias("c")).agg(F.min(F.struct("metadata", "provenance")).alias("m"))
    data = F.try_parse_json("metadata")
    first = first.select("source", "target", "kind", F.when(F.col("l") >= 0, F.col("l")).alias("line"), F.when(F.col("c") >= 0, F.col("c")).alias("col"), "m.metadata", "m.provenance")
    return first.withColumn("confidence", F.try_variant_get(data, "$.confidence", "double")).withColumn("resolved_by", F.try_variant_get(data, "$.resolvedBy", "string"))


def clean_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges between nodes. Ends are looked up among the rows of ``nodes`` as they stand: a semi join needs no distinct ids."""
    ids = usable_nodes(nodes).select("id")
    return distinct_edges(edges).join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def current_files(files: DataFrame) -> DataFrame:
    rows = files.where("path is not null").withColumn("language", F.lower("language"))
    columns = ("content_hash", "language", "size", "modified_at", "indexed_at", "node_count", "generated")
    return rows.groupBy("path").agg(*(F.max_by(c, "indexed_at").alias(c) for c in columns))


def delete_files(store: GraphStore, paths: DataFrame) -> dict[str, DataFrame]:
    """All four tables without the files of ``paths`` (path) and what hangs on their nodes."""
    gone = store.nodes.join(paths.withColumnRenamed("path", "file_path"), "file_path", "left_semi").select("id")
    nodes = store.nodes.join(gone, "id", "left_anti")
    edges = store.edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    refs = store.refs.join(gone.withColumnRenamed("id", "from_node_id"), "from_node_id", "left_anti")
    return {"nodes": nodes, "edges": edges, "refs": refs, "files": store.files.join(paths, "path", "left_anti")}


def upsert(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those with the same key."""
    return current.join(changes.select(key), key, "left_anti").unionByName(changes)


def mark_failed(refs: DataFrame, failed: DataFrame) -> DataFrame:
    """Refs with status failed and their name tail where (from_node_id, reference_name) is in ``failed``."""
    hit = failed.select("from_node_id", "reference_name").distinct().withColumn("hit", F.lit(True))
    rows = refs.join(hit, ["from_node_id", "reference_name"], "left")
    return rows.withColumn("name_tail", F.when(F.col("hit"), name_tail(F.col("reference_name"))).otherwise(F.col("name_tail"))).withColumn("status", F.when(F.col("hit"), "failed").otherwise(F.col("status"))).drop("hit")


def reopened_refs(edges: DataFrame) -> DataFrame:
    """Resolution edges as references again, where metadata keeps how they were resolved."""
    return edges.where("resolved_by is not null").select(F.col("source").alias("from_node_id"), "target", F.col("kind").alias("reference_kind"), "line", "col")


_TRIM = "lower(regexp_replace(kind, '^\\s+|\\s+$', '', 'g'))"
SQL = f"""
n AS (SELECT * REPLACE ({_TRIM} AS kind, coalesce(qualified_name, name) AS qualified_name) FROM nodes
  WHERE id IS NOT NULL AND kind IS NOT NULL AND name IS NOT NULL AND file_path IS NOT NULL AND language IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1),
e AS (SELECT source, target, {_TRIM} AS kind, line, col, metadata, provenance,
  CASE WHEN json_valid(metadata) THEN TRY_CAST(json_extract_string(metadata, '$.confidence') AS DOUBLE) END AS confidence,
  CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.resolvedBy') END AS resolved_by
  FROM edges WHERE kind IS NOT NULL AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n)
  QUALIFY row_number() OVER (PARTITION BY source, target, {_TRIM}, coalesce(line, -1), coalesce(col, -1) ORDER BY metadata NULLS FIRST, provenance NULLS FIRST) = 1),
f AS (SELECT * REPLACE (lower(language) AS language) FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1),
r AS (SELECT DISTINCT * FROM unresolved_refs),
x AS (SELECT e.*, a.file_path AS s_file, b.file_path AS t_file, a.name AS s_name, b.name AS t_name, a.kind AS s_kind, b.kind AS t_kind FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target)
"""


def with_sql(text: str, recursive: bool = False, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{SQL}{', ' + more if more else ''} {text}"
