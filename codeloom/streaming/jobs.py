"""Streaming jobs: change debouncing, usage counters and incremental sync.

Every job has a form over any streaming DataFrame; the queries run it over a table's file as a
stream that ends when the file is read (availableNow), so their results can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.operators.store import GraphStore, current_files, with_sql
from codeloom.plans.scratch import Scratch, shared_dir
from codeloom.sources.tables import table

QUIET_GAP = "30 minutes"
LATENESS = "1 day"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*")


def drained(stream: DataFrame, scratch: Scratch, mode: str = "complete") -> DataFrame:
    """What a stream gives when all there is has been read: the last whole result, or all rows appended."""
    spark, kept = stream.sparkSession, []

    def keep(batch: DataFrame, epoch: int) -> None:
        saved = scratch.spool(batch)
        if mode == "complete":
            kept[:] = [saved]
        else:
            kept.append(saved)

    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{scratch.root}/progress").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    if not kept:
        return spark.createDataFrame([], stream.schema)
    out = kept[0]
    for part in kept[1:]:
        out = out.unionByName(part)
    return out


def sessions(events: DataFrame, gap: str = QUIET_GAP) -> DataFrame:
    """Changes of one key with no quiet gap between them, folded: the debounce of a watcher."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)
    folded = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return folded.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("first_ts"), "n_events")


def usage_counters(events: DataFrame) -> DataFrame:
    """Running totals per key, by a state that survives batches; one row per key and batch."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for part in parts:
            n, total = n + len(part), total + float(part["value"].fillna(0).sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n_events": [n], "total": [round(total, 4)]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, n_events long, total double", "n long, total double", "update", GroupStateTimeout.NoTimeout)


def t02_pending_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last change and the number of changes of each path, from the stream of file rows."""
    changes = table_stream(spark, sf_dir, "files").where("path is not null")
    folded = changes.groupBy("path").agg(F.min("indexed_at").alias("first_seen"), F.max("indexed_at").alias("last_seen"), F.count(F.lit(1)).alias("n_changes"))
    return drained(folded, Scratch(spark, "t02"))


def t03_debounced_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(sessions(table_stream(spark, sf_dir, "events")), Scratch(spark, "t03"))


SYNC_BUCKETS = 64


class BucketedTable:
    """A table of current rows in buckets of its key, each the rows of one folder: a batch writes anew only the buckets it touches."""

    def __init__(self, scratch: Scratch, key: str, newest: Callable[[DataFrame], DataFrame], buckets: int = SYNC_BUCKETS) -> None:
        self.scratch, self.key, self.newest, self.buckets = scratch, key, newest, buckets
        self.parts: dict[int, DataFrame] = {}

    def merge(self, batch: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        fresh = self.newest(batch).withColumn("bucket", bucket)
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        rows = self.newest(fresh.drop("bucket").unionByName(old.drop("bucket"))) if (old := self._read(touched)) is not None else fresh.drop("bucket")
        written = self.scratch.spool(rows.withColumn("bucket", bucket))
        self.parts |= dict.fromkeys(touched, written)

    def _read(self, wanted: list[int]) -> DataFrame | None:
        held: dict[int, tuple[DataFrame, list[int]]] = {}
        for b in wanted:
            if b in self.parts:
                held.setdefault(id(self.parts[b]), (self.parts[b], []))[1].append(b)
        out = None
        for df, own in held.values():
            part = df.where(F.col("bucket").isin(own))
            out = part if out is None else out.unionByName(part)
        return out

    def rows(self) -> DataFrame | None:
        out = self._read(sorted(self.parts))
        return None if out is None else out.drop("bucket")


def t05_incremental_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files table built by upserts of micro-batches: the same as a full rebuild."""
    scratch = Scratch(spark, "t05")
    kept = BucketedTable(scratch, "path", current_files)
    rows = table(spark, sf_dir, "files")
    half = rows.withColumn("part", F.pmod(F.xxhash64("path", "indexed_at"), F.lit(2)))
    arrivals = f"{shared_dir(spark)}/{scratch.root.rsplit('/', 1)[-1]}-arrivals"
    half.write.partitionBy("part").parquet(arrivals)
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "2").parquet(arrivals)
    run = stream.writeStream.option("checkpointLocation", f"{scratch.root}/progress").foreachBatch(lambda batch, epoch: kept.merge(batch)).trigger(availableNow=True).start()
    run.awaitTermination()
    scratch._delete(arrivals)
    done = kept.rows()
    return (current_files(rows) if done is None else done).select("path", "content_hash", "indexed_at")


def watch(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """A stream of the files that appear below a folder or change: path, modificationTime, length, content."""
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def t08_reopened_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges to open again as definitions of their target's name came or went between two states of the nodes, split at the median time."""
    g = GraphStore(spark, sf_dir)
    cut = g.nodes.agg(F.median("updated_at")).first()[0] or 0
    named = g.nodes.select("file_path", "name", (F.col("updated_at") > cut).alias("late")).distinct()
    both = named.groupBy("file_path", "name").agg(F.bool_or("late").alias("late"), F.bool_or(~F.col("late")).alias("early"))
    names = both.where("late <> early").select(F.col("name").alias("t_name")).distinct()
    edges = g.located("name").where("kind <> 'contains' and coalesce(provenance, '') <> 'heuristic'")
    return edges.join(names, "t_name", "left_semi").select("source", "target", "kind", "line", "col")


def t09_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes gathered into one message an hour: how many files, and whether more than 200 leave the list out."""
    changes = table_stream(spark, sf_dir, "files").where("path is not null")
    hour = F.floor(F.col("indexed_at") / 3_600_000).alias("hour")
    folded = changes.groupBy(hour).agg(F.count(F.lit(1)).alias("n_changes"))
    return drained(folded, Scratch(spark, "t09")).withColumn("listed", F.col("n_changes") <= 200)


def t11_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a path that say the same, folded in the stream."""
    changes = table_stream(spark, sf_dir, "files").where("path is not null").select("path", "indexed_at", "content_hash")
    return drained(changes.dropDuplicates(), Scratch(spark, "t11"), "append")


def t06_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracked files against the texts that are there: added, removed, modified, same."""
    tracked = current_files(table(spark, sf_dir, "files")).select("path", "content_hash")
    there = table(spark, sf_dir, "source_files").where("path is not null").groupBy("path").agg(F.max(F.sha2("content", 256)).alias("now"))
    both = tracked.join(there, "path", "full")
    change = F.when(F.col("content_hash").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("content_hash"), "modified").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n_files"))


def t10_usage_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per user after the stream: the last of each user's rows."""
    rows = drained(usage_counters(table_stream(spark, sf_dir, "events").select("user_id", "value")), Scratch(spark, "t10"), "update")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("n_events", "total"), "n_events").alias("r")).select("user_id", "r.n_events", F.round("r.total", 2).alias("total"))


def w10_counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of a counter from row to row; a fall is a reset and counts as a new start."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").withColumn("before", F.lag("value").over(order))
    delta = F.when(F.col("before").isNull() | (F.col("value") < F.col("before")), F.col("value")).otherwise(F.col("value") - F.col("before"))
    return rows.select("event_id", F.round(delta, 4).alias("delta"))


QUERIES = {f.__name__: f for f in (t02_pending_changes, t03_debounced_sessions, t05_incremental_sync, t08_reopened_edges, t09_change_events, t11_duplicates, t06_reconciliation, t10_usage_counters, w10_counter_deltas)}
ORACLE = {
    "t08_reopened_edges": with_sql("SELECT source, target, kind, line, col FROM x WHERE kind <> 'contains' AND coalesce(provenance, '') <> 'heuristic' AND t_name IN (SELECT name FROM (SELECT file_path, name, bool_or(updated_at > (SELECT median(updated_at) FROM n)) AS late, bool_or(updated_at <= (SELECT median(updated_at) FROM n)) AS early FROM n GROUP BY file_path, name) WHERE late <> early)"),
    "t09_change_events": "SELECT indexed_at // 3600000 AS hour, count(*) AS n_changes, count(*) <= 200 AS listed FROM files WHERE path IS NOT NULL GROUP BY 1",
    "t11_duplicates": "SELECT DISTINCT path, indexed_at, content_hash FROM files WHERE path IS NOT NULL",
    "t02_pending_changes": "SELECT path, min(indexed_at) AS first_seen, max(indexed_at) AS last_seen, count(*) AS n_changes FROM files WHERE path IS NOT NULL GROUP BY path",
    "t03_debounced_sessions": "SELECT user_id, min(ts) AS first_ts, count(*) AS n_events FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE ts IS NOT NULL)) GROUP BY user_id, s",
    "t05_incremental_sync": "SELECT path, content_hash, indexed_at FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1",
    "t06_reconciliation": "SELECT change, count(*) AS n_files FROM (SELECT CASE WHEN f.content_hash IS NULL THEN 'added' WHEN s.now IS NULL THEN 'removed' WHEN s.now <> f.content_hash THEN 'modified' ELSE 'same' END AS change FROM (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1) f FULL JOIN (SELECT path, max(sha256(content)) AS now FROM source_files WHERE path IS NOT NULL GROUP BY path) s ON s.path = f.path) GROUP BY change",
    "t10_usage_counters": "SELECT user_id, count(*) AS n_events, round(sum(coalesce(value, 0)), 2) AS total FROM events GROUP BY user_id",
    "w10_counter_deltas": "SELECT event_id, round(CASE WHEN before IS NULL OR value < before THEN value ELSE value - before END, 4) AS delta FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)",
}
