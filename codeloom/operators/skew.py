"""Per-key results where a few keys hold most rows.

Method: range partitioning on the composite key followed by a secondary order, whose
bounds are sampled quantiles, so a heavy key is cut across as many partitions as its share
asks for; each task folds its sorted run into partial states, one per key it meets; the
states that a bound cut apart are stitched by the least and greatest secondary value.

Ties on key and secondary order are cut too, by a row ordinal as the last order column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATE = pa.schema([("part", pa.int32()), ("k1", pa.string()), ("k2", pa.string()), ("n_rows", pa.int64()), ("n_distinct", pa.int64()), ("first", pa.string()), ("last", pa.string())])


def _changes(column: pa.Array) -> np.ndarray:
    """True where a row differs from the row before; nulls are equal to each other."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False) | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return np.concatenate([[True], differ])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial states of one sorted partition; the last key of a batch is carried on."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    held: list | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k1, k2, sub = batch.column(0), batch.column(1), batch.column(2)
        new_key = _changes(k1) | _changes(k2)
        new_sub = (new_key | _changes(sub)) & sub.is_valid().to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new_key)
        ends = np.append(starts[1:], batch.num_rows)
        distinct = np.add.reduceat(new_sub.astype(np.int64), starts)
        first_valid = pc.if_else(sub.is_valid(), pa.array(np.arange(batch.num_rows)), pa.scalar(None, pa.int64()))
        valid_at = np.minimum.reduceat(first_valid.fill_null(batch.num_rows).to_numpy(), starts)  # nulls sort first
        take_first = pa.array([int(v) if v < e else None for v, e in zip(valid_at, ends)], pa.int64())
        states = list(zip(k1.take(pa.array(starts)).to_pylist(), k2.take(pa.array(starts)).to_pylist(), (ends - starts).tolist(), distinct.tolist(), sub.take(take_first).to_pylist(), sub.take(pa.array(ends - 1)).to_pylist()))
        if held is not None and held[:2] == list(states[0][:2]):
            states[0] = tuple(_stitched(held, states[0]))
        elif held is not None:
            states.insert(0, tuple(held))
        held = list(states.pop())
        if states:
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(states), pa.int32()), *(pa.array(c, f.type) for c, f in zip(zip(*states), list(STATE)[1:]))], schema=STATE)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x], f.type) for x, f in zip(held, list(STATE)[1:]))], schema=STATE)


def _stitched(a, b) -> list:
    """The state of two neighbouring runs of one key."""
    both = a[5] is not None and a[5] == b[4]
    return [a[0], a[1], a[2] + b[2], a[3] + b[3] - both, a[4] if a[4] is not None else b[4], b[5] if b[5] is not None else a[5]]


def skewed_key_counts(rows: DataFrame, k1: str, k2: str, secondary: str, parts: int | None = None) -> DataFrame:
    """(k1, k2, n_rows, n_distinct) for every key: its rows and distinct non-null ``secondary``.

    A null in a key column is a key value of its own. Repeated rows count as they stand in
    n_rows and once in n_distinct. An empty input gives an empty result.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col(k1).cast("string").alias("k1"), F.col(k2).cast("string").alias("k2"), F.col(secondary).cast("string").alias("sub"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("int").alias("tie"))
    placed = rows.repartitionByRange(parts, "k1", "k2", "sub", "tie").sortWithinPartitions("k1", "k2", "sub").select("k1", "k2", "sub")
    states = placed.mapInArrow(_fold, "part int, k1 string, k2 string, n_rows long, n_distinct long, first string, last string")
    # One state per key and partition: a key has at most ``parts`` of them.
    order = Window.partitionBy("k1", "k2").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    overlap = F.coalesce((F.last("last", ignorenulls=True).over(order) == F.col("first")).cast("long"), F.lit(0))
    stitched = states.withColumn("overlap", overlap).groupBy("k1", "k2").agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_distinct") - F.sum("overlap")).alias("n_distinct"))
    return stitched.select(F.col("k1").alias(k1), F.col("k2").alias(k2), "n_rows", "n_distinct")
