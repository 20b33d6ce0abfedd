"""Shared pieces of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows in an Arrow batch of texts: a batch of texts of 1 MiB stays far below a worker's memory.
BATCH_ROWS = 256


def map_rows(df: DataFrame, function: Callable[..., Iterator[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Rows that ``function(*columns of one row)`` yields, for every row of ``df``.

    Works batch by batch over Arrow, without pandas; batches hold few rows, as texts may be long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # short-lived syntax trees and token lists; nothing here makes reference cycles that last
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    out.extend(function(*row))
                if len(out) >= 2000:
                    yield _batch(out, arrow)
                    out = []
            gc.collect(0)
        if out:
            yield _batch(out, arrow)

    return df.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
