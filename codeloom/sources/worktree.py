"""The files that version control knows, read from its index, without running it."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def index_entries(data: bytes) -> Iterator[tuple[str, str, int, int]]:
    """(path, hash of the content, size, modified second) of an index file of version 2 to 4; entries of merge stages count once."""
    if data[:4] != b"DIRC":
        raise ValueError("no index file")
    version, count = struct.unpack(">II", data[4:12])
    if version not in (2, 3, 4):
        raise ValueError(f"version {version} of the index file")
    at, last, seen = 12, b"", set()
    for _ in range(count):
        start = at
        modified = struct.unpack(">I", data[at + 8 : at + 12])[0]
        size = struct.unpack(">I", data[at + 36 : at + 40])[0]
        digest = data[at + 40 : at + 60].hex()
        flags = struct.unpack(">H", data[at + 60 : at + 62])[0]
        at += 64 if version > 2 and flags & 0x4000 else 62
        if version == 4:
            drop = 0
            first = True
            while True:  # how much of the last path goes, in sevens of bits
                byte = data[at]
                at += 1
                drop = (byte & 0x7F) if first else ((drop + 1) << 7) | (byte & 0x7F)
                first = False
                if not byte & 0x80:
                    break
            end = data.index(b"\0", at)
            last = last[: len(last) - drop] + data[at:end]
            at = end + 1
        else:
            end = data.index(b"\0", at)
            last = data[at:end]
            at = start + (end - start + 8) // 8 * 8
        path = last.decode("utf-8", "replace")
        if path not in seen:
            seen.add(path)
            yield path, digest, size, modified


def tracked_files(spark: SparkSession, *copies: str) -> DataFrame:
    """copy, path, content_hash, size, modified_at of the tracked files of working copies, each given by its folder."""
    # Named one by one: a listing leaves hidden folders out.
    raw = spark.read.format("binaryFile").load([f"{c.rstrip('/')}/.git/index" for c in copies]).select("path", "content")
    arrow = pa.schema([("copy", pa.string()), ("path", pa.string()), ("content_hash", pa.string()), ("size", pa.int64()), ("modified_at", pa.int64())])

    def run(batches):
        for batch in batches:
            for path, content in zip(*(batch.column(i).to_pylist() for i in range(2))):
                copy = path.removesuffix("/.git/index").rsplit("/", 1)[-1]
                rows = [(copy, p, h, s, m * 1000) for p, h, s, m in index_entries(content)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return raw.mapInArrow(run, "copy string, path string, content_hash string, size long, modified_at long")
