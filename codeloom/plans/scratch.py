"""Scratch tables in the folder that all executors share.

Iterative operators cut their lineage by writing a round's result as Parquet below
``spark.checkpoint.dir`` and reading it back: columnar, compressed, with known sizes
for the planner, and safe when executors are lost. A folder of our own is made only
where the setting is missing (tests, local sessions).
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only where none is set."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_code.isDefined():
        return set_by_code.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="codeloom-")
        atexit.register(__import__("shutil").rmtree, _OWN_DIR, ignore_errors=True)
    return f"file://{_OWN_DIR}"


class Scratch:
    """Named scratch tables of one operator run.

    ``spool`` writes a DataFrame and returns it read back. ``drop`` deletes one that no
    later plan reads; what is left lives as long as the result that reads it and goes
    when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.clear)

    def spool(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.mode("overwrite").parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = path
        back._codeloom_path = path
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            path = getattr(df, "_codeloom_path", None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended
            pass
