"""Parquet table access.

Every operator projects the columns it needs straight after the scan, so extra
columns of any name never reach a join, and Parquet reads only those columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a dataset directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def norm_kind(col: Column) -> Column:
    """A kind as it is compared: trimmed of white space, lower case; null stays null."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))
