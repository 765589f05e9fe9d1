"""Parquet tables of one input folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; columns are pruned and filters pushed by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blankless(col: Column | str) -> Column:
    """The text without surrounding white space of any script (null stays null).

    Most texts begin and end with visible ASCII: they are taken as they are, without a pattern.
    """
    col = F.col(col) if isinstance(col, str) else col
    visible = lambda c: c.between("!", "~")
    plain = visible(F.substring(col, 1, 1)) & visible(F.substring(col, -1, 1))
    return F.when(plain, col).otherwise(F.regexp_replace(col, r"(?U)^[\s\u200b\ufeff]+|[\s\u200b\ufeff]+$", ""))
