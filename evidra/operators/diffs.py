"""Differences between snapshots of files, and unified diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_files(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, status`` of files that differ by ``hash``: A, D or M. Rows must be unique on the keys; null hashes are values."""
    a = old.select(*keys, F.col("hash").alias("_old"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col("hash").alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "A").when(F.col("_b").isNull(), "D").when(~F.col("_old").eqNullSafe(F.col("_new")), "M")
    return a.join(b, keys, "full").select(*keys, status.alias("status")).where("status is not null")


def renames(changes: DataFrame, old: DataFrame, new: DataFrame, within: str, name: str) -> DataFrame:
    """Added files whose content was that of a removed file of the same ``within``: ``within, old_name, new_name``; the least old name wins."""
    gone = changes.where("status = 'D'").join(old.select(within, name, "hash"), [within, name]).where("hash is not null")
    came = changes.where("status = 'A'").join(new.select(within, name, "hash"), [within, name]).where("hash is not null")
    one = gone.groupBy(within, "hash").agg(F.min(name).alias("old_name"))
    return came.select(within, "hash", F.col(name).alias("new_name")).join(one, [within, "hash"]).select(within, "old_name", "new_name")


def line_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Added and removed lines of each file as multisets: ``keys, added, removed``; files without a difference give no row."""

    def counted(df: DataFrame, sign: int) -> DataFrame:
        lines = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n")
        return df.select(*keys, F.explode(lines).alias("line")).groupBy(*keys, F.xxhash64("line").alias("line")).agg((F.count("*") * sign).alias("n"))

    both = counted(old, -1).unionByName(counted(new, 1)).groupBy(*keys, "line").agg(F.sum("n").alias("n")).where("n != 0")
    return both.groupBy(*keys).agg(F.sum(F.greatest("n", F.lit(0))).alias("added"), F.sum(F.greatest(-F.col("n"), F.lit(0))).alias("removed"))


def hunks(diffs: DataFrame) -> DataFrame:
    """``id, hunk, new_start, added, removed`` of unified diffs (``id, diff``).

    A header starts a hunk; lines before the first header and file headers aren't counted. The
    lines of a diff stay in one array, so hunks are numbered without a shuffle.
    """
    lines = F.filter(F.split(F.regexp_replace("diff", "\r\n?", "\n"), "\n"), lambda x: ~x.rlike(r"^(---|\+\+\+) "))
    text = F.array_join(lines, "\n")
    parts = F.slice(F.split(F.concat(F.lit("\n"), text), r"\n(?=@@ )"), 2, 1_000_000_000)
    rows = diffs.where(F.col("diff").isNotNull()).select("id", F.posexplode(parts).alias("hunk", "body"))
    count = lambda sign: F.size(F.filter(F.split("body", "\n"), lambda x: x.startswith(sign)))
    return rows.select("id", "hunk", F.regexp_extract("body", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).try_cast("int").alias("new_start"), count("+").alias("added"), count("-").alias("removed"))


def limited(files: DataFrame, by: str, order: list[str], most_files: int, most_bytes: int) -> DataFrame:
    """Per group what a listing with limits gives: files taken, those that are too large, whether there were more, and a status."""
    from pyspark.sql import Window as W

    rows = files.withColumn("_n", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    taken = F.col("_n") <= most_files
    large = F.coalesce(F.col("size_bytes") > most_bytes, F.lit(False))
    more = F.max("_n") > most_files
    return rows.groupBy(by).agg(
        F.count_if(taken & ~large).alias("n_files"), F.count_if(taken & large).alias("n_too_large"), more.alias("truncated"), F.when(more, "limit_exceeded").otherwise("success").alias("status")
    )


def changed_with_stats(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, status, added, removed`` of files that differ by ``hash``; files without line statistics (no content) have 0 of both."""
    stats = line_changes(old.where("content is not null"), new.where("content is not null"), keys)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return changed_files(old, new, keys).join(stats, keys, "left").select(*keys, "status", zero("added"), zero("removed"))
