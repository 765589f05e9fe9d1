"""Session helpers shared by operators: settings, checkpoint folder, hot keys."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def build_session(app: str = "evidra", master: str = "local[8]", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings every operator assumes (UTC, AQE)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("EVIDRA_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder comes from ``spark.checkpoint.dir``. Only a session with a local master
    (tests, a laptop) that names none gets a temporary folder; on a cluster that is an
    error, since a folder of one machine is lost with it.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="evidra-ckpt-"))


def saved(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot when it holds more than this share of the rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 0.002
#: A hot key is spread over so many join partitions.
HOT_SALTS = 32


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of all rows of ``df``: at most ``1 / share`` rows.

    The counts are combined on the map side; the bound on the result holds for
    any data, which is what makes it safe to broadcast.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_all"))
    return counts.where(F.col("_n") > total.scalar() * F.lit(share) + 100).select(key)


def salted_left_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Left join on ``key`` that spreads the hot keys of ``left`` over salts.

    ``right`` must be unique on ``key``; only its rows for hot keys are repeated,
    ``HOT_SALTS`` times each. The broadcast table has at most ``1 / HOT_SHARE`` rows; the caller may give it
    (as ``hot_keys`` gives it, of the rows that make ``left``) where counting ``left`` would compute it twice.
    """
    hot = F.broadcast((hot_keys(left, key) if hot is None else hot).withColumn("_hot", F.lit(True)))
    salts = F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))
    other = [c for c in left.columns if c != key]
    left = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*other), F.lit(HOT_SALTS))).otherwise(F.lit(0)).cast("int")
    )
    right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), salts).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
    )
    return left.drop("_hot").join(right, [key, "_salt"], "left").drop("_salt")


def running_total(df: DataFrame, by: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its ``by`` group up to it in ``order``.

    Rows are split into ranges of the order, so a group of any size spreads over all tasks; each range adds the sum of
    those before it, which are a row per group and range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_"))
    keyed = df.withColumn("_k", key).withColumn("_v", value)
    ranged = saved(keyed.repartitionByRange(parts, "_k", *order).withColumn("_part", F.spark_partition_id()))
    before = W.partitionBy("_k").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = ranged.groupBy("_k", "_part").agg(F.sum("_v").alias("_s")).select("_k", "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    own = W.partitionBy("_k", "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return ranged.join(sums, ["_k", "_part"]).withColumn(name, F.col("_off") + F.sum("_v").over(own)).drop("_k", "_v", "_part", "_off")
