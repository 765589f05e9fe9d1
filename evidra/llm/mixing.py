"""Mixing sources to target shares of all tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hash ranges per source; prefix sums run within a range, the sums of ranges are few rows.
RANGES = 1024


def _named(col: str):
    return F.lower(F.trim(F.coalesce(F.col(col), F.lit(""))))


def budgets(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: what it has, and its budget of tokens.

    A source without tokens, with a null or non-positive share or with
    ``max_repeats`` below 1 can't be drawn; the shares of the others are taken
    relative to each other. Without ``total`` the mix is the largest in which no
    source needs more than its repeats, so every share is met exactly up to one
    document; with ``total`` a source ends at its cap and the others fill their own
    budgets only.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count("*").alias("source_docs"))
    wanted = targets.select(_named("source").alias("source"), "target_share", "max_repeats").dropDuplicates(["source"])
    rows = wanted.join(have, "source", "left").withColumn(
        "usable", (F.col("target_share") > 0) & (F.col("max_repeats") >= 1) & (F.coalesce("source_tokens", F.lit(0)) > 0)
    )
    usable = rows.where("usable").agg(
        F.sum("target_share").alias("_shares"), F.min(F.col("source_tokens") * F.col("max_repeats") / F.col("target_share")).alias("_most")
    )
    rows = rows.withColumns({"_shares": usable.select("_shares").scalar(), "_most": usable.select("_most").scalar()})
    whole = F.col("_most") * F.col("_shares") if total is None else F.lit(float(total))
    goal = F.when(F.col("usable"), whole * F.col("target_share") / F.col("_shares")).otherwise(0.0)
    cap = F.when(F.col("usable"), F.col("source_tokens") * F.col("max_repeats")).otherwise(0.0)
    return rows.select(
        "source", "target_share", "max_repeats", F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        F.least(goal, cap).alias("budget"),
    )


def mix(sizes: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 17) -> DataFrame:
    """The drawn documents: ``doc_id, source, n_tokens, repeats``.

    ``sizes``: ``doc_id, source, n_tokens``, one row per document. Documents stand in
    the order of a random key within their source. Whole epochs give every document
    once; the last one is cut in that order at the rest of the budget, at the
    document whose middle passes it. Prefix sums are taken within hash ranges of a
    source and shifted by the sums of the ranges before, so no task sees a source as
    a whole. Documents without tokens are never drawn.
    """
    plan = budgets(sizes.select(_named("source").alias("source"), "n_tokens"), targets, total).where("budget > 0")
    key = F.xxhash64(F.lit(seed), "doc_id")
    docs = sizes.where("n_tokens > 0").select("doc_id", _named("source").alias("source"), "n_tokens", key.alias("_key"))
    docs = docs.withColumn("_range", F.shiftrightunsigned("_key", 54).cast("int"))
    ranges = docs.groupBy("source", "_range").agg(F.sum("n_tokens").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("source", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    # at most RANGES rows per target source, and the plan has one row per target source
    bounds = ranges.join(F.broadcast(plan.select("source", "source_tokens", "budget")), "source")
    inside = F.sum("n_tokens").over(W.partitionBy("source", "_range").orderBy("_key", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    placed = docs.join(F.broadcast(bounds), ["source", "_range"]).withColumn("_start", F.col("_before") + F.coalesce(inside, F.lit(0)))
    epochs = F.floor(F.col("budget") / F.col("source_tokens"))
    rest = F.col("budget") - epochs * F.col("source_tokens")
    repeats = (epochs + F.when(F.col("_start") + F.col("n_tokens") / 2.0 <= rest, 1).otherwise(0)).cast("int")
    return placed.select("doc_id", "source", "n_tokens", repeats.alias("repeats")).where("repeats > 0")


def shares(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source what was drawn and the share it reached."""
    got = drawn.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats")
    )
    rows = targets.select(_named("source").alias("source"), "target_share", "max_repeats").dropDuplicates(["source"]).join(got, "source", "left").na.fill(0)
    whole = got.agg(F.sum("n_tokens").alias("_all"))
    return rows.withColumn("_all", whole.scalar()).select(
        "source", "target_share", "max_repeats", "n_docs", "n_tokens", "most_repeats",
        F.round(F.coalesce(F.col("n_tokens") / F.col("_all"), F.lit(0.0)), 6).alias("actual_share"),
    )
