"""What changed between consecutive full snapshots of a table.

Rows become compact arrays: the hash of their key within a snapshot, the hash
under which the same key would stand in the next snapshot, and the hash of the
compared values. All rows of a key of one series meet in one hash bucket, where
numpy sorts the arrays and ``searchsorted`` takes the set differences. Only
differing keys leave the buckets, and full values are read for these alone.

Buckets are made of series *and* key, so a series that holds most of the rows
spreads over all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.session import saved
from evidra.sources.tables import blankless

ADDED, REMOVED, MODIFIED = 1, 2, 3


def snapshot_order(snapshots: DataFrame, series: list[str], snapshot: str, at: str) -> DataFrame:
    """Each snapshot with its number in its series (from 0) and the id of the next one.

    Redelivered snapshots count once; ties of ``at`` go by id; rows without id are dropped.
    """
    once = snapshots.where(F.col(snapshot).isNotNull()).groupBy(*series, snapshot).agg(F.min(at).alias(at))
    order = W.partitionBy(*series).orderBy(F.col(at).asc_nulls_first(), snapshot)
    return once.select(
        *series, snapshot, (F.row_number().over(order) - 1).alias("_seq"), F.lead(snapshot).over(order).alias("_next"), F.col(at).alias("_at")
    )


_ARRAYS = ("here", "there", "here2", "there2", "value", "first", "last")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Set differences of one partition from its arrays (two hashes here and there, value, first, last)."""
    parts: dict[str, list[np.ndarray]] = {n: [] for n in _ARRAYS}
    for batch in batches:
        for name, own in parts.items():
            own.append(batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False))
    if not parts["here"]:
        return
    here, there, here2, there2, value, first, last = (np.concatenate(parts[n]) for n in _ARRAYS)
    order = np.lexsort((value, here2, here))
    # a key that stands several times in a snapshot counts by its first value
    lead = np.ones(len(here), bool)
    lead[1:] = (here[order][1:] != here[order][:-1]) | (here2[order][1:] != here2[order][:-1])
    order = order[lead]
    here, there, here2, there2, value, first, last = (x[order] for x in (here, there, here2, there2, value, first, last))

    # rows whose key isn't in the next snapshot; where first hashes collide, the second finds the row among its neighbours
    end = len(here) - 1
    at = np.minimum(np.searchsorted(here, there), end)
    while (astray := (here[at] == there) & (here2[at] != there2) & (at < end) & (here[np.minimum(at + 1, end)] == there)).any():
        at = at + astray
    found = (here[at] == there) & (here2[at] == there2)
    removed = ~found & ~last
    # rows that some row of the snapshot before leads to
    met = np.zeros(len(here), bool)
    met[at[found]] = True
    added = ~met & ~first
    modified = np.zeros(len(here), bool)
    src, dst = np.flatnonzero(found), at[found]
    modified[dst[value[src] != value[dst]]] = True
    old = np.zeros(len(here), np.int64)
    old[dst] = src
    for mask, kind in ((added, ADDED), (removed, REMOVED), (modified, MODIFIED)):
        at = np.flatnonzero(mask)
        for low in range(0, len(at), 65536):
            some = at[low : low + 65536]
            before = old[some]
            yield pa.RecordBatch.from_arrays(
                [pa.array(here[some]), pa.array(here2[some]), pa.array(here[before]), pa.array(here2[before]), pa.array(np.full(len(some), kind, np.int32))],
                ["here", "here2", "old", "old2", "kind"],
            )


def snapshot_differences(rows: DataFrame, order: DataFrame, series: list[str], snapshot: str, key: Column, value: Column) -> tuple[DataFrame, DataFrame]:
    """The differing keys and the rows they stand for.

    ``rows`` belong to snapshots of ``order`` (others are ignored). Gives
    ``(differences, hashed)``: ``differences`` has ``here, here2`` (hashes of snapshot and
    key of the row, 96 bits in all), ``old, old2`` (those of the row before, for modified keys) and
    ``kind``; ``hashed`` is ``rows`` with ``here, here2, _next``.
    """
    numbered = rows.join(order.select(*series, snapshot, "_seq", "_next"), [*series, snapshot] if set(series) <= set(rows.columns) else snapshot)
    following = F.col("_seq") + 1
    hashed = numbered.withColumns({"here": F.xxhash64(*series, "_seq", key), "there": F.xxhash64(*series, following, key), "here2": F.hash(*series, "_seq", key), "there2": F.hash(*series, following, key)})
    compact = hashed.select(
        "here", "there", "here2", "there2", value.alias("value"), (F.col("_seq") == 0).alias("first"), F.col("_next").isNull().alias("last"),
        F.pmod(F.xxhash64(*series, key), F.lit(1 << 30)).alias("_bucket"),
    )
    differences = compact.repartition("_bucket").drop("_bucket").mapInArrow(_differences, "here long, here2 int, old long, old2 int, kind int")
    return differences, hashed


def clean(col: Column | str) -> Column:
    """Text for comparison: no surrounding blanks, null as empty."""
    return F.coalesce(blankless(col), F.lit(""))


def finding_key() -> Column:
    """The identity of a finding row, as ratchet summaries use it."""
    symbols = F.array_join(F.col("affected_symbols"), ",", "")
    fallback = F.when(F.coalesce(symbols, F.lit("")) != "", symbols).otherwise(F.coalesce("title", F.lit("")))
    path = F.coalesce(F.try_element_at("evidence", F.lit(1))["path"], F.lit(""))
    plain = F.concat_ws("|", F.coalesce("rule_id", F.lit("")), path, fallback)
    return F.when(F.col("fingerprint").isNotNull(), F.concat(F.lit("fingerprint:"), F.col("fingerprint"))).otherwise(plain)


def severity_rank(col: Column) -> Column:
    """1 to 4 from low to critical, 0 for anything else."""
    rank = F.lit(0)
    for i, name in enumerate(("low", "medium", "high", "critical"), 1):
        rank = F.when(F.lower(clean(col)) == name, i).otherwise(rank)
    return rank


def finding_changes(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """``repo_root, branch, run_id, finding_key, change_kind`` of each run against the one before.

    Redelivered rows count once. Null and empty values, order and repeats of
    tags, surrounding blanks and noise beyond four decimals make no difference.
    Findings of unknown runs are ignored; a run without findings is a run.
    """
    order = saved(snapshot_order(runs, ["repo_root", "branch"], "run_id", "generated_at"))
    tags = F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("tags", clean), lambda x: x != ""))), "\u0001")
    rows = findings.select(
        "run_id",
        finding_key().alias("finding_key"),
        severity_rank(F.col("severity")).alias("rank"),
        F.xxhash64(
            clean("category"), clean("severity"), F.coalesce(F.round("confidence", 4), F.lit(-1.0)), clean("title"), clean("summary"), F.coalesce(tags, F.lit(""))
        ).alias("value"),
    )
    differences, hashed = snapshot_differences(rows, order, ["repo_root", "branch"], "run_id", F.col("finding_key"), F.col("value"))
    differences = saved(differences)
    # full values of differing keys only: those of the row itself, and of the row before for modified ones
    case = F.struct("here", "here2").alias("case")
    sides = differences.select(F.col("here").alias("at"), F.col("here2").alias("at2"), "kind", case, F.lit(True).alias("own")).unionByName(
        differences.where(F.col("kind") == MODIFIED).select(F.col("old").alias("at"), F.col("old2").alias("at2"), "kind", case, F.lit(False).alias("own"))
    )
    full = hashed.select("repo_root", "branch", "run_id", "finding_key", "rank", "_next", "value", F.col("here").alias("at"), F.col("here2").alias("at2"))
    cases = sides.join(full, ["at", "at2"]).groupBy("case", "kind").agg(
        F.min_by(F.struct("repo_root", "branch", "run_id", "finding_key", "rank", "_next"), F.when(F.col("own"), F.col("value"))).alias("n"),
        F.min_by("rank", F.when(~F.col("own"), F.col("value"))).alias("before"),
    )
    kind = (
        F.when(F.col("kind") == ADDED, "added").when(F.col("kind") == REMOVED, "removed").when(F.col("n.rank") > F.col("before"), "worsened").otherwise("changed")
    )
    return cases.select(
        "n.repo_root", "n.branch", F.when(F.col("kind") == REMOVED, F.col("n._next")).otherwise(F.col("n.run_id")).alias("run_id"),
        F.col("n.finding_key").alias("finding_key"), kind.alias("change_kind"),
    )


def ratchet_summary(changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts of new, resolved, worsened and otherwise changed findings of every run but the first."""
    order = snapshot_order(runs, ["repo_root", "branch"], "run_id", "generated_at").where("_seq > 0")
    counts = changes.groupBy("run_id").pivot("change_kind", ["added", "removed", "worsened", "changed"]).agg(F.count("finding_key"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return order.join(counts, "run_id", "left").select(
        "repo_root", "branch", "run_id", zero("added").alias("new_findings"), zero("removed").alias("resolved_findings"),
        zero("worsened").alias("worsened_findings"), zero("changed").alias("changed_findings"),
    )
