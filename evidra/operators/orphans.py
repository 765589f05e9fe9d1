"""References to records that aren't there, kept as incremental state.

The state has two append-only tables: lives of parents (observed, deleted) and
references with the reason why they are orphans, or null if they are answered.
A batch brings new references and events of lives:

* new references probe the parent index and wait if it has no answer;
* arriving parents re-examine the references that name them, so waiting
  orphans are resolved (or turn from ``missing`` to ``late``);
* ends of lives re-examine answered references too, which reopens those made
  after the deletion.

A batch examines only references that are new or name an id of the batch, and
writes only what it changes. A reference is judged at its own time, hence any
split of the input into batches ends in the same state; counts after each batch
are sums over the deltas.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.session import hot_keys, salted_left_join, saved
from evidra.sources.tables import blankless

REF = ["table_name", "record_id", "field_name", "target_id", "at"]


def normal_id(col: Column | str) -> Column:
    """An id without surrounding blanks and in lower case."""
    return F.lower(blankless(col))


def references(df: DataFrame, table_name: str, record: str, field: str, at: str, many: bool = False, arrived: str | None = None) -> DataFrame:
    """The references of one field. Null, blank and ``ext:`` values are none.

    ``many`` says that the field is an array with one reference per item; ``arrived`` is
    the time at which the row came in, if it isn't ``at``.
    """
    value = F.explode(F.array_distinct(F.col(field))) if many else F.col(field)
    rows = df.select(F.col(record).alias("record_id"), F.col(at).alias("at"), F.col(arrived or at).alias("arrived"), value.alias("_v"))
    rows = rows.withColumn("target_id", normal_id("_v")).where(
        (F.col("target_id") != "") & ~F.col("target_id").startswith("ext:") & F.col("record_id").isNotNull()
    )
    return rows.select(F.lit(table_name).alias("table_name"), "record_id", F.lit(field).alias("field_name"), "target_id", "at", "arrived")


def lives_of(df: DataFrame) -> DataFrame:
    """The lives of target rows as events: ``target_id, life, observed_at, deleted_at``.

    A life comes with its observation; its end may come in a later batch as the same life with ``deleted_at``.
    Redelivered rows are one life.
    """
    rows = df.select(normal_id("id").alias("target_id"), "observed_at", "deleted_at").where("target_id != ''").distinct()
    return rows.select("target_id", F.xxhash64("observed_at", "deleted_at").alias("life"), "observed_at", "deleted_at")


def parent_index(lives: DataFrame) -> DataFrame:
    """One row per id: its first observation, since when it is there for good, and its closed lives.

    Open lives collapse into their earliest start; closed lives are all kept, each once.
    """
    now = lives.groupBy("target_id", "life").agg(F.min("observed_at").alias("observed_at"), F.max("deleted_at").alias("deleted_at"))
    return (
        now.groupBy("target_id")
        .agg(
            F.min("observed_at").alias("first_at"),
            F.min(F.when(F.col("deleted_at").isNull(), F.col("observed_at"))).alias("open_from"),
            F.collect_set(F.when(F.col("deleted_at") > F.col("observed_at"), F.struct("observed_at", "deleted_at"))).alias("closed"),
        )
    )


def judge(refs: DataFrame, lives: DataFrame, hot: DataFrame | None = None) -> DataFrame:
    """``refs`` with ``reason``: ``missing``, ``late``, ``deleted`` or null if the target is there.

    A reference without a time can't be answered by time: its reason is
    ``missing`` if no row has the id, else null.
    """
    at = F.col("at")
    there = (F.col("open_from") <= at) | F.exists("closed", lambda x: (x["observed_at"] <= at) & (at < x["deleted_at"]))
    reason = (
        F.when(F.col("first_at").isNull(), "missing")
        .when(F.coalesce(there, F.lit(False)) | at.isNull(), None)
        .when(F.col("first_at") > at, "late")
        .otherwise("deleted")
    )
    joined = salted_left_join(refs, parent_index(lives), "target_id", hot)
    return joined.select(*refs.columns, reason.alias("reason"))


@dataclass
class OrphanState:
    """The keyed state: append-only deltas of references and of lives; ``apply`` adds one batch.

    A delta of references holds those whose reason is new or another than before, with
    ``prior`` (the reason before) and ``batch``; the newest row of a reference holds. A batch
    writes its own rows and those it changes, never the whole state.
    """

    refs: DataFrame
    lives: DataFrame
    hot: DataFrame
    batch: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        """A state that has seen nothing."""
        return cls(
            spark.createDataFrame([], "table_name string, record_id string, field_name string, target_id string, at timestamp_ntz, reason string, prior string, batch int"),
            spark.createDataFrame([], "target_id string, life long, observed_at timestamp_ntz, deleted_at timestamp_ntz"),
            spark.createDataFrame([], "target_id string"),
        )

    def current(self) -> DataFrame:
        """The references with their reason now, one row each."""
        return self.refs.groupBy(*REF).agg(F.max_by("reason", "batch").alias("reason"))

    def apply(self, new_refs: DataFrame, new_lives: DataFrame, keep: bool = True, hot: DataFrame | None = None) -> OrphanState:
        """The state after a batch; with ``keep`` its delta is written to the checkpoint folder.

        ``hot``: ids that many references name, if the caller knows them (at most ``1 / HOT_SHARE`` rows).

        New references probe the lives; references that name an id of the new lives are examined
        again. Repeated references and references that are known already change nothing.
        """
        number = self.batch + 1
        if hot is None:  # at most 1 / HOT_SHARE ids a batch
            hot = saved(hot_keys(new_refs, "target_id").unionByName(self.hot).distinct())
        asked, lives = new_refs.select(*REF, F.lit(None).cast("string").alias("prior"), F.lit(True).alias("fresh")), new_lives
        if self.batch:
            moved = new_lives.select("target_id").distinct()
            known = self.refs.join(moved, "target_id", "left_semi")
            known = known if self.batch == 1 else known.groupBy(*REF).agg(F.max_by("reason", "batch").alias("reason"))
            asked = asked.unionByName(known.select(*REF, F.col("reason").alias("prior"), F.lit(False).alias("fresh")))
            lives = self.lives.unionByName(new_lives)
        judged = judge(asked, lives, hot)
        changed = judged.where("fresh or not (reason <=> prior)").select(*REF, "reason", "prior", F.lit(number).alias("batch"))
        if keep:
            changed, new_lives = saved(changed), saved(new_lives)
        return OrphanState(self.refs.unionByName(changed) if self.batch else changed, self.lives.unionByName(new_lives) if self.batch else new_lives, hot, number)

    def orphans(self) -> DataFrame:
        """The references that are orphans now, one row each. References that never were any aren't shuffled."""
        ever = self.refs.where("reason is not null or prior is not null").groupBy(*REF).agg(F.max_by("reason", "batch").alias("reason"))
        return ever.where("reason is not null").select("table_name", "record_id", "field_name", "target_id", "reason", "at")

    def counts(self) -> DataFrame:
        """A snapshot: orphans per table, field, reason and month of the reference."""
        month = F.date_format("at", "yyyy-MM").alias("month")
        rows = self.orphans().select("table_name", "record_id", "field_name", "target_id", "reason", month).distinct()
        return rows.groupBy("table_name", "field_name", "reason", "month").agg(F.count("*").alias("n_orphans"))

    def snapshots(self) -> DataFrame:
        """Orphans per table, field and reason after each batch, from the deltas alone: what a batch adds less what it takes away."""
        moves = F.array_compact(F.array(
            F.when(F.col("reason").isNotNull(), F.struct("reason", F.lit(1).alias("n"))), F.when(F.col("prior").isNotNull(), F.struct(F.col("prior").alias("reason"), F.lit(-1).alias("n"))),
        ))
        once = self.refs.where("reason is not null or prior is not null").groupBy(*REF, "batch").agg(F.max("prior").alias("prior"), F.max("reason").alias("reason"))
        steps = once.where("not (reason <=> prior)").select("table_name", "field_name", "batch", F.explode(moves).alias("m")).groupBy("table_name", "field_name", "m.reason", "batch").agg(F.sum("m.n").alias("n"))
        running = F.sum("n").over(W.partitionBy("table_name", "field_name", "reason").orderBy("batch"))
        return steps.select("table_name", "field_name", "reason", "batch", F.col("n").alias("change"), running.alias("n_orphans"))


def replay(refs: DataFrame, lives: DataFrame, cuts: list) -> OrphanState:
    """Run the whole history through the state in batches split at the times ``cuts``.

    A reference comes with the batch of its ``arrived`` (its own time if the column is missing), a life with that of its
    observation, and the end of a life with the batch *after* the one it falls in: deletions
    are known late, so references made in between are reopened. The last batch brings what is left
    and isn't written, the caller's action runs it. Rows without a time come with the first batch.
    """
    state = OrphanState.empty(refs.sparkSession)
    if "arrived" not in refs.columns:
        refs = refs.withColumn("arrived", F.col("at"))
    hot = saved(hot_keys(refs, "target_id"))
    bounds = [None, *cuts, None]
    spans = list(zip(bounds[:-1], bounds[1:], strict=True))

    def within(col: str, span: tuple) -> Column:
        low, high = span
        tests = [F.col(col) >= F.lit(low)] if low is not None else []
        tests += [F.col(col) < F.lit(high)] if high is not None else []
        test = reduce(lambda a, b: a & b, tests, F.lit(True))
        return test | F.col(col).isNull() if low is None else test

    for i, span in enumerate(spans):
        seen = lives.where(within("observed_at", span))
        events = seen.withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
        ended = lives.where("deleted_at is not null")
        if i:
            events = events.unionByName(ended.where(within("deleted_at", spans[i - 1])))
        if i == len(spans) - 1:
            events = events.unionByName(ended.where(within("deleted_at", span)))
        state = state.apply(refs.where(within("arrived", span)), events, i < len(spans) - 1, hot)
    return state
