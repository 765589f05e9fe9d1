"""Comparison of two runs' findings by prioritised one-to-one matching, and what follows from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions.scalars import severity_rank, title_key
from evidra.session import saved

_COLUMNS = ["pair", "id", "rule_id", "path", "fingerprint", "symbols", "severity", "category", "confidence", "ord"]
_MATCH = "pair string, rule_id string, current_id string, previous_id string, status string, matched_on string"


class _Group:
    """The rows before of one group, looked up by key; each is taken once, and with it all rows of its id."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.by: dict[tuple, list[int]] = {}
        self.next: dict[tuple, int] = {}
        self.used: set[str] = set()

    def add(self, row: tuple) -> None:
        for _, key in _keys(row):
            self.by.setdefault(key, []).append(len(self.rows))
        self.rows.append(row)

    def take(self, row: tuple) -> tuple[tuple, str] | None:
        """The first row that isn't used, by the keys of a current row in their order. Used rows are passed once."""
        for stage, key in _keys(row):
            places = self.by.get(key, ())
            at = self.next.get(key, 0)
            while at < len(places) and self.rows[places[at]][0] in self.used:
                at += 1
            self.next[key] = at
            if at < len(places):
                found = self.rows[places[at]]
                self.used.add(found[0])
                return found, stage
        return None


def _keys(row: tuple) -> Iterator[tuple[str, tuple]]:
    """Stages and keys under which a row (id, rule, path, fingerprint, symbols, values) is looked for."""
    _, rule, path, fingerprint, symbols, _ = row
    if fingerprint:
        yield "fingerprint", ("f", fingerprint)
    yield "path", ("p", rule, path)
    for symbol in symbols or ():
        yield "symbol", ("s", rule, symbol)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams groups: rows come sorted by group, those before first, each side in its order. One group is held at a time."""
    name, group = None, _Group()
    out: list[tuple] = []

    def left() -> None:
        out.extend((name[0], r[1], None, r[0], "resolved", "none") for r in group.rows if r[0] not in group.used)

    for batch in batches:
        for pair, key, current, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (pair, key) != name:
                if name is not None:
                    left()
                name, group = (pair, key), _Group()
            row = (*row[:5], tuple(row[5:]))
            if not current:
                group.add(row)
                continue
            hit = group.take(row)
            if hit is None:
                out.append((pair, row[1], row[0], None, "new", "none"))
            else:
                then, stage = hit
                out.append((pair, row[1], row[0], then[0], "unchanged" if row[5] == then[5] else "modified", stage))
        yield _batch(out)
        out = []
    if name is not None:
        left()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["pair", "rule_id", "current_id", "previous_id", "status", "matched_on"])


def compare_exact(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Greedy matching in input order within a pair of runs: fingerprint, then rule and path, then rule and each symbol.

    Both sides need the columns pair (what is compared with what), id, rule_id, path,
    fingerprint, symbols, severity, category, confidence, ord. A row before is taken once, with all rows of its id. Null and
    empty fingerprints match nothing.

    The order of rows decides, so rows that may meet are streamed in that order by one task, one group at a time. A group is
    a rule in a pair of runs, or the whole pair where a fingerprint stands under several rules of it. A rule
    whose rows can't meet any others (no row on the other side) never leaves the JVM.
    """
    # aliases, since both sides may stem from one table
    side = lambda d, now: d.select(*[F.col(c).alias(c) for c in _COLUMNS], F.lit(now).alias("cur"))
    rows = saved(side(previous, False).unionByName(side(current, True)))  # read three times
    spread = rows.where("fingerprint != ''").groupBy("pair", "fingerprint").agg((F.min("rule_id") != F.max("rule_id")).alias("many")).where("many").select("pair", F.lit(True).alias("_many")).distinct()
    groups = rows.join(spread, "pair", "left").withColumn("grp", F.when(F.col("_many"), F.lit(None).cast("string")).otherwise(F.coalesce("rule_id", F.lit(""))))
    sides = groups.groupBy("pair", "grp").agg(F.max("cur").alias("_now"), F.min("cur").alias("_then"))
    sides = sides.withColumn("both", F.col("_now") & ~F.col("_then")).select("pair", F.coalesce("grp", F.lit("\u0000")).alias("grp"), "both")
    judged = groups.withColumn("grp", F.coalesce("grp", F.lit("\u0000"))).join(sides, ["pair", "grp"])
    none = F.lit(None).cast("string")
    alone = judged.where("not both").select(
        "pair", "rule_id", F.when(F.col("cur"), F.col("id")).alias("current_id"), F.when(~F.col("cur"), F.col("id")).alias("previous_id"),
        F.when(F.col("cur"), "new").otherwise("resolved").alias("status"), F.lit("none").alias("matched_on"),
    )
    meet = judged.where("both").repartition("pair", "grp").sortWithinPartitions("pair", "grp", "cur", "ord", "id")
    met = meet.select("pair", "grp", "cur", "id", "rule_id", F.coalesce("path", F.lit("")).alias("path"), "fingerprint", "symbols", "severity", "category", F.coalesce(F.col("confidence").cast("string"), none).alias("confidence"))
    return alone.unionByName(met.mapInArrow(_matched, _MATCH))


def compare_staged(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Set-based and fully distributed: equal fingerprints pair up by rank, the rest by rule and path.

    A different semantics from ``compare_exact`` where keys disagree with each other.
    """
    keep = ["pair", "rule_id"]

    def matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        rank = F.row_number().over(W.partitionBy(*keep, key).orderBy("ord", "id"))
        a = left.where(F.col(key).isNotNull()).withColumn("_n", rank)
        b = right.where(F.col(key).isNotNull()).withColumn("_n", rank)
        b = b.select(*keep, key, "_n", *[F.col(c).alias("p_" + c) for c in ("id", "severity", "category", "confidence")])
        same = F.lit(True)
        for c in ("severity", "category", "confidence"):
            same = same & F.col(c).eqNullSafe(F.col("p_" + c))
        return a.join(b, [*keep, key, "_n"]).select(*keep, "id", "p_id", same.alias("same"))

    def without(df: DataFrame, found: DataFrame, column: str) -> DataFrame:
        # a row stands in one pair on a side, the same row in another pair is another case
        return df.join(found.select("pair", F.col(column).alias("id")), ["pair", "id"], "left_anti")

    def case(df: DataFrame, now: str | None, then: str | None, status: Column) -> DataFrame:
        pick = lambda c, name: (F.col(c) if c else F.lit(None).cast("string")).alias(name)
        return df.select(*keep, pick(now, "current_id"), pick(then, "previous_id"), status.alias("status"))

    current, previous = saved(current), saved(previous)  # each is read five times
    first = saved(matched(current, previous, "fingerprint"))
    rest_c, rest_p = without(current, first, "id"), without(previous, first, "p_id")
    second = saved(matched(rest_c, rest_p, "path"))
    done = case(first.unionByName(second), "id", "p_id", F.when(F.col("same"), "unchanged").otherwise("modified"))
    new = case(without(rest_c, second, "id"), "id", None, F.lit("new"))
    gone = case(without(rest_p, second, "p_id"), None, "id", F.lit("resolved"))
    return done.unionByName(new).unionByName(gone)


def with_values(matches: DataFrame, current: DataFrame, previous: DataFrame) -> DataFrame:
    """Matches with ``path, severity, category`` of the current row (of the one before if it is resolved), and ``old_severity``."""
    now = current.select("pair", F.col("id").alias("current_id"), F.struct(F.col("path").alias("path"), F.col("severity").alias("severity"), F.col("category").alias("category")).alias("_now"))
    then = previous.select("pair", F.col("id").alias("previous_id"), F.struct(F.col("path").alias("path"), F.col("severity").alias("severity"), F.col("category").alias("category")).alias("_then"))
    rows = matches.join(now, ["pair", "current_id"], "left").join(then, ["pair", "previous_id"], "left")
    pick = lambda c: F.coalesce(F.col(f"_now.{c}"), F.when(F.col("_now").isNull(), F.col(f"_then.{c}"))).alias(c)
    return rows.select("pair", "rule_id", "current_id", "previous_id", "status", pick("path"), pick("severity"), pick("category"), F.col("_then.severity").alias("old_severity"))


def summary(matches: DataFrame, dimension: str, values: list[str]) -> DataFrame:
    """Counts of new, resolved and unchanged findings per pair and value of a dimension, dense. Modified findings stand in no cell."""
    cells = matches.groupBy("pair", dimension).pivot("status", ["new", "resolved", "unchanged"]).agg(F.count("rule_id"))
    grid = matches.select("pair").distinct().select("pair", F.explode(F.array(*map(F.lit, values))).alias(dimension))
    return grid.join(cells, ["pair", dimension], "left").na.fill(0, ["new", "resolved", "unchanged"])


#: Weights of severities in the risk score of a run, and of a regression (fixed values).
RISK_WEIGHTS = {"critical": 10, "high": 5, "medium": 2, "low": 1}
REGRESSION_WEIGHTS = {"critical": 20, "high": 10, "medium": 5, "low": 2}


def weight_of(severity: Column, weights: dict[str, int]) -> Column:
    """The weight of a severity; 0 for others."""
    out = F.lit(0)
    for name, weight in weights.items():
        out = F.when(severity == name, weight).otherwise(out)
    return out


def trends(matches: DataFrame) -> DataFrame:
    """Per pair: the trend score with its direction, those of critical and high findings, and the change of the risk score.

    The score is what went less what came, per finding before, with 0.3 of critical and 0.2 of high ones on top; within 0.1 of 0 it
    is stable. Without findings before it is 0.
    """
    n = lambda test: F.count_if(test)
    sev, new, gone = F.col("severity"), F.col("status") == "new", F.col("status") == "resolved"
    weight = weight_of(sev, RISK_WEIGHTS)
    rows = matches.groupBy("pair").agg(
        n(F.col("previous_id").isNotNull()).alias("n_before"), (n(gone) - n(new)).alias("less"), (n(gone & (sev == "critical")) - n(new & (sev == "critical"))).alias("less_critical"),
        (n(gone & (sev == "high")) - n(new & (sev == "high"))).alias("less_high"), F.sum(F.when(new, weight).when(gone, -weight).otherwise(0)).alias("risk_change"),
    )
    score = F.when(F.col("n_before") > 0, (F.col("less") + F.col("less_critical") * 0.3 + F.col("less_high") * 0.2) / F.col("n_before")).otherwise(0.0)
    way = lambda c: F.when(F.col(c) > 0, "decreasing").when(F.col(c) < 0, "increasing").otherwise("stable")
    rows = rows.withColumn("score", score)
    return rows.select(
        "pair", F.round("score", 6).alias("score"), F.when(F.col("score") > 0.1, "improving").when(F.col("score") < -0.1, "degrading").otherwise("stable").alias("direction"),
        way("less_critical").alias("critical_trend"), way("less_high").alias("high_trend"), "risk_change",
    )


def regressions(matches: DataFrame, least: str = "medium", rules: tuple[str, ...] = ()) -> DataFrame:
    """``matches`` that are regressions, with ``reason``; a finding may be one for several reasons.

    ``reintroduced``: a new finding whose rule and path also stand among the resolved ones, from the severity ``least`` on;
    ``listed_rule``: a new finding of one of ``rules``; ``escalated``: a matched finding whose severity rose.
    """
    new = matches.where("status = 'new'")
    gone = matches.where("status = 'resolved'").select("pair", "rule_id", "path").distinct()
    back = new.where(severity_rank("severity") >= severity_rank(F.lit(least))).join(gone, ["pair", "rule_id", "path"], "left_semi")
    up = matches.where("status in ('unchanged', 'modified')").where(severity_rank("severity") > severity_rank("old_severity"))
    parts = [back.withColumn("reason", F.lit("reintroduced")), up.withColumn("reason", F.lit("escalated"))]
    if rules:
        parts.append(new.where(F.col("rule_id").isin(*rules)).withColumn("reason", F.lit("listed_rule")))
    columns = [*matches.columns, "reason"]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def potential_regressions(matches: DataFrame, found: DataFrame) -> DataFrame:
    """New findings of a rule that also stands among the resolved ones, but for the regressions ``found``."""
    gone = matches.where("status = 'resolved'").select("pair", "rule_id").distinct()
    return matches.where("status = 'new'").join(gone, ["pair", "rule_id"], "left_semi").join(found.select("pair", "current_id").where("current_id is not null").distinct(), ["pair", "current_id"], "left_anti")


def regression_summary(found: DataFrame, by: list[str], threshold: str = "high") -> DataFrame:
    """Per group: regressions, their distinct paths and severities, the weighted risk score, and whether one blocks (from ``threshold`` on)."""
    return found.groupBy(*by).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("path")), ",").alias("paths"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"),
        F.sum(weight_of(F.col("severity"), REGRESSION_WEIGHTS)).alias("risk_score"), F.bool_or(F.coalesce(severity_rank("severity") >= severity_rank(F.lit(threshold)), F.lit(False))).alias("blocks"),
    )


def slo(matches: DataFrame, found: DataFrame) -> DataFrame:
    """Per pair: indicators of quality with their status, and ``met``, ``at_risk`` (a warning) or ``breached`` (a failure)."""
    n = lambda *tests: F.count_if(F.col("status").isin(*tests[1:]) & (F.col("severity") == tests[0]))
    more = lambda s: n(s, "new") - n(s, "resolved")
    counts = matches.groupBy("pair").agg(
        F.greatest(more("critical") + more("high"), F.lit(0)).alias("net_severe"), n("high", "new", "unchanged").alias("_now"), n("high", "resolved", "unchanged").alias("_then"),
    )
    blockers = found.groupBy("pair").agg(F.count_if(F.col("severity").isin("critical", "high")).alias("blockers"))
    rate = F.when(F.col("_then") > 0, (F.col("_now") - F.col("_then")) / F.col("_then")).otherwise(F.when(F.col("_now") > 0, 1.0).otherwise(0.0))
    rows = counts.join(blockers, "pair", "left").na.fill(0, ["blockers"]).withColumn("high_rate", rate)
    status = F.when(F.col("blockers") > 0, "breached").when((F.col("net_severe") > 0) | (F.col("high_rate") > 0.25), "at_risk").otherwise("met")
    return rows.select("pair", "blockers", "net_severe", F.round("high_rate", 4).alias("high_rate"), status.alias("status"))


#: Statuses of a gate from best to worst (fixed values).
GATE_ORDER = ("passed", "passed_with_risk", "needs_review", "blocked_input", "failed")


def metric_deltas(order: DataFrame, metrics: DataFrame, columns: list[str], status: str | None = None) -> DataFrame:
    """Metrics of each snapshot (``run_id``) beside those of the one before (``previous_run`` of ``order``): now, before and change.

    With a ``status``, whether it improved or degraded in ``GATE_ORDER``.
    """
    rank = lambda c: F.array_position(F.array(*map(F.lit, GATE_ORDER)), c)
    then = metrics.select(F.col("run_id").alias("previous_run"), *[F.col(c).alias(f"{c}_before") for c in [*columns, *([status] if status else [])]])
    rows = order.select("run_id", "previous_run").where("previous_run is not null").join(metrics, "run_id").join(then, "previous_run")
    out = [F.col(c) for c in ("run_id", "previous_run")]
    for c in columns:
        out += [F.col(c), F.col(f"{c}_before"), (F.col(c) - F.col(f"{c}_before")).alias(f"{c}_change")]
    if status:
        a, b = rank(F.col(status)), rank(F.col(f"{status}_before"))
        out += [F.col(status), (a < b).alias("improved"), (a > b).alias("degraded")]
    return rows.select(*out)


def compare_risks(current: DataFrame, previous: DataFrame) -> DataFrame:
    """``pair, current_id, previous_id, status, matched_on`` of risks (``pair, id, title, severity, likelihood, sources, ord``).

    A risk meets the last one before that has its first source (in order) that any has, else the last one before with the same
    plain title; one before may be met by several. ``evolved``: severity or likelihood differ.
    """
    kept = F.struct("id", "severity", "likelihood")
    sources = previous.select("pair", F.explode("sources").alias("source"), kept.alias("then"), "ord").groupBy("pair", "source").agg(F.max_by("then", F.struct("ord", "then")).alias("then"))
    titles = previous.select("pair", title_key("title").alias("key"), kept.alias("then"), "ord").groupBy("pair", "key").agg(F.max_by("then", F.struct("ord", "then")).alias("by_title"))
    asked = current.select("pair", F.col("id").alias("cid"), F.posexplode("sources").alias("place", "source"))
    by_source = asked.join(sources, ["pair", "source"]).groupBy("pair", "cid").agg(F.min_by("then", "place").alias("by_source"))
    now = current.select("pair", F.col("id").alias("cid"), title_key("title").alias("key"), "severity", "likelihood")
    met = now.join(by_source, ["pair", "cid"], "left").join(titles, ["pair", "key"], "left").withColumn("then", F.coalesce("by_source", "by_title"))
    same = F.col("severity").eqNullSafe(F.col("then.severity")) & F.col("likelihood").eqNullSafe(F.col("then.likelihood"))
    status = F.when(F.col("then").isNull(), "new").when(same, "unchanged").otherwise("evolved")
    on = F.when(F.col("by_source").isNotNull(), "source").when(F.col("by_title").isNotNull(), "title").otherwise("none")
    found = met.select("pair", F.col("cid").alias("current_id"), F.col("then.id").alias("previous_id"), status.alias("status"), on.alias("matched_on"))
    gone = previous.select("pair", F.col("id").alias("previous_id")).join(found.select("pair", "previous_id").where("previous_id is not null"), ["pair", "previous_id"], "left_anti")
    return found.unionByName(gone.select("pair", F.lit(None).cast("string").alias("current_id"), "previous_id", F.lit("resolved").alias("status"), F.lit("none").alias("matched_on")))
