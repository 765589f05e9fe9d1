"""Suppressions and policies as tables: validation, breadth, expiry, audit; redaction of details; spec drift; evaluation of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that cover much on their own (fixed values).
BROAD_PATHS = ("src/**", "fixtures/**", "tests/**", "test/**", "**/*.ts", "**/*.js", "**/*.py", "*", "**", "src/**/*", "fixtures/**/*")
#: Begin of a pattern -> how broad it is, the first that fits (fixed values).
BROAD_TYPES = (("src/", "source-wide"), ("fixtures/", "fixture-wide"), ("tests/", "test-wide"), ("test/", "test-wide"), ("**/*.", "extension-wide"), ("*", "rule-wide"))


def is_broad(path: Column | str) -> Column:
    """Whether a pattern covers a large scope: a known one, a whole top folder, or any depth from the top."""
    path = F.col(path) if isinstance(path, str) else path
    parts = F.split(path, "/")
    whole = (F.size(parts).isin(2, 3)) & (F.get(parts, F.lit(1)) == "**")
    return F.coalesce(path.isin(*BROAD_PATHS) | whole | (F.get(parts, F.lit(0)) == "**"), F.lit(False))


def broad_suppressions(suppressions: DataFrame) -> DataFrame:
    """The suppressions with a broad ``path``, with ``broad_type``."""
    kind = F.lit("mixed-wide")
    for begin, name in reversed(BROAD_TYPES):
        kind = F.when(F.col("path").startswith(begin), name).otherwise(kind)
    return suppressions.where(is_broad("path")).withColumn("broad_type", kind)


def expiry_warnings(suppressions: DataFrame, now: Column, warn_days: int = 30) -> DataFrame:
    """Suppressions that are expired or will be within ``warn_days``: ``status`` and ``days`` (without sign; a begun day counts)."""
    days = F.ceil((F.unix_timestamp(F.to_timestamp("expiry")) - F.unix_timestamp(now)) / 86400)
    rows = suppressions.where("expiry is not null").withColumn("_d", days)
    status = F.when(F.col("_d") < 0, "expired").when(F.col("_d") <= warn_days, "expiring_soon")
    return rows.withColumn("status", status).where("status is not null").withColumn("days", F.abs("_d")).drop("_d")


def problems(checks: list[tuple[Column, str]]) -> Column:
    """The messages of the checks that hold, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), message) for test, message in checks]))


def validate_suppressions(suppressions: DataFrame, now: Column) -> DataFrame:
    """``suppressions`` with ``errors``, ``warnings`` and ``valid``: missing fields, dates that are none, patterns that look wrong, dates that are over."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    date = F.try_to_timestamp("expiry")
    errors = problems([*[(empty(c), f"missing {c}") for c in ("rule_id", "path", "reason")], (~empty("expiry") & date.isNull(), "invalid expiry")])
    opened = lambda a, b: F.length(F.regexp_replace("path", rf"[^\{a}]", "")) != F.length(F.regexp_replace("path", rf"[^\{b}]", ""))
    warnings = problems([
        (opened("{", "}"), "unbalanced braces"), (opened("[", "]"), "unbalanced brackets"), (F.contains(F.col("path"), F.lit("\\")), "backslash in path"), (F.col("path").rlike(r"\*\*\*"), "three stars"), (date < now, "expired"),
    ])
    return suppressions.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("valid", F.size("errors") == 0)


def too_many_per_rule(suppressions: DataFrame, most: int) -> DataFrame:
    """``rule_id, n`` of rules with more than ``most`` suppressions."""
    return suppressions.groupBy("rule_id").agg(F.count("*").alias("n")).where(F.col("n") > most)


#: Classes of suppressions (fixed values).
SUPPRESSION_CLASSES = ("false-positive", "accepted-risk", "legacy", "test-only", "other")


def by_class(suppressed: DataFrame, by: list[str]) -> DataFrame:
    """Suppressed findings (``class``) per group and class, dense; an unknown class counts as ``other``."""
    name = lambda c: "n_" + c.replace("-", "_")
    own = F.when(F.col("class").isin(*SUPPRESSION_CLASSES), F.col("class")).otherwise("other")
    return suppressed.groupBy(*by).agg(*[F.count_if(own == c).alias(name(c)) for c in SUPPRESSION_CLASSES])


def redact_details(df: DataFrame, columns: list[str], public: bool) -> DataFrame:
    """``df`` with the details in ``columns`` hidden under the public profile; nulls stay."""
    if not public:
        return df
    return df.select(*[F.when(F.col(c).isNull(), F.lit(None).cast("string")).otherwise("[redacted]").alias(c) if c in columns else F.col(c) for c in df.columns])


def redaction_summary(df: DataFrame, columns: list[str], public: bool) -> dict[str, list[str]]:
    """Which columns are visible and which are hidden under a profile."""
    hidden = [c for c in df.columns if public and c in columns]
    return {"visible": [c for c in df.columns if c not in hidden], "redacted": hidden}


def missing_items(expected: Column, text: Column) -> Column:
    """The expected items that a text doesn't hold."""
    return F.filter(expected, lambda x: ~F.contains(text, x))


#: Severity of a drift finding by the kind of its check (fixed values).
DRIFT_SEVERITY = {"command": "high", "schema": "high", "test": "medium"}


def set_drift(checks: DataFrame) -> DataFrame:
    """``checks`` (``check, kind, expected, actual``: arrays) with ``missing``, ``unexpected``, ``status`` and ``severity`` (null if it passed)."""
    none = F.array().cast("array<string>")
    a, b = F.coalesce("expected", none), F.coalesce("actual", none)
    rows = checks.withColumn("missing", F.array_sort(F.array_except(a, b))).withColumn("unexpected", F.array_sort(F.array_except(b, a)))
    failed = F.size("missing") > 0
    severity = F.lit("low")
    for kind, level in DRIFT_SEVERITY.items():
        severity = F.when(F.col("kind") == kind, level).otherwise(severity)
    return rows.withColumn("status", F.when(failed, "failed").otherwise("passed")).withColumn("severity", F.when(failed, severity))


def fp_evaluation(reviews: DataFrame, by: list[str], target: float) -> DataFrame:
    """Per group: true and false positives and uncertain reviews (``verdict``: TP, FP, other), the rate of false ones in percent, and whether it meets the target."""
    fp = F.count_if(F.col("verdict") == "FP")
    rate = F.when(F.count("*") > 0, F.round(100.0 * fp / F.count("*"), 2)).otherwise(0.0)
    rows = reviews.groupBy(*by).agg(
        F.count_if(F.col("verdict") == "TP").alias("tp"), fp.alias("fp"), F.count_if(~F.coalesce(F.col("verdict").isin("TP", "FP"), F.lit(False))).alias("uncertain"), rate.alias("fp_rate"),
    )
    return rows.withColumn("meets", F.col("fp_rate") <= target)


def compare_evaluations(evaluations: DataFrame, rate: str, meets: str) -> DataFrame:
    """One row over evaluations: mean, worst and best rate, whether all or any meet their target."""
    return evaluations.agg(
        F.round(F.avg(rate), 2).alias("average"), F.max(rate).alias("greatest"), F.min(rate).alias("least"), F.coalesce(F.bool_and(meets), F.lit(True)).alias("all_meet"), F.coalesce(F.bool_or(meets), F.lit(False)).alias("any_meets"),
    )


def suppression_advice(reviews: DataFrame) -> DataFrame:
    """Suppressions that the false positives suggest: per rule the path if all share one, else ``**``, and the first reason by ``ord``."""
    fp = reviews.where("verdict = 'FP'")
    return fp.groupBy("rule_id").agg(
        F.when(F.count_distinct("path") == 1, F.min("path")).otherwise("**").alias("path"), F.min_by("reason", "ord").alias("reason"), F.count("*").alias("n")
    )


def review_by_place(findings: DataFrame, reviews: DataFrame, order: str) -> DataFrame:
    """Findings (in their order per ``run_id``) with the review at the same place (``run_id, place, verdict``), as reviews without ids are given.

    Reviews are as many as findings, and made in the query Spark takes them for as few as their runs: they are sorted and merged, never broadcast.
    """
    from pyspark.sql import Window as W

    placed = findings.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy(F.col(order).asc_nulls_last())) - 1)
    given = reviews.withColumnsRenamed({"run_id": "_run", "place": "_place"}).hint("merge")
    return placed.join(given, F.col("run_id").eqNullSafe(F.col("_run")) & (F.col("place") == F.col("_place")), "left").drop("_run", "_place")


def detections(seeded: DataFrame, findings: DataFrame) -> DataFrame:
    """``seeded`` (``seeded_id, rule_id, path``) with the first finding (by id) of the rule whose path is the seeded one or ends in its name, and ``detected``."""
    base = F.substring_index("path", "/", -1)
    wanted = seeded.select("seeded_id", "rule_id", base.alias("_base"))
    have = findings.select("rule_id", base.alias("_base"), F.col("id").alias("_id"))
    first = wanted.join(have, ["rule_id", "_base"]).groupBy("seeded_id").agg(F.min("_id").alias("finding_id"))
    return seeded.join(first, "seeded_id", "left").withColumn("detected", F.col("finding_id").isNotNull())


def detection_rate(found: DataFrame, by: list[str]) -> DataFrame:
    """Per group: how many seeded defects were detected, in percent."""
    return found.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("detected").alias("n_detected"), F.round(100.0 * F.count_if("detected") / F.count("*"), 2).alias("rate"))


#: Grades by the least score (fixed values).
GRADES = ((90, "A"), (80, "B"), (70, "C"), (60, "D"))


def quality_score(scores: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """The weighted total of scores (0 to 100), rounded, and its grade."""
    total = F.round(sum((c * w for c, w in scores.values()), F.lit(0.0))).cast("int")
    grade = F.lit("F")
    for least, name in reversed(GRADES):
        grade = F.when(total >= least, name).otherwise(grade)
    return total, grade
