"""Text rules as a table of patterns, and the engine that turns what rules claim into findings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import classify
from evidra.functions.scalars import fingerprint
from evidra.operators.text_rules import split_lines
from evidra.session import running_total


@dataclass(frozen=True)
class LineRule:
    """A rule on lines: a pattern, and a veto that speaks against it in the lines around."""

    rule_id: str
    category: str
    severity: str
    confidence: float
    pattern: str
    veto: str | None = None
    before: int = 0
    after: int = 0
    languages: tuple[str, ...] = ()


def claims(files: DataFrame, rules: list[LineRule]) -> DataFrame:
    """``ord, rule_id, category, severity, confidence, title, repo_root, path, start_line, end_line``: a row per line that a rule hits.

    Files (``repo_root, path, language, content``) are read once for all rules; the lines of a file stay in one array, windows are slices of it.
    """

    def hits(ord_: int, rule: LineRule) -> Column:
        def window(i: Column) -> Column:
            low = F.greatest(i - rule.before, F.lit(0))
            return F.slice("lines", low + 1, i + rule.after - low + 1)

        def made(x: Column, i: Column) -> Column:
            clear = ~F.exists(window(i), lambda y: y.rlike(rule.veto)) if rule.veto else F.lit(True)
            return F.when(x.rlike(rule.pattern) & clear, F.struct(F.lit(ord_).alias("ord"), (i + 1).alias("line")))

        found = F.array_compact(F.transform("lines", made))
        return F.when(F.col("language").isin(*rule.languages), found).otherwise(F.array().cast("array<struct<ord:int,line:int>>")) if rule.languages else found

    any_ = "|".join(f"(?:{r.pattern})" for r in rules)
    rows = files.where(F.col("content").rlike(any_)).select("repo_root", "path", "language", split_lines("content").alias("lines"))
    rows = rows.select("repo_root", "path", F.explode(F.concat(*[hits(i, r) for i, r in enumerate(rules)])).alias("h")).distinct()
    of = lambda get: F.element_at(F.array(*[F.lit(get(r)) for r in rules]), F.col("h.ord") + 1)
    return rows.select(
        "h.ord", of(lambda r: r.rule_id).alias("rule_id"), of(lambda r: r.category).alias("category"), of(lambda r: r.severity).alias("severity"), of(lambda r: r.confidence).alias("confidence"),
        F.concat(of(lambda r: r.rule_id), F.lit(" in "), "path").alias("title"), "repo_root", "path", F.col("h.line").alias("start_line"), F.col("h.line").alias("end_line"),
    )


def evaluate(claimed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings with sequential ids, fingerprint and tags, and the claims that are rejected with a ``reason``.

    Reasons in order: ``missing_evidence`` (no path), ``path_not_found``, ``invalid_range`` (incomplete, backwards or beyond the file),
    ``unreadable`` (no content). Ids follow the order of rules, then of places, over all findings; they are counted in ranges, so
    no task sees them all. Fingerprints are taken before tags.
    """
    known = files.select("repo_root", "path", "content").dropDuplicates(["repo_root", "path"])
    lines = F.size(split_lines("content"))
    rows = claimed.join(known.select("repo_root", "path", F.lit(True).alias("_there"), lines.alias("_lines"), "content"), ["repo_root", "path"], "left")
    s, e = F.col("start_line"), F.col("end_line")
    reason = (
        F.when(F.coalesce("path", F.lit("")) == "", "missing_evidence").when(F.col("_there").isNull(), "path_not_found").when(F.col("content").isNull(), "unreadable")
        .when(s.isNull() | e.isNull() | (s < 1) | (e < s) | (e > F.col("_lines")), "invalid_range")
    )
    judged = rows.withColumn("reason", reason)
    rejected = judged.where("reason is not null").select(*claimed.columns, "reason")
    excerpt = classify.excerpt_hash(F.col("content"), s, e)
    sign = fingerprint(F.col("rule_id"), F.lit(None).cast("array<string>"), excerpt, F.col("path"))
    good = judged.where("reason is null").withColumn("fingerprint", sign).drop("content", "_there", "_lines", "reason")
    tags = F.array_sort(F.concat(F.array(F.concat(F.lit("domain:"), classify.domain_of(F.col("path"), F.col("category")))), classify.review_tags(F.col("confidence"), F.array("path"))))
    numbered = running_total(good.withColumn("tags", tags), [], ["ord", "repo_root", "path", "start_line"], F.lit(1), "_n")
    return numbered.select(F.concat(F.lit("finding-"), F.lpad(F.col("_n").cast("string"), 8, "0")).alias("id"), *[c for c in good.columns if c != "ord"], "tags"), rejected


def completeness(claimed: DataFrame, rejected: DataFrame, files: DataFrame) -> DataFrame:
    """One row: ``partial`` if a claim was rejected or no file was there, else ``complete``, with both counts."""
    n_bad, n_files = rejected.agg(F.count("*").alias("n")).scalar(), files.agg(F.count("*").alias("n")).scalar()
    return claimed.agg(F.count("*").alias("n_claims")).select("n_claims", n_bad.alias("n_rejected"), F.when((n_bad > 0) | (n_files == 0), "partial").otherwise("complete").alias("completeness"))
