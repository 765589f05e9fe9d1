"""Pattern joins: first match, last match, longest prefix.

Pattern tables are configuration: they come as Python lists and become one
expression per pattern (``rlike`` on constant patterns), so no join is needed
and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.scalars import glob_regex, owner_regex


def first_match(path: Column, patterns: list[tuple[Column, str, dict]]) -> Column:
    """Struct of the first entry whose condition and regex hold, or null. There must be an entry."""
    out = None
    for condition, regex, values in reversed(patterns):
        row = F.struct(*[F.lit(v).alias(k) for k, v in values.items()])
        hit = F.coalesce(condition & path.rlike(regex), F.lit(False))
        out = F.when(hit, row) if out is None else F.when(hit, row).otherwise(out)
    return out


def suppress(findings: DataFrame, suppressions: list[dict], now: str, skip_expired: bool, warn_days: int = 30) -> DataFrame:
    """``findings`` with ``suppression`` (its reason) and ``suppression_status``.

    ``skip_expired=False``: the first matching entry decides, even an expired one.
    ``skip_expired=True``: expired entries are passed over and the search goes on.
    Statuses: ``active``, ``expiring``, ``expired``, ``not_matched``.
    """

    def status(expiry: str | None) -> str:
        import datetime as dt

        if expiry is None:
            return "active"
        days = (dt.date.fromisoformat(expiry) - dt.date.fromisoformat(now)).days
        return "expired" if days < 0 else "expiring" if days <= warn_days else "active"

    entries = [(s, status(s.get("expiry"))) for s in suppressions]
    rows = [
        (F.col("rule_id") == s["rule_id"], glob_regex(s["path"]), {"reason": s["reason"], "status": st})
        for s, st in entries
        if not (skip_expired and st == "expired")
    ]
    if not rows:
        return findings.withColumn("suppression", F.lit(None).cast("string")).withColumn("suppression_status", F.lit("not_matched"))
    hit = first_match(F.col("path"), rows)
    return findings.withColumn("_hit", hit).select(
        "*", F.col("_hit.reason").alias("suppression"), F.coalesce("_hit.status", F.lit("not_matched")).alias("suppression_status")
    ).drop("_hit")


def owners(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """``files`` with ``owner``: that of the last rule whose pattern matches the path, or null."""
    rows = [(F.lit(True), owner_regex(p), {"owner": o}) for p, o in reversed(rules)]
    return files.withColumn("owner", first_match(F.col("path"), rows)["owner"] if rows else F.lit(None).cast("string"))


def longest_prefix(files: DataFrame, modules: DataFrame) -> DataFrame:
    """``repo_root, path, module``: the longest module folder of the same repo that holds the path, or ``.``.

    The folders above a path are exploded and meet the modules in an equi-join;
    paths are short, so a file gives few rows whatever the number of modules.
    """
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = files.select("repo_root", "path", F.explode(folders).alias("module"))
    hits = above.join(modules.select("repo_root", "module").distinct(), ["repo_root", "module"])
    best = hits.groupBy("repo_root", "path").agg(F.max_by("module", F.length("module")).alias("module"))
    return files.select("repo_root", "path").join(best, ["repo_root", "path"], "left").na.fill({"module": "."})
