"""Gates over findings: buckets by precedence, reasons, ordered rules, and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.scalars import severity_rank


def ordered_rules(rules: list[tuple[Column, str]]) -> Column:
    """Outcome of rules in order: ``allow`` ends the search, ``block`` outweighs ``hold``; null if none applies.

    Rules behind the first ``allow`` that applies aren't looked at; it doesn't undo what came before.
    """
    blocked, held, stopped = F.lit(False), F.lit(False), F.lit(False)
    for condition, action in rules:
        hit = F.coalesce(condition, F.lit(False)) & ~stopped
        if action == "block":
            blocked = blocked | hit
        elif action == "hold":
            held = held | hit
        else:
            stopped = stopped | hit
    return F.when(blocked, "block").when(held, "hold").when(stopped, "allow")


def bucket(
    findings: DataFrame, block_severities: list[str], block_categories: list[str], block_rules: list[str], least_confidence: float, rules: list[tuple[Column, str]], suppressed: Column
) -> DataFrame:
    """``findings`` with ``bucket`` and ``reasons``.

    Precedence: suppressed, low confidence, blocked (by severity, by rule for high and critical
    findings, by category, by the ordered rules), held, passed. Null confidence counts as high.
    """
    outcome = ordered_rules(rules)
    severe = severity_rank("severity") >= 3
    level = F.lower(F.trim("severity"))
    reasons = F.array_compact(
        F.array(
            F.when(level.isin(block_severities), F.concat(F.lit("severity:"), level)),
            F.when(F.col("rule_id").isin(block_rules) & severe, F.concat(F.lit("rule:"), F.col("rule_id"))),
            F.when(F.col("category").isin(block_categories), F.concat(F.lit("category:"), F.col("category"))),
            F.when(outcome == "block", F.lit("rules")),
        )
    )
    low = F.coalesce(F.col("confidence") < least_confidence, F.lit(False))
    value = (
        F.when(F.coalesce(suppressed, F.lit(False)), "suppressed").when(low, "low_confidence").when(F.size("reasons") > 0, "blocked")
        .when(outcome == "hold", "held").otherwise("passed")
    )
    return findings.withColumn("reasons", reasons).withColumn("bucket", value)


def status(buckets: DataFrame, by: list[str], limits: dict[str, int]) -> DataFrame:
    """A status per group: blocked, over a limit of a severity (strictly), held, or passed; with counts."""
    level = F.lower(F.trim("severity"))
    open_row = F.col("bucket") != "suppressed"
    counts = buckets.groupBy(*by).agg(
        *[F.count_if(F.col("bucket") == b).alias(f"n_{b}") for b in ("blocked", "held", "low_confidence", "suppressed", "passed")],
        *[F.count_if((level == s) & open_row).alias(f"_{s}") for s in limits],
    )
    over = F.lit(False)
    for name, most in limits.items():
        over = over | (F.col(f"_{name}") > most)
    value = F.when(F.col("n_blocked") > 0, "blocked").when(over, "over_limit").when(F.col("n_held") > 0, "held").otherwise("passed")
    return counts.withColumn("status", value).drop(*[f"_{s}" for s in limits])


def condition(when: dict, baseline: Column | None = None, evidence: Column | None = None) -> Column:
    """The condition of a rule as policies write it: all that is given must hold.

    ``severity``, ``category`` and ``ruleId`` are a value or a list of values; ``baseline`` and ``manualEvidence`` ask whether the finding is known
    there (the flags of the row, ``False`` if there are none). A rule without any test holds for every finding.
    """
    columns = {"severity": F.lower(F.trim("severity")), "category": F.col("category"), "ruleId": F.col("rule_id")}
    flags = {"baseline": baseline, "manualEvidence": evidence}
    out = F.lit(True)
    for name, wanted in when.items():
        if name in columns:
            out = out & columns[name].isin(*(wanted if isinstance(wanted, list) else [wanted]))
        elif name in flags:
            known = F.lit(False) if flags[name] is None else F.coalesce(flags[name], F.lit(False))
            out = out & (known == F.lit(bool(wanted)))
        else:
            raise ValueError(f"unknown test: {name}")
    return F.coalesce(out, F.lit(False))


def rules_of(policy: dict, baseline: Column | None = None, evidence: Column | None = None) -> list[tuple[Column, str]]:
    """The ordered rules of a policy (``dsl.rules``) for ``ordered_rules``."""
    return [(condition(r.get("when") or {}, baseline, evidence), r["action"]) for r in (policy.get("dsl") or {}).get("rules") or []]
