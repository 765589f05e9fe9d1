"""Findings for other tools, and manifests that bind artifacts to their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.scalars import primary_path


def sarif_rows(findings: DataFrame) -> DataFrame:
    """``run_id, result``: one SARIF result per finding as JSON; critical and high are errors, medium warnings, else notes.

    Results stay rows: a report of any size is written by the tasks, and no run is gathered in one row.
    """
    level = F.lower(F.trim("severity"))
    first = F.get("evidence", F.lit(0))
    result = F.struct(
        F.col("rule_id").alias("ruleId"),
        F.when(level.isin("critical", "high"), "error").when(level == "medium", "warning").otherwise("note").alias("level"),
        F.struct(F.coalesce("title", F.lit("")).alias("text")).alias("message"),
        F.array(F.struct(F.struct(F.struct(primary_path().alias("uri")).alias("artifactLocation"), F.struct(F.coalesce(first["start_line"], F.lit(1)).alias("startLine")).alias("region")).alias("physicalLocation"))).alias("locations"),
    )
    return findings.select("id", "run_id", F.to_json(result).alias("result"))


def verdicts(findings: DataFrame, by: str) -> DataFrame:
    """A verdict per group: ``blocked_input`` with a critical finding, ``hold`` with a high one, else ``passed``."""
    level = F.lower(F.trim("severity"))
    n = lambda s: F.count_if(level == s)
    return findings.groupBy(by).agg(F.when(n("critical") > 0, "blocked_input").when(n("high") > 0, "hold").otherwise("passed").alias("verdict"), F.count("*").alias("n_signals"))


def manifest(artifacts: DataFrame, name: str, content: str) -> DataFrame:
    """``name, sha256, n_bytes`` of each artifact; without content the hash is null and the size 0."""
    return artifacts.select(F.col(name).alias("name"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.coalesce(F.octet_length(content), F.lit(0)).alias("n_bytes"))


def check_manifest(listed: DataFrame, actual: DataFrame) -> DataFrame:
    """``name, state`` against a manifest: ok, changed, missing or unlisted."""
    a, b = listed.select("name", F.col("sha256").alias("_l"), F.lit(1).alias("_in")), actual.select("name", F.col("sha256").alias("_a"), F.lit(1).alias("_there"))
    state = F.when(F.col("_there").isNull(), "missing").when(F.col("_in").isNull(), "unlisted").when(F.col("_l").eqNullSafe(F.col("_a")), "ok").otherwise("changed")
    return a.join(b, "name", "full").select("name", state.alias("state"))


def _by_severity(by: str, findings: DataFrame) -> DataFrame:
    level = F.lower(F.trim("severity"))
    return findings.groupBy(by).agg(F.count_if(level == "critical").alias("critical"), F.count_if(level == "high").alias("high"), F.count("*").alias("total"))


def static_results(findings: DataFrame, by: str) -> DataFrame:
    """Per group a status (``blocked_input``, ``warning``, ``passed``) with a hint for a gate and a summary."""
    rows = _by_severity(by, findings)
    c, h = F.col("critical") > 0, F.col("high") > 0
    text = F.concat(F.col("critical").cast("string"), F.lit(" critical, "), F.col("high").cast("string"), F.lit(" high severity findings"))
    return rows.select(
        by, F.when(c, "blocked_input").when(h, "warning").otherwise("passed").alias("status"), F.when(c, "block").when(h, "hold").otherwise("pass").alias("hint"),
        F.when(c | h, text).otherwise("All static analysis checks passed").alias("summary"), F.col("total").alias("n_signals"),
    )


def signals(findings: DataFrame) -> DataFrame:
    """``id, finding_id, evidence`` of each finding: the places of its evidence, an unknown line as ``?``."""
    place = F.transform("evidence", lambda e: F.concat(F.coalesce(e["path"], F.lit("")), F.lit(":"), F.coalesce(F.nullif(e["start_line"], F.lit(0)).cast("string"), F.lit("?"))))
    return findings.select(F.concat(F.lit("signal-"), "id").alias("id"), F.col("id").alias("finding_id"), F.coalesce(place, F.array().cast("array<string>")).alias("evidence"))


def state_evidence(findings: DataFrame, by: str) -> DataFrame:
    """Per group the readiness (``blocked_input``, ``needs_review``, ``passed``), failed conditions with their counts, and whether people must look."""
    rows = _by_severity(by, findings)
    failed = F.array_compact(F.array(
        F.when(F.col("critical") > 0, F.concat(F.lit("BLOCKING_SEVERITY_CRITICAL:"), F.col("critical").cast("string"))), F.when(F.col("high") > 0, F.concat(F.lit("BLOCKING_SEVERITY_HIGH:"), F.col("high").cast("string"))),
    ))
    status = F.when(F.col("critical") > 0, "blocked_input").when(F.col("high") > 0, "needs_review").otherwise("passed")
    return rows.select(by, status.alias("status"), failed.alias("failed_conditions"), (F.size(failed) > 0).alias("needs_people"))


def workflow_evidence(findings: DataFrame, by: str) -> DataFrame:
    """Per group the status with the counts of severe findings."""
    rows = _by_severity(by, findings)
    status = F.when(F.col("critical") > 0, "blocked_input").when(F.col("high") > 0, "needs_review").otherwise("passed")
    return rows.select(by, status.alias("status"), F.col("critical").alias("critical_count"), F.col("high").alias("high_count"), ((F.col("critical") > 0) | (F.col("high") > 0)).alias("needs_review"))


def manual_seeds(findings: DataFrame) -> DataFrame:
    """``id, title, paths`` of severe findings: what to test by hand, and where."""
    severe = findings.where(F.lower(F.trim("severity")).isin("critical", "high"))
    paths = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.transform("evidence", lambda e: e["path"]), F.array().cast("array<string>")), lambda p: p != "")))
    return severe.select(F.concat(F.lit("seed-"), "id").alias("id"), "title", paths.alias("paths"))


def gate_input(findings: DataFrame, manifests: DataFrame, by: str) -> DataFrame:
    """Per group one row for a gate: status, counts, and the artifacts (``by, name, sha256``) with one hash over them, by name."""
    listed = manifests.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("name", "sha256"))).alias("_m"))
    line = F.transform("_m", lambda m: F.concat_ws(":", m["name"], m["sha256"]))
    rows = state_evidence(findings, by).join(listed.select(by, F.size("_m").alias("n_artifacts"), F.sha2(F.array_join(line, ","), 256).alias("artifacts_hash")), by, "left")
    return rows.select(by, "status", F.array_join("failed_conditions", ";").alias("failed_conditions"), F.coalesce("n_artifacts", F.lit(0)).alias("n_artifacts"), F.coalesce("artifacts_hash", F.lit("")).alias("artifacts_hash"))


def anchor(text: Column | str) -> Column:
    """A text as an anchor: letters and digits in lower case with dashes between; ``entry`` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("entry"))


def provenance(rows: DataFrame, surface: str) -> DataFrame:
    """Provenance entries of a surface from ``locator, path, hash, source_id, line, anchor`` (line and anchor may be null)."""
    key = F.concat_ws("|", F.lit(surface), "locator", "path", "source_id", F.coalesce(F.col("line").cast("string"), F.lit("")), F.coalesce("anchor", F.lit("")))
    return rows.select(F.concat(F.lit("prov-"), F.substring(F.sha2(key, 256), 1, 12)).alias("id"), F.lit(surface).alias("surface"), "locator", F.concat(F.lit("sha256:"), "hash").alias("artifact_hash"), "source_id")


def viewer_entries(findings: DataFrame, report: str, path: str, digest: Column) -> DataFrame:
    """An entry per finding of a report page."""
    place = F.concat(F.lit("finding-"), anchor("id"))
    return provenance(findings.select(
        F.concat(F.lit(f"{report}#"), place).alias("locator"), F.lit(path).alias("path"), digest.alias("hash"), F.col("id").alias("source_id"), F.get("evidence", F.lit(0))["start_line"].alias("line"), place.alias("anchor")), "viewer")


_SARIF_ENTRIES = "struct<runs:array<struct<results:array<struct<ruleId:string,partialFingerprints:struct<findingId:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>"


def sarif_entries(reports: DataFrame) -> DataFrame:
    """An entry per result of SARIF reports (``report, hash``), with the places of run and result."""
    runs = reports.select("hash", F.posexplode(F.from_json("report", _SARIF_ENTRIES)["runs"]).alias("i", "run"))
    rows = runs.select("hash", "i", F.posexplode("run.results").alias("j", "r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    uri, line = F.coalesce(place["artifactLocation"]["uri"], F.lit("unknown")), place["region"]["startLine"]
    own = F.coalesce("r.partialFingerprints.findingId", F.concat_ws(":", F.coalesce("r.ruleId", F.lit("sarif")), uri, F.coalesce(line.cast("string"), F.lit("?"))))
    locator = F.concat(F.lit("results.sarif#/runs/"), F.col("i").cast("string"), F.lit("/results/"), F.col("j").cast("string"))
    return provenance(rows.select(locator.alias("locator"), F.lit("results.sarif").alias("path"), "hash", own.alias("source_id"), line.alias("line"), uri.alias("anchor")), "sarif")


def item_entries(items: DataFrame, surface: str, page: str) -> DataFrame:
    """An entry per item (``item_id, title, sources, path, hash``) of a review comment or a release pack; the first source names it."""
    own = F.coalesce(F.get("sources", F.lit(0)), F.col("item_id"))
    return provenance(items.select(F.concat(F.lit(f"{page}#"), anchor("item_id")).alias("locator"), "path", "hash", own.alias("source_id"), F.lit(None).cast("int").alias("line"), anchor("title").alias("anchor")), surface)
