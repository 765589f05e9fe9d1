"""Queries for artifacts: query domains over JSON documents, exports, provenance, scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators import exports, query_dsl
from evidra.plans.registry import FILES_SQL, FINDINGS_SQL, Registry, rows_of
from evidra.sources import config, filesystem
from evidra.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _records(spark, folder: str) -> DataFrame:
    """The lines of artifact records as JSON artifacts, each once."""
    rows = table(spark, folder, "artifact_records").select("file_id", "line_no", "payload").where("payload is not null")
    file = F.concat("file_id", F.lit(":"), F.col("line_no").cast("string"))
    return rows.select(file.alias("file"), F.sha2("payload", 256).alias("hash"), F.try_parse_json("payload").alias("document")).where("document is not null")


_R = "with a as (select distinct file_id || ':' || line_no as file, sha256(payload) as hash, payload from artifact_records where payload is not null and json_valid(payload)), "
_NUM = "case json_type(payload, '$.durationMs') when 'NULL' then 0.0 when 'VARCHAR' then case when trim(payload ->> '$.durationMs') = '' then 0.0 else try_cast(trim(payload ->> '$.durationMs') as double) end when 'BOOLEAN' then null when 'OBJECT' then null when 'ARRAY' then null else try_cast(payload ->> '$.durationMs' as double) end"


@query(_R + f"q as (select 'artifact:' || file as id, file as locator, hash as source_hash from a where coalesce({_NUM} <= 500000, false)) select * from q")
def query_artifact_number(spark, folder):
    """``artifact where durationMs <= 500000``: a JSON null counts as 0, a missing value as none."""
    return query_dsl.artifact_matches(_records(spark, folder), "artifact where durationMs <= 500000").select("id", "locator", "source_hash").distinct()


@query(_R + "q as (select 'artifact:' || file as id from a where coalesce(payload ->> '$.tool.version', '') <> '1.0' or json_type(payload, '$.tool.version') = 'BOOLEAN') select * from q")
def query_artifact_text(spark, folder):
    """``artifact where tool.version != x1.0``-like comparison of texts, where null and missing are empty."""
    return query_dsl.artifact_matches(_records(spark, folder), "artifact where tool.version != '1.0'").select("id").distinct()


_NESTED = "with a as (select distinct record_id as file, sha256(payload) as hash, payload from nested_artifacts where payload is not null and json_valid(payload) and json_type(payload, '$.findings') = 'ARRAY'), i as (select file, hash, u.place, u.f from a, lateral (select unnest(json_extract(payload, '$.findings[*]')) as f, generate_subscripts(json_extract(payload, '$.findings[*]'), 1) as place) u), "


@query(_NESTED + """h as (select *, row_number() over (partition by file order by place) - 1 as n from i where json_type(f, '$.severity') = 'VARCHAR' and lower(trim(f ->> '$.severity')) in ('high', 'critical'))
 select case when json_type(f, '$.id') = 'VARCHAR' then f ->> '$.id' else 'finding:' || n end as id, file as source_artifact, file || '#findings/' || n as locator, hash as source_hash from h""")
def query_finding_documents(spark, folder):
    """``finding where severity >= high`` over the findings of JSON documents; locators count answers."""
    rows = table(spark, folder, "nested_artifacts").where("payload is not null").select(F.col("record_id").alias("file"), F.sha2("payload", 256).alias("hash"), F.try_parse_json("payload").alias("document"))
    return query_dsl.artifact_matches(rows.where("document is not null"), "finding where severity >= high").select("id", "source_artifact", "locator", "source_hash").distinct()


@query("select distinct 'baseline:' || run_id as id, run_id || '#baseline' as locator, cast(finding_count as varchar) as value from runs where finding_count > 3")
def query_baseline(spark, folder):
    """``baseline where count > 3`` over documents with a baseline."""
    baseline = F.struct(F.struct(F.col("finding_count").alias("count"), "branch").alias("baseline"))
    rows = table(spark, folder, "runs").select(F.col("run_id").alias("file"), F.lit("h").alias("hash"), F.parse_json(F.to_json(baseline)).alias("document"))
    return query_dsl.artifact_matches(rows, "baseline where count > 3").select("id", "locator", "value").distinct()


# -- exports
_COUNTS = FINDINGS_SQL + "c as (select run_id, count(*) filter (lower(trim(severity)) = 'critical') as c, count(*) filter (lower(trim(severity)) = 'high') as h, count(*) as n from f group by run_id), "


@query(_COUNTS + "q as (select run_id, case when c > 0 then 'blocked_input' when h > 0 then 'warning' else 'passed' end as status, case when c > 0 then 'block' when h > 0 then 'hold' else 'pass' end as hint, case when c + h > 0 then c || ' critical, ' || h || ' high severity findings' else 'All static analysis checks passed' end as summary, n as n_signals from c) select * from q")
def export_static_results(spark, folder):
    """The result of each run for a downstream gate."""
    return exports.static_results(rows_of(spark, folder, "findings", "run_id", "severity"), "run_id")


@query(FINDINGS_SQL + "q as (select 'signal-' || id as id, id as finding_id, array_to_string(list_transform(coalesce(evidence, []), lambda e: coalesce(e.path, '') || ':' || case when coalesce(e.start_line, 0) = 0 then '?' else e.start_line::varchar end), ',') as evidence from f) select * from q")
def export_signals(spark, folder):
    """A signal per finding with its places."""
    rows = exports.signals(table(spark, folder, "findings"))
    return rows.select("id", "finding_id", F.array_join("evidence", ",").alias("evidence")).dropDuplicates(["id"])


@query(_COUNTS + "q as (select run_id, case when c > 0 then 'blocked_input' when h > 0 then 'needs_review' else 'passed' end as status, array_to_string(list_filter([case when c > 0 then 'BLOCKING_SEVERITY_CRITICAL:' || c end, case when h > 0 then 'BLOCKING_SEVERITY_HIGH:' || h end], lambda x: x is not null), ';') as failed_conditions, c + h > 0 as needs_people from c) select * from q")
def export_state_evidence(spark, folder):
    """Readiness of each run with its failed conditions."""
    rows = exports.state_evidence(rows_of(spark, folder, "findings", "run_id", "severity"), "run_id")
    return rows.select("run_id", "status", F.array_join("failed_conditions", ";").alias("failed_conditions"), "needs_people")


@query(_COUNTS + "q as (select run_id, case when c > 0 then 'blocked_input' when h > 0 then 'needs_review' else 'passed' end as status, c as critical_count, h as high_count, c + h > 0 as needs_review from c) select * from q")
def export_workflow_evidence(spark, folder):
    """Status and counts of each run for a workflow."""
    return exports.workflow_evidence(rows_of(spark, folder, "findings", "run_id", "severity"), "run_id")


@query(FINDINGS_SQL + "q as (select 'seed-' || id as id, coalesce(title, '') as title, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(evidence, []), lambda e: e.path), lambda p: p <> ''))), ',') as paths from f where lower(trim(severity)) in ('critical', 'high')) select * from q")
def export_manual_seeds(spark, folder):
    """What to test by hand."""
    rows = exports.manual_seeds(table(spark, folder, "findings"))
    return rows.select("id", F.coalesce("title", F.lit("")).alias("title"), F.array_join("paths", ",").alias("paths")).dropDuplicates(["id"])


@query(_COUNTS + """m as (select run_id, id as name, sha256(coalesce(title, '')) as s from f), l as (select run_id, count(*) as n, sha256(string_agg(name || ':' || s, ',' order by name)) as h from m group by run_id),
 q as (select c.run_id, case when c > 0 then 'blocked_input' when c.h > 0 then 'needs_review' else 'passed' end as status, array_to_string(list_filter([case when c > 0 then 'BLOCKING_SEVERITY_CRITICAL:' || c end, case when c.h > 0 then 'BLOCKING_SEVERITY_HIGH:' || c.h end], lambda x: x is not null), ';') as failed_conditions, cast(l.n as int) as n_artifacts, l.h as artifacts_hash from c join l using (run_id)) select * from q""")
def export_gate_input(spark, folder):
    """One row per run for a gate, with a hash over its artifacts (its findings)."""
    rows = rows_of(spark, folder, "findings", "run_id", "severity", F.sha2(F.coalesce("title", F.lit("")), 256).alias("sha256"))
    return exports.gate_input(rows, rows.select("run_id", F.col("id").alias("name"), "sha256"), "run_id")


@query(FINDINGS_SQL + r"""p as (select id, 'finding-' || coalesce(nullif(regexp_replace(regexp_replace(lower(id), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'entry') as anchor, evidence[1].start_line as line, run_id from f)
 select 'prov-' || substr(sha256('viewer|report.html#' || anchor || '|findings.json|' || id || '|' || coalesce(line::varchar, '') || '|' || anchor), 1, 12) as id, 'viewer' as surface, 'report.html#' || anchor as locator, 'sha256:' || sha256(run_id) as artifact_hash, id as source_id from p""")
def provenance_viewer(spark, folder):
    """Provenance of the findings of a report page."""
    rows = exports.viewer_entries(table(spark, folder, "findings"), "report.html", "findings.json", F.sha2("run_id", 256))
    return rows.dropDuplicates(["source_id"])


@query(FINDINGS_SQL + """p as (select run_id, id, rule_id, coalesce(evidence[1].path, 'unknown') as uri, evidence[1].start_line as line, row_number() over (partition by run_id order by id) - 1 as j from f),
 q as (select *, 'results.sarif#/runs/0/results/' || j as locator, case when length(id) % 2 = 0 then id else coalesce(rule_id, 'sarif') || ':' || uri || ':' || coalesce(line::varchar, '?') end as sid from p)
 select 'prov-' || substr(sha256('sarif|' || locator || '|results.sarif|' || sid || '|' || coalesce(line::varchar, '') || '|' || uri), 1, 12) as id, 'sarif' as surface, locator, 'sha256:' || run_id as artifact_hash, sid as source_id from q""")
def provenance_sarif(spark, folder):
    """Provenance of the results of SARIF reports, one report a run."""
    rows = rows_of(spark, folder, "findings", "run_id", "rule_id", F.get("evidence", F.lit(0))["path"].alias("path"), F.get("evidence", F.lit(0))["start_line"].alias("line"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    own = F.struct(F.when(F.length("id") % 2 == 0, F.col("id")).alias("findingId"))
    result = F.struct("id", F.struct(F.col("rule_id").alias("ruleId"), own.alias("partialFingerprints"), F.array(place).alias("locations")).alias("r"))
    listed = rows.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(result)), lambda x: x["r"]).alias("results"))
    return exports.sarif_entries(listed.select(F.col("run_id").alias("hash"), F.to_json(F.struct(F.array(F.struct("results")).alias("runs"))).alias("report")))


@query(r"""with d as (select walk_id, repo_root, coalesce(len(reasons), 0) as n, reasons[1] as r from directory_walks), p as (select distinct walk_id as item_id, coalesce(repo_root, '') as title, case when n > 0 then r else walk_id end as sid from d where r is not null or n = 0),
 q as (select *, 'pack.html#' || coalesce(nullif(regexp_replace(regexp_replace(lower(item_id), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'entry') as locator, coalesce(nullif(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'entry') as anchor from p)
 select 'prov-' || substr(sha256('release-pack|' || locator || '|pack.json|' || sid || '||' || anchor), 1, 12) as id, 'release-pack' as surface, locator, 'sha256:h' as artifact_hash, sid as source_id from q""")
def provenance_items(spark, folder):
    """Provenance of the entries of a release pack (a walk each, its first reason as source)."""
    rows = table(spark, folder, "directory_walks").where("size(reasons) <= 0 or reasons is null or reasons[0] is not null").select(
        F.col("walk_id").alias("item_id"), F.coalesce("repo_root", F.lit("")).alias("title"), F.col("reasons").alias("sources"), F.lit("pack.json").alias("path"), F.lit("h").alias("hash")
    ).distinct()
    return exports.item_entries(rows, "release-pack", "pack.html")


# -- scans
_LIMITS = {"max_file_bytes": 3000, "max_total_bytes": 8000, "max_files": 12, "max_depth": 3}


def _scanned(spark, folder: str) -> DataFrame:
    files = rows_of(spark, folder, "files", "repo_root", "path", "size_bytes", where="path is not null")
    return filesystem.bounded(files.where(~filesystem.is_ignored("path") & filesystem.is_target("path")), by=["repo_root"], **_LIMITS)


_SCAN = FILES_SQL + "w as (select id, repo_root, path, size_bytes from fi where path is not null and len(list_filter(string_split(path, '/'), lambda s: list_contains([" + ", ".join(f"'{x}'" for x in filesystem.IGNORED) + """], s) or starts_with(s, '.test-temp'))) = 0
 and regexp_matches(path, '\\.(ts|tsx|js|jsx|py|rb|go|rs|java|php|cs|cpp|cc|cxx|hpp|hxx|mjs|cjs|json|yaml|yml|md)$') and not ends_with(path, '.d.ts')), a as (select *, case when len(string_split(path, '/')) - 1 > 3 then 'MAX_DEPTH_EXCEEDED' end as r0 from w),
 b as (select *, count(*) filter (r0 is null) over (partition by repo_root order by path rows unbounded preceding) as n from a), c as (select *, coalesce(r0, case when n > 12 then 'MAX_FILES_EXCEEDED' when size_bytes > 3000 then 'MAX_FILE_SIZE_EXCEEDED' end) as r1 from b),
 d as (select *, sum(case when r1 is null then coalesce(size_bytes, 0) else 0 end) over (partition by repo_root order by path rows unbounded preceding) as t from c), s as (select id, repo_root, size_bytes, coalesce(r1, case when t > 8000 then 'MAX_TOTAL_BYTES_EXCEEDED' end) as skipped from d), """


@query(_SCAN + "q as (select id, coalesce(skipped, '') as skipped from s) select * from q")
def bounded_scan(spark, folder):
    """What a bounded scan of each repo takes, and why it leaves the rest."""
    return _scanned(spark, folder).select("id", F.coalesce("skipped", F.lit("")).alias("skipped"))


@query(_SCAN + """q as (select repo_root, count(skipped) > 0 as partial_walk, coalesce(array_to_string(list_sort(list(distinct skipped) filter (skipped is not null)), ','), '') as reasons, count(*) filter (skipped is null or skipped not in ('MAX_DEPTH_EXCEEDED', 'MAX_FILES_EXCEEDED')) as visited_files,
 cast(coalesce(sum(size_bytes) filter (skipped is null), 0) as bigint) as accepted_bytes, count(skipped) as skipped_files from s group by repo_root) select * from q""")
def scan_summary(spark, folder):
    """The summary of each scan."""
    rows = filesystem.walk_summary(_scanned(spark, folder), ["repo_root"])
    return rows.withColumn("reasons", F.array_join("reasons", ","))


@query("""with o as (select repo_root, row_number() over (partition by repo_root order by path) as line, path, length(path) as n from (select distinct repo_root, path from files where path is not null)) select repo_root, cast(line as int) as line,
 case when n % 7 = 0 then '!' else '' end || path as pattern, case when n % 7 <> 0 and n % 5 <> 0 then '@a,@b' when n % 7 <> 0 then 'EMPTY_OWNERS' else 'UNSUPPORTED_PATTERN' end as outcome from o where not contains(path, ' ')""")
def owner_file_rules(spark, folder):
    """Ownership files (a line per path) as rules and diagnostics."""
    n = F.length("path")
    text = F.concat(F.when(n % 7 == 0, "!").otherwise(""), "path", F.when(n % 5 == 0, "").otherwise("  @a @b"))
    rows = table(spark, folder, "files").where("path is not null").select("repo_root", "path", text.alias("t")).distinct()
    made = rows.groupBy("repo_root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "t"))), lambda x: x["t"]), "\r\n").alias("content"))
    rules, bad = config.owner_rules(made.select("repo_root", F.lit("CODEOWNERS").alias("path"), "content"))
    numbered = made.select("repo_root", F.posexplode(F.split("content", "\r\n")).alias("i", "t")).select("repo_root", (F.col("i") + 1).alias("line"), F.split("t", " ")[0].alias("pattern"))
    good = rules.select("repo_root", "line", "pattern", F.array_join("owners", ",").alias("outcome"))
    return good.unionByName(bad.join(numbered, ["repo_root", "line"]).select("repo_root", "line", "pattern", F.col("code").alias("outcome")))
