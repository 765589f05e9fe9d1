"""Queries for importers: the findings of the tables, written as reports of other tools and read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import scalars as S
from evidra.plans.registry import FINDINGS_SQL, Registry, rows_of
from evidra.sources import reports
from evidra.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _located(spark, folder, *columns: Column | str) -> DataFrame:
    """Findings with a rule, a place and what else a report needs."""
    first = F.get("evidence", F.lit(0))
    rows = rows_of(
        spark, folder, "findings", "run_id", "rule_id", S.primary_path().alias("path"), first["start_line"].alias("line"), first["end_line"].alias("end_line"), *columns, where="rule_id is not null and rule_id != ''"
    )
    return rows.where("path != '' and line >= 1 and end_line >= line")


#: The same rows for SQL, with the level of a severity.
_L = FINDINGS_SQL + """l as (select id, run_id, rule_id, evidence[1].path as path, evidence[1].start_line as line, evidence[1].end_line as end_line, lower(trim(severity)) as level, title, summary, confidence, tags
 from f where rule_id <> '' and evidence[1].path <> '' and evidence[1].start_line >= 1 and evidence[1].end_line >= evidence[1].start_line), """
_CATEGORY = """case when regexp_matches({0}, 'security|no-eval|no-implied-eval') then 'security' when regexp_matches({0}, 'auth|password|secret') then 'auth' when regexp_matches({0}, 'unused|no-var|prefer-') then 'maintainability'
 when regexp_matches({0}, 'injection|xss') then 'security' when regexp_matches({0}, 'jwt') then 'auth' when regexp_matches({0}, 'sql|data') then 'data' else 'maintainability' end"""
_KEY = "regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def _flat(findings: DataFrame) -> DataFrame:
    """Findings as rows of plain values, each once."""
    e = F.get("evidence", F.lit(0))
    return findings.select(
        "id", "rule_id", "category", "severity", "confidence", "title", "summary", e["path"].alias("path"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line"),
        F.coalesce(F.array_join("tags", ","), F.lit("")).alias("tags"), F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
    ).distinct()


def _reports(rows: DataFrame, entry: Column, shape) -> DataFrame:
    """One report per run with the entries of its findings."""
    return rows.groupBy("run_id").agg(F.collect_list(entry).alias("_e")).select(F.to_json(shape(F.col("_e"))).alias("report"))


def _lint_reports(spark, folder) -> DataFrame:
    level = F.lower(F.trim("severity"))
    number = F.when(level.isin("high", "critical"), 2).when(level == "medium", 1).otherwise(0)
    rows = _located(spark, folder, number.alias("level"), "title")
    message = F.struct(F.lower("rule_id").alias("ruleId"), F.col("level").alias("severity"), F.coalesce("title", F.lit("")).alias("message"), "line", F.col("end_line").alias("endLine"))
    return _reports(rows, F.struct(F.col("path").alias("filePath"), F.array(message).alias("messages")), lambda e: e)


@query(_L + f"""q as (select distinct 'import-eslint-' || substr(sha256('eslint:' || lower(rule_id) || ':' || path || ':' || line), 1, 12) as id, 'ESLINT_' || replace(upper(rule_id), '-', '_') as rule_id, {_CATEGORY.format('lower(rule_id)')} as category,
 case when level in ('high', 'critical') then 'high' when level = 'medium' then 'medium' else 'low' end as severity, 0.9::double as confidence, lower(rule_id) as title, coalesce(title, '') as summary, path, line as start_line, end_line, '' as tags, '' as fingerprint from l) select * from q""")
def import_lint(spark, folder):
    """Lint reports as findings."""
    return _flat(reports.lint(_lint_reports(spark, folder)))


@query(_L + f"""q as (select distinct 'import-semgrep-' || substr(sha256('semgrep:' || lower(rule_id) || ':' || path || ':' || line), 1, 12) as id, 'SEMGREP_' || replace(upper(rule_id), '-', '_') as rule_id, {_CATEGORY.format('lower(rule_id)')} as category,
 case when level = 'critical' then 'critical' when level in ('high', 'warning') then 'high' else 'medium' end as severity, 0.85::double as confidence, lower(rule_id) as title, coalesce(summary, '') as summary, path, line as start_line, end_line,
 case when confidence > 0.8 then 'owasp-A01' else '' end as tags, '' as fingerprint from l) select * from q""")
def import_sast(spark, folder):
    """Scanner reports as findings."""
    rows = _located(spark, folder, "severity", "summary", "confidence")
    line = lambda c: F.struct(F.col(c).alias("line"))
    owasp = F.struct(F.when(F.col("confidence") > 0.8, "A01").alias("owasp"))
    extra = F.struct(F.coalesce("summary", F.lit("")).alias("message"), F.trim("severity").alias("severity"), owasp.alias("metadata"))
    entry = F.struct(F.lower("rule_id").alias("check_id"), "path", line("line").alias("start"), line("end_line").alias("end"), extra.alias("extra"))
    return _flat(reports.sast(_reports(rows, entry, lambda e: F.struct(e.alias("results")))))


def _sarif_reports(spark, folder) -> DataFrame:
    rows = _located(spark, folder, F.lower(F.trim("severity")).alias("level"), "title", "confidence", "tags")
    region = F.struct(F.col("line").alias("startLine"), F.col("end_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    level = F.when(F.col("level").isin("critical", "high"), "error").when(F.col("level") == "medium", "warning").otherwise("note")
    score = F.when(F.col("confidence") > 0.8, F.col("confidence") * 10).cast("string")
    properties = F.struct(score.alias("security-severity"), F.col("tags"))
    entry = F.struct(F.lower("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.coalesce("title", F.lit("")).alias("text")).alias("message"), properties.alias("properties"), F.array(place).alias("locations"),
                     F.struct(F.col("path").alias("primaryLocationLineHash")).alias("partialFingerprints"))
    return _reports(rows, entry, lambda e: F.struct(F.array(F.struct(F.struct(F.struct(F.lit("x").alias("name")).alias("driver")).alias("tool"), e.alias("results"))).alias("runs")))


_SARIF_SQL = """w as (select *, lower(rule_id) || coalesce(' ' || lower(array_to_string(tags, ' ')), '') as words from l),
q as (select distinct 'import-{tool}-' || substr(sha256('{tool}:' || lower(rule_id) || ':' || path || ':' || line), 1, 12) as id, '{TOOL}_' || {key} as rule_id,
 case when regexp_matches(words, 'auth|jwt|password') then 'auth' when regexp_matches(words, 'security|cwe|owasp|injection|xss') then 'security' else {category} end as category,
 case when confidence > 0.8 then case when confidence * 10 >= 9 then 'critical' else 'high' end when level in ('critical', 'high') then 'high' when level = 'medium' then 'medium' else 'low' end as severity, {confidence}::double as confidence, lower(rule_id) as title,
 coalesce(title, '') as summary, path, line as start_line, end_line, coalesce(array_to_string(list_sort(list_distinct(list_filter(tags, lambda t: t <> ''))), ','), '') as tags, substr(sha256(path), 1, 16) as fingerprint from w) select * from q"""


@query(_L + _SARIF_SQL.format(tool="sarif", TOOL="SARIF", key=_KEY.format("rule_id"), category=_CATEGORY.format("lower(rule_id)"), confidence="0.85"))
def import_sarif(spark, folder):
    """SARIF reports as findings."""
    return _flat(reports.sarif(_sarif_reports(spark, folder)))


@query(_L + _SARIF_SQL.format(tool="codeql", TOOL="CODEQL", key=_KEY.format("rule_id"), category=_CATEGORY.format("lower(rule_id)"), confidence="0.9"))
def import_codeql(spark, folder):
    """The same format under another tool's name."""
    return _flat(reports.sarif(_sarif_reports(spark, folder), "codeql"))


@query(_L + """q as (select distinct 2000 + length(path) as code, path, line, end_line, level, coalesce(title, '') as title from l)
select distinct 'import-tsc-' || substr(sha256('tsc:' || code || ':' || path || ':' || line), 1, 12) as id, 'TSC_TS' || code as rule_id, 'maintainability' as category, case when level in ('critical', 'high') then 'high' else 'medium' end as severity,
 0.95::double as confidence, 'TypeScript Error TS' || code as title, title as summary, path, line as start_line, end_line, '' as tags, '' as fingerprint from q""")
def import_compiler(spark, folder):
    """Type-checker reports as findings."""
    rows = _located(spark, folder, F.lower(F.trim("severity")).alias("level"), "title")
    at = lambda c: F.struct(F.col(c).alias("line"))
    category = F.when(F.col("level").isin("critical", "high"), "error").otherwise("warning")
    entry = F.struct((F.length("path") + 2000).alias("code"), category.alias("category"), F.coalesce("title", F.lit("")).alias("messageText"), F.col("path").alias("file"), at("line").alias("start"), at("end_line").alias("end"))
    return _flat(reports.compiler(_reports(rows, entry, lambda e: F.struct(e.alias("diagnostics")))))


@query("""with p as (select p_partkey, p_name, p_brand, p_size from part),
q as (select lower(replace(p_brand, '#', '-')) || '/' || p_partkey as package, * from p)
select 'import-npm-audit-' || substr(sha256('npm-audit:' || package || ':package-lock.json:1'), 1, 12) as id, 'NPM_AUDIT_' || regexp_replace(regexp_replace(upper(package), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as rule_id, 'security' as category,
 case when p_size % 4 = 0 then 'critical' when p_size % 4 = 1 then 'high' when p_size % 4 = 2 then 'medium' else 'low' end as severity, 0.95::double as confidence, 'Vulnerable dependency: ' || package as title,
 case when p_size % 3 = 0 then 'npm audit reported ' || (['critical', 'high', 'moderate', 'info'])[p_size % 4 + 1] || ' severity for ' || package || ' (<' || p_size || ')' else 'Issue of ' || p_name end as summary, 'package-lock.json' as path, null::int as start_line, null::int as end_line,
 case when p_size % 3 = 0 then '' else 'CWE-' || p_size || ',' end || case when p_size % 2 = 0 then 'direct-dependency' else 'transitive-dependency' end as tags, '' as fingerprint from q""")
def import_audit(spark, folder):
    """Dependency audits as findings (a report per brand, a package per part)."""
    package = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.col("p_partkey").cast("string"))
    size = F.col("p_size")
    level = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "moderate", "info")]), (size % 4 + 1).cast("int"))
    advisory = F.to_json(F.struct(F.concat(F.lit("Issue of "), "p_name").alias("title"), level.alias("severity"), F.array(F.concat(F.lit("CWE-"), size.cast("string"))).alias("cwe")))
    via = F.when(size % 3 == 0, F.concat(F.lit('["'), package, F.lit('"]'))).otherwise(F.concat(F.lit("["), advisory, F.lit("]")))
    head = F.to_json(F.struct(F.when(size % 3 == 0, level).alias("severity"), (size % 2 == 0).alias("isDirect"), F.concat(F.lit("<"), size.cast("string")).alias("range")))
    value = F.concat(F.expr("left({0}, length({0}) - 1)".replace("{0}", "head")), F.lit(',"via":'), "via", F.lit("}"))
    rows = table(spark, folder, "part").select("p_brand", package.alias("package"), head.alias("head"), via.alias("via"))
    member = F.concat(F.lit('"'), "package", F.lit('":'), value)
    made = rows.groupBy("p_brand").agg(F.concat(F.lit('{"vulnerabilities":{'), F.array_join(F.collect_list(member), ","), F.lit("}}")).alias("report"))
    return _flat(reports.audit(made))


@query("""with c as (select distinct id, repo_root || '/' || path as path, line_count as total, line_count * (size_bytes % 10) // 10 as covered, size_bytes % 7 as fns, size_bytes % 3 as fcov from files where line_count is not null and size_bytes is not null and path is not null),
p as (select path, 'lines' as part, total, covered from c where total > 0 union all select path, 'functions', fns, least(fcov, fns) from c where fns > 0),
r as (select *, covered / total::double as rate from p)
select 'import-coverage-' || substr(sha256('coverage:' || case part when 'lines' then 'low-coverage' else 'low-function-coverage' end || ':' || path || ':1'), 1, 12) as id, case part when 'lines' then 'COVERAGE_LOW_LINE_COVERAGE' else 'COVERAGE_LOW_FUNCTION_COVERAGE' end as rule_id,
 'testing' as category, case when part = 'lines' then case when rate < 0.3 then 'high' else 'medium' end else case when rate < 0.3 then 'medium' else 'low' end end as severity, 0.95::double as confidence,
 'Low ' || rtrim(part, 's') || ' coverage (' || round(rate * 100)::int || '%)' as title, 'File ' || path || ' has only ' || round(rate * 100)::int || '% ' || rtrim(part, 's') || ' coverage (' || covered || '/' || total || ' ' || part || ')' as summary,
 path, null::int as start_line, null::int as end_line, '' as tags, '' as fingerprint from r where rate < 0.5""")
def import_coverage(spark, folder):
    """Coverage summaries as findings (a report per repo)."""
    rows = rows_of(spark, folder, "files", "repo_root", "path", "line_count", "size_bytes", where="line_count is not null and size_bytes is not null and path is not null")
    part = lambda total, covered: F.struct(total.alias("total"), covered.alias("covered"))
    size = F.col("size_bytes")
    lines = part(F.col("line_count"), F.floor(F.col("line_count") * (size % 10) / 10))
    functions = part(size % 7, F.least(size % 3, size % 7))
    entry = F.struct(F.concat("repo_root", F.lit("/"), "path"), F.struct(lines.alias("lines"), functions.alias("functions")))
    made = rows.groupBy("repo_root").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("coverageMap"))).alias("report"))
    return _flat(reports.coverage(made))


@query("""select distinct 'import-test-' || substr(sha256('test:failed:unknown:' || case when event_id % 5 = 0 then 1 else event_id % 5 end), 1, 12) as id, 'TEST_FAILED' as rule_id, 'testing' as category, 'high' as severity, 1.0::double as confidence,
 'test ' || user_id as title, case when event_id % 2 = 0 then 'value ' || user_id else 'Test failed' end as summary, 'unknown' as path, case when event_id % 5 = 0 then 1 else event_id % 5 end::int as start_line, null::int as end_line, '' as tags, '' as fingerprint
 from events where event_type = 'error'""")
def import_tests(spark, folder):
    """Test reports as findings (a report per user; events that are errors are failed tests)."""
    status = F.when(F.col("event_type") == "error", "failed").otherwise("passed")
    message = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("value "), F.col("user_id").cast("string")))
    entry = F.struct(F.concat(F.lit("test "), F.col("user_id").cast("string")).alias("name"), status.alias("status"), (F.col("event_id") % 5).cast("int").alias("line"), message.alias("message"))
    made = table(spark, folder, "events").groupBy("user_id").agg(F.to_json(F.collect_list(entry)).alias("report"))
    return _flat(reports.tests(made))


@query("select count(*) as n_seen, count(*) filter (event_type = 'error') as n_findings, count(*) filter (event_type <> 'error') as n_dropped from events")
def import_inspection(spark, folder):
    """Entries seen, findings made of them and entries dropped, for the test reports."""
    status = F.when(F.col("event_type") == "error", "failed").otherwise("passed")
    made = table(spark, folder, "events").groupBy("user_id").agg(F.to_json(F.collect_list(F.struct(status.alias("status"), F.lit("a").alias("file")))).alias("report"))
    return reports.inspect(made, reports.tests(made), F.json_array_length("report"))


@query(_L + """q as (select 'import-eslint-' || substr(sha256('eslint:' || lower(rule_id) || ':' || path || ':' || line), 1, 12) as id from l),
g as (select id, count(*) as n from q group by id) select 'kept' as outcome, count(*) as n from g union all select 'duplicate_id', sum(n - 1)::bigint from g having sum(n - 1) > 0""")
def import_normalised(spark, folder):
    """Findings that an import takes over, and the others by diagnostic."""
    found = reports.lint(_lint_reports(spark, folder))
    good, bad = reports.normalise(found, ["title", "summary", "severity"])
    return good.select(F.lit("kept").alias("outcome")).unionByName(bad.select(F.col("diagnostic").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query(_L + """a as (select 'import-eslint-' || substr(sha256('eslint:' || lower(rule_id) || ':' || path || ':' || line), 1, 12) as id, 'eslint' as tool from l union all
 select 'import-sarif-' || substr(sha256('sarif:' || lower(rule_id) || ':' || path || ':' || line), 1, 12), 'sarif' from l)
 select tool, count(distinct id) as n from a group by tool""")
def import_union(spark, folder):
    """What an import of two tools takes over, by tool."""
    found = reports.merged([reports.lint(_lint_reports(spark, folder)), reports.sarif(_sarif_reports(spark, folder))])
    return found.groupBy("upstream.tool").agg(F.count("*").alias("n"))


@query(_L + """a as (select 'import-eslint-' || substr(sha256('eslint:' || lower(rule_id) || ':' || path || ':' || line), 1, 12) as id from l) select id, 'eslint' as tools, count(*) as n from a group by id having count(*) > 1""")
def import_repeated_ids(spark, folder):
    """Ids that an import would have to refuse."""
    return reports.repeated_ids(reports.lint(_lint_reports(spark, folder))).select("id", F.array_join("tools", ",").alias("tools"), "n")
