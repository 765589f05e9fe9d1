"""Queries over lines of sources, snapshots of files, plugins, and the remaining joins and summaries."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions import scalars
from evidra.operators import diffs, plugins, rule_engine, text_rules
from evidra.plans import reference_queries, rules_queries
from evidra.plans.registry import FILES_SQL, FINDINGS_SQL, Registry, rows_of
from evidra.sources import artifacts, sinks
from evidra.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

_L = FILES_SQL + r"s as (select id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) as ls from fi where content is not null), l as (select id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from s), "


@query(_L + r"q as (select id, line_no, line, coalesce(lead(line) over (partition by id order by line_no), '') as nxt from l) select id, cast(line_no as int) as line_no from q where regexp_matches(line, 'limit') and not regexp_matches(line, '[0-9]') and not regexp_matches(nxt, '[0-9]')")
def next_line_default(spark, folder):
    """Lines that name a limit where neither they nor the next line hold a number."""
    return text_rules.without_default(table(spark, folder, "files"), "limit", "[0-9]").distinct()


@query(_L + "m as (select *, case when regexp_matches(line, '^>>>>>>> ') then 0 when regexp_matches(line, '^<<<<<<< ') then 1 end as st from l), w as (select *, last_value(st ignore nulls) over (partition by id order by line_no rows unbounded preceding) as ins from m) select id, cast(line_no as int) as line_no, line from w where st is null and ins = 1")
def marker_regions(spark, folder):
    """Lines between conflict markers."""
    return text_rules.regions(table(spark, folder, "files"), "^<<<<<<< ", "^>>>>>>> ")


@query(_L + "b as (select *, sum(case when regexp_matches(line, '^(def|class|func|function|export|public) ') then 1 else 0 end) over (partition by id order by line_no rows unbounded preceding) as block from l) select id, cast(block as bigint) as block, cast(min(line_no) as int) as first_line, count(*) as n_lines from b where block > 0 group by id, block")
def line_blocks(spark, folder):
    """Blocks of lines that declarations start."""
    return text_rules.blocks(table(spark, folder, "files"), "^(def|class|func|function|export|public) ")


def _branches_sql(opener: str) -> str:
    return _L + f"""o as (select distinct id from s where len(list_filter(ls, x -> true)) > 0), d as (select *, sum(length(line) - length(replace(line, '{{', '')) - (length(line) - length(replace(line, '}}', '')))) over (partition by id order by line_no rows unbounded preceding) as depth from l),
 e as (select *, coalesce(lag(depth) over (partition by id order by line_no), 0) as before, max(line_no) over (partition by id) as last_line from d), st as (select * from e where regexp_matches(line, '{opener}') and contains(line, '{{') and depth > before)
 select st.id, cast(st.line_no as int) as start_line, cast(coalesce((select min(d.line_no) from d where d.id = st.id and d.line_no > st.line_no and d.depth <= st.before), st.last_line) as int) as end_line from st""".replace("o as (select distinct id from s where len(list_filter(ls, x -> true)) > 0), ", "")


@query(_branches_sql(r"\b(if|switch)\b"))
def conditional_blocks(spark, folder):
    """Branches with the lines they span."""
    return text_rules.branch_blocks(table(spark, folder, "files"), r"\b(if|switch)\b")


@query(_branches_sql(r"\b(for|while)\b"))
def loop_blocks(spark, folder):
    """Loops with the lines they span."""
    return text_rules.branch_blocks(table(spark, folder, "files"), r"\b(for|while)\b")


@query(_L + "n as (" + " union all ".join(f"select id, '{k}' as kind, regexp_extract(line, '{p}', 1) as name, cast(line_no as int) as line_no from l" for k, p in text_rules.FLOW_LINES.items()) + ") select distinct id, kind, name, line_no, substr(sha256(id || ':' || kind || ':' || name || ':' || line_no), 1, 16) as node from n where name <> ''")
def dataflow_nodes(spark, folder):
    """Assignments, returned values, conditions and members set, as nodes."""
    return text_rules.flow_nodes(table(spark, folder, "files"))


@query("with t as (select doc_id, string_split(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(10)) as ls from documents where text is not null), l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as line_no from t), h as (select doc_id, line_no, unnest(list_filter([case when contains(line, 'coverage') then 'coverage.json' end, case when contains(line, 'audit') then 'audit.json' end, case when contains(line, 'release') then 'release.json' end], x -> x is not null)) as target from l) select target, count(*) as n from h group by target".replace("x ->", "lambda x:"))
def backlinks(spark, folder):
    """Lines of documents that name artifacts, by artifact."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(text_rules.split_lines("text")).alias("i", "line"))
    found = text_rules.backlinks(rows.select(F.col("doc_id").alias("id"), F.col("i").alias("line_no"), "line"), {"coverage": "coverage.json", "audit": "audit.json", "release": "release.json"})
    return found.groupBy("target").agg(F.count("*").alias("n"))


# -- snapshots and diffs
@query(FILES_SQL + r"""s as (select id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) as ls from fi where content is not null), d as (select id, len(ls) as n, len(list_filter(ls, x -> contains(x, 'return'))) as r from s where len(list_filter(ls, x -> starts_with(x, '@@ ') or starts_with(x, '--- ') or starts_with(x, '+++ '))) = 0)
 select id, 0 as hunk, 1 as new_start, r as added, n - r as removed from d""".replace("x ->", "lambda x:"))
def diff_hunks(spark, folder):
    """Hunks of diffs (one a file: lines that return are added, the others removed)."""
    lines = text_rules.split_lines("content")
    odd = F.exists(lines, lambda x: x.startswith("@@ ") | x.startswith("--- ") | x.startswith("+++ "))
    signed = F.transform(lines, lambda x: F.concat(F.when(F.contains(x, F.lit("return")), "+").otherwise("-"), F.lit(" "), x))
    text = F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@ x\n"), F.array_join(signed, "\n"))
    rows = rows_of(spark, folder, "files", text.alias("diff"), where=F.col("content").isNotNull() & ~odd)
    return diffs.hunks(rows).select("id", "hunk", "new_start", "added", "removed")


@query(FILES_SQL + r"""s as (select id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) as ls from fi where content is not null), c as (select id, len(list_filter(ls, x -> contains(x, 'return'))) as n from s) select id, n as added, n as removed from c where n > 0""".replace("x ->", "lambda x:"))
def changed_line_counts(spark, folder):
    """Lines added and removed between each file and its next state, in which every ``return`` is spelled another way."""
    old = rows_of(spark, folder, "files", "content", where="content is not null")
    new = old.select("id", F.replace("content", F.lit("return"), F.lit("retürn")).alias("content"))
    return diffs.line_changes(old, new, ["id"])


@query("""with a as (select distinct id, repo_root, path, size_bytes from files where observed_at <= timestamp '2025-05-01' and (deleted_at is null or deleted_at > timestamp '2025-05-01')), r as (select *, row_number() over (partition by repo_root order by path, id) as n, count(*) over (partition by repo_root) as total from a)
 select repo_root, count(*) filter (n <= 20 and coalesce(size_bytes, 0) <= 1000) as n_files, count(*) filter (n <= 20 and size_bytes > 1000) as n_too_large, bool_or(total > 20) as truncated, case when bool_or(total > 20) then 'limit_exceeded' else 'success' end as status from r group by repo_root""")
def snapshot_at_ref(spark, folder):
    """The files of each repo at a moment, within limits of their number and size."""
    moment = F.lit("2025-05-01").cast("timestamp_ntz")
    alive = (F.col("observed_at") <= moment) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > moment))
    rows = rows_of(spark, folder, "files", "repo_root", "path", "size_bytes", where=alive)
    return diffs.limited(rows, "repo_root", ["path", "id"], 20, 1000)


# -- joins, sets and summaries that are left
@query(FINDINGS_SQL + """o as (select run_id, lag(run_id) over w as before from (select distinct run_id, repo_root, branch, generated_at from runs) window w as (partition by repo_root, branch order by generated_at, run_id)),
 g as (select id, run_id, coalesce(rule_id, '') || '|' || coalesce(title, '') || '|' || array_to_string(list_sort(list_filter(coalesce(list_transform(evidence, lambda e: e.path), []), lambda p: p is not null)), ',') as sig from f)
 select g.id, g.run_id from g join o using (run_id) where o.before is not null and not exists (select 1 from g b where b.run_id = o.before and b.sig = g.sig)""")
def new_by_signature(spark, folder):
    """Findings of each run whose signature (rule, title, sorted paths) the run before doesn't have."""
    paths = F.array_sort(F.filter(F.coalesce(F.transform("evidence", lambda e: e["path"]), F.array().cast("array<string>")), lambda p: p.isNotNull()))
    sign = F.concat_ws("|", F.coalesce("rule_id", F.lit("")), F.coalesce("title", F.lit("")), F.array_join(paths, ","))
    rows = rows_of(spark, folder, "findings", "run_id", sign.alias("sig"))
    order = W.partitionBy("repo_root", "branch").orderBy("generated_at", "run_id")
    runs = table(spark, folder, "runs").select("run_id", "repo_root", "branch", "generated_at").distinct().select("run_id", F.lag("run_id").over(order).alias("before")).where("before is not null")
    old = rows.select(F.col("run_id").alias("before"), "sig").distinct()
    return rows.join(runs, "run_id").join(old, ["before", "sig"], "left_anti").select("id", "run_id")


@query(FINDINGS_SQL + "c as (select distinct repo_root, path from files where observed_at >= timestamp '2025-06-01' and path is not null), e as (select distinct id, repo_root, unnest(list_transform(evidence, lambda x: x.path)) as path from f) select distinct id from e join c using (repo_root, path)")
def findings_of_changes(spark, folder):
    """Findings with evidence in files observed lately."""
    changed = table(spark, folder, "files").where((F.col("observed_at") >= F.lit("2025-06-01").cast("timestamp_ntz")) & F.col("path").isNotNull()).select("repo_root", "path").distinct()
    rows = table(spark, folder, "findings").select("id", "repo_root", F.explode("evidence.path").alias("path")).where("path is not null")
    return rows.join(changed, ["repo_root", "path"], "left_semi").select("id").distinct()


@query("select id, deleted_at is not null as gone from (select *, row_number() over (partition by lower(trim(id)) order by observed_at desc, deleted_at desc nulls last, id desc) as n from (select distinct id, observed_at, deleted_at from symbols where trim(id) <> '')) where n = 1")
def last_wins(spark, folder):
    """The last life of each symbol."""
    life = F.struct("observed_at", F.col("deleted_at").isNotNull().alias("_k"), F.col("deleted_at"), "id")
    rows = table(spark, folder, "symbols").where(F.trim("id") != "").groupBy(F.lower(F.trim("id")).alias("key")).agg(F.max(life).alias("m"))
    return rows.select("m.id", F.col("m.deleted_at").isNotNull().alias("gone"))


@query("with r as (select distinct run_id, repo_root, branch, generated_at, finding_count from runs) select repo_root, branch, count(*) as n_runs, min_by(finding_count, (generated_at, run_id)) as first_count, max_by(finding_count, (generated_at, run_id)) as last_count, cast(round(date_diff('second', min(generated_at), max(generated_at)) / 86400.0) as int) as period_days from r group by repo_root, branch")
def trend_period(spark, folder):
    """First and last count of each branch, and the days between."""
    runs = table(spark, folder, "runs").select("run_id", "repo_root", "branch", "generated_at", "finding_count").distinct()
    at = F.struct("generated_at", "run_id")
    seconds = F.unix_timestamp(F.max("generated_at").cast("timestamp")) - F.unix_timestamp(F.min("generated_at").cast("timestamp"))
    return runs.groupBy("repo_root", "branch").agg(
        F.count("*").alias("n_runs"), F.min_by("finding_count", at).alias("first_count"), F.max_by("finding_count", at).alias("last_count"), F.round(seconds / 86400.0).cast("int").alias("period_days")
    )


@query(FINDINGS_SQL + """h as (select run_id, id from f where severity in ('critical', 'high')), a as (select run_id, 'aggregate' as kind, array_to_string(list_sort(list(id))[1:5], ',') as sources from f where category = 'payment' or category = 'data' group by run_id having count(*) >= 2),
 t as (select run_id, 'testing' as kind, array_to_string(list_sort(list(id))[1:3], ',') as sources from f where category = 'testing' group by run_id), u as (select run_id, unnest(list(id)) as id from f where category in ('payment', 'data') group by run_id having count(*) >= 2)
 select * from a union all select * from t union all select run_id, 'single', id from h where not exists (select 1 from u where u.run_id = h.run_id and u.id = h.id)""")
def risk_register(spark, folder):
    """Risks of each run: one of all findings about data if there are two, one of those about tests, and one per other severe finding; sources are capped."""
    rows = rows_of(spark, folder, "findings", "run_id", "category", "severity")
    data = rows.where("category in ('payment', 'data')").groupBy("run_id").agg(F.collect_list("id").alias("ids")).where("size(ids) >= 2")
    capped = lambda df, kind, k: df.select("run_id", F.lit(kind).alias("kind"), F.array_join(F.slice(F.array_sort("ids"), 1, k), ",").alias("sources"))
    tests = rows.where("category = 'testing'").groupBy("run_id").agg(F.collect_list("id").alias("ids"))
    single = rows.where("severity in ('critical', 'high')").join(data.select("run_id", F.explode("ids").alias("id")), ["run_id", "id"], "left_anti").select("run_id", F.lit("single").alias("kind"), F.col("id").alias("sources"))
    return capped(data, "aggregate", 5).unionByName(capped(tests, "testing", 3)).unionByName(single)


@query(FINDINGS_SQL + "q as (select category, quantile_disc(confidence, 0.5) as median, quantile_disc(confidence, 0.9) as p90, count(*) as n from f where confidence is not null group by category) select category, round(median, 4) as median, round(p90, 4) as p90, n from q")
def confidence_percentiles(spark, folder):
    """Median and upper decile of confidence per category, exact."""
    rows = rows_of(spark, folder, "findings", "category", "confidence", where="confidence is not null")
    at = lambda q: F.expr(f"percentile_disc({q}) within group (order by confidence)")
    return rows.groupBy("category").agg(F.round(at(0.5), 4).alias("median"), F.round(at(0.9), 4).alias("p90"), F.count("*").alias("n"))


@query("with r as (select distinct run_id, repo_root, branch, finding_count from runs) select repo_root, count(*) as n_runs, count(distinct branch) as n_branches, count(*) filter (finding_count = 0) as n_clean, cast(sum(finding_count) as bigint) as n_findings from r group by repo_root")
def portal_summary(spark, folder):
    """Runs, branches and findings per repo."""
    runs = table(spark, folder, "runs").select("run_id", "repo_root", "branch", "finding_count").distinct()
    return runs.groupBy("repo_root").agg(F.count("*").alias("n_runs"), F.count_distinct("branch").alias("n_branches"), F.count_if(F.col("finding_count") == 0).alias("n_clean"), F.sum("finding_count").alias("n_findings"))


# -- plugins
def _long_lines(path: str, content: str) -> Iterator[dict]:
    for number, line in enumerate(content.replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1):
        if len(line) > 80:
            yield {"rule_id": "LONG_LINE", "severity": "low", "title": f"{len(line)} characters", "lines": [number]}


def _failing(path: str, content: str) -> list[dict]:
    if "class" in content:
        raise ValueError(path)
    return []


@query(_L + "q as (select id, 'long' as plugin, 'LONG_LINE' as rule_id, length(line) || ' characters' as title, cast(line_no as int) as line, '' as diagnostic from l where length(line) > 80 and line_no <= 100000), x as (select id, 'failing', '', '', 0, 'failed: ValueError' from fi where contains(content, 'class') and language = 'py') select * from q union all select * from x")
def plugin_findings(spark, folder):
    """Findings and diagnostics of two plugins, one of which fails on some files."""
    files = table(spark, folder, "files").where("content is not null")
    found = plugins.run([plugins.Plugin("long", _long_lines), plugins.Plugin("failing", _failing, languages=("py",))], files)
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return found.select("id", "plugin", text("rule_id"), text("title"), F.coalesce(F.get("lines", F.lit(0)), F.lit(0)).alias("line"), text("diagnostic")).distinct()


# -- hashes, texts and review lists
@query("with fi as (select distinct id, repo_root, split_part(path, '/', 1) as folder, hash from files where hash is not null and path is not null) select repo_root, folder, sha256(string_agg(hash, '|' order by hash)) as combined from fi group by repo_root, folder")
def combined_file_hash(spark, folder):
    """One hash over the files of each top folder, as a cache keeps it (``tree_hash`` is for groups of any size)."""
    rows = rows_of(spark, folder, "files", "repo_root", F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), "hash", where="hash is not null and path is not null")
    return rows.groupBy("repo_root", "folder").agg(scalars.combined_hash(F.collect_list("hash")).alias("combined"))


@query("""with r as (select distinct run_id, branch, finding_count from runs where branch is not null), q as (select run_id, '{"a":"' || branch || '","m":{"b":[1,"x"],"y":null},"z":' || finding_count || '}' as canonical from r) select run_id, canonical, sha256(canonical) as digest from q""")
def canonical_documents(spark, folder):
    """Documents with members in any order, as canonical text with its hash."""
    text = F.concat(F.lit('{"z": '), F.col("finding_count").cast("string"), F.lit(', "m": {"y": null, "b": [1, "x"]}, "a": "'), "branch", F.lit('"}'))
    rows = table(spark, folder, "runs").where("branch is not null").select("run_id", text.alias("t"), "branch", "finding_count").distinct()
    return rows.select("run_id", scalars.canonical_json("t").alias("canonical"), scalars.canonical_digest("t").alias("digest"))


@query("select distinct run_id, sha256('# Report' || chr(10) || 'findings: ' || finding_count || chr(10)) as stable from runs")
def stable_reports(spark, folder):
    """The hash of a report of each run without what differs from run to run."""
    text = F.concat(F.lit("# Report\r\n# Generated: "), F.col("generated_at").cast("string"), F.lit("\ngenerated_at: x\nrun_id: "), "run_id", F.lit("\n**Run ID**: "), "run_id", F.lit("\nfindings: "), F.col("finding_count").cast("string"), F.lit("\n"))
    return table(spark, folder, "runs").select("run_id", F.sha2(scalars.stable_text(text), 256).alias("stable")).distinct()


@query(FINDINGS_SQL + r"""q as (select id, '| ' || id || ' | ' || regexp_replace(regexp_replace(coalesce(title, ''), '\|', '\\|', 'g'), '\r\n?|\n', ' ', 'g') || ' | ' || coalesce(severity, '') || ' |' as line, '- id: "' || id || '"' || chr(10) || '  severity: ' || case when severity is null then 'null' else '"' || severity || '"' end as item from f) select * from q""")
def rendered_findings(spark, folder):
    """Findings as rows of a markdown table and items of a YAML list."""
    return rows_of(spark, folder, "findings", sinks.markdown_row("id", "title", "severity").alias("line"), sinks.yaml_item({"id": F.col("id"), "severity": F.col("severity")}).alias("item"))


def _queue(spark, folder: str):
    slo = reference_queries.quality_slo(spark, folder).where("status != 'met'")
    late = rules_queries.expiry_warnings(spark, folder).where("status = 'expired'")
    gaps = rules_queries.test_gaps(spark, folder)
    drift = rules_queries.spec_drift(spark, folder).where("status = 'failed'")
    recurring = reference_queries.drift_recurrence_having(spark, folder)
    part = lambda df, kind, key, days: df.select(F.lit(kind).alias("type"), key.alias("key"), days.alias("days"))
    return (
        part(slo, "slo_breach", F.col("pair"), F.when(F.col("status") == "breached", 3).otherwise(7)).unionByName(part(late, "baseline_expiry", F.col("k").cast("string"), F.lit(3)))
        .unionByName(part(gaps, "manual_oracle_gap", F.concat("repo_root", F.lit(":"), "path"), F.lit(7))).unionByName(part(drift, "spec_drift", F.col("check"), F.lit(7)))
        .unionByName(part(recurring, "spec_drift_recurrence", F.col("rule_id"), F.lit(7)))
    )


def _queue_sql() -> str:
    o = {**reference_queries.ORACLES, **rules_queries.ORACLES}
    return (
        f"select 'slo_breach' as type, pair as key, case when status = 'breached' then 3 else 7 end as days from ({o['quality_slo']}) a where status <> 'met' union all select 'baseline_expiry', k::varchar, 3 from ({o['expiry_warnings']}) b where status = 'expired'"
        f" union all select 'manual_oracle_gap', repo_root || ':' || path, 7 from ({o['test_gaps']}) c union all select 'spec_drift', \"check\", 7 from ({o['spec_drift']}) d where status = 'failed' union all select 'spec_drift_recurrence', rule_id, 7 from ({o['drift_recurrence_having']}) e"
    )


@query("with q as (" + _queue_sql() + ") select type, key, strftime(date '2025-06-01' + days, '%Y-%m-%d') as due from q")
def review_queue(spark, folder):
    """What people have to look at, from five sources, with due dates."""
    return _queue(spark, folder).select("type", "key", F.date_format(F.date_add(F.lit("2025-06-01").cast("date"), F.col("days")), "yyyy-MM-dd").alias("due"))


@query("with q as (" + _queue_sql() + ") select count(*) as n, " + ", ".join(f"count(*) filter (type = '{t}') as n_{t}" for t in ("slo_breach", "baseline_expiry", "manual_oracle_gap", "spec_drift", "spec_drift_recurrence")) + " from q")
def review_queue_counts(spark, folder):
    """The queue by source, dense."""
    kinds = ("slo_breach", "baseline_expiry", "manual_oracle_gap", "spec_drift", "spec_drift_recurrence")
    return _queue(spark, folder).agg(F.count("*").alias("n"), *[F.count_if(F.col("type") == k).alias(f"n_{k}") for k in kinds])


# -- rules and their engine
_RULES = [
    rule_engine.LineRule("MARKER", "maintainability", "low", 0.6, r"TODO|FIXME"), rule_engine.LineRule("RETURNS", "data", "high", 0.8, "return", "null|nil|None", 2, 1, ("ts", "js")),
    rule_engine.LineRule("LIMIT", "config", "medium", 0.9, r"limit = [0-9]+", None, 0, 0, ("py", "rb")),
]
_CLAIMS = FILES_SQL + r"""s as (select distinct repo_root, path, language, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) as ls from fi where content is not null), l as (select *, unnest(ls) as line, generate_subscripts(ls, 1) as i from s),
 c as (select 0 as ord, 'MARKER' as rule_id, 'maintainability' as category, 'low' as severity, 0.6::double as confidence, repo_root, path, cast(i as int) as line, line as text from l where regexp_matches(line, 'TODO|FIXME')
 union all select 1, 'RETURNS', 'data', 'high', 0.8, repo_root, path, i, line from l where language in ('ts', 'js') and regexp_matches(line, 'return') and not regexp_matches(array_to_string(ls[greatest(i - 2, 1):i + 1], chr(10)), 'null|nil|None')
 union all select 2, 'LIMIT', 'config', 'medium', 0.9, repo_root, path, i, line from l where language in ('py', 'rb') and regexp_matches(line, 'limit = [0-9]+')), """


@query(_CLAIMS + """g as (select *, row_number() over (order by ord, repo_root, path, line) as n from c) select 'finding-' || lpad(n::varchar, 8, '0') as id, rule_id, severity, repo_root, path, line as start_line, substr(sha256('rule:' || rule_id || '|excerpt:' || sha256(text)), 1, 16) as fingerprint from g""")
def rule_findings(spark, folder):
    """What line rules find in all files, through the engine: ids in order, fingerprints by excerpt."""
    files = table(spark, folder, "files").where("path is not null and repo_root is not null")
    good, _ = rule_engine.evaluate(rule_engine.claims(files, _RULES), files)
    return good.select("id", "rule_id", "severity", "repo_root", "path", "start_line", "fingerprint")


@query(FINDINGS_SQL + r"""k as (select repo_root, path, max(len(string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)))) as n, bool_or(content is not null) as readable from files where path is not null group by all), c as (select f.id, f.repo_root, evidence[1].path as path, evidence[1].start_line as s, evidence[1].end_line as e from f),
 j as (select c.id, case when coalesce(c.path, '') = '' then 'missing_evidence' when k.path is null then 'path_not_found' when not k.readable then 'unreadable' when s is null or e is null or s < 1 or e < s or e > k.n then 'invalid_range' else 'accepted' end as reason from c left join k on k.repo_root = c.repo_root and k.path = c.path) select reason, count(*) as n from j group by reason""")
def claim_validation(spark, folder):
    """Findings of the tables as claims: which the engine accepts, and why it rejects the others."""
    first = F.get("evidence", F.lit(0))
    rows = rows_of(spark, folder, "findings", F.lit(0).alias("ord"), "rule_id", "category", "severity", "confidence", "title", "repo_root", first["path"].alias("path"), first["start_line"].alias("start_line"), first["end_line"].alias("end_line"))
    good, bad = rule_engine.evaluate(rows.drop("id"), table(spark, folder, "files").where("path is not null"))
    return good.select(F.lit("accepted").alias("reason")).unionByName(bad.select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(FINDINGS_SQL + "q as (select run_id, id, rule_id, severity, confidence, coalesce(evidence[1].path, '') as path, coalesce(array_to_string(tags, ','), '') as tags, coalesce(upstream.tool, '') as tool from f) select * from q")
def artifact_findings(spark, folder):
    """Findings read from JSON artifacts, one a run."""
    e = F.transform("evidence", lambda x: F.struct(x["path"].alias("path"), x["start_line"].alias("startLine")))
    finding = F.struct("id", F.col("rule_id").alias("ruleId"), "severity", "confidence", "title", e.alias("evidence"), "tags", F.struct(F.col("upstream.tool").alias("tool")).alias("upstream"))
    rows = rows_of(spark, folder, "findings", "run_id", finding.alias("f"))
    made = rows.groupBy("run_id").agg(F.to_json(F.struct("run_id", F.collect_list("f").alias("findings"))).alias("document")).select(F.concat("run_id", F.lit(".json")).alias("path"), "document")
    found = artifacts.findings(made)
    return found.select("run_id", "id", "rule_id", "severity", "confidence", F.coalesce(F.get("evidence", F.lit(0))["path"], F.lit("")).alias("path"), F.coalesce(F.array_join("tags", ",", ""), F.lit("")).alias("tags"), F.coalesce("upstream.tool", F.lit("")).alias("tool"))


@query(FILES_SQL + r"""o as (select id, hash, content from fi where observed_at < timestamp '2025-09-01'), n as (select id, case when length(id) % 2 = 0 then hash else coalesce(hash, '') || 'x' end as hash, case when length(id) % 2 = 0 then content else replace(content, 'return', 'retürn') end as content from fi where observed_at >= timestamp '2025-02-01'),
 c as (select id, content, len(list_filter(string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)), lambda x: contains(x, 'return'))) as r, len(string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10))) as total from fi),
 d as (select coalesce(o.id, n.id) as id, case when o.id is null then 'A' when n.id is null then 'D' when o.hash is distinct from n.hash then 'M' end as status from o full join n on o.id = n.id)
 select d.id, d.status, case when c.content is null then 0 when d.status = 'A' then c.total when d.status = 'M' then c.r else 0 end as added, case when c.content is null then 0 when d.status = 'D' then c.total when d.status = 'M' then c.r else 0 end as removed from d join c using (id) where d.status is not null""")
def changed_files_with_stats(spark, folder):
    """Files that differ between two states (in the later one, every second id spells ``return`` another way), with lines added and removed."""
    moment = lambda t: F.lit(t).cast("timestamp_ntz")
    odd = F.length("id") % 2 != 0
    old = rows_of(spark, folder, "files", "hash", "content", where=F.col("observed_at") < moment("2025-09-01"))
    new = rows_of(
        spark, folder, "files", F.when(odd, F.concat(F.coalesce("hash", F.lit("")), F.lit("x"))).otherwise(F.col("hash")).alias("hash"),
        F.when(odd, F.replace("content", F.lit("return"), F.lit("retürn"))).otherwise(F.col("content")).alias("content"), where=F.col("observed_at") >= moment("2025-02-01"),
    )
    return diffs.changed_with_stats(old, new, ["id"])
