"""Queries for the operators of a quality-evidence engine over the tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.functions import scalars as S
from evidra.operators import code_symbols, compare, diffs, exports, gate, graph, matching, query_dsl, snapshot_diff, text_rules
from evidra.session import running_total, saved
from evidra.sources.tables import table
from evidra.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query with its SQL."""

    def keep(run: Callable) -> Callable:
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return keep


def _rows(spark: SparkSession, folder: str, name: str, columns: tuple, where: Column | str | None) -> DataFrame:
    rows = table(spark, folder, name)
    return (rows if where is None else rows.where(where)).select("id", *[c for c in columns if not isinstance(c, str) or c != "id"])


def _findings(spark: SparkSession, folder: str, *columns: Column | str, where: Column | str | None = None) -> DataFrame:
    """Findings, redelivered rows once, with only the columns and expressions that are needed.

    Redelivered rows are equal, so rows are filtered and expressions taken first: filters reach the
    scan, and the shuffle behind the removal of repeats holds small results only.
    """
    return _rows(spark, folder, "findings", columns, where).dropDuplicates(["id"])


def _files(spark: SparkSession, folder: str, *columns: Column | str, where: Column | str | None = None) -> DataFrame:
    """The same for files."""
    return _rows(spark, folder, "files", columns, where).dropDuplicates(["id"])


def _asked(spark: SparkSession, folder: str, text: str, *columns: Column | str) -> DataFrame:
    """Findings that answer a query, each once, with the given columns."""
    rows = table(spark, folder, "findings")
    return rows.where(query_dsl.predicate(rows, query_dsl.parse(text))).select("id", *columns).dropDuplicates(["id"])


#: Findings and files once each, for SQL.
_F = "with f as (select * from findings qualify row_number() over (partition by id order by loaded_at) = 1), "
_FILES = "with fi as (select * from files qualify row_number() over (partition by id order by observed_at) = 1), "
_RANK = "case lower(trim(severity)) when 'info' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end"


# -- query language
@query(_F + f"q as (select id, run_id, rule_id, severity from f where coalesce({_RANK} >= 3, false)) select * from q")
def query_severity_ge(spark, folder):
    """``finding where severity >= high``."""
    return _asked(spark, folder, "finding where severity >= high", "run_id", "rule_id", "severity")


@query(_F + "q as (select id, category, confidence from f where coalesce(confidence < 0.35, false)) select * from q")
def query_confidence_lt(spark, folder):
    """``finding where confidence < 0.35``."""
    return _asked(spark, folder, "finding where confidence < 0.35", "category", "confidence")


@query(_F + "q as (select id, fingerprint from f where fingerprint is distinct from 'none') select * from q")
def query_field_ne_null_safe(spark, folder):
    """``!=`` holds for missing values."""
    return _asked(spark, folder, "finding where fingerprint != 'none'", "fingerprint")


@query(_F + "q as (select id, evidence[1].kind as kind from f where coalesce(evidence[1].kind = 'ast', false)) select * from q")
def query_dotted_path(spark, folder):
    """A dotted path through an array: ``evidence.0.kind = ast``."""
    return _asked(spark, folder, "finding where evidence.0.kind = ast", F.get("evidence", F.lit(0))["kind"].alias("kind"))


@query(_F + f"q as (select id, run_id, row_number() over (partition by run_id order by id) - 1 as locator from f where coalesce({_RANK} >= 3, false)) select * from q")
def query_locator_index(spark, folder):
    """The place of each answer among the answers of its run."""
    hits = _asked(spark, folder, "finding where severity >= high", "run_id")
    return query_dsl.located(hits, ["run_id"], ["id"]).select("id", "run_id", "locator")


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where coalesce(cast(json_extract_string(props, '$.k') as bigint) >= 90, false)")
def query_nested_json_field(spark, folder):
    """A condition on a member of a JSON column."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, folder, "events").select("event_id", k.alias("k")).where("k >= 90")


@query(_F + "q as (select id, title from f where contains(lower(coalesce(title,'') || ' ' || coalesce(summary,'') || ' ' || coalesce(rule_id,'') || ' ' || coalesce(category,'')), 'release')) select * from q")
def text_search(spark, folder):
    """Case-insensitive search over several columns."""
    return _findings(spark, folder, "title", where=F.contains(F.lower(F.concat_ws(" ", "title", "summary", "rule_id", "category")), F.lit("release")))


# -- aggregations
@query(_F + "q as (select run_id, " + ", ".join(f"count(*) filter (lower(trim(severity)) = '{s}') as {s}" for s in ("critical", "high", "medium", "low")) + " from f group by run_id) select * from q")
def count_by_severity_dense(spark, folder):
    """Counts of the four severities per run, zero-filled."""
    level = F.lower(F.trim("severity"))
    return _findings(spark, folder, "run_id", "severity").groupBy("run_id").agg(*[F.count_if(level == s).alias(s) for s in ("critical", "high", "medium", "low")])


@query(_F + "q as (select category, count(*) as n from f group by category) select * from q")
def count_by_category(spark, folder):
    """Findings per category; only categories that occur."""
    return _findings(spark, folder, "category").groupBy("category").agg(F.count("*").alias("n"))


@query(_F + "q as (select severity, rule_id, count(*) as n from f group by grouping sets ((severity), (rule_id))) select * from q")
def count_severity_and_rule(spark, folder):
    """Both counts in one pass by grouping sets."""
    rows = _findings(spark, folder, "severity", "rule_id")
    return rows.groupingSets([["severity"], ["rule_id"]], "severity", "rule_id").agg(F.count("*").alias("n"))


@query(_F + "q as (select category, " + ", ".join(f"count(*) filter (severity = '{s}') as {s}" for s in ("critical", "high", "medium", "low")) + " from f group by category) select * from q")
def severity_category_pivot(spark, folder):
    """Category by severity, dense."""
    return _findings(spark, folder, "category", "severity").groupBy("category").pivot("severity", ["critical", "high", "medium", "low"]).agg(F.count("id")).na.fill(0)


@query(_F + "q as (select run_id, count(*) as n_high from f where severity in ('high', 'critical') group by run_id having count(*) > 2) select * from q")
def count_threshold_having(spark, folder):
    """Runs with more severe findings than a threshold allows."""
    return _findings(spark, folder, "run_id", where=F.col("severity").isin("high", "critical")).groupBy("run_id").agg(F.count("*").alias("n_high")).where("n_high > 2")


@query(_F + "c as (select repo_root, category, count(*) as n from f group by all) select repo_root, category, n, row_number() over (partition by repo_root order by n desc, category) as place from c qualify place <= 3")
def top3_categories(spark, folder):
    """The three most frequent categories per repo; ties by name."""
    counts = _findings(spark, folder, "repo_root", "category").groupBy("repo_root", "category").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy("repo_root").orderBy(F.desc("n"), "category"))).where("place <= 3")


@query(_F + f"q as (select id, rule_id, {_RANK} as rank, confidence from f where confidence >= 0.6 order by rank desc nulls last, rule_id, id limit 500) select * from q")
def sort_severity_topk(spark, folder):
    """The 500 most severe confident findings: severity down, then rule and id."""
    rows = _findings(spark, folder, "rule_id", S.severity_rank("severity").alias("rank"), "confidence", where="confidence >= 0.6")
    return rows.orderBy(F.desc_nulls_last("rank"), "rule_id", "id").limit(500).select("id", "rule_id", "rank", "confidence")


@query(_F + "d as (select rule_id, run_id, severity from f) select rule_id, count(*) as n, count(distinct run_id) as n_runs, array_to_string(list_sort(list(distinct severity) filter (severity is not null)), ',') as severities from d group by rule_id having count(distinct run_id) > 1")
def drift_recurrence_having(spark, folder):
    """Rules that come back in several runs, with their distinct sorted severities."""
    return _findings(spark, folder, "rule_id", "run_id", "severity").groupBy("rule_id").agg(
        F.count("*").alias("n"), F.count_distinct("run_id").alias("n_runs"), F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities")
    ).where("n_runs > 1")


@query(_F + "p as (select coalesce(nullif(regexp_extract(coalesce(evidence[1].path, ''), '^(packages/[^/]+)/', 1), ''), '.') as package, severity from f) select package, count(*) as n_findings, count(*) filter (severity = 'critical') as n_critical from p group by package")
def package_summary(spark, folder):
    """Findings per package folder."""
    rows = _findings(spark, folder, S.package_of(S.primary_path()).alias("package"), "severity")
    return rows.groupBy("package").agg(F.count("*").alias("n_findings"), F.count_if(F.col("severity") == "critical").alias("n_critical"))


@query(_F + "q as (select repo_root, count(*) as total, round(100.0 * count(*) filter (confidence < 0.5) / count(*), 2) as low_rate from f group by repo_root) select * from q")
def confidence_rate(spark, folder):
    """Share of findings of low confidence per repo, in percent."""
    return _findings(spark, folder, "repo_root", "confidence").groupBy("repo_root").agg(
        F.count("*").alias("total"), F.round(100.0 * F.count_if(F.col("confidence") < 0.5) / F.count("*"), 2).alias("low_rate")
    )


@query("""with p as (select repo_root, substr(hash, 1, 3) as part, sha256(string_agg(hash, ',' order by hash)) as h from (select distinct id, repo_root, hash from files) where hash is not null group by all)
select repo_root, sha256(string_agg(h, ',' order by part)) as combined from p group by repo_root""")
def tree_hash(spark, folder):
    """One hash per repo over the sorted hashes of its files, in two levels: parts by prefix, then the parts."""
    rows = _files(spark, folder, "repo_root", "hash", where="hash is not null")
    parts = rows.groupBy("repo_root", F.substring("hash", 1, 3).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("hash")), ","), 256).alias("h"))
    whole = F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])  # at most 4096 parts
    return parts.groupBy("repo_root").agg(F.sha2(F.array_join(whole, ","), 256).alias("combined"))


# -- scalars and classifiers
_FP = "substr(sha256('rule:' || rule_id || case when len(coalesce(affected_symbols, [])) > 0 then '|symbols:' || array_to_string(list_sort(affected_symbols), ',') else '' end || coalesce('|excerpt:' || evidence[1].excerpt_hash, '') || case when len(coalesce(affected_symbols, [])) = 0 and evidence[1].excerpt_hash is null then '|path:' || coalesce(evidence[1].path, '') else '' end), 1, 16)"


def _fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    fp = S.fingerprint(F.col("rule_id"), F.col("affected_symbols"), F.get("evidence", F.lit(0))["excerpt_hash"], S.primary_path())
    return _findings(spark, folder, "run_id", fp.alias("fp"), where="rule_id is not null")


@query(_F + f"q as (select id, run_id, {_FP} as fp from f where rule_id is not null) select * from q")
def fingerprint_findings(spark, folder):
    """The fingerprint of every finding."""
    return _fingerprints(spark, folder)


@query(_F + f"q as (select run_id, {_FP} as fp, id from f where rule_id is not null) select run_id, fp, count(*) as n from q group by run_id, fp having count(*) > 1")
def fingerprint_duplicates(spark, folder):
    """Fingerprints that stand more than once in a run."""
    return _fingerprints(spark, folder).groupBy("run_id", "fp").agg(F.count("*").alias("n")).where("n > 1")


@query(_FILES + r"""q as (select id, lower(regexp_extract(path, '\.([^./]+)$', 1)) as ext, regexp_extract(path, '([^/]*)$', 1) as base,
 case when position('/' in path) > 0 then regexp_extract(path, '^(.*)/[^/]*$', 1) else '.' end as dir,
 case lower(regexp_extract(path, '\.([^./]+)$', 1)) when 'ts' then 'ts' when 'js' then 'js' when 'mjs' then 'js' when 'py' then 'py' when 'go' then 'go' when 'java' then 'java' when 'rb' then 'rb' else 'unknown' end as language from fi) select * from q""")
def classify_files(spark, folder):
    """Extension, name, folder and language of each file by its path."""
    return _files(spark, folder, "path").select("id", S.extension("path").alias("ext"), S.basename("path").alias("base"), S.dirname("path").alias("dir"), S.language_of("path").alias("language"))


@query(_F + r"""q as (select id, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as title_key,
 regexp_replace(regexp_replace(upper(rule_id), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as rule_key from f where title is not null and rule_id is not null) select * from q""")
def normalised_keys(spark, folder):
    """Normalised titles and rule ids."""
    return _findings(spark, folder, S.title_key("title").alias("title_key"), S.rule_key("rule_id").alias("rule_key"), where="title is not null and rule_id is not null")


# -- pattern joins
_MODULES = "m as (select distinct repo_root, regexp_extract(path, '^(packages/[^/]+|src/[^/]+|src)/', 1) as module from fi where regexp_matches(path, '^(packages/[^/]+|src/[^/]+|src)/') union select distinct repo_root, 'src' from fi), "


@query(_FILES + _MODULES + "q as (select fi.repo_root, fi.path, coalesce(max_by(m.module, length(m.module)), '.') as module from fi left join m on m.repo_root = fi.repo_root and starts_with(fi.path, m.module || '/') group by fi.repo_root, fi.path) select * from q")
def longest_prefix_module(spark, folder):
    """The module of each file: the longest module folder that holds it."""
    files = _files(spark, folder, "repo_root", "path")
    name = F.regexp_extract("path", r"^(packages/[^/]+|src/[^/]+|src)/", 1)
    modules = files.select("repo_root", name.alias("module")).where("module != ''").unionByName(files.select("repo_root", F.lit("src").alias("module")))
    return matching.longest_prefix(files.select("repo_root", "path").distinct(), modules)


_SUPPRESSIONS = [
    {"rule_id": "RAW_SQL", "path": "src/api/**", "reason": "old", "expiry": "2025-01-01"},
    {"rule_id": "RAW_SQL", "path": "src/**", "reason": "legacy", "expiry": "2025-06-20"},
    {"rule_id": "DEBT_MARKER", "path": "**/*.ts", "reason": "planned", "expiry": None},
    {"rule_id": "LARGE_MODULE", "path": "packages/*/src/**", "reason": "split later", "expiry": "2026-01-01"},
]
_NOW = "2025-06-01"
_SUPPRESS_SQL = """select id, {0} as suppression, {1} as suppression_status from (select id, rule_id, coalesce(evidence[1].path, '') as path from f)"""


def _suppression_case(skip: bool, what: str) -> str:
    rows = [] if skip else [("rule_id = 'RAW_SQL' and starts_with(path, 'src/api/')", "old", "expired")]
    rows += [
        ("rule_id = 'RAW_SQL' and starts_with(path, 'src/')", "legacy", "expiring"),
        (r"rule_id = 'DEBT_MARKER' and regexp_matches(path, '\.ts$')", "planned", "active"),
        ("rule_id = 'LARGE_MODULE' and regexp_matches(path, '^packages/[^/]*/src/')", "split later", "active"),
    ]
    body = " ".join(f"when {c} then '{r if what == 'reason' else s}'" for c, r, s in rows)
    return f"case {body} else {'null' if what == 'reason' else chr(39) + 'not_matched' + chr(39)} end"


def _with_path(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return _findings(spark, folder, S.primary_path().alias("path"), *columns)


@query(_F + "q as (" + _SUPPRESS_SQL.format(_suppression_case(False, "reason"), _suppression_case(False, "status")) + ") select * from q")
def suppression_matcher_mode(spark, folder):
    """The first matching suppression decides, even an expired one."""
    return matching.suppress(_with_path(spark, folder, "rule_id"), _SUPPRESSIONS, _NOW, skip_expired=False).select("id", "suppression", "suppression_status")


@query(_F + "q as (" + _SUPPRESS_SQL.format(_suppression_case(True, "reason"), _suppression_case(True, "status")) + ") select * from q")
def suppression_policy_mode(spark, folder):
    """Expired suppressions are passed over."""
    return matching.suppress(_with_path(spark, folder, "rule_id"), _SUPPRESSIONS, _NOW, skip_expired=True).select("id", "suppression", "suppression_status")


@query(_F + "q as (" + _SUPPRESS_SQL.format(_suppression_case(False, "reason"), _suppression_case(False, "status")) + ") select suppression, suppression_status, count(*) as n from q where suppression is not null group by all")
def suppression_audit(spark, folder):
    """Findings per suppression and status."""
    return suppression_matcher_mode(spark, folder).where("suppression is not null").groupBy("suppression", "suppression_status").agg(F.count("*").alias("n"))


_OWNERS = [("*.ts", "web"), ("src/", "core"), ("/src/api/", "api"), ("**/tests/**", "qa"), ("*.py", "data")]
_OWNER_SQL = r"case when regexp_matches(path, '\.py$') then 'data' when regexp_matches(path, '/tests/') then 'qa' when regexp_matches(path, '^src/api/') then 'api' when regexp_matches(path, '(^|/)src/') then 'core' when regexp_matches(path, '\.ts$') then 'web' end"


@query(_FILES + f"q as (select id, path, {_OWNER_SQL} as owner from fi) select * from q")
def ownership_last_match(spark, folder):
    """The owner of each file: the last matching rule wins."""
    return matching.owners(_files(spark, folder, "path"), _OWNERS)


@query(_FILES + f"q as (select split_part(path, '/', 1) as folder, {_OWNER_SQL} as owner from fi) select folder, count(*) as n_files, count(*) filter (owner is null) as n_unowned, coalesce(array_to_string(list_sort(list(distinct owner) filter (owner is not null)), ','), '') as owners from q group by folder")
def module_owner_rollup(spark, folder):
    """Files, files without an owner and owners per top folder."""
    rows = ownership_last_match(spark, folder).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(1)))
    return rows.groupBy("folder").agg(F.count("*").alias("n_files"), F.count_if(F.col("owner").isNull()).alias("n_unowned"), F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"))


# -- comparison of runs
def _run_pairs(spark: SparkSession, folder: str, *more: str) -> tuple[DataFrame, DataFrame]:
    """Findings of every run against those of the run before it of the same branch; ``pair`` is the later run."""
    rows = _with_path(spark, folder, "rule_id", "fingerprint", "affected_symbols", "severity", "category", "confidence", "run_id", *more)
    rows = rows.withColumn("symbols", F.coalesce("affected_symbols", F.array().cast("array<string>"))).withColumn("ord", F.col("id"))
    order = snapshot_diff.snapshot_order(table(spark, folder, "runs"), ["repo_root", "branch"], "run_id", "generated_at").select("run_id", "_seq", "_next")
    known = rows.join(order, "run_id")
    return known.where("_seq > 0").withColumn("pair", F.col("run_id")), known.where("_next is not null").withColumn("pair", F.col("_next"))


#: The greedy match as a recursion over the current findings of each run, which carries the ids that are taken.
_GREEDY = _F.replace("with ", "with recursive ") + """o as (select run_id, lag(run_id) over w as before, lead(run_id) over w as after from (select distinct run_id, repo_root, branch, generated_at from runs) window w as (partition by repo_root, branch order by generated_at, run_id)),
k as (select id, run_id, rule_id, fingerprint, coalesce(evidence[1].path, '') as path, coalesce(affected_symbols, []) as symbols, severity, category, confidence from f),
cu as (select k.*, k.run_id as pair, row_number() over (partition by k.run_id order by k.id) as n from k join o using (run_id) where before is not null),
pr as (select k.*, o.after as pair from k join o using (run_id) where after is not null),
opt as (select c.pair, c.n, c.id as cid, p.id as pid, p.id as ord, 0 as stage, 0 as place from cu c join pr p on c.pair = p.pair and c.fingerprint = p.fingerprint and c.fingerprint <> ''
 union all select c.pair, c.n, c.id, p.id, p.id, 1, 0 from cu c join pr p on c.pair = p.pair and c.rule_id = p.rule_id and c.path = p.path
 union all select c.pair, c.n, c.id, p.id, p.id, 2, c.at from (select *, unnest(range(1, len(symbols) + 1)) as at from cu) c join pr p on c.pair = p.pair and c.rule_id = p.rule_id and list_contains(p.symbols, c.symbols[c.at])),
cand as (select c.pair, c.n, c.id as cid, coalesce(l.pids, []) as pids, coalesce(l.stages, []) as stages from cu c left join (select pair, n, list(pid order by stage, place, ord) as pids, list(stage order by stage, place, ord) as stages from opt group by pair, n) l using (pair, n)),
st as (select distinct pair, 0::bigint as n, []::varchar[] as used, null::varchar as cid, null::varchar as pid, null::int as stage from cu
 union all select s.pair, c.n, case when x.at is null then s.used else list_append(s.used, c.pids[x.at]) end, c.cid, c.pids[x.at], c.stages[x.at] from st s join cand c on c.pair = s.pair and c.n = s.n + 1,
  lateral (select list_filter(range(1, len(c.pids) + 1), lambda i: not list_contains(s.used, c.pids[i]))[1] as at) x),
m as (select * from st where n > 0),
cmp as (select m.pair, c.rule_id, m.cid as current_id, m.pid as previous_id, case when m.pid is null then 'new' when (c.severity, c.category, c.confidence) is not distinct from (p.severity, p.category, p.confidence) then 'unchanged' else 'modified' end as status,
 case when m.pid is null then 'none' else (['fingerprint', 'path', 'symbol'])[m.stage + 1] end as matched_on, c.path, c.severity, c.category, p.severity as old_severity
 from m join cu c on c.pair = m.pair and c.id = m.cid left join pr p on p.pair = m.pair and p.id = m.pid
 union all select p.pair, p.rule_id, null, p.id, 'resolved', 'none', p.path, p.severity, p.category, p.severity from pr p where not exists (select 1 from m where m.pair = p.pair and m.pid = p.id)), """


@query(_GREEDY + "q as (select pair, rule_id, current_id, previous_id, status, matched_on from cmp) select * from q")
def compare_exact(spark, folder):
    """Greedy one-to-one matching of each run's findings with those of the run before."""
    current, previous = _run_pairs(spark, folder)
    return compare.compare_exact(current, previous)


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    """The exact matches of all runs with the values that reports need, written once."""
    current, previous = _run_pairs(spark, folder)
    return saved(compare.with_values(compare.compare_exact(current, previous), current, previous))


_SEVERITIES = ["critical", "high", "medium", "low"]


def _summary_sql(dimension: str, values: list[str]) -> str:
    cells = ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("new", "resolved", "unchanged"))
    listed = ", ".join(f"'{v}'" for v in values)
    zero = ", ".join(f'coalesce({s}, 0) as "{s}"' for s in ("new", "resolved", "unchanged"))
    return _GREEDY + f"g as (select pair, unnest([{listed}]) as {dimension} from (select distinct pair from cmp)), x as (select pair, {dimension}, {cells} from cmp group by all) select pair, {dimension}, {zero} from g left join x using (pair, {dimension})"


@query(_summary_sql("severity", _SEVERITIES))
def comparison_by_severity(spark, folder):
    """New, resolved and unchanged findings of each run by severity, dense."""
    return compare.summary(_compared(spark, folder), "severity", _SEVERITIES)


_CATEGORIES = ["auth", "payment", "validation", "data", "config", "maintainability", "testing", "compatibility", "release-risk", "security"]


@query(_summary_sql("category", _CATEGORIES))
def comparison_by_category(spark, folder):
    """The same by category."""
    return compare.summary(_compared(spark, folder), "category", _CATEGORIES)


@query(_GREEDY + """t as (select pair, count(*) filter (previous_id is not null) as nb, count(*) filter (status = 'resolved') - count(*) filter (status = 'new') as d,
 count(*) filter (status = 'resolved' and severity = 'critical') - count(*) filter (status = 'new' and severity = 'critical') as dc, count(*) filter (status = 'resolved' and severity = 'high') - count(*) filter (status = 'new' and severity = 'high') as dh,
 sum((case severity when 'critical' then 10 when 'high' then 5 when 'medium' then 2 when 'low' then 1 else 0 end) * (case status when 'new' then 1 when 'resolved' then -1 else 0 end)) as risk from cmp group by pair),
 u as (select *, case when nb > 0 then (d + dc * 0.3::double + dh * 0.2::double) / nb else 0.0 end as s from t)
 select pair, round(s, 6) as score, case when s > 0.1 then 'improving' when s < -0.1 then 'degrading' else 'stable' end as direction, case when dc > 0 then 'decreasing' when dc < 0 then 'increasing' else 'stable' end as critical_trend,
 case when dh > 0 then 'decreasing' when dh < 0 then 'increasing' else 'stable' end as high_trend, cast(risk as bigint) as risk_change from u""")
def risk_trends(spark, folder):
    """Trend score, directions and change of the risk score of each run."""
    return compare.trends(_compared(spark, folder))


_SQL_RANK = "case lower(trim({0})) when 'info' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end"
_REGRESSED = _GREEDY + f"""reg as (select c.*, 'reintroduced' as reason from cmp c where status = 'new' and {_SQL_RANK.format('severity')} >= 2 and exists (select 1 from cmp r where r.pair = c.pair and r.rule_id = c.rule_id and r.path = c.path and r.status = 'resolved')
 union all select c.*, 'listed_rule' from cmp c where status = 'new' and rule_id = 'RAW_SQL' union all select c.*, 'escalated' from cmp c where status in ('unchanged', 'modified') and {_SQL_RANK.format('severity')} > {_SQL_RANK.format('old_severity')}), """


@query(_REGRESSED + "q as (select pair, rule_id, current_id, status, reason from reg) select * from q")
def regressions(spark, folder):
    """Findings that came back, rose, or are of a listed rule."""
    return compare.regressions(_compared(spark, folder), rules=("RAW_SQL",)).select("pair", "rule_id", "current_id", "status", "reason")


@query(_REGRESSED + """q as (select pair, rule_id, current_id from cmp c where status = 'new' and exists (select 1 from cmp r where r.pair = c.pair and r.rule_id = c.rule_id and r.status = 'resolved')
 and not exists (select 1 from reg where reg.pair = c.pair and reg.current_id = c.current_id)) select * from q""")
def potential_regressions(spark, folder):
    """New findings of rules that also have resolved ones."""
    matches = _compared(spark, folder)
    return compare.potential_regressions(matches, compare.regressions(matches, rules=("RAW_SQL",))).select("pair", "rule_id", "current_id")


@query(_REGRESSED + f"""q as (select rule_id, count(*) as n, coalesce(array_to_string(list_sort(list(distinct path)), ','), '') as paths, coalesce(array_to_string(list_sort(list(distinct severity)), ','), '') as severities,
 cast(sum(case severity when 'critical' then 20 when 'high' then 10 when 'medium' then 5 when 'low' then 2 else 0 end) as bigint) as risk_score, bool_or(coalesce({_SQL_RANK.format('severity')} >= 3, false)) as blocks from reg group by rule_id) select * from q""")
def regression_by_rule(spark, folder):
    """Regressions per rule with their paths, severities, risk score and whether one blocks."""
    return compare.regression_summary(compare.regressions(_compared(spark, folder), rules=("RAW_SQL",)), ["rule_id"])


@query(_REGRESSED + """t as (select pair, greatest(count(*) filter (status = 'new' and severity in ('critical', 'high')) - count(*) filter (status = 'resolved' and severity in ('critical', 'high')), 0) as net_severe,
 count(*) filter (severity = 'high' and status in ('new', 'unchanged')) as a, count(*) filter (severity = 'high' and status in ('resolved', 'unchanged')) as b from cmp group by pair),
 bl as (select pair, count(*) filter (severity in ('critical', 'high')) as blockers from reg group by pair),
 u as (select t.pair, coalesce(blockers, 0) as blockers, net_severe, case when b > 0 then (a - b) / b::double when a > 0 then 1.0 else 0.0 end as r from t left join bl using (pair))
 select pair, blockers, net_severe, round(r, 4) as high_rate, case when blockers > 0 then 'breached' when net_severe > 0 or r > 0.25 then 'at_risk' else 'met' end as status from u""")
def quality_slo(spark, folder):
    """Indicators of quality of each run with their status."""
    matches = _compared(spark, folder)
    return compare.slo(matches, compare.regressions(matches, rules=("RAW_SQL",)))


@query(_F + """c as (select r.run_id, r.repo_root, r.branch, r.generated_at, count(f.id) filter (f.severity = 'critical') as critical, count(f.id) filter (f.severity = 'high') as high, count(f.id) as total from (select distinct run_id, repo_root, branch, generated_at from runs) r left join f using (run_id) group by all),
 s as (select *, case when critical > 1 then 'failed' when critical > 0 then 'blocked_input' when high > 0 then 'needs_review' when total > 0 then 'passed_with_risk' else 'passed' end as status from c),
 w as (select *, lag(run_id) over x as previous_run, lag(critical) over x as critical_before, lag(high) over x as high_before, lag(status) over x as sb from s window x as (partition by repo_root, branch order by generated_at, run_id)),
 v as (select *, list_position(['passed', 'passed_with_risk', 'needs_review', 'blocked_input', 'failed'], status) as a, list_position(['passed', 'passed_with_risk', 'needs_review', 'blocked_input', 'failed'], sb) as b from w where previous_run is not null)
 select run_id, previous_run, critical, critical_before, critical - critical_before as critical_change, high, high_before, high - high_before as high_change, status, a < b as improved, a > b as degraded from v""")
def readiness_deltas(spark, folder):
    """Counts and status of each run beside those of the run before."""
    runs = table(spark, folder, "runs").select("run_id", "repo_root", "branch", "generated_at").distinct()
    counts = _findings(spark, folder, "run_id", "severity").groupBy("run_id").agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"), F.count("*").alias("total"))
    status = F.when(F.col("critical") > 1, "failed").when(F.col("critical") > 0, "blocked_input").when(F.col("high") > 0, "needs_review").when(F.col("total") > 0, "passed_with_risk").otherwise("passed")
    metrics = runs.select("run_id").join(counts, "run_id", "left").na.fill(0, ["critical", "high", "total"]).withColumn("status", status).drop("total")
    order = snapshot_diff.snapshot_order(runs, ["repo_root", "branch"], "run_id", "generated_at").select(F.col("_next").alias("run_id"), F.col("run_id").alias("previous_run")).where("run_id is not null")
    return compare.metric_deltas(order, metrics, ["critical", "high"], "status")


@query(_F + r"""o as (select run_id, lag(run_id) over w as before from (select distinct run_id, repo_root, branch, generated_at from runs) window w as (partition by repo_root, branch order by generated_at, run_id)),
 x as (select run_id, rule_id, severity, confidence, id, coalesce(affected_symbols, []) as sources, trim(regexp_replace(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')) as key, case when confidence >= 0.7 then 'high' else 'low' end as likelihood from f),
 ps as (select o.run_id as pair, s as source, max_by(x, x.id) as r from o join x on x.run_id = o.before, unnest(x.sources) as u(s) where o.before is not null and s is not null group by 1, 2),
 pt as (select o.run_id as pair, key, max_by(x, x.id) as r from o join x on x.run_id = o.before where o.before is not null group by 1, 2),
 cs as (select x.run_id as pair, x.id, min_by(ps.r, u.at) as r from (select *, unnest(range(1, len(sources) + 1)) as at from x) u join x on x.id = u.id join ps on ps.pair = x.run_id and ps.source = u.sources[u.at] group by 1, 2),
 m as (select x.run_id as pair, x.id as current_id, coalesce(cs.r, pt.r).id as previous_id, case when coalesce(cs.r, pt.r) is null then 'new' when (x.severity, x.likelihood) is not distinct from (coalesce(cs.r, pt.r).severity, coalesce(cs.r, pt.r).likelihood) then 'unchanged' else 'evolved' end as status,
  case when cs.r is not null then 'source' when pt.r is not null then 'title' else 'none' end as matched_on from x join o on o.run_id = x.run_id and o.before is not null left join cs on cs.pair = x.run_id and cs.id = x.id left join pt on pt.pair = x.run_id and pt.key = x.key)
 select * from m union all select o.run_id, null, x.id, 'resolved', 'none' from o join x on x.run_id = o.before where not exists (select 1 from m where m.pair = o.run_id and m.previous_id = x.id)""")
def risk_comparison(spark, folder):
    """Risks (findings, with their symbols as sources) of each run against those of the run before."""
    risk = lambda d: d.select("pair", "id", F.coalesce("title", F.lit("")).alias("title"), "severity", F.when(F.col("confidence") >= 0.7, "high").otherwise("low").alias("likelihood"), F.col("symbols").alias("sources"), "ord")
    current, previous = _run_pairs(spark, folder, "title")
    return compare.compare_risks(risk(current), risk(previous))


_SIDES = """o as (select run_id, lag(run_id) over w as before, lead(run_id) over w as after from (select distinct run_id, repo_root, branch, generated_at from runs) window w as (partition by repo_root, branch order by generated_at, run_id)),
k as (select id, run_id, rule_id, fingerprint, coalesce(evidence[1].path, '') as path, severity, category, confidence, id as ord from f),
s as (select k.*, k.run_id as pair, true as cur from k join o using (run_id) where before is not null union all select k.*, o.after, false from k join o using (run_id) where after is not null),
a as (select *, row_number() over (partition by pair, rule_id, fingerprint, cur order by ord, id) as n from s where fingerprint is not null),
m1 as (select c.pair, c.rule_id, c.id as cid, p.id as pid, (c.severity, c.category, c.confidence) is not distinct from (p.severity, p.category, p.confidence) as same from a c join a p on c.pair = p.pair and c.rule_id = p.rule_id and c.fingerprint = p.fingerprint and c.n = p.n and c.cur and not p.cur),
r as (select * from s where not exists (select 1 from m1 where m1.pair = s.pair and ((s.cur and cid = s.id) or (not s.cur and pid = s.id)))),
b as (select *, row_number() over (partition by pair, rule_id, path, cur order by ord, id) as n from r),
m2 as (select c.pair, c.rule_id, c.id as cid, p.id as pid, (c.severity, c.category, c.confidence) is not distinct from (p.severity, p.category, p.confidence) as same from b c join b p on c.pair = p.pair and c.rule_id = p.rule_id and c.path = p.path and c.n = p.n and c.cur and not p.cur),
m as (select * from m1 union all select * from m2)
select pair, rule_id, cid as current_id, pid as previous_id, case when same then 'unchanged' else 'modified' end as status from m
union all select pair, rule_id, id, null, 'new' from s where cur and not exists (select 1 from m where m.pair = s.pair and cid = s.id)
union all select pair, rule_id, null, id, 'resolved' from s where not cur and not exists (select 1 from m where m.pair = s.pair and pid = s.id)"""


@query(_F + _SIDES)
def compare_staged(spark, folder):
    """Set-based matching: fingerprints first, then rule and path."""
    current, previous = _run_pairs(spark, folder)
    return compare.compare_staged(current, previous)


@query("with r as (select distinct run_id, repo_root, branch, generated_at, finding_count from runs) select run_id, coalesce(lag(run_id) over w, '') as previous_run, coalesce(finding_count - lag(finding_count) over w, 0) as delta from r window w as (partition by repo_root, branch order by generated_at, run_id)")
def previous_run_lag(spark, folder):
    """The run before each run of a branch ('' for the first) and the change of its count."""
    w = W.partitionBy("repo_root", "branch").orderBy("generated_at", "run_id")
    runs = table(spark, folder, "runs").select("run_id", "repo_root", "branch", "generated_at", "finding_count").distinct()
    return runs.select(
        "run_id", F.coalesce(F.lag("run_id").over(w), F.lit("")).alias("previous_run"), F.coalesce(F.col("finding_count") - F.lag("finding_count").over(w), F.lit(0)).alias("delta")
    )


@query(_F + f"q as (select run_id, sum(case {_RANK} when 4 then 10 when 3 then 5 when 2 then 2 when 1 then 1 else 0 end) as score, count(*) as n from f group by run_id) select run_id, cast(score as bigint) as score, n from q")
def trend_points(spark, folder):
    """A weighted risk score per run."""
    rank = S.severity_rank("severity")
    weight = F.when(rank == 4, 10).when(rank == 3, 5).when(rank == 2, 2).when(rank == 1, 1).otherwise(0)
    return _findings(spark, folder, "run_id", "severity").groupBy("run_id").agg(F.sum(weight).alias("score"), F.count("*").alias("n"))


# -- lines of source
@query(_FILES + r"l as (select id, unnest(string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10))) as line from fi where content is not null) select id, marker, count(*) as n from (select id, case when regexp_matches(line, '\bFIXME\b') then 'FIXME' when regexp_matches(line, '\bTODO\b') then 'TODO' when regexp_matches(line, '\bkeep\b') then 'keep' when regexp_matches(line, '\bdrop\b') then 'drop' end as marker from l) where marker is not null group by all")
def debt_marker_first_wins(spark, folder):
    """Lines with a marker, counted by the first of the ordered list."""
    markers = ["FIXME", "TODO", "keep", "drop"]
    found = F.filter(F.transform(text_rules.split_lines("content"), lambda x: text_rules.first_marker(x, markers)), lambda m: m.isNotNull())
    rows = _files(spark, folder, found.alias("found"), where=F.col("content").rlike("|".join(markers)))
    return rows.select("id", F.explode("found").alias("marker")).groupBy("id", "marker").agg(F.count("*").alias("n"))


@query(_FILES + r"l as (select id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) as ls from fi where content is not null), x as (select id, ls, unnest(range(1, len(ls) + 1)) as line_no from l) select id, cast(line_no as int) as line_no from x where regexp_matches(ls[line_no], 'return') and not regexp_matches(array_to_string(ls[greatest(line_no - 3, 1):line_no + 1], chr(10)), 'null|nil|None')")
def line_window_veto(spark, folder):
    """Lines with a pattern and without a veto word in the lines around."""
    return text_rules.hits_with_veto(table(spark, folder, "files"), "return", "null|nil|None", 3, 1).dropDuplicates(["id", "line_no"])


@query(_FILES + r"q as (select id, len(string_split(content, chr(10))) as n_lines, len(regexp_extract_all(content, '\bfunction\b|\bdef\b|\bfunc\b')) as n_functions from fi where content <> '') select * from q where n_lines > 40 or n_functions > 5")
def large_module(spark, folder):
    """Files with many lines or functions."""
    counts = [F.size(F.split("content", "\n")).alias("n_lines"), F.regexp_count("content", F.lit(r"\bfunction\b|\bdef\b|\bfunc\b")).alias("n_functions")]
    rows = table(spark, folder, "files").where("content != ''").select("id", *counts)
    return rows.where("n_lines > 40 or n_functions > 5").dropDuplicates(["id"])


_IMPORT = r"""(?:from|require\(|import)\s*\(?["']([^"']+)["']"""


@query(_FILES + r"q as (select id, unnest(list_distinct(regexp_extract_all(content, '" + _IMPORT.replace("'", "''") + "', 1))) as target from fi where content is not null and regexp_matches(path, '\\.(ts|js|mjs)$')) select * from q")
def import_extraction(spark, folder):
    """Distinct import specifiers of each script."""
    targets = F.array_distinct(F.regexp_extract_all("content", F.lit(_IMPORT), F.lit(1)))
    rows = _files(spark, folder, targets.alias("targets"), where=F.col("path").rlike(r"\.(ts|js|mjs)$"))
    return rows.select("id", F.explode("targets").alias("target"))


# -- joins without a match
@query(_FILES + "n as (select repo_root, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]*$', '') as key, path, regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec)/') as is_test from fi where regexp_matches(path, '\\.(ts|js|mjs|py|go|java|rb)$')) select distinct repo_root, path from n where not is_test and not exists (select 1 from n t where t.is_test and t.repo_root = n.repo_root and split_part(t.key, '_', 1) = split_part(n.key, '_', 1))")
def untested_antijoin(spark, folder):
    """Source files without a test file whose name begins alike in the same repo."""
    rows = table(spark, folder, "files").where(F.col("path").rlike(r"\.(ts|js|mjs|py|go|java|rb)$"))
    rows = rows.select("repo_root", "path", F.split_part(F.regexp_replace(S.basename("path"), r"\.[^.]*$", ""), F.lit("_"), F.lit(1)).alias("key"), F.lower("path").rlike(r"(^|/)(tests?|__tests__|spec)/").alias("is_test"))
    tests = rows.where("is_test").select("repo_root", "key").distinct()
    return rows.where("not is_test").join(tests, ["repo_root", "key"], "left_anti").select("repo_root", "path").distinct()


@query(_F + "e as (select f.id, f.repo_root, unnest(f.evidence, max_depth := 2) from (select id, repo_root, evidence from f) f), p as (select distinct repo_root, path, max(line_count) over (partition by repo_root, path) as lines from files) select reason, count(*) as n from (select case when e.path is null or e.path = '' then 'missing' when p.path is null then 'path_not_found' when e.start_line < 1 or e.end_line < e.start_line or e.end_line > p.lines then 'invalid_lines' else 'ok' end as reason from e left join p on p.repo_root = e.repo_root and p.path = e.path) group by reason")
def evidence_validity(spark, folder):
    """Evidence by the first reason why it is invalid."""
    places = F.transform("evidence", lambda e: F.struct(e["path"].alias("path"), e["start_line"].alias("start_line"), e["end_line"].alias("end_line")))
    rows = _findings(spark, folder, "repo_root", places.alias("places")).select("repo_root", F.explode("places").alias("e")).select("repo_root", "e.path", "e.start_line", "e.end_line")
    known = table(spark, folder, "files").groupBy("repo_root", "path").agg(F.max("line_count").alias("lines"), F.lit(True).alias("known"))
    reason = (
        F.when(F.coalesce("path", F.lit("")) == "", "missing").when(F.col("known").isNull(), "path_not_found")
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("lines")), "invalid_lines").otherwise("ok")
    )
    return rows.join(known, ["repo_root", "path"], "left").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("with fi as (select distinct repo_root, path from files), w as (select distinct repo_root, unnest(files) as path from directory_walks) select w.repo_root, count(*) as n_missing from w left join fi using (repo_root, path) where w.path is not null and fi.path is null group by w.repo_root")
def walk_paths_missing(spark, folder):
    """Walked paths without a row in ``files``, per repo."""
    walked = table(spark, folder, "directory_walks").select("repo_root", F.explode("files").alias("path")).where("path is not null").distinct()
    return walked.join(table(spark, folder, "files").select("repo_root", "path"), ["repo_root", "path"], "left_anti").groupBy("repo_root").agg(F.count("*").alias("n_missing"))


@query("with fi as (select distinct id, repo_root, path, size_bytes from files) select id, cast(total as bigint) as total from (select id, sum(coalesce(size_bytes, 0)) over (partition by repo_root order by path, id rows unbounded preceding) as total from fi) where total <= 8000")
def scan_running_byte_cap(spark, folder):
    """The files of each repo that a scan with a limit on all bytes takes, in the order of paths."""
    files = _files(spark, folder, "repo_root", "path", F.coalesce("size_bytes", F.lit(0)).alias("n"))
    return running_total(files, ["repo_root"], ["path", "id"], F.col("n"), "total").where("total <= 8000").select("id", "total")


@query("with old as (select distinct path, hash from files where observed_at < timestamp '2025-06-01'), new as (select distinct repo_root, path, hash from files) select repo_root, path from new where hash is not null and not exists (select 1 from old where old.path = new.path and old.hash = new.hash)")
def incremental_hash_antijoin(spark, folder):
    """Files whose path and hash weren't seen before a time: what an incremental scan has to read."""
    files = table(spark, folder, "files")
    old = files.where(F.col("observed_at") < F.lit("2025-06-01").cast("timestamp_ntz")).select("path", "hash")
    return files.where("hash is not null").select("repo_root", "path", "hash").distinct().join(old, ["path", "hash"], "left_anti").select("repo_root", "path")


# -- graph
_EDGES = "with recursive e as (select distinct lower(trim(from_id)) as src, lower(trim(to_id)) as dst from relations where trim(from_id) <> '' and trim(to_id) <> ''), "


@query(_EDGES.replace("recursive ", "") + "c as (select distinct lower(trim(id)) as id from files where role = 'config') select distinct e.src as node from e join c on e.dst = c.id")
def blast_radius_one_hop(spark, folder):
    """What refers to a configuration file directly."""
    changed = table(spark, folder, "files").where("role = 'config'").select(F.lower(F.trim("id")).alias("dst"))
    return graph.edges(table(spark, folder, "relations")).join(changed, "dst", "left_semi").select(F.col("src").alias("node")).distinct()


@query(_EDGES + "r(node, depth) as (select distinct lower(trim(id)), 0 from files where role = 'config' union select e.src, depth + 1 from r join e on e.dst = r.node where depth < 3) select node, min(depth) as depth from r group by node")
def blast_radius_depth3(spark, folder):
    """What refers to a configuration file within three hops, at its least depth."""
    seeds = table(spark, folder, "files").where("role = 'config'").select(F.lower(F.trim("id")).alias("node"))
    return graph.reach(graph.edges(table(spark, folder, "relations")), seeds, 3, reverse=True)


@query(_EDGES + "r(seed, node, depth) as (select distinct lower(trim(id)), lower(trim(id)), 0 from symbols where kind = 'route' union select seed, e.dst, depth + 1 from r join e on e.src = r.node where depth < 5) select seed, node, min(depth) as depth from r where node <> seed group by seed, node")
def call_chains(spark, folder):
    """What each route reaches within five hops."""
    seeds = table(spark, folder, "symbols").where("kind = 'route'").select(F.lower(F.trim("id")).alias("node"))
    return graph.chains(graph.edges(table(spark, folder, "relations")), seeds, 5)


_IMPORTS = _EDGES.replace("from relations where", "from relations where kind in ('imports', 'depends_on') and")
#: Cycles are listed up to this length; what lies on longer ones is in ``cycle_groups``.
CYCLE_LENGTH = 5


@query(_IMPORTS + f"""w(first, path, node, n) as (select src, [src, dst], dst, 2 from e where src < dst union all select w.first, list_append(w.path, e.dst), e.dst, n + 1 from w join e on e.src = w.node where n < {CYCLE_LENGTH} and e.dst > w.first and not list_contains(w.path, e.dst))
 select array_to_string(path, '>') as cycle, n as length from w join e on e.src = w.node and e.dst = w.first""")
def cycles(spark, folder):
    """Elementary cycles of imports, each once from its least node on, up to ``CYCLE_LENGTH`` nodes."""
    found = graph.cycles(graph.edges(table(spark, folder, "relations"), ["imports", "depends_on"]), CYCLE_LENGTH)
    return found.select(F.array_join("path", ">").alias("cycle"), "length")


@query(_EDGES + """r(a, b) as (select src, dst from e where src <> dst union select r.a, e.dst from r join e on e.src = r.b where e.src <> e.dst),
 s as (select x.a as node, x.b as other from r x join r y on x.a = y.b and x.b = y.a), g as (select node, max(greatest(node, other)) as grp from s group by node) select node, grp, count(*) over (partition by grp) as size from g where node in (select node from s where node <> other)""")
def cycle_groups(spark, folder):
    """What lies on a cycle of any length over all kinds of relations, by strongly connected group."""
    return graph.cycle_groups(graph.edges(table(spark, folder, "relations")))


_CHAIN = "r(seed, node, depth, path) as (select distinct lower(trim(id)), lower(trim(id)), 0, [lower(trim(id))] from symbols where kind = 'route' union all select seed, e.dst, depth + 1, list_append(path, e.dst) from r join e on e.src = r.node where depth < 5 and e.src <> e.dst and not list_contains(path, e.dst))"


@query(_EDGES.replace("from relations where", "from relations where kind = 'calls' and") + _CHAIN + ", q as (select seed, node, min((depth, path)) as m from r where depth > 0 group by seed, node) select seed, node, m[1] as depth, array_to_string(m[2], '>') as path from q")
def call_paths(spark, folder):
    """The shortest chain of calls from each route to all it reaches within five hops."""
    seeds = table(spark, folder, "symbols").where("kind = 'route'").select(F.lower(F.trim("id")).alias("node"))
    found = graph.call_paths(graph.edges(table(spark, folder, "relations"), ["calls"]), seeds, 5)
    return found.select("seed", "node", "depth", F.array_join("path", ">").alias("path"))


_SENSITIVE, _SINK = "password|token|secret|key|user|session", "send|save|log|write|store|publish|load"
_FLOW = """k as (select distinct lower(trim(id)) as id, name from symbols where trim(id) <> ''), n as (select distinct id from k),
e as (select distinct case kind when 'accesses' then a else b end as src, case kind when 'accesses' then b else a end as dst, kind, case kind when 'calls' then 0.7 when 'accesses' then 0.8 else 0.6 end::double as confidence
 from (select distinct lower(trim(from_id)) as a, lower(trim(to_id)) as b, kind from relations where kind in ('calls', 'references', 'accesses')) where a in (select id from n) and b in (select id from n)), """


@query("with " + _FLOW + "q as (select * from e) select * from q")
def dataflow_graph(spark, folder):
    """Data flows between known symbols."""
    return graph.dataflow(table(spark, folder, "relations"), table(spark, folder, "symbols"))


@query("with recursive " + _FLOW + f"""r(seed, node, depth, path) as (select distinct id, id, 0, [id] from k where regexp_matches(lower(name), '{_SENSITIVE}') union all select seed, e.dst, depth + 1, list_append(path, e.dst) from r join (select distinct src, dst from e where src <> dst) e on e.src = r.node where depth < 6 and not list_contains(path, e.dst)),
 q as (select seed, node, min((depth, path)) as m from r where depth > 0 and node in (select id from k where regexp_matches(lower(name), '{_SINK}')) group by seed, node) select seed, node, m[1] as depth, array_to_string(m[2], '>') as path from q""")
def sensitive_flows(spark, folder):
    """Shortest flows from symbols with sensitive names to symbols that let data out."""
    symbols = table(spark, folder, "symbols")
    named = lambda p: symbols.where(F.lower("name").rlike(p)).select(F.lower(F.trim("id")).alias("node")).where("node != ''")
    edges = graph.dataflow(table(spark, folder, "relations"), symbols).select("src", "dst").distinct()
    return graph.flows(edges, named(_SENSITIVE), named(_SINK), 6).select("seed", "node", "depth", F.array_join("path", ">").alias("path"))


@query("with recursive " + _FLOW + """c as (select distinct lower(trim(from_id)) as src, lower(trim(to_id)) as dst from relations where kind = 'calls' and trim(from_id) <> '' and trim(to_id) <> ''),
 v as (select distinct id from k where regexp_matches(lower(name), 'valid|check|verify')), r(node, depth) as (select id, 0 from v union select c.src, depth + 1 from r join c on c.dst = r.node where depth < 6)
 select s.id as node, exists (select 1 from r where r.node = s.id) as reaches from (select distinct lower(trim(id)) as id from symbols where kind = 'route') s""")
def validation_reachability(spark, folder):
    """Whether each route calls anything that validates, within six hops."""
    symbols = table(spark, folder, "symbols")
    node = F.lower(F.trim("id")).alias("node")
    checks = symbols.where(F.lower("name").rlike("valid|check|verify")).select(node).where("node != ''")
    return graph.reaches(graph.edges(table(spark, folder, "relations"), ["calls"]), symbols.where("kind = 'route'").select(node), checks, 6)


@query("with " + _FLOW + """p as (select lower(trim(id)) as id, min(lower(trim(file_id))) as file from symbols where trim(id) <> '' and trim(file_id) <> '' group by 1)
 select distinct e.src, e.dst, a.file as from_file, b.file as to_file from e join p a on a.id = e.src join p b on b.id = e.dst where a.file <> b.file""")
def cross_file_flows(spark, folder):
    """Data flows between files."""
    symbols = table(spark, folder, "symbols")
    return graph.cross_file_flows(graph.dataflow(table(spark, folder, "relations"), symbols), symbols)


@query("with t as (select distinct lower(trim(from_id)) as a, lower(trim(to_id)) as b from relations where kind = 'tests' and trim(from_id) <> '' and trim(to_id) <> ''), s as (select distinct lower(trim(id)) as node from symbols where exported) select s.node, t.a as \"to\" from s join t on t.b = s.node")
def neighbours_by_kind(spark, folder):
    """The tests of each exported symbol."""
    nodes = table(spark, folder, "symbols").where("exported").select(F.lower(F.trim("id")).alias("node"))
    return graph.neighbours(graph.edges(table(spark, folder, "relations"), ["tests"]), nodes, reverse=True)


@query("with e as (select distinct id, kind, lower(trim(to_id)) as dst from relations where trim(to_id) <> '') select kind, dst, count(*) as n from e group by all having count(*) > 5")
def hub_targets(spark, folder):
    """Targets that many edges of a kind name."""
    rows = table(spark, folder, "relations").select("id", "kind", F.lower(F.trim("to_id")).alias("dst")).where("dst != ''").distinct()
    return rows.groupBy("kind", "dst").agg(F.count("*").alias("n")).where("n > 5")


@query(_F + "n as (select 'run:' || run_id as id, 'run' as kind from runs union select 'finding:' || id, 'finding' from f union select 'file:' || e.path, 'file' from (select unnest(evidence) as e from f) where e.path is not null) select kind, count(*) as n from n group by kind")
def evidence_dag_nodes(spark, folder):
    """Nodes of the evidence graph by kind, each once."""
    found = _findings(spark, folder, "evidence.path")
    node = lambda df, kind, col: df.select(F.concat(F.lit(kind + ":"), col).alias("id"), F.lit(kind).alias("kind"))
    files = found.select(F.explode("path").alias("p")).where("p is not null")
    nodes = node(table(spark, folder, "runs"), "run", F.col("run_id")).unionByName(node(found, "finding", F.col("id"))).unionByName(node(files, "file", F.col("p")))
    return nodes.distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query(_F + "e as (select distinct run_id as source, 'contains' as kind, id as target from f union select distinct id, 'located_in', e.path from (select id, unnest(evidence) as e from f) where e.path is not null union select distinct id, 'affects', s from (select id, unnest(affected_symbols) as s from f) where s is not null) select * from e")
def evidence_dag_edges(spark, folder):
    """Edges of the evidence graph, each once."""
    found = _findings(spark, folder, "run_id", "evidence.path", "affected_symbols")
    runs = found.select(F.col("run_id").alias("source"), F.lit("contains").alias("kind"), F.col("id").alias("target"))
    files = found.select(F.col("id").alias("source"), F.lit("located_in").alias("kind"), F.explode("path").alias("target"))
    symbols = found.select(F.col("id").alias("source"), F.lit("affects").alias("kind"), F.explode("affected_symbols").alias("target"))
    return runs.unionByName(files).unionByName(symbols).where("target is not null").distinct()


# -- sets, reports, windows
@query("select artifact, string_agg(k, ',' order by k) as unexpected from (select distinct artifact, unnest(json_keys(payload)) as k from artifact_records where json_valid(payload)) where k not in ('artifact', 'status', 'errors', 'version', 'repoRoot', 'createdAt') group by artifact")
def schema_drift_except(spark, folder):
    """Top members of the payloads that the schema doesn't name, per artifact."""
    rows = table(spark, folder, "artifact_records").select("artifact", F.explode(F.json_object_keys("payload")).alias("k"))
    known = ["artifact", "status", "errors", "version", "repoRoot", "createdAt"]
    return rows.where(~F.col("k").isin(known)).groupBy("artifact").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("unexpected"))


@query(_F + "k as (select id, run_id, case when category in ('auth', 'security') then 'security' when category in ('validation', 'data') then 'data' when category in ('testing', 'maintainability', 'config') then 'technical' else 'other' end as kind from f where severity in ('critical', 'high') or confidence >= 0.7) select id, kind, row_number() over (partition by run_id, kind order by id) as number from k")
def invariant_kinds(spark, folder):
    """Findings that become invariants, numbered per run and kind."""
    kind = F.when(F.col("category").isin("auth", "security"), "security").when(F.col("category").isin("validation", "data"), "data").when(F.col("category").isin("testing", "maintainability", "config"), "technical").otherwise("other")
    rows = _findings(spark, folder, "run_id", kind.alias("kind"), where="severity in ('critical', 'high') or confidence >= 0.7")
    return rows.select("id", "kind", F.row_number().over(W.partitionBy("run_id", "kind").orderBy("id")).alias("number"))


@query("select cast(time_bucket(interval 1 hour, ts) as timestamp) as window_start, event_type, count(*) as n_events, round(sum(value), 2) as total_value from events group by all")
def stream_tumbling_counts(spark, folder):
    """Hourly counts of events: the batch twin of the stream."""
    return windows.tumbling_counts(table(spark, folder, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from g) select user_id, min(ts) as session_start, count(*) as n_events from s group by user_id, n")
def stream_sessions(spark, folder):
    """Sessions of users: the batch twin of the stream."""
    return windows.sessions(table(spark, folder, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


# -- gates
_GATE_SQL = f"""g as (select id, run_id, severity, {_RANK} as rank,
  list_filter([case when lower(trim(severity)) = 'critical' then 'severity:critical' end, case when rule_id = 'RAW_SQL' and coalesce({_RANK} >= 3, false) then 'rule:RAW_SQL' end,
   case when category = 'auth' then 'category:auth' end, case when not coalesce(confidence >= 0.95, false) and category = 'security' and severity = 'high' then 'rules' end], lambda x: x is not null) as reasons,
  coalesce(not (confidence >= 0.95) or confidence is null, true) and category = 'data' as held, coalesce(list_contains(tags, 'legacy'), false) as suppressed, coalesce(confidence < 0.4, false) as low from f),
b as (select id, run_id, severity, array_to_string(reasons, ',') as reasons, case when suppressed then 'suppressed' when low then 'low_confidence' when len(reasons) > 0 then 'blocked' when coalesce(held, false) then 'held' else 'passed' end as bucket from g)"""


def _buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _findings(spark, folder, "run_id", "severity", "rule_id", "category", "confidence", "tags")
    rules = [(F.col("confidence") >= 0.95, "allow"), ((F.col("category") == "security") & (F.col("severity") == "high"), "block"), (F.col("category") == "data", "hold")]
    return gate.bucket(rows, ["critical"], ["auth"], ["RAW_SQL"], 0.4, rules, F.array_contains("tags", "legacy"))


@query(_F + _GATE_SQL + " select id, bucket, reasons from b")
def policy_bucket(spark, folder):
    """The bucket of each finding by precedence, with all reasons."""
    return _buckets(spark, folder).select("id", "bucket", F.array_join("reasons", ",").alias("reasons"))


@query(_F + _GATE_SQL + """ select run_id, count(*) filter (bucket = 'blocked') as n_blocked, count(*) filter (bucket = 'held') as n_held, count(*) filter (bucket = 'low_confidence') as n_low_confidence,
 count(*) filter (bucket = 'suppressed') as n_suppressed, count(*) filter (bucket = 'passed') as n_passed,
 case when count(*) filter (bucket = 'blocked') > 0 then 'blocked' when count(*) filter (lower(trim(severity)) = 'medium' and bucket <> 'suppressed') > 3 then 'over_limit' when count(*) filter (bucket = 'held') > 0 then 'held' else 'passed' end as status from b group by run_id""")
def policy_status(spark, folder):
    """The status of each run with the counts of its buckets."""
    return gate.status(_buckets(spark, folder), ["run_id"], {"medium": 3})


@query(_F + _GATE_SQL + ", r as (select run_id, unnest(string_split(reasons, ',')) as reason from b where bucket = 'blocked'), c as (select reason, count(*) as n from r group by reason) select reason, n from c order by n desc, reason limit 3")
def policy_reasons(spark, folder):
    """The three most frequent reasons of blocked findings; ties by name."""
    rows = _buckets(spark, folder).where("bucket = 'blocked'").select(F.explode("reasons").alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(3)


# -- snapshots of files
_SNAPS = "a as (select distinct id, repo_root, path, hash from files where observed_at <= timestamp '2025-02-15' and (deleted_at is null or deleted_at > timestamp '2025-02-15')), b as (select distinct id, repo_root, path, hash from files where observed_at <= timestamp '2025-09-01' and (deleted_at is null or deleted_at > timestamp '2025-09-01'))"


def _at(spark: SparkSession, folder: str, time: str, *columns: str) -> DataFrame:
    moment = F.lit(time).cast("timestamp_ntz")
    rows = table(spark, folder, "files").where((F.col("observed_at") <= moment) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > moment)))
    return rows.select("id", "repo_root", "path", *columns).dropDuplicates(["id"])


@query("with " + _SNAPS + " select repo_root, path, case when a.id is null then 'A' when b.id is null then 'D' else 'M' end as status from a full join b using (repo_root, path) where a.id is null or b.id is null or a.hash is distinct from b.hash")
def changed_files(spark, folder):
    """Files added, removed or changed between two moments."""
    return diffs.changed_files(_at(spark, folder, "2025-02-15", "hash"), _at(spark, folder, "2025-09-01", "hash"), ["repo_root", "path"])


@query("with " + _SNAPS + ", g as (select a.* from a left join b using (repo_root, path) where b.id is null and a.hash is not null), c as (select b.* from b left join a using (repo_root, path) where a.id is null and b.hash is not null) select c.repo_root, min(g.path) as old_name, c.path as new_name from c join g on c.repo_root = g.repo_root and c.hash = g.hash group by c.repo_root, c.path")
def renamed_files(spark, folder):
    """Added files that have the content of a removed one."""
    old, new = _at(spark, folder, "2025-02-15", "hash"), _at(spark, folder, "2025-09-01", "hash")
    return diffs.renames(diffs.changed_files(old, new, ["repo_root", "path"]), old, new, "repo_root", "path")


@query(_FILES + "q as (select id as name, sha256(content) as sha256, coalesce(octet_length(encode(content)), 0) as n_bytes from fi) select * from q")
def bundle_manifest(spark, folder):
    """Hash and size of every file."""
    return exports.manifest(table(spark, folder, "files"), "id", "content").dropDuplicates(["name"])


@query(_FILES + "q as (select id as name, case when hash is null and content is null then 'ok' when hash = sha256(content) then 'ok' else 'changed' end as state from fi) select state, count(*) as n from q group by state")
def bundle_validate(spark, folder):
    """Files against the hashes they were delivered with."""
    files = table(spark, folder, "files")
    listed = files.select(F.col("id").alias("name"), F.col("hash").alias("sha256")).dropDuplicates(["name"])
    return exports.check_manifest(listed, exports.manifest(files, "id", "content").dropDuplicates(["name"])).groupBy("state").agg(F.count("*").alias("n"))


@query(_F + """q as (select run_id, case when count(*) filter (lower(trim(severity)) = 'critical') > 0 then 'blocked_input' when count(*) filter (lower(trim(severity)) = 'high') > 0 then 'hold' else 'passed' end as verdict, count(*) as n_signals from f group by run_id) select * from q""")
def export_verdicts(spark, folder):
    """The verdict of each run for downstream gates."""
    return exports.verdicts(_findings(spark, folder, "run_id", "severity"), "run_id")


@query(_F + """q as (select id, run_id, rule_id, case when lower(trim(severity)) in ('critical', 'high') then 'error' when lower(trim(severity)) = 'medium' then 'warning' else 'note' end as level, coalesce(title, '') as message, coalesce(evidence[1].path, '') as uri, coalesce(evidence[1].start_line, 1) as start_line from f) select * from q""")
def sarif_results(spark, folder):
    """Findings as SARIF results, read back from their JSON."""
    rows = exports.sarif_rows(table(spark, folder, "findings")).dropDuplicates(["id"])
    member = lambda path: F.get_json_object("result", path)
    place = "$.locations[0].physicalLocation"
    return rows.select(
        "id", "run_id", member("$.ruleId").alias("rule_id"), member("$.level").alias("level"), member("$.message.text").alias("message"),
        member(f"{place}.artifactLocation.uri").alias("uri"), member(f"{place}.region.startLine").cast("int").alias("start_line"),
    )


# -- derived records
@query(_F + """q as (select id, run_id, case when category in ('auth', 'security') then 'abuse' when category in ('validation', 'data', 'config') then 'boundary' when category = 'testing' then 'smoke' when category = 'maintainability' then 'regression' else 'negative' end as intent,
 case lower(trim(severity)) when 'critical' then 'e2e' when 'high' then 'integration' when 'medium' then 'unit' when 'low' then 'manual' else 'unit' end as level, coalesce(confidence < 0.7, false) as gap from f)
 select id, run_id, intent, level, gap from q union all select 'smoke:' || run_id, run_id, 'smoke', 'unit', false from f where category = 'testing' group by run_id""")
def test_seeds(spark, folder):
    """A test seed per finding and a smoke seed per run with findings about tests."""
    rows = _findings(spark, folder, "run_id", "category", "severity", "confidence")
    intent = F.when(F.col("category").isin("auth", "security"), "abuse").when(F.col("category").isin("validation", "data", "config"), "boundary").when(F.col("category") == "testing", "smoke").when(F.col("category") == "maintainability", "regression").otherwise("negative")
    sev = F.lower(F.trim("severity"))
    level = F.when(sev == "critical", "e2e").when(sev == "high", "integration").when(sev == "medium", "unit").when(sev == "low", "manual").otherwise("unit")
    seeds = rows.select("id", "run_id", intent.alias("intent"), level.alias("level"), F.coalesce(F.col("confidence") < 0.7, F.lit(False)).alias("gap"))
    smoke = rows.where("category = 'testing'").select("run_id").distinct()
    return seeds.unionByName(smoke.select(F.concat(F.lit("smoke:"), "run_id").alias("id"), "run_id", F.lit("smoke").alias("intent"), F.lit("unit").alias("level"), F.lit(False).alias("gap")))


@query(_F + """q as (select 'security' as source, id, generated_at + interval 3 day as due_at from f where category = 'security' and severity in ('high', 'critical') union all select 'uncertain', id, generated_at + interval 7 day from f where confidence < 0.3 union all select 'unlocated', id, generated_at + interval 7 day from f where coalesce(len(evidence), 0) = 0) select * from q""")
def review_queue_union(spark, folder):
    """What people have to look at, from several sources, with due dates."""
    part = lambda name, test, days: _findings(spark, folder, F.lit(name).alias("source"), (F.col("generated_at") + F.expr(f"interval {days} day")).alias("due_at"), where=test).select("source", "id", "due_at")
    return part("security", "category = 'security' and severity in ('high', 'critical')", 3).unionByName(part("uncertain", "confidence < 0.3", 7)).unionByName(part("unlocated", "coalesce(size(evidence), 0) <= 0", 7))


@query(_F + """t as (select distinct lower(trim(from_id)) as test, lower(trim(to_id)) as target from relations where kind = 'tests' and trim(from_id) <> '' and trim(to_id) <> ''), s as (select id, unnest(affected_symbols) as sym from f where severity in ('critical', 'high'))
 select distinct s.id, lower(trim(s.sym)) as symbol from s where trim(s.sym) <> '' and not exists (select 1 from t where t.target = lower(trim(s.sym)))""")
def risk_without_test(spark, folder):
    """Symbols of severe findings that no test relation names."""
    tests = table(spark, folder, "relations").where("kind = 'tests'").select(F.lower(F.trim("from_id")).alias("test"), F.lower(F.trim("to_id")).alias("symbol")).where("test != '' and symbol != ''")
    rows = table(spark, folder, "findings").where("severity in ('critical', 'high')").select("id", F.explode("affected_symbols").alias("s")).select("id", F.lower(F.trim("s")).alias("symbol")).where("symbol != ''").distinct()
    return rows.join(tests.select("symbol").distinct(), "symbol", "left_anti").select("id", "symbol")


@query("with r as (select distinct id, from_id, to_id, kind, confidence from relations) select kind, count(*) as n, round(avg(confidence), 4) as mean, round(min(confidence), 4) as least, round(max(confidence), 4) as most, count(*) filter (confidence is null) as n_null from r group by kind")
def relation_statistics(spark, folder):
    """Counts and confidence of relations per kind."""
    rows = table(spark, folder, "relations").select("id", "from_id", "to_id", "kind", "confidence").distinct()
    c = F.col("confidence")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.min(c), 4).alias("least"), F.round(F.max(c), 4).alias("most"), F.count_if(c.isNull()).alias("n_null"))


@query("with w as (select distinct walk_id, repo_root, partial_walk, reasons from directory_walks) select coalesce(r, '') as reason, count(*) as n from (select walk_id, unnest(case when len(coalesce(reasons, [])) = 0 then [null] else reasons end) as r from w where partial_walk) group by 1")
def partial_walk_reasons(spark, folder):
    """Why walks are partial."""
    walks = table(spark, folder, "directory_walks").select("walk_id", "repo_root", "partial_walk", "reasons").distinct().where("partial_walk")
    return walks.select(F.explode_outer("reasons").alias("r")).groupBy(F.coalesce("r", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 0) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def rollup_cube(spark, folder):
    """Cube over two dimensions of a large fact table."""
    return table(spark, folder, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))


@query("select n_name, count(*) as n_lines, round(sum(l_extendedprice * (1 - l_discount)), 0) as revenue from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey where l_shipdate >= timestamp '1997-01-01' group by n_name")
def fact_dimension_join(spark, folder):
    """A fact table against two dimensions; sizes decide the joins at run time."""
    lines = table(spark, folder, "lineitem").where(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    joined = lines.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"))


# -- symbols of sources
def _symbol_sql() -> str:
    parts = []
    for name, patterns in code_symbols.PATTERNS.items():
        for kind, pattern in patterns.items():
            text = pattern.replace("'", "''")
            parts.append(f"select id, '{kind}' as kind, unnest(list_distinct(regexp_extract_all(content, '{text}', 1))) as name from fi where content <> '' and language = '{name}'")
    return _FILES + "q as (" + " union ".join(parts) + ") select * from q"


@query(_symbol_sql())
def symbol_extraction(spark, folder):
    """Functions, classes, variables and interfaces of each file by the patterns of its language."""
    return code_symbols.symbols(table(spark, folder, "files"), F.col("language")).dropDuplicates()


_LINES = _FILES + "l as (select id, language, unnest(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10))) as text, generate_subscripts(string_split(regexp_replace(content, '\\r\\n?', chr(10), 'g'), chr(10)), 1) as line from fi where content <> ''), "


def _parse_sql() -> str:
    parts = []
    for name, patterns in code_symbols.LINES.items():
        for kind, pattern in patterns.items():
            text = pattern.replace("'", "''")
            groups = pattern.count("|^") + pattern.count(r"|\b") + 1
            value = "coalesce(" + ", ".join(f"nullif(regexp_extract(text, '{text}', {g}), '')" for g in range(1, groups + 1)) + ")"
            parts.append(f"select id, '{kind}' as kind, {value} as name, line from l where language = '{name}'")
    return "p as (select distinct id, kind, name, cast(line as int) as line from (" + " union all ".join(parts) + ") where name is not null), "


@query(_LINES + _parse_sql() + "q as (select * from p) select * from q")
def parsed_lines(spark, folder):
    """Symbols, routes, tests and imports with their lines."""
    return code_symbols.parse(table(spark, folder, "files"), F.col("language")).distinct()


@query(_LINES + _parse_sql() + "d as (select id, line, min(name) as name from p where kind = 'function' group by id, line), j as (select l.id, l.line, l.text, d.name, coalesce(last_value(d.name ignore nulls) over (partition by l.id order by l.line), '') as caller from l left join d on d.id = l.id and d.line = l.line where l.language in ("
       + ", ".join(f"'{x}'" for x in code_symbols.LINES) + ")), c as (select id, caller, name, cast(line as int) as line, unnest(list_distinct(regexp_extract_all(text, '\\b([A-Za-z_]\\w*)\\s*\\(', 1))) as callee from j) select id, caller, callee, line, exists (select 1 from d where d.id = c.id and d.name = c.callee) as known from c where callee not in ("
       + ", ".join(f"'{x}'" for x in code_symbols.NO_CALLS) + ") and callee is distinct from name")
def code_calls(spark, folder):
    """Calls in the functions of a file."""
    return code_symbols.calls(table(spark, folder, "files"), F.col("language"))


@query(_FILES + r"""p as (select id, content, regexp_replace(regexp_replace(content, '\\.', '', 'g'), '//[^\n]*|/\*[\s\S]*?\*/|#[^\n]*|"[^"\n]*"|''[^''\n]*''|`[^`]*`', '', 'g') as t from fi where content is not null)
 select id, 'EMPTY_FILE' as code from p where trim(content) = '' union all select id, 'UNBALANCED_BRACES' from p where length(replace(t, '{', '')) <> length(replace(t, '}', '')) union all select id, 'CONFLICT_MARKERS' from p where regexp_matches(content, '(?m)^(<<<<<<< |>>>>>>> )')""")
def code_diagnostics(spark, folder):
    """Files that can't be right at a glance."""
    return code_symbols.diagnostics(table(spark, folder, "files")).distinct()


@query(_FILES + r"""a as (select id, repo_root, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '([^/]*)$', 1) as base, regexp_extract(regexp_extract(path, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) as folder from fi where path like '%/%'),
 s as (select id, repo_root, dir, './' || base as specifier, path as target from a union all select id, repo_root, dir, './' || regexp_replace(base, '\.[^.]*$', ''), null from a union all select id, repo_root, dir, '../' || folder || '/./' || base, path from a where folder <> ''),
 e as (select id, repo_root, specifier, case when starts_with(specifier, '../') then dir || '/' || regexp_extract(specifier, '([^/]*)$', 1) else dir || substr(specifier, 2) end as b from s),
 c as (select e.id, e.specifier, e.b || x.ending as target, x.place, e.repo_root from e, (values ('', 0), ('.ts', 1), ('.tsx', 2), ('.js', 3), ('.jsx', 4), ('/index.ts', 5), ('/index.tsx', 6), ('/index.js', 7), ('/index.jsx', 8)) x(ending, place))
 select c.id, c.specifier, min_by(c.target, c.place) as target from c join (select distinct repo_root, path from fi) t on t.repo_root = c.repo_root and t.path = c.target group by all""")
def import_resolution(spark, folder):
    """What relative imports resolve to: of each file, one with and one without its extension, and one through the folder above."""
    files = _files(spark, folder, "repo_root", "path", where="path like '%/%'")
    base, above = S.basename("path"), S.basename(S.dirname("path"))
    own = F.array(F.concat(F.lit("./"), base), F.concat(F.lit("./"), F.regexp_replace(base, r"\.[^.]*$", "")), F.when(above != "", F.concat(F.lit("../"), above, F.lit("/./"), base)))
    found = files.select("id", "repo_root", "path", F.explode(F.array_compact(own)).alias("specifier"))
    return code_symbols.resolve_imports(found, table(spark, folder, "files"))


@query(_FILES + """s as (select distinct lower(trim(file_id)) as fid, name, kind from symbols where deleted_at is null), x as (select lower(trim(fi.id)) as fid, count(*) as n_symbols, count(*) filter (s.kind = 'function') as n_functions from fi join s on s.fid = lower(trim(fi.id)) group by 1)
select n_symbols, count(*) as n_files, cast(sum(n_functions) as bigint) as n_functions from x group by n_symbols""")
def symbols_per_file(spark, folder):
    """How many symbols files have."""
    found = table(spark, folder, "symbols").where("deleted_at is null").select(F.lower(F.trim("file_id")).alias("fid"), "name", "kind").distinct()
    files = _files(spark, folder).select(F.lower(F.trim("id")).alias("fid"))
    per = files.join(found, "fid").groupBy("fid").agg(F.count("*").alias("n_symbols"), F.count_if(F.col("kind") == "function").alias("n_functions"))
    return per.groupBy("n_symbols").agg(F.count("*").alias("n_files"), F.sum("n_functions").alias("n_functions"))
