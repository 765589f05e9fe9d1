"""Queries for classifiers, suppressions, policies, evaluation and traceability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import classify
from evidra.functions import scalars as S
from evidra.operators import assurance, matching, policy
from evidra.plans.registry import FILES_SQL, FINDINGS_SQL, Registry, rows_of
from evidra.sources.tables import table

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _fits_sql(begins, holds, ends, path: str = "path") -> str:
    tests = [f"len(list_filter({_list(words)}, lambda w: {test}({path}, w))) > 0" for words, test in ((begins, "starts_with"), (holds, "contains"), (ends, "ends_with")) if words]
    return "(" + " or ".join(tests) + ")"


ROLE_SQL = (
    "case " + " ".join(f"when {_fits_sql(*lists)}" + (" or (ends_with(path, '.json') and (contains(path, 'config') or contains(path, 'settings')))" if role == "config" else "") + f" then '{role}'" for role, lists in classify.ROLES.items()) + " else 'source' end"
)
_EXT = r"lower(regexp_extract(path, '\.([^./]+)$', 1))"


@query(FILES_SQL + f"""q as (select id, {ROLE_SQL} as role, {_fits_sql(*classify.ROLES['generated'])} as generated, case when {_EXT} = 'rb' and contains(path, 'spec') then 'rspec' else coalesce((map {{{', '.join(f"'{k}': '{v}'" for k, v in classify.FRAMEWORKS.items())}}})[{_EXT}], 'unknown') end as framework
 from fi where path is not null) select * from q""")
def file_roles(spark, folder):
    """Role, whether the path is one of generated files, and test framework of each file."""
    return rows_of(spark, folder, "files", classify.role_of("path").alias("role"), classify.is_generated_path("path").alias("generated"), classify.test_framework("path").alias("framework"), where="path is not null")


_ENTRY_SQL = "(" + _fits_sql([f"{x}/" for x in classify.ENTRY_FOLDERS] + [f"src/{s}.{e}" for s, ends in classify.ENTRY_FILES.items() for e in ends], [f"/{x}/" for x in classify.ENTRY_FOLDERS] + [f"/{s}.{e}" for s, ends in classify.ENTRY_ANYWHERE.items() for e in ends], ()) + " or list_contains(" + _list([f"{s}.{e}" for s, ends in classify.ENTRY_FILES.items() for e in ends]) + ", path))"


@query(FILES_SQL + f"""q as (select id, {_ENTRY_SQL} as by_path, coalesce(regexp_matches(content, '{"|".join(f"({p})" for p in classify.ENTRY_CODE).replace("'", "''")}'), false) or {_ENTRY_SQL} as entry,
 case when contains(path, 'admin') then 'admin-route' when contains(path, 'order') or contains(path, 'checkout') then 'checkout-route' when contains(path, 'api') then 'api-route' when contains(path, 'routes') or contains(path, 'router') then 'route' when contains(path, 'server') or contains(path, 'app') then 'server-entry'
 when contains(path, 'index') or contains(path, 'main') then 'main-entry' else 'entrypoint' end as kind from fi where path is not null) select * from q""")
def entrypoints(spark, folder):
    """Whether each file is an entry point by path, or by path or code, and of which kind."""
    return rows_of(spark, folder, "files", classify.is_entrypoint("path").alias("by_path"), classify.is_entrypoint("path", "content").alias("entry"), classify.entrypoint_kind("path").alias("kind"), where="path is not null")


_DOMAIN_SQL = "case " + " ".join(f"when regexp_matches(lower(path), '(^|/)({w})(/|\\.|-|_)') then '{d}'" for d, w in classify.DOMAIN_WORDS) + " else (map {" + ", ".join(f"'{k}': '{v}'" for k, v in classify.DOMAINS.items()) + "})[category] end"
_REVIEW_SQL = "list_filter([case when confidence < 0.7 then 'fp-review:low-confidence' end, case when len(paths) = 0 then 'fp-review:missing-evidence' end, " + ", ".join(
    f"case when len(list_filter(paths, lambda p: regexp_matches(lower(p), '(^|/)({w})(/|\\.|-|_)'))) > 0 then 'fp-review:{n}' end" for n, w in classify.REVIEW_WORDS.items()) + "], lambda t: t is not null)"


@query(FINDINGS_SQL + f"""p as (select id, category, confidence, coalesce(evidence[1].path, '') as path, list_filter(coalesce(list_transform(evidence, lambda e: e.path), []), lambda x: x is not null) as paths, coalesce(len(evidence), 0) as n from f),
 t as (select id, {_DOMAIN_SQL} as domain, {_REVIEW_SQL} as tags from p where n = len(paths)) select id, domain, array_to_string(tags, ',') || case when len(tags) > 0 then ',fp-review' else '' end as tags from t""")
def finding_domains(spark, folder):
    """The domain of each finding, and what its reviewer should know."""
    rows = rows_of(
        spark, folder, "findings", classify.domain_of(S.primary_path(), F.col("category")).alias("domain"), F.array_join(classify.review_tags(F.col("confidence"), F.col("evidence.path")), ",").alias("tags"),
        where=~F.coalesce(F.exists("evidence.path", lambda p: p.isNull()), F.lit(False)),
    )
    return rows


@query(FILES_SQL + r"""q as (select id, regexp_replace(path, '\.[^.]+$', '') as plain, case when regexp_matches(path, 'e2e|playwright|cypress') then 'e2e' when regexp_matches(path, 'integration|integ') then 'integration' when regexp_matches(path, 'smoke') then 'smoke' else 'unit' end as level,
 case when ends_with(path, '.py') then 'pytest ' || path when ends_with(path, '.go') then 'go test ./...' when ends_with(path, '.rb') then 'bundle exec ruby ' || path else 'npm test -- ' || path end as command from fi where path is not null),
 k as (select *, regexp_extract(plain, '([^/]*)$', 1) as base, regexp_extract(regexp_extract(plain, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) as folder from q) select id, plain, case when base = 'index' then case when folder = '' then '.' else folder end else base end as key, level, command from k""")
def test_names(spark, folder):
    """What names a file among tests, the level of a test and its command."""
    return rows_of(
        spark, folder, "files", classify.without_extension("path").alias("plain"), classify.source_key("path").alias("key"), classify.test_level("path").alias("level"), classify.test_command("path").alias("command"), where="path is not null"
    )


@query(FINDINGS_SQL + r"""q as (select id, case severity when 'critical' then 'high' when 'high' then 'medium' when 'medium' then 'low' else 'unknown' end as likelihood, regexp_replace(regexp_replace(coalesce(title, ''), '\|', '\\|', 'g'), '\r\n?|\n', ' ', 'g') as cell,
 replace(coalesce(evidence[1].path, ''), '/', '\') as windows, coalesce(evidence[1].path, '') as posix from f) select * from q""")
def text_scalars(spark, folder):
    """Likelihood of a finding, its title as a table cell, and its path with and without backslashes."""
    path = S.primary_path()
    windows = F.replace(path, F.lit("/"), F.lit("\\"))
    return rows_of(spark, folder, "findings", classify.likelihood(F.col("severity")).alias("likelihood"), classify.markdown_cell(F.coalesce("title", F.lit(""))).alias("cell"), windows.alias("windows"), S.posix(windows).alias("posix"))


@query(FILES_SQL + r"""l as (select id, string_split(regexp_replace(content, '\r\n?', chr(10), 'g'), chr(10)) as ls from fi where content is not null), q as (select id, case when len(ls) >= 4 then sha256(array_to_string(ls[2:4], chr(10))) end as h from l) select id, coalesce(h, '') as excerpt from q""")
def excerpt_hashes(spark, folder):
    """The hash of lines 2 to 4 of each file; empty if it has fewer."""
    return rows_of(spark, folder, "files", F.coalesce(classify.excerpt_hash(F.col("content"), F.lit(2), F.lit(4)), F.lit("")).alias("excerpt"), where="content is not null")


# -- suppressions, one per part: the tables hold none
def _suppressions(spark, folder: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    paths = ["src/**", "src/api/*.ts", "**/*.py", "lib/**/*", "a/b/c.ts", "{a,b/c.ts", "**", "pkg\\x.ts"]
    path = F.element_at(F.array(*map(F.lit, paths)), (k % 8 + 1).cast("int"))
    rule = F.concat(F.lit("RULE_"), (k % 400).cast("string"))
    expiry = F.when(size % 5 == 0, F.lit(None)).when(size % 5 == 1, "soon").otherwise(F.date_format(F.date_add(F.lit("2025-01-01").cast("date"), (size * 7).cast("int")), "yyyy-MM-dd"))
    reason = F.when(k % 9 == 0, "").otherwise("why")
    return table(spark, folder, "part").select(k.cast("bigint").alias("k"), rule.alias("rule_id"), path.alias("path"), reason.alias("reason"), expiry.cast("string").alias("expiry"))


_S = r"""with s as (select p_partkey as k, 'RULE_' || p_partkey % 400 as rule_id, (['src/**', 'src/api/*.ts', '**/*.py', 'lib/**/*', 'a/b/c.ts', '{a,b/c.ts', '**', 'pkg\x.ts'])[p_partkey % 8 + 1] as path, case when p_partkey % 9 = 0 then '' else 'why' end as reason,
 case p_size % 5 when 0 then null when 1 then 'soon' else strftime(date '2025-01-01' + p_size * 7, '%Y-%m-%d') end as expiry from part), """
_NOW = "2025-06-01"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp")


@query(_S + "q as (select k, case k % 8 when 0 then 'source-wide' when 2 then 'extension-wide' when 3 then 'mixed-wide' else 'rule-wide' end as broad_type from s where k % 8 in (0, 2, 3, 6)) select * from q")
def broad_suppressions(spark, folder):
    """Suppressions that cover a large scope."""
    return policy.broad_suppressions(_suppressions(spark, folder)).select("k", "broad_type")


@query(_S + "q as (select k, date_diff('day', date '2025-06-01', try_cast(expiry as date)) as d from s) select k, case when d < 0 then 'expired' else 'expiring_soon' end as status, cast(abs(d) as bigint) as days from q where d <= 30")
def expiry_warnings(spark, folder):
    """Suppressions that are over or soon will be."""
    rows = _suppressions(spark, folder).where("expiry != 'soon'")
    return policy.expiry_warnings(rows, _now()).select("k", "status", F.col("days").cast("bigint").alias("days"))


@query(_S + r"""q as (select k, list_filter([case when reason = '' then 'missing reason' end, case when expiry is not null and try_cast(expiry as date) is null then 'invalid expiry' end], lambda x: x is not null) as e,
 list_filter([case when k % 8 = 5 then 'unbalanced braces' end, case when k % 8 = 7 then 'backslash in path' end, case when try_cast(expiry as date) < date '2025-06-01' then 'expired' end], lambda x: x is not null) as w from s) select k, array_to_string(e, ',') as errors, array_to_string(w, ',') as warnings, len(e) = 0 as valid from q""")
def suppression_validation(spark, folder):
    """What is wrong with each suppression."""
    return policy.validate_suppressions(_suppressions(spark, folder), _now()).select("k", F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "valid")


@query(_S + "q as (select rule_id, count(*) as n from s group by rule_id having count(*) > 4) select * from q")
def max_suppressions_per_rule(spark, folder):
    """Rules with too many suppressions."""
    return policy.too_many_per_rule(_suppressions(spark, folder), 4)


def _classed(spark, folder: str) -> DataFrame:
    entries = [{"rule_id": "RAW_SQL", "path": "src/**", "reason": "legacy", "expiry": None}, {"rule_id": "DEBT_MARKER", "path": "**/*.ts", "reason": "accepted-risk", "expiry": None}, {"rule_id": "LARGE_MODULE", "path": "**", "reason": "unheard of", "expiry": None}]
    rows = rows_of(spark, folder, "findings", "rule_id", "severity", "run_id", S.primary_path().alias("path"))
    return matching.suppress(rows, entries, _NOW, skip_expired=True)


_CLASSED = FINDINGS_SQL + r"c as (select id, run_id, rule_id, severity, case when rule_id = 'RAW_SQL' and regexp_matches(coalesce(evidence[1].path, ''), '^src/[^.]') then 'legacy' when rule_id = 'DEBT_MARKER' and regexp_matches(coalesce(evidence[1].path, ''), '^[^.].*\.ts$') then 'accepted-risk' when rule_id = 'LARGE_MODULE' and coalesce(evidence[1].path, '') <> '' then 'unheard of' end as class from f), "


@query(_CLASSED + "q as (select severity, count(*) filter (class = 'false-positive') as n_false_positive, count(*) filter (class = 'accepted-risk') as n_accepted_risk, count(*) filter (class = 'legacy') as n_legacy, count(*) filter (class = 'test-only') as n_test_only, count(*) filter (class = 'unheard of') as n_other from c where class is not null group by severity) select * from q")
def suppressed_by_class(spark, folder):
    """Suppressed findings by severity and class."""
    return policy.by_class(_classed(spark, folder).where("suppression is not null").withColumn("class", F.col("suppression")), ["severity"])


@query(_CLASSED + "q as (select run_id, count(*) as n_raw, count(*) filter (class is null) as n_effective, count(*) filter (class is not null) as n_accepted from c group by run_id) select * from q")
def self_analysis_debt(spark, folder):
    """Findings of each run before and after suppressions."""
    return _classed(spark, folder).groupBy("run_id").agg(F.count("*").alias("n_raw"), F.count_if(F.col("suppression").isNull()).alias("n_effective"), F.count_if(F.col("suppression").isNotNull()).alias("n_accepted"))


@query(FINDINGS_SQL + "q as (select id, case when summary is null then null else '[redacted]' end as summary, rule_id from f) select * from q")
def redacted_findings(spark, folder):
    """Findings under the public profile."""
    return policy.redact_details(rows_of(spark, folder, "findings", "summary", "rule_id"), ["summary"], public=True)


@query("""with k as (select distinct artifact, unnest(json_keys(payload)) as k from artifact_records where json_valid(payload)), a as (select artifact, list(k) as actual from k group by artifact),
 e as (select artifact, actual, case artifact when 'schema-validation' then ['status', 'errors', 'schemaId', 'checkedAt'] when 'cache-metadata' then ['version', 'repoRoot'] else ['version', 'owner', 'artifact'] end as expected, case artifact when 'schema-validation' then 'schema' when 'cache-metadata' then 'command' else 'test' end as kind from a)
 select artifact as "check", kind, array_to_string(list_sort(list_filter(expected, lambda x: not list_contains(actual, x))), ',') as missing, len(list_filter(actual, lambda x: not list_contains(expected, x))) as n_unexpected,
 case when len(list_filter(expected, lambda x: not list_contains(actual, x))) > 0 then 'failed' else 'passed' end as status, coalesce(case when len(list_filter(expected, lambda x: not list_contains(actual, x))) > 0 then case kind when 'test' then 'medium' else 'high' end end, '') as severity from e""")
def spec_drift(spark, folder):
    """Members that the documents of each artifact should have and don't, and the other way round."""
    keys = table(spark, folder, "artifact_records").select("artifact", F.explode(F.json_object_keys("payload")).alias("k")).groupBy("artifact").agg(F.collect_set("k").alias("actual"))
    words = lambda *w: F.array(*map(F.lit, w))
    a = F.col("artifact")
    expected = F.when(a == "schema-validation", words("status", "errors", "schemaId", "checkedAt")).when(a == "cache-metadata", words("version", "repoRoot")).otherwise(words("version", "owner", "artifact"))
    kind = F.when(a == "schema-validation", "schema").when(a == "cache-metadata", "command").otherwise("test")
    rows = policy.set_drift(keys.select(a.alias("check"), kind.alias("kind"), expected.alias("expected"), "actual"))
    return rows.select("check", "kind", F.array_join("missing", ",").alias("missing"), F.size("unexpected").alias("n_unexpected"), "status", F.coalesce("severity", F.lit("")).alias("severity"))


@query("with t as (select doc_id, text from documents where text is not null), m as (select doc_id, list_filter(['review', 'release', 'coverage', 'owner'], lambda w: not contains(text, w)) as miss from t) select len(miss) as n_missing, count(*) as n from m group by 1")
def missing_words(spark, folder):
    """How many of the required words documents lack."""
    wanted = F.array(*map(F.lit, ("review", "release", "coverage", "owner")))
    rows = table(spark, folder, "documents").where("text is not null").select(F.size(policy.missing_items(wanted, F.col("text"))).alias("n_missing"))
    return rows.groupBy("n_missing").agg(F.count("*").alias("n"))


def _reviews(spark, folder: str) -> DataFrame:
    verdict = F.when(F.col("confidence") >= 0.6, "TP").when(F.col("confidence") < 0.4, "FP").otherwise("uncertain")
    return rows_of(spark, folder, "findings", "repo_root", "run_id", "rule_id", S.primary_path().alias("path"), "title", verdict.alias("verdict"))


_REV = FINDINGS_SQL + "r as (select id, repo_root, run_id, rule_id, coalesce(evidence[1].path, '') as path, title, case when confidence >= 0.6 then 'TP' when confidence < 0.4 then 'FP' else 'uncertain' end as verdict from f), ev as (select repo_root, count(*) filter (verdict = 'TP') as tp, count(*) filter (verdict = 'FP') as fp, count(*) filter (verdict = 'uncertain') as uncertain, round(100.0 * count(*) filter (verdict = 'FP') / count(*), 2) as fp_rate from r group by repo_root), "


@query(_REV + "q as (select *, fp_rate <= 20 as meets from ev) select * from q")
def fp_evaluation(spark, folder):
    """False positives per repo, and whether their rate meets the target."""
    return policy.fp_evaluation(_reviews(spark, folder), ["repo_root"], 20)


@query(_REV + "q as (select round(avg(fp_rate), 2) as average, max(fp_rate) as greatest, min(fp_rate) as least, bool_and(fp_rate <= 20) as all_meet, bool_or(fp_rate <= 20) as any_meets from ev) select * from q")
def fp_comparison(spark, folder):
    """The evaluations of all repos in one row."""
    return policy.compare_evaluations(policy.fp_evaluation(_reviews(spark, folder), ["repo_root"], 20), "fp_rate", "meets")


@query(_REV + "q as (select rule_id, case when count(distinct path) = 1 then min(path) else '**' end as path, min_by(title, id) as reason, count(*) as n from r where verdict = 'FP' group by rule_id) select * from q")
def fp_suppressions(spark, folder):
    """Suppressions that the false positives suggest."""
    rows = _reviews(spark, folder).select("rule_id", "path", "verdict", F.col("title").alias("reason"), F.col("id").alias("ord"))
    return policy.suppression_advice(rows)


@query(_REV + "n as (select *, row_number() over (partition by run_id order by id) - 1 as place from r) select id, run_id, place, coalesce(case when place % 2 = 0 then 'TP' when place < 3 then 'FP' end, '') as reviewed from n")
def fp_review_by_place(spark, folder):
    """Reviews that are given by place, beside the findings they mean."""
    rows = _reviews(spark, folder).drop("verdict")
    last = rows.groupBy("run_id").agg((F.count("*") - 1).cast("int").alias("last"))  # every place that a run has, in blocks, so no array is long
    blocks = last.select("run_id", "last", F.explode(F.sequence(F.lit(0), "last", F.lit(1000))).alias("b"))
    places = blocks.select("run_id", F.explode(F.sequence("b", F.least(F.col("b") + 999, "last"))).alias("place"))
    given = places.select("run_id", "place", F.when(F.col("place") % 2 == 0, "TP").when(F.col("place") < 3, "FP").alias("verdict")).where("verdict is not null")
    return policy.review_by_place(rows, given, "id").select("id", "run_id", "place", F.coalesce("verdict", F.lit("")).alias("reviewed"))


_SEED = FINDINGS_SQL + """e as (select rule_id, id, regexp_extract(evidence[1].path, '([^/]*)$', 1) as base from f where evidence[1].path <> ''), sd as (select id as seeded_id, path, regexp_extract(path, '([^/]*)$', 1) as base, (['RAW_SQL', 'DEBT_MARKER', 'LARGE_MODULE'])[length(path) % 3 + 1] as rule_id, repo_root from (select distinct id, path, repo_root from files where path is not null)),
 d as (select sd.seeded_id, sd.repo_root, min(e.id) as finding_id from sd left join e on e.rule_id = sd.rule_id and e.base = sd.base group by 1, 2), """


def _detections(spark, folder: str) -> DataFrame:
    rule = F.element_at(F.array(*map(F.lit, ("RAW_SQL", "DEBT_MARKER", "LARGE_MODULE"))), F.length("path") % 3 + 1)
    seeded = rows_of(spark, folder, "files", "path", "repo_root", rule.alias("rule_id"), where="path is not null").withColumnRenamed("id", "seeded_id")
    return policy.detections(seeded, rows_of(spark, folder, "findings", "rule_id", S.primary_path().alias("path")).where("path != ''"))


@query(_SEED + "q as (select seeded_id, coalesce(finding_id, '') as finding_id, finding_id is not null as detected from d) select * from q")
def seeded_detections(spark, folder):
    """Seeded defects (one a file) with the finding that detects them."""
    return _detections(spark, folder).select("seeded_id", F.coalesce("finding_id", F.lit("")).alias("finding_id"), "detected")


@query(_SEED + "q as (select repo_root, count(*) as n, count(finding_id) as n_detected, round(100.0 * count(finding_id) / count(*), 2) as rate from d group by repo_root) select * from q")
def detection_rates(spark, folder):
    """Share of seeded defects that are detected, per repo."""
    return policy.detection_rate(_detections(spark, folder), ["repo_root"])


@query(_REV + "q as (select repo_root, cast(round((100 - fp_rate) * 0.5 + 100.0 * tp / (tp + fp + uncertain) * 0.3 + least(tp + fp + uncertain, 100) * 0.2) as int) as total from ev) select repo_root, total, case when total >= 90 then 'A' when total >= 80 then 'B' when total >= 70 then 'C' when total >= 60 then 'D' else 'F' end as grade from q")
def rule_quality(spark, folder):
    """A weighted score of the evaluation of each repo, with its grade."""
    rows = policy.fp_evaluation(_reviews(spark, folder), ["repo_root"], 20).withColumn("n", F.col("tp") + F.col("fp") + F.col("uncertain"))
    total, grade = policy.quality_score({"precision": (100 - F.col("fp_rate"), 0.5), "confirmed": (100.0 * F.col("tp") / F.col("n"), 0.3), "size": (F.least("n", F.lit(100)).cast("double"), 0.2)})
    return rows.select("repo_root", total.alias("total"), grade.alias("grade"))


# -- traceability, tests, ownership
@query("""with n as (select distinct lower(trim(id)) as id from files where id is not null union select distinct lower(trim(id)) from symbols where id is not null), e as (select distinct id, lower(trim(from_id)) as a, lower(trim(to_id)) as b from relations)
 select e.id as edge, x.side, x.node from e, lateral (values ('source', e.a), ('target', e.b)) x(side, node) where x.node is not null and not exists (select 1 from n where n.id = x.node)""")
def dangling_references(spark, folder):
    """Ends of relations that are no files or symbols at all."""
    norm = lambda c: F.lower(F.trim(c))
    nodes = table(spark, folder, "files").select(norm("id").alias("id")).unionByName(table(spark, folder, "symbols").select(norm("id").alias("id"))).distinct()
    edges = table(spark, folder, "relations").select("id", norm("from_id").alias("src"), norm("to_id").alias("dst")).distinct()
    return assurance.dangling(nodes, edges).where("node is not null")


@query(FINDINGS_SQL + """s as (select distinct lower(trim(id)) as id from symbols where exported), a as (select lower(trim(x)) as id, count(*) as n from (select unnest(affected_symbols) as x from f) group by 1),
 t as (select b as id, count(*) as n from (select distinct lower(trim(from_id)) as a, lower(trim(to_id)) as b, kind from relations where kind = 'tests' and trim(from_id) <> '' and trim(to_id) <> '') group by 1)
 select s.id, coalesce(a.n, 0) as n_findings, coalesce(t.n, 0) as n_tests, a.n is not null or t.n is not null as traced from s left join a using (id) left join t using (id)""")
def symbol_traceability(spark, folder):
    """Exported symbols with the findings that affect and the tests that name them."""
    norm = lambda c: F.lower(F.trim(c))
    things = table(spark, folder, "symbols").where("exported").select(norm("id").alias("id"))
    affected = rows_of(spark, folder, "findings", "affected_symbols").select(F.explode("affected_symbols").alias("s")).select(norm("s").alias("id"))
    relations = table(spark, folder, "relations").where("kind = 'tests'").select(norm("from_id").alias("a"), norm("to_id").alias("id")).where("a != '' and id != ''").distinct()
    return assurance.traceability(things, {"findings": affected, "tests": relations.select("id")})


@query(FINDINGS_SQL + """r as (select id, coalesce(affected_symbols, []) as sources from f where severity in ('critical', 'high')), t as (select id, case when confidence > 0.9 then [id] else [] end as risk_ids, case when category = 'testing' then coalesce(affected_symbols, []) else [] end as sources from f),
 n as (select distinct unnest(risk_ids) as id from t), s as (select distinct unnest(sources) as s from t) select r.id, exists (select 1 from n where n.id = r.id) or len(list_filter(r.sources, lambda x: x is not null)) > 0 and exists (select 1 from s where list_contains(r.sources, s.s)) as covered from r""")
def risk_coverage(spark, folder):
    """Severe findings, and whether a test names them or shares a symbol with them."""
    none = F.array().cast("array<string>")
    rows = rows_of(spark, folder, "findings", "severity", "confidence", "category", F.coalesce("affected_symbols", none).alias("sources"))
    tests = rows.select(F.when(F.col("confidence") > 0.9, F.array("id")).otherwise(none).alias("risk_ids"), F.when(F.col("category") == "testing", F.col("sources")).otherwise(none).alias("sources"))
    return assurance.risk_coverage(rows.where("severity in ('critical', 'high')").select("id", "sources"), tests).select("id", "covered")


@query(FINDINGS_SQL + """d as (select distinct run_id, finding_count > 5 as partial, 'passed' as verdict from runs), c as (select run_id, case when confidence > 0.95 then 'gone:' || id else id end as finding_id from f where confidence > 0.9),
 l as (select distinct run_id from c where not exists (select 1 from f where f.run_id = c.run_id and f.id = c.finding_id)), s as (select distinct run_id from f where lower(trim(severity)) in ('critical', 'high')),
 q as (select d.run_id, list_filter([case when partial then 'partial' end, case when l.run_id is not null then 'dangling_condition' end, case when s.run_id is not null then 'open_severe' end], lambda x: x is not null) as g from d left join l using (run_id) left join s using (run_id)) select run_id, array_to_string(g, ',') as gaps from q where len(g) > 0""")
def unsupported_decisions(spark, folder):
    """Passing decisions with what speaks against them."""
    decisions = table(spark, folder, "runs").select("run_id", (F.col("finding_count") > 5).alias("partial"), F.lit("passed").alias("verdict")).distinct()
    findings = rows_of(spark, folder, "findings", "run_id", "severity", "confidence")
    named = F.when(F.col("confidence") > 0.95, F.concat(F.lit("gone:"), "id")).otherwise(F.col("id"))
    conditions = findings.where("confidence > 0.9").select("run_id", named.alias("finding_id"))
    return assurance.unsupported_decisions(decisions, conditions, findings).select("run_id", F.array_join("gaps", ",").alias("gaps"))


@query(FINDINGS_SQL + """c as (select case when severity = 'critical' then 'severity' else 'rule' end as condition, id from f where severity = 'critical' or rule_id = 'RAW_SQL' union select 'category', id from f where category = 'auth') select id, array_to_string(list_sort(list(distinct condition)), ',') as conditions from c group by id""")
def gate_explanation(spark, folder):
    """Findings that fail conditions, with the conditions."""
    rows = rows_of(spark, folder, "findings", "run_id", "severity", "rule_id", "category")
    one = lambda name, test: rows.where(test).groupBy("run_id").agg(F.collect_list("id").alias("finding_ids")).select(F.lit(name).alias("condition"), "finding_ids")
    conditions = one("severity", "severity = 'critical'").unionByName(one("rule", "rule_id = 'RAW_SQL' and coalesce(severity, '') != 'critical'")).unionByName(one("category", "category = 'auth'"))
    return assurance.explain_gate(conditions, rows.select("id")).select("id", F.array_join("conditions", ",").alias("conditions"))


_MADE = "'tests/' || lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\\.[^.]+$', '')) || '_spec.rb'"
_TESTS = FILES_SQL + f"""pp as (select distinct repo_root, path from fi where path is not null union select distinct repo_root, {_MADE} from fi where path is not null and length(path) % 3 = 0), r as (select distinct repo_root, path, {ROLE_SQL} as role from pp), t as (select repo_root, path as test from r where role = 'test'), s as (select repo_root, path, regexp_replace(path, '\\.[^.]+$', '') as plain from r where role = 'source' and list_contains({_list(assurance.SOURCE_EXTENSIONS)}, {_EXT})),
 k as (select *, lower(case when regexp_extract(plain, '([^/]*)$', 1) = 'index' then regexp_extract(regexp_extract(plain, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) else regexp_extract(plain, '([^/]*)$', 1) end) as key from s),
 w as (select repo_root, test, unnest(list_distinct(regexp_extract_all(lower(test), '[a-z0-9]+(?:[_-][a-z0-9]+)*'))) as word from t), ww as (select repo_root, test, word as key from w union select repo_root, test, regexp_replace(word, '^(test|spec)[_-]|[_-](test|spec)$', '', 'g') from w),
 rel as (select k.repo_root, k.path, t.test from k join t on t.repo_root = k.repo_root and list_contains(list_transform({_list(assurance.TEST_ENDINGS)}, lambda e: k.plain || e), t.test) union select k.repo_root, k.path, ww.test from k join ww using (repo_root, key) where length(key) > 2), """


def _with_tests(spark, folder: str) -> DataFrame:
    """The files of the tables, and a test for every third: the tables hold hardly any."""
    files = table(spark, folder, "files").where("path is not null").select("repo_root", "path").distinct()
    made = F.concat(F.lit("tests/"), F.lower(F.regexp_replace(S.basename("path"), r"\.[^.]+$", "")), F.lit("_spec.rb"))
    return files.unionByName(files.where(F.length("path") % 3 == 0).select("repo_root", made.alias("path")))


@query(_TESTS + "q as (select * from rel) select * from q")
def related_tests(spark, folder):
    """Tests of each source file."""
    return assurance.related_tests(_with_tests(spark, folder))


_AFFECTED = "af as (select distinct repo_root, path from files where path is not null and observed_at >= timestamp '2025-06-01'), "


@query(_TESTS + _AFFECTED + "q as (select test, array_to_string(list_sort(list(distinct path)), ',') as covers, repo_root from rel join af using (repo_root, path) group by repo_root, test) select * from q")
def test_plan(spark, folder):
    """Tests that the files observed lately want."""
    files = table(spark, folder, "files").where("path is not null")
    plan, _ = assurance.test_plan(_with_tests(spark, folder), files.where(F.col("observed_at") >= F.lit("2025-06-01").cast("timestamp_ntz")))
    return plan.select("repo_root", "test", F.array_join("covers", ",").alias("covers"))


@query(_TESTS + _AFFECTED + "q as (select distinct s.repo_root, s.path from s join af using (repo_root, path) where not exists (select 1 from rel where rel.repo_root = s.repo_root and rel.path = s.path)) select * from q")
def test_gaps(spark, folder):
    """Source files observed lately that have no test."""
    files = table(spark, folder, "files").where("path is not null")
    _, gaps = assurance.test_plan(_with_tests(spark, folder), files.where(F.col("observed_at") >= F.lit("2025-06-01").cast("timestamp_ntz")))
    return gaps


_OWNED = FILES_SQL + "w as (select distinct repo_root, path, split_part(path, '/', 1) as module, case when regexp_matches(path, '\\.py$') then 'data' when regexp_matches(path, '^src/api/') then 'api' when regexp_matches(path, '(^|/)src/') then 'core' end as owner from fi where path is not null), c as (select distinct repo_root, path from files where observed_at >= timestamp '2025-06-01'), k as (select w.*, c.path is not null as changed, case when owner is null and c.path is not null then 'high' when owner is null then 'medium' else 'low' end as risk from w left join c using (repo_root, path)), "


def _file_risks(spark, folder: str) -> DataFrame:
    files = table(spark, folder, "files").where("path is not null")
    owned = matching.owners(files.select("repo_root", "path", F.split_part("path", F.lit("/"), F.lit(1)).alias("module")).distinct(), [("src/", "core"), ("/src/api/", "api"), ("*.py", "data")])
    return assurance.file_risks(owned, files.where(F.col("observed_at") >= F.lit("2025-06-01").cast("timestamp_ntz")))


@query(_OWNED + "q as (select repo_root, path, coalesce(owner, '') as owner, changed, risk from k) select * from q")
def file_risks(spark, folder):
    """Files with their owner, whether they changed lately, and the risk of that."""
    return _file_risks(spark, folder).select("repo_root", "path", F.coalesce("owner", F.lit("")).alias("owner"), "changed", "risk")


@query(_OWNED + "m as (select repo_root, module, count(*) as n_files, count(*) filter (changed) as n_changed, count(*) filter (owner is null) as n_unowned, coalesce(array_to_string(list_sort(list(distinct owner) filter (owner is not null)), ','), '') as owners from k group by all) select *, case when n_changed > 0 and (owners = '' or n_unowned > 0) then 'high' when owners = '' or n_unowned > 0 then 'medium' else 'low' end as risk from m")
def module_risks(spark, folder):
    """The same per module."""
    return assurance.module_risks(_file_risks(spark, folder))


@query(_OWNED + "q as (select repo_root, count(*) as n_files, count(owner) as n_owned, count(*) filter (owner is null) as n_unowned, count(*) filter (changed) as n_changed, count(*) filter (risk = 'high') as n_high, count(*) filter (risk = 'medium') as n_medium, count(*) filter (risk = 'low') as n_low, coalesce(array_to_string(list_sort(list(distinct owner) filter (changed and owner is not null)), ','), '') as reviewers from k group by repo_root) select * from q")
def ownership_summary(spark, folder):
    """Counts of files by ownership and risk per repo."""
    return assurance.ownership_summary(_file_risks(spark, folder), ["repo_root"])


_SQL_RANK = "case lower(trim(severity)) when 'info' then 0 when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end"


@query(FINDINGS_SQL + f"q as (select id, rule_id, {_SQL_RANK} as rank from f where confidence >= 0.6) select id, rule_id, (select count(*) > 500 from q) as truncated from q order by rank desc nulls last, rule_id, id limit 500")
def assurance_candidates(spark, folder):
    """The 500 first candidates, and whether there are more."""
    rows = rows_of(spark, folder, "findings", "rule_id", S.severity_rank("severity").alias("rank"), where="confidence >= 0.6")
    return assurance.top_with_flag(rows, [F.desc_nulls_last("rank"), F.asc("rule_id"), F.asc("id")], 500).select("id", "rule_id", "truncated")


@query(FINDINGS_SQL + f"q as (select id, run_id, row_number() over (partition by run_id order by {_SQL_RANK} desc nulls last, id) as place from f) select * from q where place <= 5")
def annotations(spark, folder):
    """The five findings of each run that a review shows first."""
    rows = rows_of(spark, folder, "findings", "run_id", S.severity_rank("severity").alias("rank"))
    return assurance.capped(rows, ["run_id"], [F.desc_nulls_last("rank"), F.asc("id")], 5).select("id", "run_id", "place")


@query(_S + "d as (select 'o' || k % 10 as owner, date_diff('day', try_cast(expiry as date), date '2025-06-01') as o from s) select owner, count(*) as n, count(*) filter (o > 0) as n_over, cast(coalesce(max(o) filter (o > 0), 0) as int) as oldest_days from d group by owner")
def debt_ledger(spark, folder):
    """Debts per owner, and how old the oldest is that is over."""
    rows = _suppressions(spark, folder).select(F.concat(F.lit("o"), (F.col("k") % 10).cast("string")).alias("owner"), F.when(F.col("expiry") != "soon", F.col("expiry")).alias("expiry"))
    return assurance.debt_ledger(rows, F.lit(_NOW).cast("date"))
