"""Traceability over nodes and edges, test plans, ownership risk and explanations of gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions import classify
from evidra.session import saved


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edge, side, node`` for each end of an edge (``id, src, dst``) that is no node (``id``): at most two rows an edge."""
    ends = edges.select(F.col("id").alias("edge"), F.explode(F.array(F.struct(F.lit("source").alias("side"), F.col("src").alias("node")), F.struct(F.lit("target").alias("side"), F.col("dst").alias("node")))).alias("e"))
    return ends.select("edge", "e.side", "e.node").join(nodes.select(F.col("id").alias("node")), "node", "left_anti").select("edge", "side", "node")


def traceability(things: DataFrame, links: dict[str, DataFrame]) -> DataFrame:
    """``things`` (``id``) with ``n_<way>`` for each way of linking (``id`` of the thing, one row a link), and ``traced`` if there is any."""
    out = things.select("id").distinct()
    for way, rows in links.items():
        out = out.join(rows.groupBy("id").agg(F.count("*").alias(f"n_{way}")), "id", "left")
    out = out.na.fill(0, [f"n_{way}" for way in links])
    some = F.lit(False)
    for way in links:
        some = some | (F.col(f"n_{way}") > 0)
    return out.withColumn("traced", some)


def risk_coverage(risks: DataFrame, tests: DataFrame) -> DataFrame:
    """``risks`` (``id, sources``) with ``covered``: a test (``risk_ids, sources``: arrays) names the risk or shares a source finding with it.

    Both ways are equi-joins on exploded ids, so no test is compared with every risk.
    """
    named = tests.select(F.explode("risk_ids").alias("id"))
    source = risks.select("id", F.explode("sources").alias("source")).join(tests.select(F.explode("sources").alias("source")).distinct(), "source").select("id")
    hit = named.unionByName(source).distinct().withColumn("_c", F.lit(True))
    return risks.join(hit, "id", "left").withColumn("covered", F.coalesce("_c", F.lit(False))).drop("_c")


def unsupported_decisions(decisions: DataFrame, conditions: DataFrame, findings: DataFrame) -> DataFrame:
    """``run_id, gaps``: passing decisions (``run_id, verdict, partial``) with what speaks against them.

    ``partial``: the run isn't complete; ``dangling_condition``: a condition (``run_id, finding_id``) names a finding that isn't there;
    ``open_severe``: critical or high findings remain.
    """
    lost = conditions.join(findings.select("run_id", F.col("id").alias("finding_id")), ["run_id", "finding_id"], "left_anti").select("run_id").distinct().withColumn("_lost", F.lit(True))
    severe = findings.where(F.lower(F.trim("severity")).isin("critical", "high")).select("run_id").distinct().withColumn("_severe", F.lit(True))
    rows = decisions.where("verdict in ('passed', 'passed_with_risk')").join(lost, "run_id", "left").join(severe, "run_id", "left")
    gaps = F.array_compact(F.array(F.when(F.col("partial"), "partial"), F.when(F.col("_lost"), "dangling_condition"), F.when(F.col("_severe"), "open_severe")))
    return rows.select("run_id", gaps.alias("gaps")).where(F.size("gaps") > 0)


def explain_gate(conditions: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (``id``) that failed conditions (``condition, finding_ids``) name, with the sorted conditions."""
    named = conditions.select("condition", F.explode("finding_ids").alias("id")).distinct()
    why = named.groupBy("id").agg(F.array_sort(F.collect_set("condition")).alias("conditions"))
    return findings.join(why, "id")


#: Endings of the tests that belong to a source file without its extension (fixed values).
TEST_ENDINGS = (".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js", "_test.py", "_test.go")
#: Languages of source files that want tests (fixed values).
SOURCE_EXTENSIONS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rb", "rs", "java", "php", "cs", "cpp", "cc", "cxx", "hpp", "hxx")


def related_tests(files: DataFrame) -> DataFrame:
    """``repo_root, path, test``: tests of each source file of the same repo.

    A test belongs to a file if its path is one of ``TEST_ENDINGS`` behind the file's, or holds the file's name (of
    more than two characters) as a run of letters and digits between separators. Both are equi-joins: words of test paths are
    rows, so no file meets all tests.
    """
    rows = saved(files.select("repo_root", "path").distinct().withColumn("role", classify.role_of("path")))  # roles are long expressions, taken once
    tests = rows.where("role = 'test'").select("repo_root", F.col("path").alias("test"))
    sources = rows.where((F.col("role") == "source") & classify.extension("path").isin(*SOURCE_EXTENSIONS)).select("repo_root", "path")
    plain = classify.without_extension("path")
    exact = sources.select("repo_root", "path", F.explode(F.array(*[F.concat(plain, F.lit(e)) for e in TEST_ENDINGS])).alias("test")).join(tests, ["repo_root", "test"])
    words = tests.select("repo_root", "test", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("test"), F.lit(r"[a-z0-9]+(?:[_-][a-z0-9]+)*"), F.lit(0)))).alias("key"))
    key = F.lower(classify.source_key("path"))
    stems = words.select("repo_root", "test", F.explode(F.array_distinct(F.array("key", F.regexp_replace("key", r"^(test|spec)[_-]|[_-](test|spec)$", "")))).alias("key")).distinct()
    named = sources.select("repo_root", "path", key.alias("key")).where(F.length("key") > 2).join(stems, ["repo_root", "key"])
    return exact.select("repo_root", "path", "test").unionByName(named.select("repo_root", "path", "test")).distinct()


def test_plan(files: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recommended tests with the affected files (``repo_root, path``) they cover, level and command; and affected source files without a test."""
    found = related_tests(files).join(affected.select("repo_root", "path").distinct(), ["repo_root", "path"], "left_semi")
    plan = found.groupBy("repo_root", "test").agg(F.array_sort(F.collect_set("path")).alias("covers"))
    plan = plan.select("repo_root", "test", "covers", classify.test_level("test").alias("level"), classify.test_command("test").alias("command"))
    sources = affected.where((classify.role_of("path") == "source") & classify.extension("path").isin(*SOURCE_EXTENSIONS)).select("repo_root", "path").distinct()
    return plan, sources.join(found.select("repo_root", "path"), ["repo_root", "path"], "left_anti")


def file_risks(files: DataFrame, changed: DataFrame, focus: DataFrame | None = None) -> DataFrame:
    """Files (``repo_root, path, module, owner``) with ``changed`` and ``risk``: high if changed without an owner, medium without one, else low; ``focus`` keeps some paths only."""
    rows = files if focus is None else files.join(focus.select("repo_root", "path").distinct(), ["repo_root", "path"], "left_semi")
    rows = rows.join(changed.select("repo_root", "path").distinct().withColumn("_c", F.lit(True)), ["repo_root", "path"], "left").withColumn("changed", F.coalesce("_c", F.lit(False))).drop("_c")
    return rows.withColumn("risk", F.when(F.col("owner").isNull() & F.col("changed"), "high").when(F.col("owner").isNull(), "medium").otherwise("low"))


def module_risks(risks: DataFrame) -> DataFrame:
    """Per module: files, changed and unowned ones, owners, and the risk: high if it changed and lacks owners, medium if it lacks them."""
    per = risks.groupBy("repo_root", "module").agg(
        F.count("*").alias("n_files"), F.count_if("changed").alias("n_changed"), F.count_if(F.col("owner").isNull()).alias("n_unowned"), F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"),
    )
    lacks = (F.col("owners") == "") | (F.col("n_unowned") > 0)
    return per.withColumn("risk", F.when((F.col("n_changed") > 0) & lacks, "high").when(lacks, "medium").otherwise("low"))


def ownership_summary(risks: DataFrame, by: list[str]) -> DataFrame:
    """Counts of files by ownership, change and risk, and the distinct owners of changed files."""
    return risks.groupBy(*by).agg(
        F.count("*").alias("n_files"), F.count_if(F.col("owner").isNotNull()).alias("n_owned"), F.count_if(F.col("owner").isNull()).alias("n_unowned"), F.count_if("changed").alias("n_changed"),
        *[F.count_if(F.col("risk") == r).alias(f"n_{r}") for r in ("high", "medium", "low")], F.array_join(F.array_sort(F.collect_set(F.when(F.col("changed"), F.col("owner")))), ",").alias("reviewers"),
    )


def top_with_flag(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows, with ``truncated``: whether there are more."""
    more = rows.agg((F.count("*") > k).alias("_m")).scalar()
    return rows.orderBy(*order).limit(k).withColumn("truncated", more)


def capped(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group, with ``place`` from 1: review lists and annotations."""
    from pyspark.sql import Window as W

    return rows.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)


def debt_ledger(debts: DataFrame, now: Column) -> DataFrame:
    """Debts (``owner, rule_id, expiry``) per owner: how many, how many over, and the age in days of the oldest that is."""
    over = F.datediff(now, F.to_date("expiry"))
    return debts.groupBy("owner").agg(F.count("*").alias("n"), F.count_if(over > 0).alias("n_over"), F.coalesce(F.max(F.when(over > 0, over)), F.lit(0)).alias("oldest_days"))
