"""Reports of other tools as findings: one JSON document per row, taken apart with Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.scalars import rule_key

_LINT = "array<struct<filePath:string,messages:array<struct<ruleId:string,severity:int,message:string,line:int,endLine:int>>>>"
_SAST = (
    "struct<results:array<struct<check_id:string,path:string,start:struct<line:int>,end:struct<line:int>,"
    "extra:struct<message:string,severity:string,metadata:struct<owasp:string>>>>>"
)
_RULE = "struct<id:string,name:string,shortDescription:struct<text:string>,fullDescription:struct<text:string>,properties:struct<`security-severity`:string,tags:array<string>>>"
_SARIF = (
    f"struct<runs:array<struct<tool:struct<driver:struct<name:string,rules:array<{_RULE}>>>,results:array<struct<ruleId:string,ruleIndex:int,level:string,message:struct<text:string>,"
    "properties:struct<`security-severity`:string,tags:array<string>>,partialFingerprints:struct<primaryLocationLineHash:string>,fingerprints:struct<primaryLocationLineHash:string>,"
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,endLine:int>>>>>>>>>"
)
_COMPILER = "array<struct<code:int,category:string,messageText:string,message:string,file:string,start:struct<line:int>,end:struct<line:int>>>"
_AUDIT = "map<string,struct<name:string,severity:string,isDirect:boolean,range:string,via:array<string>>>"
_ADVISORY = "struct<title:string,url:string,severity:string,cwe:array<string>>"
_PART = "struct<total:double,covered:double>"
_COVERAGE = f"map<string,struct<lines:{_PART},functions:{_PART}>>"
_TESTS = "array<struct<name:string,status:string,file:string,path:string,line:int,message:string,error:string>>"

#: Words of rule ids and the category they stand for; the first group with a hit decides (fixed values).
CATEGORY_WORDS = (
    (("security", "no-eval", "no-implied-eval"), "security"),
    (("auth", "password", "secret"), "auth"),
    (("unused", "no-var", "prefer-"), "maintainability"),
    (("injection", "xss"), "security"),
    (("jwt",), "auth"),
    (("sql", "data"), "data"),
)
#: The same for rule ids and tags of SARIF results, looked at first (fixed values).
SARIF_WORDS = ((("auth", "jwt", "password"), "auth"), (("security", "cwe", "owasp", "injection", "xss"), "security"))


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def category_of(rule: Column, groups: tuple = CATEGORY_WORDS, otherwise: Column | str = "maintainability") -> Column:
    """The category that a rule id suggests."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for words, name in reversed(groups):
        out = F.when(_holds(rule, words), name).otherwise(out)
    return out


def tag_union(*sets: Column) -> Column:
    """Tags of several lists: no empty ones, each once, sorted; null if there are none."""
    joined = F.array_sort(F.array_distinct(F.filter(F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in sets]), lambda t: t != "")))
    return F.when(F.size(joined) > 0, joined)


def lint_severity(level: Column) -> Column:
    """2 is high, 1 medium, anything else low."""
    return F.when(level == 2, "high").when(level == 1, "medium").otherwise("low")


def sast_severity(level: Column) -> Column:
    """Error and critical are critical, warning and high are high, anything else medium."""
    level = F.lower(level)
    return F.when(level.isin("error", "critical"), "critical").when(level.isin("warning", "high"), "high").otherwise("medium")


def sarif_severity(level: Column, score: Column) -> Column:
    """By the security score (9, 7, 4) if it is a number, else by the level; no level counts as a warning."""
    score, level = score.try_cast("double"), F.lower(F.coalesce(level, F.lit("warning")))
    by_score = F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")
    by_level = F.when(level == "error", "high").when(level.isin("note", "none"), "low").otherwise("medium")
    return F.when(score.isNotNull() & ~F.isnan(score), by_score).otherwise(by_level)


def compiler_severity(category: Column) -> Column:
    """Errors (also given as 1) are high, anything else medium."""
    return F.when(F.lower(category).isin("1", "error"), "high").otherwise("medium")


def audit_severity(level: Column) -> Column:
    """Critical and high stay, moderate is medium, anything else low."""
    level = F.lower(level)
    return F.when(level.isin("critical", "high"), level).when(level == "moderate", "medium").otherwise("low")


def import_id(tool: str, rule: Column, path: Column, line: Column) -> Column:
    """The id of an imported finding: 12 hex digits over tool, rule, path and line."""
    key = F.concat_ws(":", F.lit(tool), rule, path, line.cast("string"))
    return F.concat(F.lit(f"import-{tool}-"), F.substring(F.sha2(key, 256), 1, 12))


def _finding(
    tool: str, key: Column, rule: Column, category: Column | str, severity: Column, confidence: float, title: Column, summary: Column, path: Column, start: Column, end: Column,
    kind: str = "external", id_line: Column | None = None, reference: Column | None = None, url: Column | None = None, tags: Column | None = None, fingerprint: Column | None = None,
) -> list[Column]:
    """The columns of a finding with one piece of evidence."""
    text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
    own = import_id(tool, key, path, id_line if id_line is not None else start)
    outside = F.struct(F.lit(tool).alias("tool"), text(reference).alias("rule_id"), text(url).alias("url"))
    evidence = F.struct(
        F.concat(F.lit("evidence-"), own, F.lit("-00")).alias("id"), path.alias("path"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), F.lit(kind).alias("kind"), outside.alias("external_ref")
    )
    return [
        own.alias("id"), rule.alias("rule_id"), text(category).alias("category"), severity.alias("severity"), F.lit(confidence).alias("confidence"), title.alias("title"), summary.alias("summary"),
        F.array(evidence).alias("evidence"), (tags if tags is not None else F.lit(None).cast("array<string>")).alias("tags"),
        F.struct(F.lit(tool).alias("tool"), text(reference).alias("rule_id")).alias("upstream"), text(fingerprint).alias("fingerprint"),
    ]


def _prefixed(prefix: str, rule: Column) -> Column:
    return F.concat(F.lit(prefix), F.replace(F.upper(rule), F.lit("-"), F.lit("_")))


def lint(reports: DataFrame) -> DataFrame:
    """Findings of lint reports (``report``: JSON): the messages of each file. A message without a rule has the rule ``unknown``."""
    files = reports.select(F.explode(F.from_json("report", _LINT)).alias("f"))
    rows = files.select(F.col("f.filePath").alias("path"), F.explode("f.messages").alias("m"))
    rule = F.coalesce("m.ruleId", F.lit("unknown"))
    end = F.coalesce("m.endLine", "m.line")
    return rows.select(*_finding("eslint", rule, _prefixed("ESLINT_", rule), category_of(rule), lint_severity(F.col("m.severity")), 0.9, rule, F.col("m.message"), F.col("path"), F.col("m.line"), end, reference=rule))


def sast(reports: DataFrame) -> DataFrame:
    """Findings of scanner reports."""
    rows = reports.select(F.explode(F.from_json("report", _SAST)["results"]).alias("r"))
    rule, owasp = F.col("r.check_id"), F.col("r.extra.metadata.owasp")
    tags = F.when(F.coalesce(owasp, F.lit("")) != "", F.array(F.concat(F.lit("owasp-"), owasp)))
    return rows.select(*_finding(
        "semgrep", rule, _prefixed("SEMGREP_", rule), category_of(rule), sast_severity(F.col("r.extra.severity")), 0.85, rule, F.col("r.extra.message"), F.col("r.path"), F.col("r.start.line"), F.col("r.end.line"),
        reference=rule, tags=tags,
    ))


def sarif(reports: DataFrame, tool: str = "sarif") -> DataFrame:
    """Findings of SARIF reports (``tool``: ``sarif`` or ``codeql``); results without a file or a line from 1 are dropped, rules may be named by index."""
    runs = reports.select(F.explode(F.from_json("report", _SARIF)["runs"]).alias("run"))
    rows = runs.select(F.col("run.tool.driver.rules").alias("rules"), F.coalesce("run.tool.driver.name", F.lit(tool)).alias("driver"), F.explode("run.results").alias("r"))
    rows = rows.withColumn("rule", F.when(F.col("r.ruleIndex") >= 0, F.get("rules", F.col("r.ruleIndex"))))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    rule, path, start, end = F.coalesce("r.ruleId", "rule.id", F.lit("unknown-rule")), place["artifactLocation"]["uri"], place["region"]["startLine"], place["region"]["endLine"]
    tags = tag_union(F.col("rule.properties.tags"), F.col("r.properties.tags"))
    words = F.concat_ws(" ", F.lower(rule), F.transform(F.coalesce(F.col("rule.properties.tags"), F.array().cast("array<string>")), F.lower), F.transform(F.coalesce(F.col("r.properties.tags"), F.array().cast("array<string>")), F.lower))
    line_hash = F.coalesce("r.partialFingerprints.primaryLocationLineHash", "r.fingerprints.primaryLocationLineHash")
    summary = F.coalesce("r.message.text", "rule.shortDescription.text", "rule.fullDescription.text", F.concat("driver", F.lit(" result "), rule))
    score = F.coalesce(F.col("r.properties")["security-severity"], F.col("rule.properties")["security-severity"])
    out = rows.where((F.coalesce(path, F.lit("")) != "") & (start >= 1))
    return out.select(*_finding(
        tool, rule, F.concat(F.lit(tool.upper() + "_"), rule_key(rule)), category_of(words, SARIF_WORDS, category_of(rule)), sarif_severity(F.col("r.level"), score), 0.9 if tool == "codeql" else 0.85,
        F.coalesce("rule.name", rule), summary, path, start, F.when(end >= start, end).otherwise(start), reference=rule, tags=tags,
        fingerprint=F.when(line_hash != "", F.substring(F.sha2(line_hash, 256), 1, 16)),
    ))


def _message(text: Column) -> Column:
    """The text of a message, or of a chain of messages from its head on."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r'"messageText"\s*:\s*"((?:[^"\\]++|\\.)*+)"'), F.lit(1)), lambda x: x != "")
    plain = F.transform(parts, lambda x: F.from_json(F.concat(F.lit('{"v":"'), x, F.lit('"}')), "v string")["v"])
    return F.when(text.startswith("{"), F.array_join(plain, " ")).otherwise(F.coalesce(text, F.lit("TypeScript compiler diagnostic")))


def compiler(reports: DataFrame) -> DataFrame:
    """Findings of type-checker reports: a list of diagnostics, or an object that holds it; those without a file are dropped."""
    listed = F.when(F.ltrim("report").startswith("["), F.col("report")).otherwise(F.get_json_object("report", "$.diagnostics"))
    rows = reports.select(F.explode(F.from_json(listed, _COMPILER)).alias("d")).where("d.file is not null and d.file != ''")
    code, line = F.col("d.code").cast("string"), F.coalesce("d.start.line", F.lit(1))
    named = F.concat(F.lit("TS"), code)
    return rows.select(*_finding(
        "tsc", code, F.concat(F.lit("TSC_"), named), category_of(code), compiler_severity(F.col("d.category")), 0.95, F.concat(F.lit("TypeScript Error "), named),
        _message(F.coalesce("d.message", "d.messageText")), F.col("d.file"), line, F.coalesce("d.end.line", line), reference=named,
    ))


def audit(reports: DataFrame, evidence_path: str = "package-lock.json") -> DataFrame:
    """Findings of dependency audits: one per vulnerable package, with the advisories it stems from."""
    rows = reports.select(F.explode(F.from_json(F.get_json_object("report", "$.vulnerabilities"), _AUDIT)).alias("package", "v"))
    advisories = F.transform(F.filter(F.coalesce(F.col("v.via"), F.array().cast("array<string>")), lambda x: x.startswith("{")), lambda x: F.from_json(x, _ADVISORY))
    rows = rows.withColumn("a", advisories)
    severity = F.coalesce("v.severity", F.get(F.filter(F.transform("a", lambda x: x["severity"]), lambda s: s.isNotNull()), F.lit(0)))
    titles = F.filter(F.transform("a", lambda x: x["title"]), lambda t: t != "")
    bounds = F.when(F.coalesce("v.range", F.lit("")) != "", F.concat(F.lit(" ("), "v.range", F.lit(")"))).otherwise("")
    plain = F.concat(F.lit("npm audit reported "), F.coalesce(severity, F.lit("unknown")), F.lit(" severity for "), "package", bounds)
    kind = F.array(F.when(F.col("v.isDirect"), "direct-dependency").otherwise("transitive-dependency"))
    tags = tag_union(kind, F.flatten(F.transform("a", lambda x: F.coalesce(x["cwe"], F.array().cast("array<string>")))))
    none = F.lit(None).cast("int")
    return rows.select(*_finding(
        "npm-audit", F.col("package"), F.concat(F.lit("NPM_AUDIT_"), rule_key("package")), "security", audit_severity(severity), 0.95, F.concat(F.lit("Vulnerable dependency: "), F.coalesce("v.name", "package")),
        F.when(F.size(titles) > 0, F.array_join(titles, "; ")).otherwise(plain), F.lit(evidence_path), none, none, id_line=F.lit(1), reference=F.col("package"),
        url=F.nullif(F.get("a", F.lit(0))["url"], F.lit("")), tags=tags,
    ))


#: Coverage findings: part, name in ids, rule, least rate, severity below ``SEVERE_COVERAGE``, severity above it (fixed values).
COVERAGE_RULES = (
    ("lines", "low-coverage", "COVERAGE_LOW_LINE_COVERAGE", "line", 0.5, "high", "medium"),
    ("functions", "low-function-coverage", "COVERAGE_LOW_FUNCTION_COVERAGE", "function", 0.5, "medium", "low"),
)
SEVERE_COVERAGE = 0.3


def coverage(reports: DataFrame) -> DataFrame:
    """At most two findings per file, for lines and functions of which less than half is covered; 0 of 0 is none.

    Both shapes are read: files under ``coverageMap``, and files beside a ``total``.
    """
    files = F.coalesce(F.get_json_object("report", "$.coverageMap"), F.col("report"))
    rows = reports.select(F.explode(F.from_json(files, _COVERAGE)).alias("path", "c")).where("path <> 'total'")
    parts = [
        F.struct(
            F.lit(key).alias("key"), F.lit(rule).alias("rule"), F.lit(word).alias("word"), F.lit(least).alias("least"), F.lit(below).alias("below"), F.lit(above).alias("above"),
            F.col(f"c.{part}.covered").alias("covered"), F.col(f"c.{part}.total").alias("total"),
        )
        for part, key, rule, word, least, below, above in COVERAGE_RULES
    ]
    rows = rows.select("path", F.explode(F.array(*parts)).alias("p")).withColumn("rate", F.try_divide("p.covered", "p.total")).where("rate < p.least")
    percent = F.concat(F.round(F.col("rate") * 100).cast("int").cast("string"), F.lit("%"))
    count = lambda c: F.col(c).cast("bigint").cast("string")
    none = F.lit(None).cast("int")
    return rows.select(*_finding(
        "coverage", F.col("p.key"), F.col("p.rule"), "testing", F.when(F.col("rate") < SEVERE_COVERAGE, F.col("p.below")).otherwise(F.col("p.above")), 0.95,
        F.concat(F.lit("Low "), "p.word", F.lit(" coverage ("), percent, F.lit(")")),
        F.concat(F.lit("File "), "path", F.lit(" has only "), percent, F.lit(" "), "p.word", F.lit(" coverage ("), count("p.covered"), F.lit("/"), count("p.total"), F.lit(" "), "p.word", F.lit("s)")),
        F.col("path"), none, none, kind="coverage", id_line=F.lit(1),
    ))


def tests(reports: DataFrame) -> DataFrame:
    """A finding per failed test."""
    rows = reports.select(F.explode(F.from_json("report", _TESTS)).alias("t")).where("t.status in ('failed', 'error')")
    filled = lambda *names: F.coalesce(*[F.nullif(F.col(f"t.{n}"), F.lit("")) for n in names])
    path, line = F.coalesce(filled("file", "path"), F.lit("unknown")), F.coalesce(F.nullif("t.line", F.lit(0)), F.lit(1))
    return rows.select(*_finding(
        "test", F.lit("failed"), F.lit("TEST_FAILED"), "testing", F.lit("high"), 1.0, F.coalesce(filled("name"), F.lit("Failed test")), F.coalesce(filled("message", "error"), F.lit("Test failed")),
        path, line, F.lit(None).cast("int"), kind="test",
    ))


IMPORTERS = {"eslint": lint, "semgrep": sast, "sarif": sarif, "codeql": lambda r: sarif(r, "codeql"), "tsc": compiler, "npm-audit": audit, "coverage": coverage, "test": tests}

#: A path that leaves the repository.
_OUTSIDE = r"^(?:[A-Za-z]:|/|\\)|(?:^|/)\.\.(?:/|$)"


def inspect(reports: DataFrame, findings: DataFrame, seen: Column) -> DataFrame:
    """One row: entries ``seen`` in all reports (a count per report), findings that came of them, and how many were dropped."""
    n_seen = reports.agg(F.coalesce(F.sum(seen), F.lit(0)).alias("n_seen"))
    n_kept = findings.agg(F.count("*").alias("n_findings"))
    return n_seen.select("n_seen", n_kept.scalar().alias("n_findings")).withColumn("n_dropped", F.greatest(F.col("n_seen") - F.col("n_findings"), F.lit(0)))


def normalise(findings: DataFrame, order: list[str], most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings that can be taken over, and the others with a ``diagnostic``.

    The first of each id by ``order`` is taken (``duplicate_id`` for the others), if all its evidence lies inside the repository
    (``path_outside``). ``most`` is the limit of an import, if it has one (``over_limit``, by id).
    """
    from pyspark.sql import Window as W

    outside = F.exists("evidence", lambda e: e["path"].rlike(_OUTSIDE) | (F.coalesce(e["path"], F.lit("")) == ""))
    rows = findings.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*order)))
    reason = F.when(F.col("_n") > 1, "duplicate_id").when(F.coalesce(outside, F.lit(True)), "path_outside")
    judged = rows.withColumn("diagnostic", reason).drop("_n")
    good = judged.where("diagnostic is null").drop("diagnostic")
    bad = judged.where("diagnostic is not null")
    if most is None:
        return good, bad
    taken = good.orderBy("id").limit(most)
    rest = good.join(taken.select("id"), "id", "left_anti").withColumn("diagnostic", F.lit("over_limit"))
    return taken, bad.unionByName(rest)


def merged(findings: list[DataFrame]) -> DataFrame:
    """All findings of several tools, each id once (the first tool by name wins); paths that leave the repository are dropped."""
    union = reduce(DataFrame.unionByName, findings)
    good, _ = normalise(union, ["upstream.tool", "rule_id", "title"])
    return good


def repeated_ids(findings: DataFrame) -> DataFrame:
    """``id, tools, n``: ids that several inputs claim; an import with any is refused."""
    rows = findings.groupBy("id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("upstream.tool")).alias("tools"))
    return rows.where("n > 1")
