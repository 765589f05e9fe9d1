"""Operators of the engine on small tables with awkward rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evidra.functions import classify, scalars
from evidra.operators import code_symbols, compare, exports, gate, graph, rule_engine, matching, plugins, query_dsl, sql_inventory, text_rules
from evidra.session import running_total
from evidra.sources import artifacts, config, filesystem, reports, sinks
from evidra.streaming import windows


def test_query_language(spark):
    schema = "id string, severity string, n double, ok boolean, evidence array<struct<path:string>>, text string"
    df = spark.createDataFrame(
        [("a", "High ", 1.0, True, [("p",)], "10"), ("b", None, None, None, None, None), ("c", "weird", -2.0, False, [], "x"), ("d", "low", 3.0, False, [("q",), ("r",)], "9")], schema)
    ask = lambda text: [r.id for r in query_dsl.run(df, text, ["ok"], ["id"]).orderBy("id").collect()]
    assert ask("finding where severity >= high") == ["a"]
    assert ask("finding WHERE severity < high") == ["d"]
    assert ask("finding where severity != high") == ["b", "c", "d"]
    assert ask("finding where n < 2") == ["a", "c"]
    assert ask("finding where ok = true") == ["a"]
    assert ask("finding where ok > false") == []
    assert ask("finding where evidence.1.path = 'r'") == ["d"]
    assert ask("finding where text > 9") == ["a"]
    assert ask("finding where absent != 1") == ["a", "b", "c", "d"]
    assert ask("finding where absent <= 0") == []
    with pytest.raises(ValueError):
        query_dsl.parse("nothing here")


def test_globs_and_owners(spark):
    df = spark.createDataFrame([(p, "R") for p in ("src/a.ts", "src/x/b.ts", "docs/src/c.md", "a.ts", None)], "path string, rule_id string")
    rules = [("*.ts", "web"), ("src/", "any"), ("/src/x/", "x")]
    owners = {r.path: r.owner for r in matching.owners(df, rules).collect()}
    assert owners == {"src/a.ts": "any", "src/x/b.ts": "x", "docs/src/c.md": "any", "a.ts": "web", None: None}
    entries = [{"rule_id": "R", "path": "src/*.ts", "reason": "one", "expiry": "2025-01-01"}, {"rule_id": "R", "path": "**/*.ts", "reason": "two", "expiry": None}]
    first = {r.path: r.suppression_status for r in matching.suppress(df, entries, "2025-02-01", False).collect()}
    skip = {r.path: r.suppression for r in matching.suppress(df, entries, "2025-02-01", True).collect()}
    assert first["src/a.ts"] == "expired" and first["a.ts"] == "active" and first[None] == "not_matched" and skip["src/a.ts"] == "two"
    assert matching.suppress(df, [], "2025-02-01", True).where("suppression is null").count() == 5 if entries else True


def test_longest_prefix(spark):
    files = spark.createDataFrame([("r", "a/b/c.ts"), ("r", "ab/c.ts"), ("r", "c.ts"), ("s", "a/b/c.ts")], "repo_root string, path string")
    modules = spark.createDataFrame([("r", "a"), ("r", "a/b"), ("r", "a/b")], "repo_root string, module string")
    got = {(r.repo_root, r.path): r.module for r in matching.longest_prefix(files, modules).collect()}
    assert got == {("r", "a/b/c.ts"): "a/b", ("r", "ab/c.ts"): ".", ("r", "c.ts"): ".", ("s", "a/b/c.ts"): "."}


SIDE = "pair string, id string, rule_id string, path string, fingerprint string, symbols array<string>, severity string, category string, confidence double, ord bigint"


def test_compare_exact_is_greedy(spark):
    row = lambda i, fp, path, symbols=(), sev="low", o=0: ("x", i, "R", path, fp, list(symbols), sev, "c", 0.5, o)
    current = spark.createDataFrame([row("c1", None, "p", o=1), row("c2", "f", "q", o=2), row("c3", None, "z", ["s"], "high", o=3), row("c4", "g", "n", o=4)], SIDE)
    previous = spark.createDataFrame([row("p1", "f", "p", o=1), row("p2", None, "y", ["s"], o=2), row("p3", None, "w", o=3)], SIDE)
    got = sorted((r.current_id or "", r.previous_id or "", r.status) for r in compare.compare_exact(current, previous).collect())
    assert got == [("", "p3", "resolved"), ("c1", "p1", "unchanged"), ("c2", "", "new"), ("c3", "p2", "modified"), ("c4", "", "new")]
    empty = current.limit(0)
    assert {r.status for r in compare.compare_exact(empty, previous).collect()} == {"resolved"}
    assert {r.status for r in compare.compare_exact(current, empty).collect()} == {"new"}
    staged = sorted((r.current_id or "", r.previous_id or "", r.status) for r in compare.compare_staged(current, previous).collect())
    assert ("c2", "p1", "unchanged") in staged and ("c1", "", "new") in staged


def test_graph(spark):
    relations = spark.createDataFrame(
        [("1", "a", "b", "x"), ("2", "B ", "c", "x"), ("3", "c", "a", "x"), ("4", "c", "d", "y"), ("5", "d", "c", "x"), ("6", "e", "e", "x"), ("7", None, "a", "x"), ("8", " ", "a", "x"), ("9", "a", "b", "x")],
        "id string, from_id string, to_id string, kind string")
    edges = graph.edges(relations)
    assert edges.count() == 6
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reach(edges, seeds, 5).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert {(r.node, r.depth) for r in graph.reach(edges, seeds, 1, reverse=True).collect()} == {("a", 0), ("c", 1)}
    assert {(r.seed, r.node, r.depth) for r in graph.chains(edges, seeds, 2).collect()} == {("a", "b", 1), ("a", "c", 2)}
    assert {tuple(r.path) for r in graph.cycles(edges, 3).collect()} == {("c", "d"), ("a", "b", "c")}
    assert graph.reach(edges, seeds.limit(0), 3).count() == 0


def test_line_rules(spark):
    files = spark.createDataFrame([("f", "a", "ts", "one\r\nhit\nveto\nx\ny\nhit"), ("n", "b", "ts", None), ("e", "c", "ts", "")], "id string, path string, language string, content string")
    assert [(r.id, r.line_no) for r in text_rules.hits_with_veto(files, "hit", "veto", 1, 1).collect()] == [("f", 6)]
    assert text_rules.lines_of(files).where("id = 'f'").count() == 6
    mark = files.select(text_rules.first_marker(F.lit("TODO then FIXME"), ["FIXME", "TODO"]).alias("m")).first().m
    assert mark == "FIXME"


def test_sql_operations(spark):
    sql = "-- DROP TABLE no;\nCREATE TABLE IF NOT EXISTS a.b (x int, y text);\nALTER TABLE t ADD COLUMN c int DEFAULT 1, DROP d, ALTER COLUMN e TYPE text;\ncreate unique index i on t (c);\nDROP TABLE IF EXISTS 'x';drop index i; select 1"
    assert sql_inventory.operations(sql) == [
        ("create_table", "a.b", None, None, False, False), ("add_column", "t", "c", None, False, True), ("drop_column", "t", "d", None, False, False), ("modify_column", "t", "e", "text", False, False),
        ("add_index", "t", "i", None, False, False), ("drop_table", "'x'", None, None, False, False), ("drop_index", None, "i", None, False, False)]
    df = spark.createDataFrame([("m.sql", sql), ("n", None), ("e", "")], "path string, content string")
    assert sql_inventory.inventory(df).count() == 7


def test_reports(spark):
    one = lambda x: spark.createDataFrame([(json.dumps(x),), ("{",), (None,)], "report string")
    lint = reports.lint(one([{"filePath": "a.ts", "messages": [{"ruleId": "r", "severity": 2, "message": "m", "line": 3}, {"ruleId": None, "severity": 1, "line": 1}]}]))
    assert sorted((r.rule_id, r.severity, r.evidence[0].end_line) for r in lint.collect()) == [("ESLINT_R", "high", 3), ("ESLINT_UNKNOWN", "medium", 1)]
    sast = reports.sast(one({"results": [{"check_id": "x.sql-y", "path": "../b.py", "start": {"line": 2}, "end": {"line": 4}, "extra": {"message": "m", "severity": "WARNING", "metadata": {"owasp": "A1"}}}]}))
    assert [(r.severity, r.rule_id, r.category, r.tags, r.evidence[0].start_line) for r in sast.collect()] == [("high", "SEMGREP_X.SQL_Y", "data", ["owasp-A1"], 2)]
    place = lambda uri, line: [{"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line, "endLine": 1}}}]
    sarif = reports.sarif(one({"runs": [{"tool": {"driver": {"rules": [{"id": "R0", "name": "n", "properties": {"security-severity": "9.1", "tags": ["CWE-1", ""]}}]}}, "results": [
        {"ruleIndex": 0, "level": "note", "locations": place("c.go", 5)}, {"ruleId": "z", "locations": place("c.go", 0)}, {"ruleId": "z"}]}]}))
    (r,) = sarif.collect()
    assert (r.rule_id, r.severity, r.category, r.title, r.summary, r.tags, r.evidence[0].end_line) == ("SARIF_R0", "critical", "security", "n", "sarif result R0", ["CWE-1"], 5)
    both = reports.merged([lint, sast, sarif, sarif])
    assert {r.evidence[0].path for r in both.collect()} == {"a.ts", "c.go"} and both.count() == 3
    _, bad = reports.normalise(lint.unionByName(sarif).unionByName(sarif).unionByName(sast), ["title"], most=1)
    assert sorted(r.diagnostic for r in bad.collect()) == ["duplicate_id", "over_limit", "over_limit", "path_outside"]
    parts = lambda a, b, c, d: {"lines": {"total": a, "covered": b}, "functions": {"total": c, "covered": d}}
    plain = {"total": parts(1, 0, 1, 0), "a": parts(10, 4, 0, 0), "b": parts(2, 1, 4, 1), "c": parts(10, 2, 10, 4)}
    wanted = [("a", "COVERAGE_LOW_LINE_COVERAGE", "medium"), ("b", "COVERAGE_LOW_FUNCTION_COVERAGE", "medium"), ("c", "COVERAGE_LOW_FUNCTION_COVERAGE", "low"), ("c", "COVERAGE_LOW_LINE_COVERAGE", "high")]
    for shape in (plain, {"coverageMap": {k: v for k, v in plain.items() if k != "total"}}):
        assert sorted((r.evidence[0].path, r.rule_id, r.severity) for r in reports.coverage(one(shape)).collect()) == wanted
    chain = {"code": 7, "category": 1, "messageText": {"messageText": "a\n", "next": [{"messageText": "b"}]}, "file": "x.ts"}
    for shape in ([chain, {"code": 8}], {"diagnostics": [chain]}):
        (r,) = reports.compiler(one(shape)).collect()
        assert (r.rule_id, r.severity, r.summary, r.evidence[0].start_line) == ("TSC_TS7", "high", "a\n b", 1)
    audit = {"vulnerabilities": {"p": {"via": ["q", {"title": "t", "severity": "moderate", "url": "u", "cwe": ["C2", "C1"]}]}, "q": {"severity": "high", "isDirect": True, "range": "<1"}}}
    rows = sorted((r.rule_id, r.severity, r.summary, r.tags, r.evidence[0].external_ref.url) for r in reports.audit(one(audit)).collect())
    assert rows == [("NPM_AUDIT_P", "medium", "t", ["C1", "C2", "transitive-dependency"], "u"), ("NPM_AUDIT_Q", "high", "npm audit reported high severity for q (<1)", ["direct-dependency"], None)]
    rows = reports.tests(one([{"status": "error", "line": 0}, {"status": "passed"}, {"status": "failed", "path": "p", "line": 3, "error": "e", "name": "n"}])).collect()
    assert sorted((r.evidence[0].path, r.evidence[0].start_line, r.title, r.summary) for r in rows) == [("p", 3, "n", "e"), ("unknown", 1, "Failed test", "Test failed")]
    for importer in reports.IMPORTERS.values():
        assert importer(one([]).limit(0)).count() == 0


def test_globs():
    import re

    def hits(glob, *paths):
        return [p for p in paths if re.search(scalars.glob_regex(glob), p)]

    assert hits("src/**", "src", "src/a", "src/a/b.ts", "src/.x", "x/src/a") == ["src/a", "src/a/b.ts"]
    assert hits("**/*.ts", "a.ts", "a/b.ts", ".a.ts", ".d/a.ts", "a/.b.ts") == ["a.ts", "a/b.ts"]
    assert hits("a/*/c.{js,ts}", "a/b/c.js", "a/b/c.ts", "a/b/b/c.ts", "a/.b/c.ts") == ["a/b/c.js", "a/b/c.ts"]
    assert hits("[a-c]?.x[!1]", "bb.x2", "bb.x1", "db.x2") == ["bb.x2"] and hits("a/**/b", "a/b", "a/x/y/b") == ["a/b", "a/x/y/b"]
    assert hits("a.b+(c)", "a.b+(c)", "axb+(c)") == ["a.b+(c)"] and hits("{a,{b,c}}", "a", "b", "c", "d") == ["a", "b", "c"]


def test_owner_patterns_and_paths():
    import re

    hit = lambda p, path: re.search(scalars.owner_regex(p), path) is not None
    assert hit("docs/*.md", "a/docs/x.md") and hit("docs/api/", "pkg/docs/api/x.md") and not hit("**/tests/**", "tests/x.ts") and hit("**/tests/**", "a/tests/x.ts")
    assert hit("*.js", "a/b.js") and not hit("*.js", "a.js/b") and hit("/docs/", "docs") and hit("/docs/", "docs/x") and not hit("/docs/", "a/docs/x") and not hit("/", "a")
    assert hit("/src/*.ts", "src/a.ts") and not hit("/src/*.ts", "x/src/a.ts") and not hit("docs/", "docs")


def test_import_resolution(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/lib/index.tsx", "src/lib/index.js", "b.js", "pkg", "src/a.js")] + [("q", "src/c.ts")], "repo_root string, path string")
    asked = [("r", "src/x.ts", "./a", "src/a.ts"), ("r", "src/x.ts", "./lib", "src/lib/index.tsx"), ("r", "src/lib/y.ts", "../../b.js", "b.js"), ("r", "z.ts", "pkg", "pkg"), ("r", "src/x.ts", "./c", None), ("r", "src/x.ts", "..\\b", "b.js")]
    rows = [(str(i), *x[:3]) for i, x in enumerate(asked)]
    got = {r.id: r.target for r in code_symbols.resolve_imports(spark.createDataFrame(rows, "id string, repo_root string, path string, specifier string"), files).collect()}
    assert got == {str(i): x[3] for i, x in enumerate(asked) if x[3]}


def test_cycles_of_any_length(spark):
    import random

    rng = random.Random(8)
    pairs = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(62)} | {(f"z{i:02}", f"z{(i + 1) % 9:02}") for i in range(9)}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reached(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen and b != a or b == a and a not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    reach = {n: reached(n) for n in {x for p in pairs for x in p}}
    group = {n: {m for m in reach[n] if n in reach[m]} | {n} for n in reach}
    wanted = {n: (max(g), len(g)) for n, g in group.items() if len(g) > 1}
    assert {r.node: (r.grp, r.size) for r in graph.cycle_groups(edges).collect()} == wanted and wanted["z00"] == ("z08", 9)
    found = [tuple(r.path) for r in graph.cycles(edges, 6).collect()]

    def ways(path):
        for b in out.get(path[-1], ()):
            if b == path[0] and len(path) > 1:
                yield tuple(path)
            if b > path[0] and b not in path and len(path) < 6:
                yield from ways([*path, b])

    assert sorted(found) == sorted(w for n in out for w in ways([n]))
    assert graph.cycle_groups(edges.limit(0)).count() == 0 and graph.cycles(edges.limit(0), 4).count() == 0


def test_scalars(spark):
    row = spark.createDataFrame([("a/b/c.test.TS", "c", " Critical")], "p string, q string, s string").select(
        scalars.extension("p").alias("e"), scalars.basename("p").alias("b"), scalars.dirname("p").alias("d"), scalars.dirname("q").alias("dq"), classify.role_of("p").alias("r"),
        scalars.severity_rank("s").alias("k"), scalars.rule_key(F.lit("--a b!")).alias("rk"), scalars.rule_key(F.lit("!")).alias("ru"), scalars.title_key(F.lit(" A,  b! ")).alias("t")).first()
    assert tuple(row) == ("ts", "c.test.TS", "a/b", ".", "test", 4, "A_B", "UNKNOWN", "a b")


def test_streams_equal_their_batch_twins(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i * 7 + (i % 5) * 20), i % 3, "click" if i % 2 else "error", float(i)) for i in range(200)]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    for name, build, keys in (("t", windows.tumbling_counts, ["window_start", "event_type"]), ("s", windows.sessions, ["user_id", "session_start"])):
        stream = windows.events_stream(spark, str(tmp_path / "in"), events.schema)
        # all files in one batch: then nothing is late, and the end of input closes every window after a later event
        run = build(stream).writeStream.format("memory").queryName(f"q_{name}").outputMode("append" if name == "s" else "complete").option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(availableNow=True).start()
        run.awaitTermination(120)
        got = {tuple(r[k] for k in keys): r.n_events for r in spark.table(f"q_{name}").collect()}
        want = {tuple(r[k] for k in keys): r.n_events for r in build(events).collect()}
        assert got.items() <= want.items() and got
        if name == "t":
            assert got == want


def test_folders(spark, tmp_path):
    from evidra.sources import filesystem

    for name, text in {"a/x.json": '{"generated_at": "2025-01-02T00:00:00Z"}', "b/x.json": "{", "c/y.txt": "yy", "node_modules/z.json": "{}", "a/b/c/d.txt": "dddd"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = filesystem.scan(spark, str(tmp_path))
    assert {r.path for r in files.select("path").collect()} == {"a/x.json", "b/x.json", "c/y.txt", "a/b/c/d.txt"}
    limits = {r.path: r.skipped for r in filesystem.bounded(files, 10, 5, 9, 2).collect()}
    assert limits == {"a/x.json": "MAX_FILE_SIZE_EXCEEDED", "b/x.json": None, "c/y.txt": None, "a/b/c/d.txt": "MAX_DEPTH_EXCEEDED"}
    few = {r.path: r.skipped for r in filesystem.bounded(files, 100, 40, 3, 9, deadline=F.col("path") == "c/y.txt").collect()}
    assert few == {"a/b/c/d.txt": None, "a/x.json": "MAX_TOTAL_BYTES_EXCEEDED", "b/x.json": "MAX_TOTAL_BYTES_EXCEEDED", "c/y.txt": "SCAN_DEADLINE_EXCEEDED"}
    row = filesystem.walk_summary(filesystem.bounded(files, 10, 5, 9, 2).withColumn("r", F.lit(1)), ["r"]).first()
    assert (row.partial_walk, row.reasons, row.visited_files, row.accepted_bytes, row.skipped_files) == (True, ["MAX_DEPTH_EXCEEDED", "MAX_FILE_SIZE_EXCEEDED"], 3, 3, 2)
    assert filesystem.bounded(files.limit(0)).count() == 0
    assert [r.path for r in filesystem.json_artifacts(spark, str(tmp_path)).orderBy("path").collect()] == ["a/x.json", "node_modules/z.json"]
    assert [(r.run, r.generated_at is None) for r in filesystem.discover_runs(spark, str(tmp_path), "x.json").collect()] == [("a", False), ("b", True)]


def test_imports_resolve(spark):
    from evidra.operators import code_symbols

    files = spark.createDataFrame([("r", "src/a.ts"), ("r", "src/lib/index.js"), ("r", "src/b.js"), ("r", "src/b.ts"), ("s", "src/c.ts")], "repo_root string, path string")
    imports = spark.createDataFrame(
        [(s, "r", "src/x/y.ts", s) for s in ("../a", "../lib", "./../b", "./c", "../../src/a.ts", "react", "../../../../src/a")], "id string, repo_root string, path string, specifier string")
    got = {r.specifier: r.target for r in code_symbols.resolve_imports(imports, files).collect()}
    assert got == {"../a": "src/a.ts", "../lib": "src/lib/index.js", "./../b": "src/b.ts", "../../src/a.ts": "src/a.ts", "../../../../src/a": "src/a.ts"}


def test_gate_precedence(spark):
    from evidra.operators import gate

    rows = [("a", "critical", "x", "R", 0.9, True), ("b", "critical", "x", "R", 0.1, False), ("c", "critical", "x", "R", None, None), ("d", "low", "hold", "R", 0.9, False), ("e", None, None, None, 0.9, False), ("f", "low", "hold", "R", 0.99, False)]
    df = spark.createDataFrame(rows, "id string, severity string, category string, rule_id string, confidence double, off boolean")
    rules = [(F.col("confidence") > 0.95, "allow"), (F.col("category") == "hold", "hold")]
    got = gate.bucket(df, ["critical"], [], [], 0.3, rules, F.col("off"))
    assert {r.id: r.bucket for r in got.collect()} == {"a": "suppressed", "b": "low_confidence", "c": "blocked", "d": "held", "e": "passed", "f": "passed"}
    assert gate.status(got, ["rule_id"], {"low": 1}).where("rule_id = 'R'").first().status == "blocked"


def test_file_differences(spark):
    from evidra.operators import diffs

    old = spark.createDataFrame([("a", "1", "x\ny\ny"), ("b", "2", "k"), ("c", None, None)], "path string, hash string, content string").withColumn("r", F.lit("r"))
    new = spark.createDataFrame([("a", "9", "x\ny\nz"), ("d", "2", "k"), ("c", None, None)], "path string, hash string, content string").withColumn("r", F.lit("r"))
    changes = diffs.changed_files(old, new, ["r", "path"])
    assert sorted((r.path, r.status) for r in changes.collect()) == [("a", "M"), ("b", "D"), ("d", "A")]
    assert [(r.old_name, r.new_name) for r in diffs.renames(changes, old, new, "r", "path").collect()] == [("b", "d")]
    lines = {r.path: (r.added, r.removed) for r in diffs.line_changes(old, new, ["path"]).collect()}
    assert lines["a"] == (1, 1) and "c" not in lines
    diff = "--- a\n+++ b\n@@ -1,2 +3 @@ f\n-x\n+y\n+z\n same\n@@ -9 +12,4 @@\n+q\n"
    hunks = diffs.hunks(spark.createDataFrame([("1", diff), ("2", None), ("3", "")], "id string, diff string"))
    assert sorted((r.hunk, r.new_start, r.added, r.removed) for r in hunks.collect()) == [(0, 3, 2, 1), (1, 12, 1, 0)]


CODE = {
    "ts": "import { a } from './a';\nexport const f = async (x) => {\n  g(x);\n};\nfunction g(y) { return h(y) }\nabstract class C {}\ninterface I {}\napp.get('/x', f)\ntest('works', () => f())\n",
    "py": "from a.b import c\nclass K:\n    async def m(self):\n        return helper(1)\n\ndef helper(x):\n    return len(x)\n@app.get('/p')\ndef test_it():\n    helper(2)\n",
    "go": "package a\nimport \"fmt\"\ntype T struct {}\nfunc (t *T) Run() {\n\tHelp()\n}\nfunc Help() {}\n", "rs": "use std::io;\npub(crate) async fn run() {}\nstruct S;\ntrait Q {}\nmod m;\n",
    "java": "import java.util.List;\npublic final class A {\n  public static int go(int x) {\n    return x;\n  }\n}\n", "php": "use App\\X;\nfinal class P {\n  public function q() {}\n}\n", "cs": "using System;\npublic class Z {\n  public async Task<int> W(int a)\n  {\n}}\n",
    "cpp": "#include <vector>\nnamespace n {\nint Foo::bar(int x) {\n}\n}\n", "rb": "require 'x'\nmodule M\n  def self.go?\n  end\nend\n", "unknown": "def x(): pass",
}


def test_line_parsers(spark):
    files = spark.createDataFrame([(k, k, v) for k, v in CODE.items()] + [("n", "py", None), ("e", "py", "")], "id string, language string, content string")
    got = {}
    for r in code_symbols.parse(files, F.col("language")).collect():
        got.setdefault(r.id, set()).add((r.kind, r.name, r.line))
    assert got["ts"] == {("import", "./a", 1), ("function", "f", 2), ("function", "g", 5), ("class", "C", 6), ("interface", "I", 7), ("route", "/x", 8), ("test", "works", 9)}
    assert got["py"] == {("import", "a.b", 1), ("class", "K", 2), ("function", "m", 3), ("function", "helper", 6), ("route", "/p", 8), ("function", "test_it", 9), ("test", "test_it", 9)}
    assert got["go"] == {("import", "fmt", 2), ("class", "T", 3), ("function", "Run", 4), ("function", "Help", 7)} and got["rs"] == {("import", "std::io", 1), ("function", "run", 2), ("class", "S", 3), ("interface", "Q", 4), ("module", "m", 5)}
    assert got["java"] == {("import", "java.util.List", 1), ("class", "A", 2), ("function", "go", 3)} and got["php"] == {("import", "App\\X", 1), ("class", "P", 2), ("function", "q", 3)}
    assert got["cs"] == {("import", "System", 1), ("class", "Z", 2), ("function", "W", 3)} and got["cpp"] == {("import", "vector", 1), ("module", "n", 2), ("function", "Foo::bar", 3)} and got["rb"] == {("import", "x", 1), ("module", "M", 2), ("function", "go?", 3)}
    assert set(got) == set(CODE) - {"unknown"}
    calls = {(r.id, r.caller, r.callee, r.known) for r in code_symbols.calls(files, F.col("language")).collect()}
    assert {("ts", "f", "g", True), ("py", "m", "helper", True), ("py", "helper", "len", False), ("py", "test_it", "helper", True), ("go", "Run", "Help", True)} <= calls
    odd = spark.createDataFrame([("a", "x = '{' // {\n"), ("b", "{ \"}\" "), ("c", " "), ("d", "<<<<<<< a\n"), ("e", '"' + "a" * 200000 + '"'), ("n", None)], "id string, content string")
    assert {(r.id, r.code) for r in code_symbols.diagnostics(odd).collect()} == {("b", "UNBALANCED_BRACES"), ("c", "EMPTY_FILE"), ("d", "CONFLICT_MARKERS")}


def test_configuration_sources(spark):
    text = "version: 1\npolicy_id: 'p'  # own\nblocking:\n  severity:\n    critical: true\n    high: false\n  rules: [A, B]\nlist:\n  - ruleId: R\n    path: src/**\n    expiry: 2025-01-01\n  - plain\nextra: 1.5\n"
    read, errors = config.policy(text)
    assert read["blocking"] == {"severity": {"critical": True, "high": False}, "rules": ["A", "B"]} and read["list"] == [{"ruleId": "R", "path": "src/**", "expiry": "2025-01-01"}, "plain"] and read["extra"] == 1.5
    assert errors == ["unknown member list", "unknown member extra"] and config.policy("[1]")[1] == ["policy is no mapping"] and config.policy("")[1] == ["missing version", "missing blocking"]
    assert config.suppressions("suppressions:\n  - rule_id: R\n    path: a\n    reason: why\n") == [{"rule_id": "R", "path": "a", "reason": "why", "expiry": None, "author": None, "class": None}]
    rows = config.risks(spark, '{"risks": [{"id": "x", "title": "t", "severity": "high", "sourceFindingIds": ["f"]}]}').collect()
    assert [(r.id, r.sources, r.ord) for r in rows] == [("x", ["f"], 0)] and config.risks(spark, "").count() == 0
    files = spark.createDataFrame([("r", "CODEOWNERS", "# c\n* @a\r\n!x @b\nsrc/\n"), ("r", "docs/CODEOWNERS", "* @z"), ("q", "x", "* @z")], "repo_root string, path string, content string")
    rules, bad = config.owner_rules(files)
    assert [(r.line, r.pattern, r.owners) for r in rules.collect()] == [(2, "*", ["@a"])] and sorted((r.line, r.code) for r in bad.collect()) == [(3, "UNSUPPORTED_PATTERN"), (4, "EMPTY_OWNERS")]


def test_json_comparison_tells_null_from_missing(spark):
    rows = ['{"n": null, "s": "High", "t": "7", "b": true, "e": "", "a": [{"x": 1}]}', "{}"]
    df = spark.createDataFrame([(str(i), "h", r) for i, r in enumerate(rows)], "file string, hash string, document string").withColumn("document", F.parse_json("document"))
    ask = lambda text: sorted(r.locator for r in query_dsl.artifact_matches(df, f"artifact where {text}").collect())
    assert ask("n <= 0") == ["0"] and ask("n != 0") == ["1"] and ask("n = 'x'") == [] and ask("s >= medium") == ["0"] and ask("t > 6.5") == ["0"]
    assert ask("b = true") == ["0"] and ask("b != true") == ["1"] and ask("b > 0") == [] and ask("b != 3") == ["0", "1"] and ask("e = 0") == ["0"] and ask("a.0.x = 1") == ["0"]
    with pytest.raises(ValueError):
        query_dsl.artifact_matches(df, "other where a = 1")


def test_baseline_is_found(spark):
    docs = lambda *rows: spark.createDataFrame([(p, "h", json.dumps(d)) for p, d in rows], "path string, sha256 string, document string")
    linked = ("release-readiness.json", {"artifactRefs": {"findings": "./old.json"}, "baseline": {"owner": "o", "expiresAt": "2026"}})
    assert filesystem.baseline(docs(linked, ("old.json", {"findings": []}))).first().owner == "o"
    assert filesystem.baseline(docs(linked, ("old.json", {"findings": []}), ("baseline-findings.json", {"findings": []}))).first().path == "baseline-findings.json"
    assert filesystem.baseline(docs(linked)).count() == 0


def test_running_total_over_ranges(spark):
    rows = [("a" if i % 3 else None, i * 7 % 50, i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x int, y int, v int")
    want = {}
    for g in ("a", None):
        total = 0
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            total += r[3]
            want[r[2]] = total
    assert {r.y: r.t for r in running_total(df, ["g"], ["x", "y"], F.col("v"), "t").collect()} == want
    assert running_total(df, [], ["x", "y"], F.col("v"), "t").agg({"t": "max"}).first()[0] == sum(r[3] for r in rows)


def test_plugins_are_isolated(spark):
    def rule(path, content):
        if "boom" in content:
            raise KeyError(path)
        for i in range(content.count("x")):
            yield {"rule_id": "X", "severity": "low", "title": "t", "lines": [i + 1]}
        if "odd" in content:
            yield {"rule_id": "", "severity": "huge", "title": "t", "lines": [0]}

    found = plugins.run_fixture(spark, plugins.Plugin("p", rule), {"a.py": "xx", "b.py": "boom", "c.py": "x odd", "d.py": ""})
    assert sorted((f["path"], f["lines"]) for f in found) == [("a.py", [1]), ("a.py", [2]), ("c.py", [1])]
    df = spark.createDataFrame([("b", "b", "py", "boom"), ("c", "c", "py", "odd"), ("m", "m", "py", "x" * 1500), ("n", None, None, None)], "id string, path string, language string, content string")
    bad = {(r.id, r.diagnostic) for r in plugins.run([plugins.Plugin("p", rule)], df).where("diagnostic is not null").collect()}
    assert bad == {("b", "failed: KeyError"), ("c", "missing rule_id"), ("c", "unknown severity"), ("c", "lines are no line numbers"), ("m", "too many findings")}
    assert plugins.run([plugins.Plugin("p", rule, languages=("go",))], df).count() == 0 and plugins.exit_code("failed") == 1


def test_line_states(spark):
    text = "a {\nif (x) {\n  y = z;\n} else if (q.r) {\n}\n}\n<<<<<<< o\nin\n>>>>>>> t\nout\nwhile (1) {\nreturn v\n"
    files = spark.createDataFrame([("f", text), ("n", None), ("e", "")], "id string, content string")
    ends = lambda p: sorted((r.start_line, r.end_line) for r in text_rules.branch_blocks(files, p).collect())
    assert ends("if") == [(2, 5)] and ends("while") == [(11, 13)]
    assert [(r.line_no, r.line) for r in text_rules.regions(files, "^<<<<<<<", "^>>>>>>>").collect()] == [(8, "in")]
    nodes = {(r.kind, r.name, r.line_no) for r in text_rules.flow_nodes(files).collect()}
    assert nodes == {("branch", "x", 2), ("assign", "y", 3), ("branch", "q.r", 4), ("return", "v", 12)}
    assert text_rules.without_default(files, "return", "v").count() == 0 and text_rules.blocks(files, "^(if|while)").count() == 2


def test_a_cluster_needs_a_shared_folder():
    from evidra import session

    class Context:
        master = "spark://x:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        session.use_checkpoints(Session())


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None, 'q"\n'), ("c", 1, None)], "x string, y int, z string")
    sinks.write_json(df, str(tmp_path / "out"))
    assert sorted(spark.read.json(str(tmp_path / "out")).select("x", "y").collect()) == [("a|b", None), ("c", 1)]
    document = sinks.write_document(df.where("x = 'c'"), str(tmp_path / "one.json"))
    assert document == json.loads((tmp_path / "one.json").read_text()) == {"x": "c", "y": 1} and [p.name for p in tmp_path.iterdir() if p.is_file()] == ["one.json"]
    with pytest.raises(ValueError):
        sinks.write_document(df, str(tmp_path / "two.json"))
    rows = df.select(sinks.markdown_row("x", "y").alias("m"), sinks.yaml_item({"x": F.col("x"), "z": F.col("z")}).alias("i")).collect()
    assert rows[0].m == "| a\\|b |  |" and rows[0].i == '- x: "a|b"\n  z: "q\\"\\n"' and rows[1].i == '- x: "c"\n  z: null'


def test_rule_engine(spark):
    files = spark.createDataFrame([("r", "src/a.ts", "ts", "x\r\nbad\nfine\nbad\n"), ("r", "b.py", "py", "bad"), ("r", "c.ts", "ts", None), ("r", "c.ts", "ts", None)], "repo_root string, path string, language string, content string")
    rules = [rule_engine.LineRule("A", "auth", "low", 0.6, "bad", "fine", 1, 1, ("ts",)), rule_engine.LineRule("B", "data", "high", 0.9, "^bad$")]
    claimed = rule_engine.claims(files, rules)
    assert sorted((r.ord, r.path, r.start_line) for r in claimed.collect()) == [(1, "b.py", 1), (1, "src/a.ts", 2), (1, "src/a.ts", 4)]
    more = spark.createDataFrame(
        [(0, "A", "auth", "low", 0.6, "t", "r", p, s, e) for p, s, e in [(None, 1, 1), ("gone", 1, 1), ("c.ts", 1, 1), ("b.py", 1, 2), ("b.py", None, 1), ("src/a.ts", 1, 2)]], claimed.schema)
    good, bad = rule_engine.evaluate(claimed.unionByName(more), files)
    rows = good.orderBy("id").collect()
    assert [(r.id, r.rule_id, r.path, r.start_line) for r in rows] == [("finding-00000001", "A", "src/a.ts", 1), ("finding-00000002", "B", "b.py", 1), ("finding-00000003", "B", "src/a.ts", 2), ("finding-00000004", "B", "src/a.ts", 4)]
    assert rows[0].tags == ["domain:auth", "fp-review", "fp-review:low-confidence"] and rows[1].fingerprint == rows[2].fingerprint != rows[0].fingerprint
    assert sorted(r.reason for r in bad.collect()) == ["invalid_range", "invalid_range", "missing_evidence", "path_not_found", "unreadable"]
    state = rule_engine.completeness(claimed.unionByName(more), bad, files).first()
    assert (state.n_claims, state.n_rejected, state.completeness) == (9, 5, "partial")


def test_artifacts(spark):
    docs = spark.createDataFrame([("findings.json", '{"run_id": "r", "findings": [{"id": "a", "ruleId": "R", "evidence": [{"path": "p", "startLine": 2}]}, {}]}'), ("x.json", "{}"), ("y.json", "["), ("ready.json", '{"run_id": "r", "status": "passed", "counts": {"critical": 1}}')], "path string, document string")
    rows = artifacts.findings(docs).collect()
    assert [(r.ord, r.id, r.rule_id) for r in rows] == [(0, "a", "R"), (1, None, None)] and rows[0].evidence[0].start_line == 2
    assert [(r.status, r.critical, r.high) for r in artifacts.readiness(docs).collect()] == [("passed", 1, None)]
    assert artifacts.evidence_set(docs, ("findings.json", "a.json")).first().missing == ["a.json"] and artifacts.evidence_set(docs.limit(0), ()).first().complete


def test_policy_rules_and_bundles(spark, tmp_path):
    import zipfile

    df = spark.createDataFrame([("a", "High ", "auth", "R", True), ("b", "low", "auth", "S", None), ("c", None, None, None, False)], "id string, severity string, category string, rule_id string, known boolean")
    hit = lambda when: sorted(r.id for r in df.where(gate.condition(when, F.col("known"))).collect())
    assert hit({"severity": ["high", "critical"]}) == ["a"] and hit({"category": "auth", "baseline": False}) == ["b"] and hit({}) == ["a", "b", "c"] and hit({"manualEvidence": True}) == []
    rules = gate.rules_of({"dsl": {"rules": [{"when": {"ruleId": "R"}, "action": "allow"}, {"when": {"category": "auth"}, "action": "block"}]}})
    assert {r.id: r.o for r in df.select("id", gate.ordered_rules(rules).alias("o")).collect()} == {"a": "allow", "b": "block", "c": None}
    with pytest.raises(ValueError):
        gate.condition({"price": 1})
    files = spark.createDataFrame([("b.txt", "é"), ("a.json", None)], "name string, content string")
    assert sinks.write_bundle(files, str(tmp_path / "x.zip")) == 2
    with zipfile.ZipFile(tmp_path / "x.zip") as bundle:
        assert bundle.namelist() == ["a.json", "b.txt", "manifest.json"] and bundle.read("b.txt").decode() == "é"
        listed = spark.createDataFrame(json.loads(bundle.read("manifest.json")), "name string, sha256 string, n_bytes bigint")
    assert {r.state for r in exports.check_manifest(listed, exports.manifest(files.na.fill(""), "name", "content")).collect()} == {"ok"}


def test_cycle_groups_take_few_rounds(spark, monkeypatch):
    import random

    from evidra.session import saved

    rounds = []
    monkeypatch.setattr(graph, "saved", lambda df: rounds.append(1) or saved(df))
    # 40 rings in a row, the greatest first: each used to take rounds of its own, and as many as it is long
    rings = [(f"{40 - i:03}/{j:02}", f"{40 - i:03}/{(j + 1) % 20:02}") for i in range(40) for j in range(20)] + [(f"{40 - i:03}/00", f"{39 - i:03}/00") for i in range(39)]
    found = {r.node: (r.grp, r.size) for r in graph.cycle_groups(spark.createDataFrame(rings, "src string, dst string")).collect()}
    assert found == {f"{i:03}/{j:02}": (f"{i:03}/19", 20) for i in range(1, 41) for j in range(20)} and len(rounds) <= 3

    rng = random.Random(5)
    pairs = sorted({(f"n{rng.randrange(60):02}é", f"n{rng.randrange(60):02}é") for _ in range(90)})
    edges = spark.createDataFrame(pairs, "src string, dst string")
    whole = sorted(graph.cycle_groups(edges).collect())
    assert whole and all(sorted(graph.cycle_groups(edges, limit).collect()) == whole for limit in (2, 15, 50))  # the same through rounds of joins and many tasks


def test_reviews_by_place_reach_all_findings(spark, tmp_path):
    from evidra.plans.rules_queries import fp_review_by_place

    rows = [(f"a{i:05}", "many", 0.5) for i in range(2500)] + [("b0", None, 0.5), ("b1", None, 0.5), ("c0", "not among the runs", 0.5)]
    evidence = F.array(F.struct(F.lit("p").alias("path")))
    findings = spark.createDataFrame(rows, "id string, run_id string, confidence double").withColumns({"evidence": evidence, "repo_root": F.lit("r"), "rule_id": F.lit("R"), "title": F.lit("t")})
    findings.unionByName(findings.limit(5)).write.parquet(str(tmp_path / "findings.parquet"))
    spark.createDataFrame([("many",)], "run_id string").write.parquet(str(tmp_path / "runs.parquet"))
    found = fp_review_by_place(spark, str(tmp_path))
    verdict = lambda place: "TP" if place % 2 == 0 else "FP" if place < 3 else ""
    wanted = {(f"a{i:05}", "many", i, verdict(i)) for i in range(2500)} | {("b0", None, 0, "TP"), ("b1", None, 1, "FP"), ("c0", "not among the runs", 0, "TP")}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(wanted) and set(got) == wanted
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_cycles_take_few_rounds(spark, monkeypatch):
    from evidra.session import saved

    rounds = []
    monkeypatch.setattr(graph, "saved", lambda df: rounds.append(1) or saved(df))
    # rings of two in a row, the greatest first, with edges back and forth inside: the search for their groups used to take rounds for each
    rings = [x for i in range(30) for x in ((f"{30 - i:02}a", f"{30 - i:02}b"), (f"{30 - i:02}b", f"{30 - i:02}a"), (f"{30 - i:02}a", f"{29 - i:02}a"))]
    found = [tuple(r.path) for r in graph.cycles(spark.createDataFrame(rings, "src string, dst string"), 3).collect()]
    assert sorted(found) == [(f"{i:02}a", f"{i:02}b") for i in range(1, 31)] and len(rounds) <= 6


def test_one_large_group_takes_few_rounds(spark, monkeypatch):
    import random

    from evidra.session import saved

    rounds = []
    monkeypatch.setattr(graph, "saved", lambda df: rounds.append(1) or saved(df))
    # a ring with more edges than a task holds by name: its group used to take as many rounds as the ring is long
    ring = [(f"n{i:02}", f"n{(i + 1) % 40:02}") for i in range(40)] + [("n05", "n04"), ("n00", "out"), ("in", "n00"), ("n09", "m"), ("m", "out"), ("n09", "z"), ("z", "y"), ("y", "out")]
    edges = spark.createDataFrame(ring, "src string, dst string")
    assert {(r.node, r.grp, r.size) for r in graph.cycle_groups(edges, 10).collect()} == {(f"n{i:02}", "n39", 40) for i in range(40)} and len(rounds) <= 5
    rounds.clear()
    monkeypatch.setattr(graph, "TASK_EDGES", 10)
    assert {(tuple(r.path), r.length) for r in graph.cycles(edges, 5).collect()} == {(("n04", "n05"), 2)} and len(rounds) <= 10

    rng = random.Random(6)
    pairs = sorted({(f"n{rng.randrange(60):02}é", f"n{rng.randrange(60):02}é") for _ in range(90)})
    edges = spark.createDataFrame(pairs, "src string, dst string")
    whole = sorted(graph.cycle_groups(edges, 1_000).collect())
    # the same with numbers in one task, and through rounds of joins to many tasks with names or numbers
    assert whole and all(sorted(graph.cycle_groups(edges, *limits).collect()) == whole for limits in ((2,), (2, 2), (2, 15), (15, 15), (15, 50)))
    assert graph.cycle_groups(edges.where("src < dst"), 2).count() == 0
