"""Problems 3 to 6 against brute force and edge cases."""

import json
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidra.operators import nested_tables, orphans, schema_drift, snapshot_diff

NAMED = {"findings", "evidence", "changed_files", "hunks", "contents", "plugin_versions"}


def brute_objects(text):
    """Parent and path of every object below the top, walked one by one."""
    out = []

    def held(value):
        if isinstance(value, str):
            try:
                inner = json.loads(value)
            except ValueError:
                return value
            return held(inner) if isinstance(inner, dict | list) else value
        return value

    def walk(value, path, around):
        value = held(value)
        if isinstance(value, dict):
            if path:
                out.append((around, path))
            for k, v in value.items():
                v = held(v)
                p = f"{path}.{k}" if path else k
                if k in NAMED and isinstance(v, dict):
                    p += "[0]"
                walk(v, p, path or "$")
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]", around)

    try:
        top = json.loads(text, parse_constant=lambda x: 1 / 0) if text else None
    except ZeroDivisionError:
        return []
    except ValueError:
        return []
    if isinstance(top, dict | list):
        walk(top, "", "$")
    return out


def random_json(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 5)
    if kind == 0:
        return rng.choice([1, -2.5e3, 0])
    if kind == 1:
        return rng.choice(["a", 'q"x\\', "{not json", "日本 ", "[1, 2]", " {\"in\": {\"s\": 1}} ", ""])
    if kind == 2:
        return rng.choice([None, True, False])
    if kind == 3:
        return json.dumps(random_json(rng, depth + 1), ensure_ascii=rng.random() < 0.5)
    if kind in (4, 5):
        return [random_json(rng, depth + 1) for _ in range(rng.randrange(4))]
    names = ["findings", "evidence", "hunks", "a", "b.c", "é", 'k"q', "x y"]
    return {rng.choice(names): random_json(rng, depth + 1) for _ in range(rng.randrange(5))}


def test_nested_objects_equal_brute_force(spark):
    rng = random.Random(7)
    payloads = []
    for _ in range(400):
        value = {"top": random_json(rng), rng.choice(["findings", "b", "hunks"]): random_json(rng)}
        payloads.append(json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])))
    payloads += [None, "", "{", "nul", "[]", "{}", '[{"a": {}}, [{"b": 1}]]', '{"a": NaN, "b": {}}', '{"x": ' + "[" * 50 + "]" * 50 + "}"]
    payloads.append(json.dumps({"findings": [{"evidence": {"id": i}} for i in range(5000)]}))
    rows = [(f"r{i}", p, "clash") for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "record_id string, p string, members string")
    got = nested_tables.nested_objects(df.select("record_id", "p"), "p", ["record_id"])
    found = sorted((r.record_id, r.parent_path, r.child_path) for r in got.collect())
    wanted = sorted((i, a, b) for i, p, _ in rows for a, b in brute_objects(p))
    assert found == wanted


def test_nested_members_and_child_table(spark):
    df = spark.createDataFrame([("r", '{"findings": [{"id": "f\\u00e9\\n", "n": 1.5, "n": 2, "evidence": {"id": "e"}}, null, {"id": 3}]}')], "k string, p string")
    objects = nested_tables.nested_objects(df, "p", ["k"])
    rows = {r.child_path: r for r in nested_tables.child_table(objects, "findings", ["k"], {"id": "string", "n": "double"}).collect()}
    assert rows["findings[0]"].id == "fé\n" and rows["findings[0]"].n == 2.0 and rows["findings[0]"].ord == 0
    assert rows["findings[2]"].id == "3" and rows["findings[2]"].n is None
    child = nested_tables.child_table(objects, "findings.evidence", ["k"], {"id": "string"}).first()
    assert child.parent_path == "findings[0]" and child.child_path == "findings[0].evidence[0]"
    assert nested_tables.nested_objects(df.limit(0), "p", ["k"]).count() == 0


def test_scalar_items_equal_brute_force(spark):
    def items(value, path, around):
        if isinstance(value, str) and value[:1] in ("{", "["):
            value = json.loads(value)
        if isinstance(value, dict):
            for k, v in value.items():
                yield from items(v, (f"{path}.{k}" if path else k) + ("[0]" if k in NAMED and isinstance(v, dict) else ""), path or "$") if isinstance(v, dict | list | str) and (not isinstance(v, str) or v[:1] in ("{", "[")) else ()
        elif isinstance(value, list):
            for i, v in enumerate(value):
                if isinstance(v, dict | list) or isinstance(v, str) and v[:1] in ("{", "["):
                    yield from items(v, f"{path}[{i}]", around)
                elif v is not None:
                    yield around, f"{path}[{i}]", i, v if isinstance(v, str) else json.dumps(v)

    def owner(value):
        return [(a, b, c, d) for a, b, c, d in items(value, "", "$")]

    payloads = [
        {"findings": [{"tags": ["a", None, "né\n", "x,]"], "affectedSymbols": []}, {"n": [1, -2.5, True, False, [3, ["q"]], {"k": [" "]}]}]},
        {"deep": [[["z"]], "[7, {\"m\": [8]}]", "plain"], "e": [[], {}, None]}, ["top", 1], {"x": "[9]"},
    ]
    df = spark.createDataFrame([(f"r{i}", json.dumps(p, ensure_ascii=i % 2 == 0, indent=[None, 2][i % 2])) for i, p in enumerate(payloads)] + [("b", "{"), ("n", None)], "k string, p string")
    got = sorted((r.k, r.child_path, r.ord, r.value) for r in nested_tables.scalar_items(df, "p", ["k"]).collect())
    assert got == sorted((f"r{i}", b, c, d) for i, p in enumerate(payloads) for _, b, c, d in owner(p)) and len(got) == 17
    first = {r.child_path: r for r in nested_tables.scalar_items(df, "p", ["k"]).where("k = 'r0'").collect()}
    assert first["findings[0].tags[2]"].parent_path == "findings[0]" and first["findings[0].tags[2]"].table_path == "findings.tags" and first["findings[1].n[5].k[0]"].parent_path == "findings[1].n[5]"
    assert nested_tables.scalar_items(df.limit(0), "p", ["k"]).count() == 0


def test_every_path_of_the_payloads_has_a_flat_table(spark):
    from evidra.plans import core_problems

    folder = "/root/testdata/sf0.01"
    paths = {r[0] for r in core_problems._objects(spark, folder).select("table_path").distinct().collect()}
    assert paths <= {"findings", "findings.evidence", "changed_files.hunks"} | {p for p, _ in core_problems._FLAT.values()}
    assert {r[0] for r in core_problems.p6_items(spark, folder).select("table_path").distinct().collect()} >= {"findings.tags", "findings.affectedSymbols"}
    assert core_problems.QUERIES["p6_changed_files"](spark, folder).where("path is not null").count() > 0


def test_table_of_all_lines_holds_the_rescued_values(spark, tmp_path):
    from evidra.plans import core_problems

    payloads = ['{"version": 2, "status": "ok", "errors": ["a", {"b": "\\"q"}], "new": {"x": 1.0, "y": null}}', '{"version": "1"}', "{", None]
    rows = [("s", "f", f"k{i}", i, datetime(2025, 1, 1), datetime(2025, 1, 1), p) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "stream_id string, file_id string, record_key string, line_no int, written_at timestamp, received_at timestamp, payload string")
    df.write.parquet(str(tmp_path / "artifact_records.parquet"))
    got = {r.line_no: r for r in core_problems.p3_table(spark, str(tmp_path)).collect()}
    values = json.loads(got[0].rescued)
    assert {k: json.loads(v) for k, v in values.items()} == {"version": 2, "errors": ["a", {"b": '"q'}], "new.x": 1, "new.y": None}
    assert list(values) == sorted(values) == got[0].rescued_paths.split(",") and [got[i].rescued for i in (1, 2, 3)] == ["{}"] * 3


def drift(spark, files):
    rows = []
    for i, lines in enumerate(files):
        for j, line in enumerate(lines):
            rows.append(("s", f"f{i}", datetime(2025, 1, 1) + timedelta(days=i), f"k{j}", line if isinstance(line, str | None) else json.dumps(line)))
    df = spark.createDataFrame(rows, "stream_id string, file_id string, written_at timestamp, record_key string, payload string")
    targets = {"version": "string", "n": "double"}
    table = schema_drift.ingest(df, targets)
    lines = table.where("_parsed").select("stream_id", "file_id", "written_at", "record_key", schema_drift.fields_of(targets).alias("fields"))
    return sorted(tuple(r) for r in schema_drift.changes(lines).collect())


def test_schema_changes(spark):
    assert drift(spark, [[{"a": 1, "o": {"x": "v"}}], [{"a": 1.0, "o": {"y": "v"}, "z": None}]]) == [
        ("f1", "o.x", "renamed", "o.y"), ("f1", "z", "added", "")]
    assert drift(spark, [[{"a": 1}], [{"b": 2}]]) == [("f1", "a", "removed", ""), ("f1", "b", "added", "")]
    assert drift(spark, [[{"n": 1}, {"n": 2}], [{"n": "1"}, {"n": 2}]]) == [("f1", "n", "type_changed", "")]
    # one record disagrees: no renaming; values of different types aren't equal
    assert [x[2] for x in drift(spark, [[{"a": 1}, {"a": 2}], [{"b": 1}, {"b": 3}]])] == ["removed", "added"]
    assert [x[2] for x in drift(spark, [[{"a": "1"}], [{"b": 1}]])] == ["removed", "added"]
    # a typed and a rescued field with equal values; nulls on one side don't count
    assert drift(spark, [[{"version": "é\"\n"}, {"version": None}], [{"w": "é\"\n"}, {"w": "q"}]]) == [("f1", "version", "renamed", "w")]
    assert drift(spark, [[None, "", "{", "[1]", {"a": {}}], [{"a": {}}]]) == []


def test_promote_replays_rescued_values(spark):
    df = spark.createDataFrame([('{"x": 5, "y": "t", "z": [1]}',), ('{"x": "5"}',), (None,)], "payload string")
    table = schema_drift.ingest(df, {"y": "string"})
    assert sorted(table.first()._rescued) == ["x", "z"]
    rows = schema_drift.promote(table, {"x": "bigint"}).collect()
    assert [r.f_x for r in rows] == [5, None, None] and rows[0].f_y == "t"
    assert [r._rescued for r in rows] == [{"z": "[1]"}, {"x": '"5"'}, None]


def test_orphan_state_is_independent_of_batches(spark):
    rng = random.Random(3)
    day = lambda i: datetime(2025, 1, 1) + timedelta(days=i)
    refs = [("t", f"r{i}", "f", f"p{0 if rng.random() < 0.4 else rng.randrange(30)}", day(rng.randrange(100))) for i in range(400)]
    parents = []
    for i in range(25):
        for _ in range(rng.choice([1, 1, 2])):
            start = rng.randrange(100)
            parents.append((f"p{i}", day(start), day(start + rng.randrange(40)) if rng.random() < 0.5 else None))
    r = spark.createDataFrame(refs, "table_name string, record_id string, field_name string, target_id string, at timestamp_ntz")
    p = spark.createDataFrame(parents, "target_id string, observed_at timestamp_ntz, deleted_at timestamp_ntz")
    p = p.distinct().select("target_id", F.xxhash64("observed_at", "deleted_at").alias("life"), "observed_at", "deleted_at")

    def reason(target, at):
        own = [x for x in parents if x[0] == target]
        if not own:
            return "missing"
        if any(a <= at and (b is None or at < b) for _, a, b in own):
            return None
        return "late" if all(a > at for _, a, _ in own) else "deleted"

    wanted = sorted((x[1], why) for x in refs if (why := reason(x[3], x[4])))
    for cuts in ([], [day(30), day(60)]):
        state = orphans.replay(r, p, cuts)
        assert sorted((x.record_id, x.reason) for x in state.orphans().collect()) == wanted
        steps = state.snapshots().collect()
        assert sum(x.change for x in steps) == len(wanted) == sum(x.n_orphans for x in steps if x.batch == max(y.batch for y in steps if y.reason == x.reason))
        # ends of lives come a batch late and reopen answered references
        assert not cuts or any(x.batch > 1 and x.reason == "deleted" and x.change > 0 for x in steps)
        # a batch writes what it brings and what it changes
        assert state.refs.count() < 1.7 * len(refs)
    # batches need not follow time
    late = orphans.OrphanState.empty(spark).apply(r, p.limit(0))
    assert late.orphans().count() == len(refs)
    late = late.apply(r.limit(0), p)
    assert sorted((x.record_id, x.reason) for x in late.orphans().collect()) == wanted
    assert late.counts().agg({"n_orphans": "sum"}).first()[0] == len(wanted)


def test_references_skip_what_is_none(spark):
    df = spark.createDataFrame([("a", None, None), ("b", "  ", None), ("c", " EXT:x", None), ("d", " File:1 ", None)], "id string, t string, at timestamp_ntz")
    rows = orphans.references(df, "x", "id", "t", "at").collect()
    assert [(r.record_id, r.target_id) for r in rows] == [("d", "file:1")]


FINDINGS = ("run_id string, rule_id string, category string, severity string, confidence double, title string, summary string, "
            "evidence array<struct<path string>>, affected_symbols array<string>, tags array<string>, fingerprint string")


def test_finding_changes(spark):
    runs = spark.createDataFrame(
        [(f"r{i}", datetime(2025, 1, i + 1), "main", "repo") for i in range(4)] + [("r1", datetime(2025, 1, 2), "main", "repo"), (None, None, None, None)],
        "run_id string, generated_at timestamp, branch string, repo_root string")
    f = lambda run, fp, sev="low", conf=0.5, title="t", tags=(), symbols=None: (
        run, "R", "c", sev, conf, title, None, [("p",)], symbols, list(tags) if tags is not None else None, fp)
    rows = [
        f("r0", "a"), f("r0", "b"), f("r0", None, title="u"), f("r0", "s", tags=["y", "x "]),
        f("r1", "a", "high"), f("r1", "a", "high"), f("r1", None, title="u", conf=0.50004), f("r1", "s", tags=["x", "y", "y", ""]), f("r1", None, symbols=["m", "n"]),
        f("r3", "a", "low"), f("zz", "q"),
    ]
    got = snapshot_diff.finding_changes(spark.createDataFrame(rows, FINDINGS), runs)
    found = sorted((r.run_id, r.finding_key, r.change_kind) for r in got.collect())
    assert found == sorted([
        ("r1", "fingerprint:a", "worsened"), ("r1", "fingerprint:b", "removed"), ("r1", "R|p|m,n", "added"),
        ("r2", "fingerprint:a", "removed"), ("r2", "R|p|u", "removed"), ("r2", "fingerprint:s", "removed"), ("r2", "R|p|m,n", "removed"),
        ("r3", "fingerprint:a", "added")])
    counts = {r.run_id: r for r in snapshot_diff.ratchet_summary(got, runs).collect()}
    assert counts["r2"].resolved_findings == 4 and counts["r1"].worsened_findings == 1 and "r0" not in counts
    empty = spark.createDataFrame([], FINDINGS)
    assert snapshot_diff.finding_changes(empty, runs).count() == 0


@pytest.mark.parametrize("share", [0.002])
def test_hot_keys_stay_few(spark, share):
    from evidra.session import hot_keys

    df = spark.range(30000).selectExpr("case when id % 3 = 0 then 'hot' else cast(id as string) end as k")
    assert [r.k for r in hot_keys(df, "k", share).collect()] == ["hot"]


def test_deep_and_dotted_payloads_lose_nothing(spark):
    deep = '{"a":' * 3000 + '{"x":1}' + "}" * 3000
    table = schema_drift.ingest(spark.createDataFrame([(1, deep), (2, '{"a.b":1,"a":{"b":"x"}}'), (3, "{}"), (4, "[1]"), (5, None)], "n int, payload string"), {})
    rows = {r.n: r for r in table.collect()}
    assert list(rows[1]._rescued) == [".".join(["a"] * 3000 + ["x"])]
    assert rows[2]._rescued == {"a\\.b": "1", "a.b": '"x"'}
    assert rows[3]._rescued == {} and rows[3]._parsed and rows[4]._rescued is None and not rows[5]._parsed
    nested = spark.createDataFrame([("d", deep)], "record_id string, payload string")
    assert nested_tables.nested_objects(nested, "payload", ["record_id"]).count() == 3000
    assert drift(spark, [[{"a.b": 1, "a": {"b": "x"}}], [{"a": {"b": "x"}}]]) == [("f1", "a.b", "removed", "")]


def test_numbers_are_told_apart_exactly(spark):
    assert drift(spark, [[{"p": 9007199254740993}], [{"q": 9007199254740992}]]) == [("f1", "p", "removed", ""), ("f1", "q", "added", "")]
    assert drift(spark, [[{"p": 9007199254740993, "n": 1e2}], ['{"q": 9007199254740993.0, "r": 100}']]) == [("f1", "n", "renamed", "r"), ("f1", "p", "renamed", "q")]
    assert [schema_drift._number(x) for x in ("10", "10.0", "1e1", "-0", "0.50", "1e400", "12345678901234567890123")] == ["10", "10", "10", "0", "0.5", "1e400", "12345678901234567890123"]


def test_leaf_maps_equal_a_walk():
    import random

    rng = random.Random(4)

    def value(d):
        k = rng.randrange(8)
        if d > 4 or k < 3:
            return rng.choice([1, -2.5, 0, True, None, "a", "", 'x"y', "\u00e9\\", 3.0])
        return {rng.choice(["a", "b", "c.d", 'q"', "e"]): value(d + 1) for _ in range(rng.randrange(4))} if k < 6 else [value(d + 1) for _ in range(rng.randrange(3))]

    def walk(head, node, out):
        for key, v in node.items():
            path = (head + "." if head else "") + key.replace("\\", "\\\\").replace(".", "\\.")
            walk(path, v, out) if isinstance(v, dict) else out.__setitem__(path, v)
        return out

    tops = [value(0) for _ in range(3000)]
    texts = [json.dumps(t, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for t in tops]
    for top, found in zip(tops, schema_drift.leaf_maps(pa.array(texts)).to_pylist(), strict=True):
        if not isinstance(top, dict):
            assert found is None
        else:
            assert {k: json.loads(v) for k, v in found} == walk("", top, {})
