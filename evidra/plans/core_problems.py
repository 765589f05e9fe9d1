"""Queries over the tables for the general data problems (3 to 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators import nested_tables, orphans, schema_drift, snapshot_diff
from evidra.session import saved
from evidra.sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every change of fields between consecutive files of a stream."""
    raw = table(spark, folder, "artifact_records").select("stream_id", "file_id", "record_key", "written_at", "payload")
    lines = schema_drift.ingest(raw).where("_parsed")
    fields = schema_drift.fields_of(schema_drift.TARGETS).alias("fields")
    return schema_drift.changes(saved(lines.select("stream_id", "file_id", "record_key", "written_at", fields)))


def p3_table(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table of all lines: typed columns and what was rescued (paths, and an object of their JSON texts, both sorted)."""
    raw = table(spark, folder, "artifact_records").dropDuplicates(["file_id", "line_no"])
    lines = schema_drift.ingest(raw.drop("received_at"))
    rescued = F.array_sort(F.map_keys("_rescued"))
    values = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("_rescued"))))
    return lines.select(
        "stream_id", "file_id", "line_no", "record_key", *[schema_drift.column_of(p) for p in schema_drift.TARGETS],
        F.coalesce(F.array_join(rescued, ","), F.lit("")).alias("rescued_paths"), F.coalesce(F.size(rescued), F.lit(0)).alias("n_rescued"),
        F.coalesce(values, F.lit("{}")).alias("rescued"),
    )


#: Fields that came with the drift and were approved later: path -> type.
APPROVED = {"updatedAt": "string", "owner_team": "string", "branch": "string", "retry": "double", "exitCode": "double"}


def p3_promoted(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent table after fields were approved: what ingestion had rescued of them is replayed into typed columns."""
    raw = table(spark, folder, "artifact_records").select("file_id", "line_no", "payload")
    ingested = schema_drift.ingest(raw)
    lines = schema_drift.promote(ingested, APPROVED)
    columns = [schema_drift.column_of(p) for p in APPROVED]
    rows = lines.where(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNotNull())
    return rows.select("file_id", "line_no", *columns).dropDuplicates(["file_id", "line_no"])


def _references(spark: SparkSession, folder: str) -> DataFrame:
    symbols, relations, findings = (table(spark, folder, n) for n in ("symbols", "relations", "findings"))
    return (
        orphans.references(symbols, "symbols", "id", "file_id", "observed_at")
        .unionByName(orphans.references(relations, "relations", "id", "from_id", "observed_at"))
        .unionByName(orphans.references(relations, "relations", "id", "to_id", "observed_at"))
        .unionByName(orphans.references(findings, "findings", "id", "affected_symbols", "generated_at", many=True, arrived="loaded_at"))
    )


#: The history is replayed in so many batches of about equally many relations.
BATCHES = 3


def _orphan_state(spark: SparkSession, folder: str) -> orphans.OrphanState:
    lives = orphans.lives_of(table(spark, folder, "files")).unionByName(orphans.lives_of(table(spark, folder, "symbols")))
    seconds = F.unix_timestamp(F.col("observed_at").cast("timestamp"))
    shares = [i / BATCHES for i in range(1, BATCHES)]
    at = table(spark, folder, "relations").agg(F.percentile_approx(seconds, shares, 100).alias("m")).first()["m"]  # a fixed number of values
    cuts = [F.timestamp_seconds(F.lit(int(x))).cast("timestamp_ntz") for x in dict.fromkeys(at or [])]
    return orphans.replay(_references(spark, folder), lives, cuts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every reference to a file or symbol that isn't there at that time."""
    return _orphan_state(spark, folder).orphans().drop("at").distinct()


def p4_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field, reason and month."""
    return _orphan_state(spark, folder).counts()


def p4_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans per table, field and reason after each batch, with what the batch changed."""
    return _orphan_state(spark, folder).snapshots()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """What changed between consecutive runs of a branch."""
    return snapshot_diff.finding_changes(table(spark, folder, "findings"), table(spark, folder, "runs"))


def p5_ratchet_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts of a ratchet summary for every run but the first of its branch."""
    return snapshot_diff.ratchet_summary(p5_found(spark, folder), table(spark, folder, "runs"))


def _objects(spark: SparkSession, folder: str) -> DataFrame:
    return nested_tables.nested_objects(table(spark, folder, "nested_artifacts"), "payload", ["record_id"])


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every JSON object below the top of a payload with the object around it."""
    return _objects(spark, folder).select("record_id", "parent_path", "child_path").distinct()


def p6_findings(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of the findings in the payloads."""
    columns = {"id": "string", "ruleId": "string", "severity": "string", "confidence": "double", "title": "string"}
    return nested_tables.child_table(_objects(spark, folder), "findings", ["record_id"], columns).distinct()


def p6_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of evidence, linked to its finding by ``parent_path``."""
    columns = {"id": "string", "path": "string", "kind": "string", "startLine": "int"}
    return nested_tables.child_table(_objects(spark, folder), "findings.evidence", ["record_id"], columns).distinct()


def p6_hunks(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of diff hunks, linked to the changed file by ``parent_path``."""
    columns = {"startLine": "int", "endLine": "int"}
    return nested_tables.child_table(_objects(spark, folder), "changed_files.hunks", ["record_id"], columns).distinct()


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """The flat table of scalar items of arrays (tags, affected symbols and files), linked to the object around them."""
    rows = nested_tables.scalar_items(table(spark, folder, "nested_artifacts"), "payload", ["record_id"])
    return rows.select("record_id", "table_path", "parent_path", "child_path", "ord", "value").distinct()


#: The other objects of the payloads: the path of each flat table and the types of its members.
_FLAT = {
    "p6_changed_files": ("changed_files", {"path": "string", "status": "string", "additions": "int", "deletions": "int"}),
    "p6_contents": ("contents", {"name": "string", "path": "string", "type": "string", "size_bytes": "long", "hash_sha256": "string"}),
    "p6_external_refs": ("findings.evidence.externalRef", {"tool": "string", "ruleId": "string", "url": "string"}),
    "p6_upstreams": ("findings.upstream", {"tool": "string", "ruleId": "string"}),
    "p6_repos": ("repo", {"root": "string", "revision": "string", "base_ref": "string", "head_ref": "string"}),
    "p6_sources": ("source", {"repo_root": "string", "branch": "string", "run_id": "string", "policy_id": "string", "tool_version": "string"}),
    "p6_tools": ("tool", {"name": "string", "version": "string"}),
    "p6_plugin_versions": ("tool.plugin_versions", {"name": "string", "version": "string", "visibility": "string"}),
    "p6_signatures": ("signature", {"algorithm": "string"}),
    "p6_signers": ("signature.signer", {"team": "string", "role": "string"}),
    "p6_blast_radius": ("blast_radius", {}),
    "p6_diff_findings": ("diff_findings", {}),
}


def _flat(name: str):
    path, columns = _FLAT[name]

    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested_tables.child_table(_objects(spark, folder), path, ["record_id"], columns).distinct()

    query.__name__, query.__doc__ = name, f"The flat table of ``{path}``, linked to the object around it by ``parent_path``."
    return query


QUERIES = {f.__name__: f for f in (p3_found, p3_table, p3_promoted, p4_found, p4_counts, p4_snapshots, p5_found, p5_ratchet_counts, p6_found, p6_findings, p6_evidence, p6_hunks, p6_items, *map(_flat, _FLAT))}

_ID = r"lower(regexp_replace({0}, '^\s+|\s+$', '', 'g'))"
_P4_JUDGED = f"""
with parents as (
  select distinct {_ID.format('id')} as tid, observed_at, deleted_at from files
  union select distinct {_ID.format('id')}, observed_at, deleted_at from symbols),
refs as (
  select 'symbols' as table_name, id as record_id, 'file_id' as field_name, {_ID.format('file_id')} as target_id, observed_at as ref_at from symbols
  union select 'relations', id, 'from_id', {_ID.format('from_id')}, observed_at from relations
  union select 'relations', id, 'to_id', {_ID.format('to_id')}, observed_at from relations
  union select 'findings', id, 'affected_symbols', {_ID.format('s')}, generated_at from (select id, generated_at, unnest(affected_symbols) as s from findings)),
judged as (
  select table_name, record_id, field_name, target_id, ref_at,
    case when count(tid) = 0 then 'missing'
         when coalesce(bool_or(observed_at <= ref_at and (deleted_at is null or ref_at < deleted_at)), false) then null
         when min(observed_at) > ref_at then 'late' else 'deleted' end as reason
  from refs left join parents on tid = target_id
  where target_id <> '' and not starts_with(target_id, 'ext:') group by table_name, record_id, field_name, target_id, ref_at)
"""

_P5_CASES = r"""
with clean as (
  select distinct run_id, rule_id, evidence, affected_symbols, fingerprint, title,
    trim(coalesce(category, '')) as category, trim(coalesce(severity, '')) as severity, coalesce(round(confidence, 4), -1) as confidence,
    trim(coalesce(title, '')) as ctitle, trim(coalesce(summary, '')) as summary,
    list_sort(list_distinct(list_filter(list_transform(coalesce(tags, []), lambda x: trim(coalesce(x, ''))), lambda x: x <> ''))) as tags
  from findings),
keyed as (
  select distinct run_id, category, severity, confidence, ctitle, summary, tags,
    case lower(severity) when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 else 0 end as rank,
    case when fingerprint is not null then 'fingerprint:' || fingerprint else
      coalesce(rule_id, '') || '|' || coalesce(evidence[1].path, '') || '|' ||
      case when coalesce(array_to_string(affected_symbols, ','), '') <> '' then array_to_string(affected_symbols, ',') else coalesce(title, '') end
    end as finding_key
  from clean),
ordered as (
  select repo_root, branch, run_id, lag(run_id) over w as before
  from (select distinct repo_root, branch, run_id, generated_at from runs) window w as (partition by repo_root, branch order by generated_at, run_id)),
cases as (
  select o.repo_root, o.branch, o.run_id, coalesce(n.finding_key, b.finding_key) as finding_key,
    case when b.run_id is null then 'added' when n.run_id is null then 'removed' when n.rank > b.rank then 'worsened'
         when (n.category, n.severity, n.confidence, n.ctitle, n.summary, n.tags) is distinct from (b.category, b.severity, b.confidence, b.ctitle, b.summary, b.tags)
         then 'changed' end as change_kind
  from (select o.*, k.finding_key as k from ordered o join keyed k on k.run_id in (o.run_id, o.before) where o.before is not null group by all) o
  left join keyed n on n.run_id = o.run_id and n.finding_key = o.k
  left join keyed b on b.run_id = o.before and b.finding_key = o.k)
"""

_P3_CASES = r"""
with lines as (select distinct stream_id, file_id, record_key, written_at, payload from artifact_records where json_valid(payload)),
leaves as (
  select l.stream_id, l.file_id, l.record_key, replace(substr(j.fullkey, 3), '"', '') as path,
    case j.type when 'VARCHAR' then 'string' when 'ARRAY' then 'array' when 'BOOLEAN' then 'boolean' when 'NULL' then null else 'number' end as kind,
    case when j.type in ('DOUBLE', 'BIGINT', 'UBIGINT') then cast(cast(j.value as double) as varchar) else cast(j.value as varchar) end as value
  from lines l, json_tree(l.payload) j where j.type <> 'OBJECT' and j.fullkey <> '$' and j.fullkey not like '%[%'),
pairs as (
  select file_id, lag(file_id) over (partition by stream_id order by written_at, file_id) as before
  from (select stream_id, file_id, min(written_at) as written_at from lines group by all)),
fields as (select file_id, path, coalesce(list_sort(list(distinct kind) filter (kind is not null)), []) as kinds from leaves group by all),
paths as (select distinct p.file_id, p.before, f.path from pairs p join fields f on f.file_id in (p.file_id, p.before) where p.before is not null),
sides as (
  select p.file_id, p.before, p.path, n.kinds as new_kinds, b.kinds as old_kinds from paths p
  left join fields n on n.file_id = p.file_id and n.path = p.path left join fields b on b.file_id = p.before and b.path = p.path),
renamed as (
  select o.file_id, o.path as old_path, n.path as new_path
  from sides o join sides n on o.file_id = n.file_id and o.new_kinds is null and n.old_kinds is null
  join leaves a on a.file_id = o.before and a.path = o.path and a.kind is not null
  join leaves c on c.file_id = o.file_id and c.path = n.path and c.kind is not null and c.record_key = a.record_key
  group by all having bool_and(a.kind = c.kind and a.value = c.value))
select file_id, path as field_path, 'added' as change_kind, '' as new_path from sides s where old_kinds is null
  and not exists (select 1 from renamed r where r.file_id = s.file_id and r.new_path = s.path)
union select file_id, path, 'removed', '' from sides s where new_kinds is null
  and not exists (select 1 from renamed r where r.file_id = s.file_id and r.old_path = s.path)
union select file_id, old_path, 'renamed', new_path from renamed
union select file_id, path, 'type_changed', '' from sides where new_kinds is not null and old_kinds is not null and new_kinds <> old_kinds
"""

def _promoted_sql() -> str:
    parts = []
    for path, kind in APPROVED.items():
        types, cast = ("'VARCHAR'", "varchar") if kind == "string" else ("'BIGINT', 'UBIGINT', 'DOUBLE'", "double")
        parts.append(f"case when json_type(payload, '$.{path}') in ({types}) then cast(json_extract_string(payload, '$.{path}') as {cast}) end as {schema_drift.column_of(path)}")
    columns = [schema_drift.column_of(p) for p in APPROVED]
    some = " or ".join(f"{c} is not null" for c in columns)
    return f"select distinct file_id, line_no, {', '.join(columns)} from (select file_id, line_no, {', '.join(parts)} from artifact_records where json_valid(payload)) where {some}"


_ARRAYS = "(" + ", ".join(f"'{m}'" for m in nested_tables.ARRAY_MEMBERS) + ")"


def _tree_sql(level: int, docs: str) -> str:
    """Nodes of JSON documents (``rid, eid, head, up, lone, spot, doc``) with their paths, by a walk from parents to children."""
    t, w = f"t{level}", f"w{level}"
    path = f"case when w.type = 'ARRAY' then w.path || '[' || t.key || ']' else case when w.path = '' then '' else w.path || '.' end || t.key || case when t.type = 'OBJECT' and t.key in {_ARRAYS} then '[0]' else '' end end"
    return f"""{t} as (select d.rid, d.eid, d.head, d.up, d.lone, d.spot, j.id, j.parent, cast(j.key as varchar) as key, j.type, j.atom from {docs} d, json_tree(d.doc) j),
{w}(rid, eid, id, type, path, around, ord, key, atom, kind) as (select rid, eid, id, type, head || case when lone and type = 'OBJECT' then '[0]' else '' end, up, case when lone then 0 else spot end, cast(null as varchar), atom, 'top' from {t} where parent is null
 union all select t.rid, t.eid, t.id, t.type, {path}, case when w.type = 'OBJECT' then case when w.path = '' then '$' else w.path end else w.around end,
 case when w.type = 'ARRAY' then cast(t.key as int) when t.type = 'OBJECT' and t.key in {_ARRAYS} then 0 else -1 end, t.key, t.atom, case when w.type = 'ARRAY' then 'item' else 'member' end from {w} w join {t} t on t.rid = w.rid and t.eid = w.eid and t.parent = w.id),
"""


def _inner_sql(level: int) -> str:
    """The strings among the nodes that hold an object or array, as documents of the next level."""
    text = "(atom ->> '$')"
    holds = f"type = 'VARCHAR' and json_valid({text}) and case when json_valid({text}) then json_type({text}) in ('OBJECT', 'ARRAY') end"
    return f"d{level + 1} as (select rid, row_number() over () as eid, path as head, around as up, kind = 'member' and key in {_ARRAYS} as lone, case when kind = 'item' then ord else -1 end as spot, {text} as doc from w{level} where {holds}), "


#: The nodes of all payloads, with three levels of strings that hold JSON.
_P6 = (
    "with recursive d0 as (select distinct record_id as rid, 0 as eid, '' as head, '$' as up, false as lone, -1 as spot, payload as doc from nested_artifacts where payload is not null and json_valid(payload) and json_type(payload) in ('OBJECT', 'ARRAY')), "
    + _tree_sql(0, "d0") + _inner_sql(0) + _tree_sql(1, "d1") + _inner_sql(1) + _tree_sql(2, "d2") + _inner_sql(2) + _tree_sql(3, "d3")
    + """n as (select 0 as lv, * from w0 union all select 1, * from w1 union all select 2, * from w2 union all select 3, * from w3),
o as (select *, regexp_replace(path, '\\[[0-9]+\\]', '', 'g') as table_path from n where type = 'OBJECT' and path <> ''), """
)


def _child_sql(path: str, columns: dict[str, str]) -> str:
    kinds = {"string": "varchar", "int": "int", "long": "bigint", "double": "double"}
    text = "m.atom ->> '$'"
    plain = f"m.type in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN') and not (m.type = 'VARCHAR' and json_valid({text}) and case when json_valid({text}) then json_type({text}) in ('OBJECT', 'ARRAY') end)"
    picks = "".join(f", try_cast(max(case when m.key = '{c}' and {plain} then {text} end) as {kinds[k]}) as \"{c}\"" for c, k in columns.items())
    return _P6 + f"""c as (select o.rid as record_id, o.around as parent_path, o.path as child_path, o.ord as ord{picks} from o left join n m on m.rid = o.rid and m.lv = o.lv and m.eid = o.eid and m.kind = 'member' and m.around = o.path and m.path not like o.path || '%[%' where o.table_path = '{path}' group by o.rid, o.lv, o.eid, o.id, o.around, o.path, o.ord) select distinct * from c"""


_P6_TABLES = {
    "p6_findings": ("findings", {"id": "string", "ruleId": "string", "severity": "string", "confidence": "double", "title": "string"}),
    "p6_evidence": ("findings.evidence", {"id": "string", "path": "string", "kind": "string", "startLine": "int"}),
    "p6_hunks": ("changed_files.hunks", {"startLine": "int", "endLine": "int"}),
} | _FLAT

def _table_sql() -> str:
    """The consistent table by a walk over the leaves of each line."""
    picks, typed = [], []
    for path, kind in schema_drift.TARGETS.items():
        column = schema_drift.column_of(path)
        if kind == "string":
            test, value = "type = 'VARCHAR'", "atom ->> '$'"
        else:
            test, value = "type in ('BIGINT', 'UBIGINT', 'DOUBLE') and length(replace(replace(cast(atom as varchar), '-', ''), '.', '')) <= 15", "cast(atom as double)"
        picks.append(f"max(case when path = '{path}' and {test} then {value} end) as {column}")
        typed.append(f"(path = '{path}' and {test})")
    plain = "path is not null and not coalesce(" + " or ".join(typed) + ", false)"
    return f"""with r as (select distinct stream_id, file_id, line_no, record_key, case when json_valid(payload) then payload else '{{}}' end as payload from artifact_records),
l as (select r.stream_id, r.file_id, r.line_no, r.record_key, replace(substr(j.fullkey, 3), '"', '') as path, j.type, j.atom, case j.type when 'VARCHAR' then cast(to_json(j.atom ->> '$') as varchar) when 'ARRAY' then regexp_replace(cast(json(j.value) as varchar), '([0-9])\\.0+([,\\]])', '\\1\\2', 'g') when 'NULL' then 'null' else cast(j.atom as varchar) end as text
 from r left join lateral (select * from json_tree(r.payload) where type <> 'OBJECT' and fullkey <> '$' and fullkey not like '%[%') j on true)
select stream_id, file_id, line_no, record_key, {', '.join(picks)}, coalesce(string_agg(path, ',' order by path) filter ({plain}), '') as rescued_paths, cast(count(*) filter ({plain}) as int) as n_rescued,
 '{{' || coalesce(string_agg(cast(to_json(path) as varchar) || ':' || cast(to_json(text) as varchar), ',' order by path) filter ({plain}), '') || '}}' as rescued from l group by stream_id, file_id, line_no, record_key"""


ORACLES = {
    "p3_table": _table_sql(),
    "p6_found": _P6 + "q as (select distinct rid as record_id, around as parent_path, path as child_path from o) select * from q",
    "p6_items": _P6
    + """q as (select distinct rid as record_id, regexp_replace(path, '\\[[0-9]+\\]', '', 'g') as table_path, around as parent_path, path as child_path, ord, atom ->> '$' as value from n where kind = 'item' and type not in ('OBJECT', 'ARRAY', 'NULL')
 and not (type = 'VARCHAR' and json_valid(atom ->> '$') and case when json_valid(atom ->> '$') then json_type(atom ->> '$') in ('OBJECT', 'ARRAY') end)) select * from q""",
    **{name: _child_sql(*spec) for name, spec in _P6_TABLES.items()},
    "p3_promoted": _promoted_sql(),
    "p3_found": _P3_CASES,
    "p4_found": _P4_JUDGED + "select distinct table_name, record_id, field_name, target_id, reason from judged where reason is not null",
    "p4_counts": _P4_JUDGED
    + "select table_name, field_name, reason, strftime(ref_at, '%Y-%m') as month, count(*) as n_orphans from "
    "(select distinct table_name, record_id, field_name, target_id, reason, ref_at from judged where reason is not null) group by all",
    "p5_found": _P5_CASES + "select distinct * from cases where change_kind is not null",
    "p5_ratchet_counts": _P5_CASES
    + """, kinds as (select distinct * from cases where change_kind is not null)
select o.repo_root, o.branch, o.run_id, count(*) filter (change_kind = 'added') as new_findings, count(*) filter (change_kind = 'removed') as resolved_findings,
  count(*) filter (change_kind = 'worsened') as worsened_findings, count(*) filter (change_kind = 'changed') as changed_findings
from ordered o left join kinds k on k.run_id = o.run_id where o.before is not null group by all""",
}
