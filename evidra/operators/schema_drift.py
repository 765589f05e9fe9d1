"""Rescue-column ingestion of JSON lines, and the changes between files of a stream.

``ingest`` enforces a target schema: a field whose JSON value has the wanted
type goes to its typed column, every other leaf (unknown, of another type, or
an explicit null) stays as JSON text in ``_rescued``. ``promote`` adds approved
fields to the target and replays the rescued values into the new columns.
No value is lost at any step, hence ``fields_of`` gives back every field of a line
and ``changes`` is computed from what was ingested.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidra.operators.json_structure import Structure, unescape
from evidra.session import saved

#: Type of a typed column -> type of the JSON value it takes.
JSON_KIND = {"string": "string", "double": "number", "bigint": "number", "boolean": "boolean"}

#: Target schemas of the artifacts, path -> type (fixed values of the data model).
TARGETS = {
    "artifact": "string",
    "status": "string",
    "schemaId": "string",
    "version": "string",
    "repoRoot": "string",
    "createdAt": "string",
    "generated_at": "string",
    "run_id": "string",
    "repo.root": "string",
    "tool.version": "string",
    "durationMs": "double",
    "rawFindings.total": "double",
    "acceptedExceptions.total": "double",
}


_NUMBER = re.compile(r"(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$")
_PLAIN_ARRAY = re.compile(r'\[(?:"[^"\\]*"(?:,"[^"\\]*")*)?\]$')


def _number(text: str) -> str:
    """One spelling per value, so that 10, 10.0 and 1e1 are equal; digits are exact."""
    sign, whole, part, power = _NUMBER.match(text).groups()
    digits = (whole + (part or "")).lstrip("0")
    exponent = int(power or 0) - len(part or "")
    short = digits.rstrip("0")
    exponent += len(digits) - len(short)
    if not short:
        return "0"
    if 0 <= exponent <= 20:
        return sign + short + "0" * exponent
    if -20 <= exponent < 0:
        padded = short.rjust(1 - exponent, "0")
        return f"{sign}{padded[:exponent]}.{padded[exponent:]}"
    return f"{sign}{short}e{exponent}"


class _Num(str):
    """The canonical text of a JSON number."""


def _canonical(value: object) -> str:
    if isinstance(value, _Num):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + _canonical(v) for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_canonical, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _same_spelling(raw: str) -> str:
    """The canonical text of one scalar or array (an array too deep for the parser keeps its own spelling)."""
    if raw[0] in "-0123456789":
        return _number(raw)
    number = lambda x: _Num(_number(x))
    try:
        return _canonical(json.loads(raw, parse_int=number, parse_float=number)).encode("utf-8", "replace").decode()
    except RecursionError:
        return raw


def leaf_maps(texts: pa.Array) -> pa.Array:
    """A map per text: dotted path and canonical JSON of every value that isn't an object; null if the text is no JSON object.

    Dots and backslashes of names are escaped by a backslash, so no two fields of a text
    have one path. Of equal names the last counts.
    """
    n = len(texts)
    s = Structure(pc.fill_null(texts.cast(pa.large_string()), ""))
    top = np.zeros(n, bool)
    first = s.level == 1
    top[s.row[first]] = s.is_obj[first]
    value_at = s.solid(s.colons + 1)
    names = unescape(s.slices(*s.name_before(s.colons)))
    names = pc.replace_substring_regex(names, r"([\\.])", r"\\\1")
    holder = s.colon_holder
    code = names.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(names) else np.zeros(0, np.int64)
    order = np.lexsort((s.colons, code, holder))
    counts = np.ones(len(order), bool)  # the last member of its name
    again = (holder[order][1:] == holder[order][:-1]) & (code[order][1:] == code[order][:-1])
    counts[order[:-1][again]] = False
    box = np.searchsorted(s.start, value_at)
    is_box = (box < len(s.start)) & (s.start[np.minimum(box, max(len(s.start) - 1, 0))] == value_at) if len(s.start) else np.zeros(0, bool)
    member_of = np.full(len(s.start), -1, np.int64)
    member_of[box[is_box]] = np.flatnonzero(is_box)
    # paths of objects, level by level
    alive = np.zeros(len(s.start), bool)
    local = np.zeros(len(s.start), np.int64)
    paths: list[pa.Array] = []
    empty, dot = pa.scalar("", pa.large_string()), pa.scalar(".", pa.large_string())
    under = lambda above, name: pc.binary_join_element_wise(above, pc.if_else(pc.equal(above, empty), empty, dot), name, empty)
    taken: list[np.ndarray] = []
    for level, own in enumerate(s.by_level):
        own = own[s.is_obj[own]]
        if level:
            m = member_of[own]
            own = own[(m >= 0) & counts[np.maximum(m, 0)] & alive[s.parent[own]]]
        alive[own] = True
        local[own] = np.arange(len(own))
        if not len(own):
            break
        taken.append(own)
        if level:
            path = under(paths[-1].take(pa.array(local[s.parent[own]])), names.take(pa.array(member_of[own])))
        else:
            path = pa.array([""] * len(own), pa.large_string())
        paths.append(path.cast(pa.large_string()))
    leaf = np.flatnonzero(counts & alive[holder] & (s.data[value_at] != 0x7B)) if len(holder) else np.zeros(0, np.int64)
    leaf = leaf[np.argsort(s.row[holder[leaf]], kind="stable")]
    at = value_at[leaf]
    ends = np.empty(len(leaf), np.int64)
    ends[is_box[leaf]] = s.end[box[leaf][is_box[leaf]]] + 1
    ends[~is_box[leaf]] = s.value_ends(at[~is_box[leaf]])
    values = s.slices(at, ends)
    odd = pc.match_substring_regex(values, r'^(?:\[|"[^\\]*\\|-?[0-9]+[.eE]|-0|-?[0-9]{20})').to_numpy(zero_copy_only=False)
    if odd.any():
        fixed = values.to_pylist()
        for i in np.flatnonzero(odd):
            if not _PLAIN_ARRAY.match(fixed[i]):
                fixed[i] = _same_spelling(fixed[i])
        values = pa.array(fixed, pa.large_string())
    number = np.full(len(s.start), -1, np.int64)
    if taken:
        number[np.concatenate(taken)] = np.arange(sum(map(len, taken)))
    keys = under(pa.concat_arrays(paths).take(pa.array(number[holder[leaf]])), names.take(pa.array(leaf))) if len(leaf) else names.slice(0, 0)
    edges = np.concatenate([[0], np.cumsum(np.bincount(s.row[holder[leaf]], minlength=n) if len(leaf) else np.zeros(n, np.int64))]).astype(np.int32)
    offsets = pa.array(edges, pa.int32(), mask=np.concatenate([~top, [False]]))
    return pa.MapArray.from_arrays(offsets, keys.cast(pa.string()), values.cast(pa.string()))


def flatten_lines(df: DataFrame, payload: str = "payload") -> DataFrame:
    """``df`` with ``_leaves`` (map of dotted path to JSON text, see ``leaf_maps``) in place of ``payload``.

    Null, empty or broken payloads and payloads that aren't objects give a null map. Whole
    Arrow batches are taken apart at once.
    """
    keep = [c for c in df.columns if c not in (payload, "_leaves", "_rescued", "_parsed")]
    df = df.select(*keep, payload)
    schema = df.select(*keep, F.lit(None).cast("map<string,string>").alias("_leaves")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(payload)
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                columns = [part.column(i) for i in range(part.num_columns) if i != at]
                names = [n for n in batch.schema.names if n != payload]
                yield pa.RecordBatch.from_arrays([*columns, leaf_maps(part.column(at))], [*names, "_leaves"])

    return df.mapInArrow(run, schema)


def shown(path: Column | str) -> Column:
    """A path as it is reported: without escapes."""
    return F.regexp_replace(path, r"\\(.)", "$1")


def json_kind(text: Column) -> Column:
    """The JSON type of a canonical JSON text; null for the JSON null."""
    first = F.substring(text, 1, 1)
    return (
        F.when(first == '"', "string")
        .when(first == "[", "array")
        .when(first.isin("t", "f"), "boolean")
        .when(first == "n", None)
        .otherwise("number")
    )


def _typed(text: Column, kind: str) -> Column:
    """The value as ``kind``, or null if the JSON type is another or it doesn't fit."""
    fits = json_kind(text) == JSON_KIND[kind]
    if kind == "string":
            return F.when(fits, _text_of(text))
    if kind == "double":
        fits = fits & text.rlike(EXACT)
    return F.when(fits, text.try_cast(kind))


#: Numbers that a double holds exactly enough to tell all of them apart: at most 15 digits. Others stay as text.
EXACT = r"^-?(?:[0-9]{1,15}|(?=[0-9.]{3,16}$)[0-9]+\.[0-9]+)$"


def _text_of(text: Column) -> Column:
    """The value of one JSON string; only those with escapes are parsed."""
    parsed = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return F.when(F.contains(text, F.lit("\\")), parsed).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))


def _number_hash(text: Column) -> Column:
    return F.when(text.rlike(EXACT), F.xxhash64(F.lit("number"), text.try_cast("double"))).otherwise(F.xxhash64(F.lit("exact"), text))


def column_of(path: str) -> str:
    """The typed column of a field path."""
    return "f_" + path.replace(".", "__")


def ingest(df: DataFrame, targets: dict[str, str] = TARGETS, payload: str = "payload") -> DataFrame:
    """One consistent table: a typed column per target field, and ``_rescued``.

    ``_rescued`` maps the path of every leaf that has no typed value to its JSON
    text; ``_parsed`` is false for lines that are no JSON object.
    """
    return promote(
        flatten_lines(df, payload)
        .withColumn("_parsed", F.col("_leaves").isNotNull())
        .withColumnRenamed("_leaves", "_rescued"),
        targets,
    )


def promote(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Give each approved field a typed column and replay the rescued values into it."""
    for path, kind in approved.items():
        table = table.withColumn(column_of(path), _typed(F.col("_rescued")[path], kind))
    moved = [(p, column_of(p)) for p in approved]
    taken = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(p)) for p, c in moved]))
    return table.withColumn("_taken", taken).withColumn(
        "_rescued", F.map_filter("_rescued", lambda k, _: ~F.array_contains(F.col("_taken"), k))
    ).drop("_taken")


def fields_of(targets: dict[str, str]) -> Column:
    """Every field of an ingested line again, as an array of ``path``, ``kind`` and ``value`` (a hash).

    Explicit nulls have a null kind; they show that the field is there. A typed value and
    a rescued one of the same JSON type and text have the same hash.
    """

    def typed(path: str, kind: str) -> Column:
        col = F.col(column_of(path))
        own = {"double": F.xxhash64(F.lit("number"), col), "bigint": _number_hash(col.cast("string")), "boolean": F.xxhash64(F.lit("boolean"), col.cast("string"))}
        value = own.get(kind, F.xxhash64(F.lit(JSON_KIND[kind]), col))
        return F.when(col.isNotNull(), F.struct(F.lit(path).alias("path"), F.lit(JSON_KIND[kind]).alias("kind"), value.alias("value")))

    def rescued(entry: Column) -> Column:
        kind = json_kind(entry["value"])
        value = (
            F.when(kind == "string", F.xxhash64(F.lit("string"), _text_of(entry["value"])))
            .when(kind == "number", _number_hash(entry["value"]))
            .otherwise(F.xxhash64(F.coalesce(kind, F.lit("null")), entry["value"]))
        )
        return F.struct(entry["key"].alias("path"), kind.alias("kind"), value.alias("value"))

    rest = F.transform(F.map_entries(F.coalesce("_rescued", F.create_map().cast("map<string,string>"))), rescued)
    return F.concat(F.array_compact(F.array(*[typed(p, k) for p, k in targets.items()])), rest)


#: One bit per JSON type: sets of types are compared as integers.
KIND_BIT = {"string": 1, "number": 2, "boolean": 4, "array": 8}


def changes(lines: DataFrame) -> DataFrame:
    """What each file of a stream changed against the one before it by ``written_at``.

    ``lines``: ``stream_id, file_id, written_at, record_key, fields``, one row per parsed line, with
    the array of ``fields_of``. Gives ``file_id, field_path, change_kind, new_path``. The first
    file of a stream changes nothing; ties of ``written_at`` go by ``file_id``. A file is
    taken as present when any of its lines is a JSON object. Repeated lines make no difference.

    A field that goes and one that comes are one renamed field if some record has both
    values and none has different ones; that is counted per record with partial aggregates, so the
    records of a large file never meet in one task.
    """
    files = lines.groupBy("stream_id", "file_id").agg(F.min("written_at").alias("written_at"))
    order = W.partitionBy("stream_id").orderBy("written_at", "file_id")
    pairs = files.select("file_id", F.lag("file_id").over(order).alias("before"), F.lead("file_id").over(order).alias("after"))
    cells = lines.select("file_id", "record_key", F.explode("fields").alias("f")).select("file_id", "record_key", "f.*")
    bit = F.lit(0)
    for kind, n in KIND_BIT.items():
        bit = F.when(F.col("kind") == kind, n).otherwise(bit)
    fields = cells.groupBy("file_id", "path").agg(F.bit_or(bit).alias("kinds"))
    # each field stands in its own file (new side) and in the file after it (old side)
    side = lambda new, later, before: F.when(later.isNotNull() & before.isNotNull(), F.struct(later.alias("later"), before.alias("before"), F.lit(new).alias("new")))
    own, after = side(1, F.col("file_id"), F.col("before")), side(0, F.col("after"), F.col("file_id"))
    sides = fields.join(pairs, "file_id").select("path", "kinds", F.explode(F.array_compact(F.array(own, after))).alias("s")).select("path", "kinds", "s.*")
    compared = sides.groupBy("later", "before", "path").agg(
        F.max(F.when(F.col("new") == 1, F.col("kinds"))).alias("new_kinds"), F.max(F.when(F.col("new") == 0, F.col("kinds"))).alias("old_kinds")
    ).where("not (new_kinds <=> old_kinds)")
    compared = saved(compared)
    both = compared.where("new_kinds is not null and old_kinds is not null").select(
        F.col("later").alias("file_id"), F.col("path").alias("field_path"), F.lit("type_changed").alias("change_kind"), F.lit("").alias("new_path")
    )
    one = compared.where("new_kinds is null or old_kinds is null").select("later", "before", "path", F.col("old_kinds").isNull().alias("added"))
    # values of the fields that come or go, by record
    marks = one.select(F.when(F.col("added"), F.col("later")).otherwise(F.col("before")).alias("file_id"), "path", "later", "added")
    values = saved(cells.where("kind is not null and record_key is not null").join(marks, ["file_id", "path"]).select("later", "added", "path", "record_key", "value"))
    gone = values.where("not added").select("later", "record_key", F.col("path").alias("old_path"), F.col("value").alias("v1"))
    come = values.where("added").select("later", "record_key", F.col("path").alias("new_path"), F.col("value").alias("v2"))
    renamed = saved(
        gone.join(come, ["later", "record_key"]).groupBy("later", "old_path", "new_path").agg(F.bool_and(F.col("v1") == F.col("v2")).alias("same"))
        .where("same").select("later", "old_path", "new_path")
    )
    used = renamed.select("later", F.col("old_path").alias("path"), F.lit(False).alias("added")).unionByName(
        renamed.select("later", F.col("new_path").alias("path"), F.lit(True).alias("added"))
    )
    rest = one.join(used, ["later", "path", "added"], "left_anti").select(
        F.col("later").alias("file_id"), F.col("path").alias("field_path"),
        F.when(F.col("added"), "added").otherwise("removed").alias("change_kind"), F.lit("").alias("new_path"),
    )
    named = renamed.select(
        F.col("later").alias("file_id"), F.col("old_path").alias("field_path"), F.lit("renamed").alias("change_kind"), "new_path"
    )
    out = both.unionByName(rest).unionByName(named)
    return out.withColumn("field_path", shown("field_path")).withColumn("new_path", shown("new_path")).distinct()
