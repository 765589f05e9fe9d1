"""Nested JSON records as flat tables that keep their parent links.

Whole Arrow batches of payloads are taken apart at once: ``json_structure`` finds
containers, parents and places in the shared UTF-8 buffer and says which
payloads are JSON; keys and paths are propagated from parents to children level
by level with Arrow's take and join kernels. No payload is parsed or walked by
itself. Strings that hold JSON themselves form the next round of buffers, below
the place where they stand. Depth has no limit; paths of a payload with n levels
have a length of n, so they take room of n squared in all.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators.json_structure import Structure, unescape

#: Members that are arrays by the schema: a lone object in their place is their item 0 (fixed values of the data model).
ARRAY_MEMBERS = ("findings", "evidence", "changed_files", "hunks", "contents", "plugin_versions")

_OPENING = np.frombuffer(b"{[", np.uint8)
_ARRAY_NAMES = pa.array(ARRAY_MEMBERS, pa.large_string())


_EMPTY, _DOT, _ZERO, _TOP, _LEFT, _RIGHT = (pa.scalar(x, pa.large_string()) for x in ("", ".", "[0]", "$", "[", "]"))


def _joined(*parts: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, _EMPTY)


def _index(place: np.ndarray) -> pa.Array:
    """Places as they stand in paths."""
    return _joined(_LEFT, pc.cast(pa.array(place, pa.int64()), pa.large_string()), _RIGHT)


def _at(places: np.ndarray) -> pa.Array:
    return pa.array(places, pa.int64())


def _paths(s: Structure, heads: pa.Array, up: pa.Array, lone: np.ndarray, names: pa.Array, place: np.ndarray, in_obj: np.ndarray, lone_obj: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Path of every container and of the nearest object around it, level by level: each level takes from the one above."""
    n = len(s.start)
    local = np.zeros(n, np.int64)  # place of a container in its level
    paths, arounds, order = [], [], []
    for level, own in enumerate(s.by_level):
        local[own] = np.arange(len(own))
        if not level:
            row = _at(s.row[own])
            path = _joined(heads.take(row), pc.if_else(pa.array(lone[s.row[own]] & s.is_obj[own]), _ZERO, _EMPTY))
            around = up.take(row)
        else:
            parent = s.parent[own]
            at = _at(local[parent])
            above, over = paths[-1].take(at), arounds[-1].take(at)
            top = pc.equal(above, _EMPTY)
            index = _index(place[own])
            member = _joined(pc.if_else(top, _EMPTY, _DOT), names.take(_at(own)), pc.if_else(pa.array(lone_obj[own]), _ZERO, _EMPTY))
            path = _joined(above, pc.if_else(pa.array(in_obj[own]), member, index))
            around = pc.if_else(pa.array(s.is_obj[parent]), pc.if_else(top, _TOP, above), over)
        paths.append(path.cast(pa.large_string()))
        arounds.append(around.cast(pa.large_string()))
        order.append(own)
    if not n:
        return pa.array([], pa.large_string()), pa.array([], pa.large_string())
    back = np.empty(n, np.int64)
    back[np.concatenate(order)] = np.arange(n)
    whole = lambda parts: pa.concat_arrays(parts).take(_at(back))
    return whole(paths), whole(arounds)


def _round(s: Structure, rows: np.ndarray, heads: pa.Array, up: pa.Array, lone: np.ndarray, spot: np.ndarray, items: bool = False) -> tuple[list[pa.Array], tuple | None]:
    """Objects of one round of texts (``items``: scalar items of arrays instead), and the texts of the next round.

    ``s``: the structure of the texts. ``heads``: path at which each text stands ("" for a payload); ``up``: path of the
    nearest object around it; ``lone``: the text stands for an array member, so an
    object at its top is item 0; ``spot``: its place if it is an item of an array, else -1.
    """
    n = len(s.start)
    data = s.data
    has = s.parent >= 0
    in_obj = np.zeros(n, bool)
    in_obj[has] = s.is_obj[s.parent[has]]
    in_arr = has & ~in_obj
    place = np.zeros(n, np.int64)
    place[in_arr] = s.place(s.parent[in_arr], s.start[in_arr])
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    low[in_obj], high[in_obj] = s.name_at(s.start[in_obj])
    names = unescape(s.slices(low, high))
    lone_obj = in_obj & s.is_obj & pc.is_in(names, _ARRAY_NAMES).to_numpy(zero_copy_only=False)
    path, around = _paths(s, heads, up, lone, names, place, in_obj, lone_obj)

    # scalars: members behind colons, items of arrays
    value_at = s.solid(s.colons + 1)
    scalar = ~np.isin(data[value_at], _OPENING)
    holder, value_at, colon = s.colon_holder[scalar], value_at[scalar], s.colons[scalar]
    m_names = unescape(s.slices(*s.name_before(colon)))
    is_str = data[value_at] == 0x22
    ends = s.value_ends(value_at)
    values = s.slices(value_at, ends)
    # items of arrays; strings among them may hold JSON
    arr_open = np.flatnonzero(~s.is_obj)
    in_list = ~s.is_obj[s.comma_holder] if n else np.zeros(0, bool)
    item_at = s.solid(np.concatenate([s.start[arr_open] + 1, s.commas[in_list] + 1]))
    item_holder = np.concatenate([arr_open, s.comma_holder[in_list]])
    plain_at, plain_holder = item_at, item_holder
    keep = data[item_at] == 0x22
    item_at, item_holder = item_at[keep], item_holder[keep]
    item_ends = s.value_ends(item_at)

    # the next round: strings that hold an object or array
    def inner(at: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = s.slices(at + 1, end - 1)
        return pc.match_substring_regex(raw, r"^(?:[ ]|\\[tnr]|\\u00(?:20|09|0[aAdD]))*(?:[{\[]|\\u00(?:7[bB]|5[bB]))").to_numpy(zero_copy_only=False)

    spots = s.place(item_holder, item_at)
    m = np.flatnonzero(is_str)
    m = m[inner(value_at[m], ends[m])]
    i = np.flatnonzero(inner(item_at, item_ends))
    begin, end = np.concatenate([value_at[m], item_at[i]]), np.concatenate([ends[m], item_ends[i]])
    inner_texts = pa.array([json.loads(x).encode("utf-8", "replace").decode() for x in s.slices(begin, end).to_pylist()], pa.large_string())
    structure = Structure(inner_texts)
    h = np.concatenate([holder[m], item_holder[i]])
    member = np.arange(len(h)) < len(m)
    above = path.take(_at(h))
    top = pc.equal(above, _EMPTY)
    name = m_names.take(_at(np.concatenate([m, np.zeros(len(i), np.int64)]))) if len(m_names) else pa.array([""] * len(h), pa.large_string())
    index = _index(np.concatenate([np.zeros(len(m), np.int64), spots[i]]))
    head = _joined(above, pc.if_else(pa.array(member), _joined(pc.if_else(top, _EMPTY, _DOT), name), index))
    over = pc.if_else(pa.array(member | s.is_obj[h]), pc.if_else(top, _TOP, above), around.take(_at(h)))
    alone = member & pc.is_in(name, _ARRAY_NAMES).to_numpy(zero_copy_only=False)
    at_place = np.concatenate([np.full(len(m), -1), spots[i]])
    following = None if not structure.valid.any() else (structure, rows[s.row[h]], head.cast(pa.large_string()), over.cast(pa.large_string()), alone, at_place)
    held, held_items = m[structure.valid[: len(m)]], item_at[i[structure.valid[len(m) :]]]
    if items:
        # (nulls are no items but keep their place, and a bracket ends an empty array)
        keep = ~np.isin(data[plain_at], np.frombuffer(b"{[]n", np.uint8)) & ~np.isin(plain_at, held_items)
        at, h = plain_at[keep], plain_holder[keep]
        spots = s.place(h, at)
        out = [
            pa.array(rows[s.row[h]], pa.int64()), around.take(_at(h)).cast(pa.string()), _joined(path.take(_at(h)), _index(spots)).cast(pa.string()),
            pa.array(spots, pa.int32()), s.slices(at, s.value_ends(at)).cast(pa.string()),
        ]
        return out, following

    # members of each object, in order of the holder
    keep = np.ones(len(holder), bool)
    keep[held] = False
    kept = np.flatnonzero(keep)
    # a name that is given twice keeps its last value
    rank = np.array(m_names.dictionary_encode().indices.to_numpy(zero_copy_only=False), np.int64) if len(m_names) else np.zeros(0, np.int64)
    order = kept[np.lexsort((value_at[kept], rank[kept], holder[kept]))] if len(kept) else kept
    if len(order):
        final = np.ones(len(order), bool)
        final[:-1] = (holder[order][1:] != holder[order][:-1]) | (rank[order][1:] != rank[order][:-1])
        order = order[final]
    objects = np.flatnonzero(s.is_obj & ~pc.equal(path, _EMPTY).to_numpy(zero_copy_only=False))
    firsts = np.searchsorted(holder[order], objects)
    lasts = np.searchsorted(holder[order], objects, side="right")
    size = lasts - firsts
    offsets = np.zeros(len(objects) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    take = pa.array(np.repeat(firsts - offsets[:-1], size) + np.arange(offsets[-1]))
    picked = pa.array(order).take(take) if len(order) else pa.array([], pa.int64())
    members = pa.MapArray.from_arrays(
        pa.array(offsets.astype(np.int32)), m_names.take(picked).cast(pa.string()), values.take(picked).cast(pa.string())
    )
    tops = np.where(lone[s.row], 0, spot[s.row])
    shown_ord = np.where(in_arr[objects], place[objects], np.where(lone_obj[objects], 0, np.where(has[objects], -1, tops[objects])))
    out = [
        pa.array(rows[s.row[objects]], pa.int64()), around.take(_at(objects)).cast(pa.string()), path.take(_at(objects)).cast(pa.string()),
        pa.array(shown_ord, pa.int32()), members,
    ]
    return out, following


def objects_of(texts: pa.Array, rows: np.ndarray, items: bool = False) -> Iterator[list[pa.Array]]:
    """Row, parent path, path, place and members of the objects below the tops of the texts, round by round.

    With ``items``, the scalar items of arrays with their JSON text instead.
    """
    n = len(texts)
    plain = lambda value: pa.array([value] * n, pa.large_string())
    todo = (Structure(pc.fill_null(texts.cast(pa.large_string()), "")), rows, plain(""), plain("$"), np.zeros(n, bool), np.full(n, -1))
    while todo is not None:
        out, todo = _round(*todo, items)
        yield out


def nested_objects(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Every JSON object below the top of a payload: ``keep``, ``parent_path``, ``child_path``,
    ``table_path`` (the path without places), ``ord`` (place in the array, or -1) and
    ``members`` (scalars and their JSON text).

    Null, empty and broken payloads give no rows. A payload that holds a string
    holding JSON counts as what the string holds. Duplicated names keep the last value.
    """
    return _nested(df, payload, keep, False)


def scalar_items(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Every scalar item of an array in a payload: ``keep``, ``parent_path`` (of the nearest object),
    ``child_path``, ``ord`` (place in the array), ``value`` and ``table_path``.

    Strings come without their quotes. Null items give no rows but keep their places;
    strings that hold JSON count as what they hold.
    """
    text = F.from_json(F.concat(F.lit('{"v":'), F.col("value"), F.lit("}")), "v string")["v"]
    return _nested(df, payload, keep, True).withColumn("value", text)


def _nested(df: DataFrame, payload: str, keep: list[str], items: bool) -> DataFrame:
    source = df.select(*keep, F.col(payload).alias("_payload"))
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    schema = source.select(
        *keep, null("parent_path", "string"), null("child_path", "string"), null("ord", "int"),
        null("value", "string") if items else null("members", "map<string,string>"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("_payload")
            payloads = batch.column(at)
            for low in range(0, batch.num_rows, 512):
                part = payloads.slice(low, 512)
                for row, *rest in objects_of(part, np.arange(low, low + len(part)), items):
                    kept = [batch.column(i).take(row) for i in range(batch.num_columns) if i != at]
                    yield pa.RecordBatch.from_arrays([*kept, *rest], schema.names)

    table_path = F.regexp_replace("child_path", r"\[[0-9]+\]", "").alias("table_path")
    return source.mapInArrow(run, schema).select("*", table_path)


def child_table(objects: DataFrame, table_path: str, keep: list[str], columns: dict[str, str]) -> DataFrame:
    """One flat table: a column per member (of the given type), with the link to its parent.

    A member of another JSON type gives null; string members come without their quotes.
    """
    text = lambda c: F.from_json(F.concat(F.lit('{"v":'), F.col("members")[c], F.lit("}")), "v string")["v"]
    return objects.where(F.col("table_path") == table_path).select(
        *keep, "parent_path", "child_path", "ord", *[text(c).try_cast(kind).alias(c) for c, kind in columns.items()]
    )
