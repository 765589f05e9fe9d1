"""Light parsing of SQL definitions: tokens and schema operations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"(?P<comment>--[^\n]*|/\*[\s\S]*?(?:\*/|$))|(?P<string>'(?:[^']|'')*(?:'|$))|(?P<name>\"[^\"]*\"|`[^`]*`|\[[^\]]*\]|[A-Za-z_][\w$]*(?:\.[A-Za-z_\"`][\w$\"`]*)*)"
    r"|(?P<number>\d+(?:\.\d+)?)|(?P<op>[-+*/%=<>!|:]+|[(),;.?@$])|(?P<ws>\s+)"
)


def tokens(sql: str, keep_all: bool = False) -> list[tuple]:
    """Kind and text of each token but blanks and comments; with ``keep_all`` of every one, unknown characters too, and its line."""
    out, at, line = [], 0, 1
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        kind, text = (m.lastgroup, m[0]) if m else ("unknown", sql[at])
        if keep_all:
            out.append((kind, text, line))
            line += text.count("\n")
        elif kind not in ("ws", "comment", "unknown"):
            out.append((kind, text))
        at += len(text)
    return out


def plain_name(name: str) -> str:
    """A name without quotes."""
    return name.strip("\"`[]").replace('"', "").replace("`", "")


_plain = plain_name


def _behind_if(upper: list[str], at: int) -> int:
    if upper[at : at + 3] == ["IF", "NOT", "EXISTS"]:
        return at + 3
    return at + 2 if upper[at : at + 2] == ["IF", "EXISTS"] else at


def operations(sql: str) -> list[tuple[str, str | None, str | None, str | None, bool, bool]]:
    """Type, table, object, new type, and whether not null and with a default, of each schema operation; ``if [not] exists`` is skipped."""
    found: list[tuple] = []
    statement: list[tuple[str, str]] = []
    for token in [*tokens(sql), ("op", ";")]:
        if token[1] != ";" or token[0] != "op":
            statement.append(token)
            continue
        words, statement = statement, []
        upper = [t.upper() for _, t in words]

        def name(at: int, words: list[tuple[str, str]] = words) -> str | None:
            return plain_name(words[at][1]) if at < len(words) else None

        add = lambda kind, table, thing: found.append((kind, table, thing, None, False, False))
        if upper[:1] == ["CREATE"] and "TABLE" in upper[1:3]:
            add("create_table", name(_behind_if(upper, upper.index("TABLE") + 1)), None)
        elif upper[:1] == ["CREATE"] and "INDEX" in upper[1:3]:
            if "ON" in upper:
                add("add_index", name(upper.index("ON") + 1), name(_behind_if(upper, upper.index("INDEX") + 1)))
        elif upper[:2] == ["DROP", "TABLE"]:
            add("drop_table", name(_behind_if(upper, 2)), None)
        elif upper[:2] == ["DROP", "INDEX"]:
            add("drop_index", None, name(_behind_if(upper, 2)))
        elif upper[:2] == ["DROP", "CONSTRAINT"]:
            add("drop_constraint", None, name(_behind_if(upper, 2)))
        elif upper[:2] == ["ALTER", "TABLE"]:
            at = _behind_if(upper, 2)
            table, depth, part = name(at), 0, []
            for word in [*words[at + 1 :], ("op", ",")]:
                depth += (word[1] == "(") - (word[1] == ")")
                if word[1] != "," or depth:
                    part.append(word)
                    continue
                if action := _action(part):
                    found.append((action[0], table, *action[1:]))
                part = []
    return [x for x in found if x[1] or x[2]]


def _action(part: list[tuple[str, str]]) -> tuple | None:
    upper = [t.upper() for _, t in part]
    if not upper:
        return None
    verb, rest = upper[0], upper[1:]
    noun = rest[0] if rest and rest[0] in ("COLUMN", "CONSTRAINT", "INDEX") else "COLUMN"
    at = _behind_if(upper, 1 + bool(rest and rest[0] == noun))
    thing = plain_name(part[at][1]) if at < len(part) else None
    if verb in ("ADD", "DROP"):
        strict = any(a == "NOT" and b == "NULL" for a, b in zip(upper, upper[1:], strict=False))
        return f"{verb.lower()}_{noun.lower()}", thing, None, strict, "DEFAULT" in upper
    if verb in ("MODIFY", "ALTER"):
        to = upper.index("TYPE") + 1 if "TYPE" in upper else at + 1 if verb == "MODIFY" else len(part)
        return "modify_column", thing, part[to][1].lower() if to < len(part) else None, False, "DEFAULT" in upper
    return ("alter_table", thing, None, False, False) if verb == "RENAME" else None


def inventory(scripts: DataFrame) -> DataFrame:
    """``path, seq, operation, table_name, object_name`` of the scripts (``path, content``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (p, i, *op[:3])
                for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for i, op in enumerate(operations(t or ""))
            ]
            names = ["path", "seq", "operation", "table_name", "object_name"]
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return scripts.select("path", "content").mapInArrow(run, "path string, seq int, operation string, table_name string, object_name string")
