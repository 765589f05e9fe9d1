"""Small configuration files: read on the driver, given as rows or expressions. Ownership files come as tables of lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _scalar(text: str) -> object:
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text[:1] in ("[", "{"):
        try:
            return json.loads(text)
        except ValueError:
            return [_scalar(x) for x in text[1:-1].split(",") if x.strip()] if text[0] == "[" else text
    if text in ("", "null", "~"):
        return None
    if text in ("true", "false"):
        return text == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def yaml_like(text: str) -> object:
    """JSON, or the plain part of YAML: nested mappings and lists by indentation, scalars, quotes, comments."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    lines = []
    for raw in text.replace("\r\n", "\n").split("\n"):
        line = re.sub(r"(^|\s)#(?=(?:[^'\"]|'[^']*'|\"[^\"]*\")*$).*$", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, depth: int) -> tuple[object, int]:
        out: object = [] if lines[at][1].startswith("-") else {}
        while at < len(lines) and lines[at][0] == depth:
            body = lines[at][1]
            if isinstance(out, list):
                if not re.match(r"-(\s|$)", body):
                    break
                rest = body[1:].lstrip()
                inner = depth + len(body) - len(rest)
                if re.match(r"[\w.-]+:(\s|$)", rest):
                    lines[at] = (inner, rest)
                    value, at = block(at, inner)
                else:
                    value, at = _scalar(rest), at + 1
                out.append(value)
                continue
            m = re.match(r"(?:\"([^\"]*)\"|'([^']*)'|([^:]+?)):(?:\s+(.*))?$", body)
            at += 1
            if not m:
                continue
            key = m[1] or m[2] or m[3]
            if m[4]:
                out[key] = _scalar(m[4])
            elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("-")):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


#: Members of a policy and their types (fixed values of the data model).
POLICY = {"version": str, "policy_id": str, "blocking": dict, "confidence": dict, "suppression": dict, "partial": dict, "exit": dict, "dsl": dict}


def policy(text: str) -> tuple[dict, list[str]]:
    """A policy and what is wrong with it: no mapping, missing ``version`` or ``blocking``, members of another type, unknown members."""
    read = yaml_like(text)
    if not isinstance(read, dict):
        return {}, ["policy is no mapping"]
    errors = [f"missing {name}" for name in ("version", "blocking") if name not in read]
    errors += [f"{k} is no {POLICY[k].__name__}" for k, v in read.items() if k in POLICY and v is not None and not isinstance(v, POLICY[k]) and not (POLICY[k] is str and isinstance(v, int | float))]
    errors += [f"unknown member {k}" for k in read if k not in POLICY]
    return read, errors


def suppressions(text: str) -> list[dict]:
    """The entries of a suppression file, with plain names: ``rule_id, path, reason, expiry, author, class``."""
    read = yaml_like(text)
    entries = read.get("suppressions", []) if isinstance(read, dict) else read if isinstance(read, list) else []
    get = lambda e, *names: next((e[n] for n in names if e.get(n) is not None), None)
    return [
        {"rule_id": get(e, "rule_id", "ruleId"), "path": get(e, "path"), "reason": get(e, "reason"), "expiry": None if get(e, "expiry") is None else str(get(e, "expiry")), "author": get(e, "author"), "class": get(e, "class")}
        for e in entries or [] if isinstance(e, dict)
    ]


def risks(spark: SparkSession, text: str) -> DataFrame:
    """The risks of a register (YAML or JSON) as rows."""
    read = yaml_like(text)
    rows = [(str(r.get("id")), r.get("title"), r.get("severity"), r.get("likelihood"), [str(x) for x in r.get("sourceFindingIds") or []], i) for i, r in enumerate((read.get("risks") if isinstance(read, dict) else None) or [])]
    return spark.createDataFrame(rows, "id string, title string, severity string, likelihood string, sources array<string>, ord int")


#: Where ownership files lie, in order (fixed values).
OWNER_FILES = (".github/CODEOWNERS", "CODEOWNERS", "docs/CODEOWNERS")


def owner_rules(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules (``repo_root, line, pattern, owners``) and diagnostics (``repo_root, line, code``) of ownership files (``repo_root, path, content``).

    Of several files of a repo the first of ``OWNER_FILES`` counts. Comments and blank lines are none; negated patterns and lines without owners are
    diagnostics.
    """
    place = F.array_position(F.array(*map(F.lit, OWNER_FILES)), F.col("path"))
    first = files.where(place > 0).groupBy("repo_root").agg(F.min_by("content", place).alias("content"))
    lines = first.select("repo_root", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("line", "text"))
    parts = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    rows = lines.select("repo_root", (F.col("line") + 1).alias("line"), parts.alias("p")).where((F.col("p")[0] != "") & ~F.col("p")[0].startswith("#"))
    rows = rows.select("repo_root", "line", F.col("p")[0].alias("pattern"), F.slice("p", F.lit(2), F.size("p")).alias("owners"))
    code = F.when(F.col("pattern").startswith("!"), "UNSUPPORTED_PATTERN").when(F.size("owners") == 0, "EMPTY_OWNERS")
    rows = rows.withColumn("code", code)
    return rows.where("code is null").drop("code"), rows.where("code is not null").select("repo_root", "line", "code")
