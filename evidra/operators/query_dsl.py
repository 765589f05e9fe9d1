"""The query language ``<domain> where <field> <op> <value>`` as column predicates."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.functions.scalars import SEVERITIES, severity_rank

#: The form of a query (fixed syntax).
_FORM = re.compile(r"^\s*(\w+)\s+where\s+([\w.]+)\s*(<=|>=|!=|=|<|>)\s*(.+?)\s*$", re.I | re.S)


@dataclass(frozen=True)
class Query:
    """A parsed query."""

    domain: str
    field: str
    op: str
    value: str


def parse(text: str) -> Query:
    """Parse a query; one layer of quotes around the value is removed."""
    m = _FORM.match(text)
    if not m:
        raise ValueError(f"not a query: {text!r}")
    value = m[4]
    if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
        value = value[1:-1]
    return Query(m[1].lower(), m[2], m[3], value)


def field(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The column behind a dotted path; digits index arrays from 0. A missing field is null."""
    schema: T.DataType = df.schema
    out: Column | None = None
    for part in path.split("."):
        if isinstance(schema, T.ArrayType) and part.isdigit():
            out, schema = F.get(out, F.lit(int(part))), schema.elementType
        elif isinstance(schema, T.StructType) and part in schema.fieldNames():
            out = F.col(part) if out is None else out[part]
            schema = schema[part].dataType
        else:
            return F.lit(None).cast("string"), T.StringType()
    return out, schema


def _compare(op: str, a: Column, b: Column) -> Column:
    return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def predicate(df: DataFrame, query: Query) -> Column:
    """Two-valued: booleans know only ``=`` and ``!=``, severities compare by rank, then numbers, then text.

    A missing or null value differs from every value, and no other comparison holds for it.
    """
    col, kind = field(df, query.field)
    op, value = query.op, query.value
    if isinstance(kind, T.BooleanType) or value.lower() in ("true", "false"):
        test = _compare(op, col.cast("string"), F.lit(value.lower())) if op in ("=", "!=") else F.lit(False)
    elif isinstance(kind, T.StringType) and value.lower() in SEVERITIES:
        rank = severity_rank(col)
        test = F.when(rank.isNotNull(), _compare(op, rank, F.lit(SEVERITIES.index(value.lower())))).otherwise(
            _compare(op, col, F.lit(value)) if op in ("=", "!=") else F.lit(False)
        )
    else:
        try:
            number = float(value)
        except ValueError:
            number = None
        text = _compare(op, col.cast("string"), F.lit(value)) if op in ("=", "!=") else F.lit(False)
        if number is None:
            test = text
        else:
            left = col.cast("double") if isinstance(kind, T.NumericType) else col.cast("string").try_cast("double")
            test = F.when(left.isNotNull(), _compare(op, left, F.lit(number))).otherwise(text)
    return F.coalesce(test, F.lit(op == "!="))


def run(df: DataFrame, text: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows of ``df`` that answer the query, with ``locator``: their place among the answers of each ``by`` group."""
    return located(df.where(predicate(df, parse(text))), by, order)


def located(hits: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``hits`` with ``locator``: the place of each row in its ``by`` group, from 0."""
    return hits.withColumn("locator", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def _json_paths(field_: str) -> tuple[str, str]:
    """A dotted path in JSON, with digits as places of arrays and as names."""
    parts = field_.split(".")
    name = lambda p: "['" + p.replace("'", "") + "']"
    return "$" + "".join(f"[{p}]" if p.isdigit() else name(p) for p in parts), "$" + "".join(map(name, parts))


def json_value(document: Column, field_: str) -> Column:
    """The value at a dotted path of a VARIANT: SQL null if it is missing, a JSON null if it is one."""
    places, names = _json_paths(field_)
    return F.coalesce(F.try_variant_get(document, places, "variant"), F.try_variant_get(document, names, "variant"))


def json_predicate(value: Column, query: Query) -> Column:
    """Two-valued comparison of a JSON value, missing or null ones included.

    If either side is a boolean, only ``=`` and ``!=`` can hold, and only a boolean equals one. Severities compare by rank. Then numbers:
    texts that are numbers count as such, an empty text and a JSON null as 0, a missing value as none. Else ``=`` and ``!=`` compare
    texts, where null and missing are the empty text.
    """
    kind = F.schema_of_variant(value)
    text = F.try_variant_get(value, "$", "string")
    missing, null = value.isNull(), F.coalesce(F.is_variant_null(value), F.lit(False))
    is_text, op = kind == "STRING", query.op
    equal = {"=": True, "!=": False}.get(op)
    if query.value in ("true", "false"):
        same = F.coalesce((kind == "BOOLEAN") & (text == query.value), F.lit(False))
        return same if op == "=" else ~same if op == "!=" else F.lit(False)
    plain = F.coalesce(F.when(null, F.lit("")).otherwise(text), F.lit(""))
    out = F.lit(False) if equal is None else (plain == query.value if equal else plain != query.value)
    try:
        number = float(query.value)
    except ValueError:
        number = None
    if number is not None:
        trimmed = F.trim(text)
        actual = F.when(missing, None).when(null, 0.0).when(is_text & (trimmed == ""), 0.0).when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), None).otherwise(trimmed.try_cast("double"))
        out = F.when(actual.isNotNull(), _compare(op, actual, F.lit(number))).otherwise(out)
    if query.value.lower() in SEVERITIES:
        rank = F.when(is_text, severity_rank(text))
        out = F.when(rank.isNotNull(), _compare(op, rank, F.lit(SEVERITIES.index(query.value.lower())))).otherwise(out)
    return F.when(kind == "BOOLEAN", F.lit(op == "!=")).otherwise(F.coalesce(out, F.lit(False)))


def artifact_matches(artifacts: DataFrame, text: str) -> DataFrame:
    """``id, type, source_artifact, source_hash, locator, value`` of the answers in JSON artifacts (``file, hash, document``: VARIANT).

    Domains: ``artifact`` asks each document, ``finding`` each item of its ``findings`` (the locator counts answers, from 0 in each
    document), ``baseline`` its member of that name if it is an object or a list.
    """
    query = parse(text)
    base = [F.col("file").alias("source_artifact"), F.col("hash").alias("source_hash")]
    shown = lambda v: F.to_json(v).alias("value")
    if query.domain == "artifact":
        rows = artifacts.withColumn("_v", json_value(F.col("document"), query.field)).where(json_predicate(F.col("_v"), query))
        return rows.select(F.concat(F.lit("artifact:"), "file").alias("id"), F.lit("artifact").alias("type"), *base, F.col("file").alias("locator"), shown(F.col("_v")))
    if query.domain == "baseline":
        own = F.try_variant_get("document", "$.baseline", "variant")
        rows = artifacts.where(F.schema_of_variant(own).rlike("^(OBJECT|ARRAY)")).withColumn("_v", json_value(own, query.field)).where(json_predicate(F.col("_v"), query))
        return rows.select(F.concat(F.lit("baseline:"), "file").alias("id"), F.lit("baseline").alias("type"), *base, F.concat("file", F.lit("#baseline")).alias("locator"), shown(F.col("_v")))
    if query.domain != "finding":
        raise ValueError(f"unknown domain: {query.domain}")
    items = F.filter(
        F.transform(F.try_variant_get("document", "$.findings", "array<variant>"), lambda f: F.struct(f.alias("f"), json_value(f, query.field).alias("v"))), lambda x: json_predicate(x["v"], query)
    )
    rows = artifacts.select(*base, F.posexplode(items).alias("place", "x"))
    place = F.col("place").cast("string")
    own_id = F.try_variant_get("x.f", "$.id", "variant")
    named = F.when(F.schema_of_variant(own_id) == "STRING", F.try_variant_get(own_id, "$", "string")).otherwise(F.concat(F.lit("finding:"), place))
    return rows.select(named.alias("id"), F.lit("finding").alias("type"), "source_artifact", "source_hash", F.concat("source_artifact", F.lit("#findings/"), place).alias("locator"), shown(F.col("x.v")))
