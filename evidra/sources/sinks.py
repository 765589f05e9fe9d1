"""Sinks: findings and reports as JSON, YAML and markdown. Rows are rendered by the tasks; only artifacts of one row pass the driver."""

from __future__ import annotations

import json
import os
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.functions.classify import markdown_cell


def write_json(rows: DataFrame, folder: str, partition: str | None = None) -> None:
    """Rows as lines of JSON below a folder, if wanted a folder per value of a column; the committer of Spark makes it all or nothing."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(partition) if partition else writer).json(folder)


def write_document(rows: DataFrame, path: str) -> dict:
    """An artifact of one row as a document at ``path``, written beside it and moved there, so that no reader sees half of it."""
    (row,) = rows.limit(2).toJSON().collect()
    document = json.loads(row)
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        json.dump(document, out, indent=2, ensure_ascii=False)
        out.write("\n")
    os.replace(temporary, path)
    return document


def markdown_row(*cells: Column | str) -> Column:
    """A row of a markdown table; nulls are empty cells."""
    text = [markdown_cell(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))) for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *text), F.lit(" |"))


def _quoted(col: Column) -> Column:
    return F.when(col.isNull(), "null").otherwise(F.to_json(F.struct(col.cast("string").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(col.cast("string").alias("v")))) - 6))


def yaml_item(fields: dict[str, Column]) -> Column:
    """An item of a YAML list with the given members; texts are quoted as in JSON, which YAML reads alike, nulls are ``null``, lists have an item a line."""
    parts = []
    for i, (name, col) in enumerate(fields.items()):
        lead = "- " if i == 0 else "  "
        parts.append(F.concat(F.lit(f"{lead}{name}: "), _quoted(col)))
    return F.concat_ws("\n", *parts)


def write_bundle(artifacts: DataFrame, path: str) -> int:
    """A ZIP with the artifacts (``name, content``) and a ``manifest.json`` of their hashes and sizes; gives the number of artifacts.

    Rows are streamed to the one file partition by partition, so a bundle may be larger than the memory of the driver.
    """
    import hashlib
    import zipfile

    manifest = []
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for row in artifacts.select("name", F.coalesce("content", F.lit("")).cast("binary").alias("content")).orderBy("name").toLocalIterator():
            data = bytes(row.content)
            out.writestr(row.name, data)
            manifest.append({"name": row.name, "sha256": hashlib.sha256(data).hexdigest(), "n_bytes": len(data)})
        out.writestr("manifest.json", json.dumps(manifest, indent=2))
    return len(manifest)
