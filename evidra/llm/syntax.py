"""Source files that don't parse as the language of their extension."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.grammars import LANGUAGES, check

#: Extensions that are checked, as a pattern on the path; the case of an extension doesn't matter.
EXTENSION = r"(?i)\.(" + "|".join(LANGUAGES) + r")$"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds, lines, found = [], [], []
        for ext, text in zip(batch.column("ext").to_pylist(), batch.column("content").to_pylist(), strict=True):
            language = LANGUAGES[ext]
            text = text.replace("\r\n", "\n").replace("\r", "\n")
            verdict, at, (classes, starts) = check(language, text)
            start = starts[at] if at < len(starts) else len(text)
            kinds.append(verdict)
            lines.append(None if verdict == "ok" else text.count("\n", 0, start) + 1)
            found.append(None if verdict != "error" else classes[at])
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(kinds, pa.string()), pa.array(lines, pa.int32()), pa.array(found, pa.string())],
            ["id", "verdict", "fail_line", "fail_token"],
        )


def parse_verdicts(files: DataFrame) -> DataFrame:
    """``id, verdict, fail_line, fail_token`` of every file that has content and a checked extension.

    ``verdict`` is ``ok``, ``error`` (the derivative by ``fail_token`` is empty) or
    ``truncated`` (the derivative at the end lacks the empty word). Redelivered rows
    count once; null and empty contents and other extensions give no row. Needs
    the columns ``id, path, content``; others are ignored.
    """
    rows = files.where((F.col("content") != "") & F.col("path").rlike(EXTENSION)).select(
        "id", F.lower(F.regexp_extract("path", EXTENSION, 1)).alias("ext"), "content"
    )
    return rows.mapInArrow(_verdicts, "id string, verdict string, fail_line int, fail_token string").distinct()


def parse_rates(files: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per repo and language: checked files, files that don't parse, and their rate."""
    once = files.select("id", "repo_root", "language").dropDuplicates(["id"])
    bad = F.count(F.when(F.col("verdict") != "ok", 1))
    return verdicts.join(once, "id").groupBy("repo_root", "language").agg(
        F.count("verdict").alias("n_files"), bad.alias("n_broken"), F.count(F.when(F.col("verdict") == "truncated", 1)).alias("n_truncated"),
        F.round(bad / F.count("verdict"), 4).alias("rate"),
    )
