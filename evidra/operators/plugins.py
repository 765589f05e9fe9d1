"""Rules given by users as Python functions over files: run by Spark's tasks, isolated per file, and checked before they count."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidra.functions.scalars import SEVERITIES

#: Limits of the contract (fixed values): findings of a plugin for a file, pieces of evidence of a finding.
MOST_FINDINGS, MOST_EVIDENCE = 1000, 10
_FIELDS = ("rule_id", "severity", "title")


@dataclass(frozen=True)
class Plugin:
    """A rule: ``evaluate`` gives findings (``rule_id, severity, title, lines``) for the path and content of a file."""

    name: str
    evaluate: Callable[[str, str], Iterable[dict]]
    languages: tuple[str, ...] = ()
    seconds: float = 60.0
    severities: tuple[str, ...] = field(default=SEVERITIES)


def problems_of(finding: object, severities: tuple[str, ...] = SEVERITIES) -> list[str]:
    """What breaks the contract in a finding."""
    if not isinstance(finding, dict):
        return ["finding is no mapping"]
    out = [f"missing {n}" for n in _FIELDS if not isinstance(finding.get(n), str) or not finding[n]]
    if isinstance(finding.get("severity"), str) and finding["severity"] not in severities:
        out.append("unknown severity")
    lines = finding.get("lines", [])
    if not isinstance(lines, list) or any(not isinstance(x, int) or x < 1 for x in lines):
        out.append("lines are no line numbers")
    elif len(lines) > MOST_EVIDENCE:
        out.append("too much evidence")
    return out


def _of_file(plugin: Plugin, path: str, content: str) -> tuple[list[dict], list[str]]:
    """Findings of one file and diagnostics; a failure, a breach of the contract or of the time concerns this file alone."""
    begin, good, bad = time.monotonic(), [], []
    try:
        for number, finding in enumerate(plugin.evaluate(path, content)):
            if time.monotonic() - begin > plugin.seconds:
                return good, [*bad, "timeout"]
            if number >= MOST_FINDINGS:
                return good, [*bad, "too many findings"]
            wrong = problems_of(finding, plugin.severities)
            bad.extend(wrong)
            if not wrong:
                good.append(finding)
    except Exception as failure:  # noqa: BLE001 (a plugin may fail in any way)
        bad.append(f"failed: {type(failure).__name__}")
    return good, bad


_OUT = "id string, plugin string, rule_id string, severity string, title string, lines array<int>, diagnostic string"


def run(plugins: list[Plugin], files: DataFrame) -> DataFrame:
    """Findings and diagnostics of all plugins over files (``id, path, language, content``): a row each, diagnostics have only ``diagnostic``.

    Files without content are passed over; a plugin for some languages sees only these. Tasks hold one batch of files at a time.
    """

    def batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "plugin", "rule_id", "severity", "title", "lines", "diagnostic"]
        kinds = [pa.string()] * 5 + [pa.list_(pa.int32()), pa.string()]
        for some in batches:
            rows = []
            for key, path, language, content in zip(*(c.to_pylist() for c in some.columns), strict=True):
                for plugin in plugins if content else ():
                    if plugin.languages and language not in plugin.languages:
                        continue
                    good, bad = _of_file(plugin, path or "", content)
                    rows += [(key, plugin.name, f["rule_id"], f["severity"], f["title"], f.get("lines", []), None) for f in good]
                    rows += [(key, plugin.name, None, None, None, None, b) for b in bad]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return files.select("id", "path", "language", "content").mapInArrow(batch, _OUT)


def run_fixture(spark: SparkSession, plugin: Plugin, files: dict[str, str]) -> list[dict]:
    """The findings of a rule on a few files given by path: what tests of rules need."""
    df = spark.createDataFrame([(p, p, p.rsplit(".", 1)[-1], c) for p, c in files.items()], "id string, path string, language string, content string")
    rows = run([plugin], df).collect()
    return [{"path": r.id, "rule_id": r.rule_id, "severity": r.severity, "title": r.title, "lines": r.lines} for r in rows if r.diagnostic is None]


def exit_code(status: str) -> int:
    """0 for a run that may go on, else 1."""
    return 0 if status in ("passed", "passed_with_risk") else 1
