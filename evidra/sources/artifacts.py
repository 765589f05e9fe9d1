"""JSON artifacts as typed rows: findings, readiness, and whether a folder holds what others need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_REF = "struct<tool:string,ruleId:string,url:string>"
_EVIDENCE = f"array<struct<id:string,path:string,startLine:int,endLine:int,kind:string,excerptHash:string,nodeId:string,symbolId:string,externalRef:{_REF}>>"
_FINDINGS = (
    f"struct<run_id:string,findings:array<struct<id:string,ruleId:string,category:string,severity:string,confidence:double,title:string,summary:string,evidence:{_EVIDENCE},"
    "affectedSymbols:array<string>,affectedEntrypoints:array<string>,tags:array<string>,upstream:struct<tool:string,ruleId:string>,fingerprint:string>>>"
)


def findings(artifacts: DataFrame) -> DataFrame:
    """The findings of artifacts (``path, document``) with the names of the ``findings`` table; documents without findings give none."""
    rows = artifacts.select("path", F.from_json("document", _FINDINGS).alias("d")).select("path", F.col("d.run_id").alias("run_id"), F.posexplode("d.findings").alias("ord", "f"))
    evidence = F.transform("f.evidence", lambda e: F.struct(
        e["id"].alias("id"), e["path"].alias("path"), e["startLine"].alias("start_line"), e["endLine"].alias("end_line"), e["kind"].alias("kind"), e["excerptHash"].alias("excerpt_hash"), e["nodeId"].alias("node_id"),
        e["symbolId"].alias("symbol_id"), F.struct(e["externalRef"]["tool"].alias("tool"), e["externalRef"]["ruleId"].alias("rule_id"), e["externalRef"]["url"].alias("url")).alias("external_ref")))
    return rows.select(
        "path", "run_id", "ord", "f.id", F.col("f.ruleId").alias("rule_id"), "f.category", "f.severity", "f.confidence", "f.title", "f.summary", evidence.alias("evidence"), F.col("f.affectedSymbols").alias("affected_symbols"),
        F.col("f.affectedEntrypoints").alias("affected_entrypoints"), "f.tags", F.struct(F.col("f.upstream.tool").alias("tool"), F.col("f.upstream.ruleId").alias("rule_id")).alias("upstream"), "f.fingerprint",
    )


_READINESS = "struct<run_id:string,status:string,counts:struct<findings:int,critical:int,high:int,risks:int,testSeeds:int>,failedConditions:array<struct<id:string,matchedFindingIds:array<string>>>>"


def readiness(artifacts: DataFrame) -> DataFrame:
    """``path, run_id, status``, the counts, and the failed conditions of readiness artifacts; others are left out."""
    d = F.from_json("document", _READINESS)
    rows = artifacts.select("path", d.alias("d")).where("d.status is not null and d.counts is not null")
    return rows.select("path", "d.run_id", "d.status", "d.counts.*", F.col("d.failedConditions").alias("failed_conditions"))


def evidence_set(artifacts: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: the required files that a folder lacks, sorted, and whether it is complete."""
    have = artifacts.agg(F.collect_set(F.when(F.col("path").isin(*required), F.col("path"))).alias("have"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, required)), "have"))
    return have.select(missing.alias("missing"), (F.size(missing) == 0).alias("complete"))
