"""Folders of files as tables: bounded scans, JSON artifacts, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.session import running_total

#: Folders that a scan leaves out (fixed values); so are folders that begin with one of ``IGNORED_BEGINS``.
IGNORED = (
    ".git", "node_modules", "dist", "coverage", ".cache", "__pycache__", ".svn", ".hg", ".venv", "venv", ".env", "env", ".browser-use-env", ".test-temp", ".real-repo-temp", "htmlcov", ".nyc_output", "build", "out", ".out",
    "vendor", "vendors", "third_party", "third-party", "_build", "site",
)
IGNORED_BEGINS = (".test-temp",)
#: Extensions of files that are analysed (fixed values).
TARGETS = ("ts", "tsx", "js", "jsx", "py", "rb", "go", "rs", "java", "php", "cs", "cpp", "cc", "cxx", "hpp", "hxx", "mjs", "cjs", "json", "yaml", "yml", "md")
#: Limits of a scan (fixed values): files, depth, bytes of a file, bytes in all.
LIMITS = {"max_files": 100_000, "max_depth": 64, "max_file_bytes": 10 * 1024 * 1024, "max_total_bytes": 2 * 1024**3}


def is_ignored(path: Column | str) -> Column:
    """Whether some segment of a path is left out of scans."""
    begins = lambda x: F.exists(F.array(*map(F.lit, IGNORED_BEGINS)), lambda b: x.startswith(b))
    return F.exists(F.split(path, "/"), lambda x: x.isin(*IGNORED) | begins(x))


def is_target(path: Column | str) -> Column:
    """Whether a file is analysed: by its extension, but for type declarations."""
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(r"\.(" + "|".join(TARGETS) + r")$") & ~path.endswith(".d.ts")


def scan(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """``path`` (below the root), ``size_bytes``, ``modified_at`` and ``content`` of all files but those in ignored folders.

    The content is read only by plans that use it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^" + "".join("\\" + c if not c.isalnum() else c for c in base) + "/", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    if not ignored:
        return rows
    return rows.where(~(is_ignored("path") if ignored is IGNORED else F.exists(F.split("path", "/"), lambda x: x.isin(*ignored))))


def bounded(
    files: DataFrame, max_file_bytes: int = LIMITS["max_file_bytes"], max_total_bytes: int = LIMITS["max_total_bytes"], max_files: int = LIMITS["max_files"], max_depth: int = LIMITS["max_depth"],
    by: list[str] | None = None, deadline: Column | None = None,
) -> DataFrame:
    """``files`` with ``skipped``: why a bounded scan leaves a file out, or null.

    Files are taken in the order of their paths (within each ``by`` group). Too deep files and those behind the deadline
    (``deadline``: a condition of a row) aren't visited; then the number of visited files is limited, too large ones are
    passed over, and the bytes of the others are limited. Both limits are running totals over ranges of
    the order, so one group of any size is split.
    """
    by = by or []
    alone = F.when(F.coalesce(deadline, F.lit(False)) if deadline is not None else F.lit(False), "SCAN_DEADLINE_EXCEEDED").when(F.size(F.split("path", "/")) - 1 > max_depth, "MAX_DEPTH_EXCEEDED")
    rows = files.withColumn("_alone", alone)
    rows = running_total(rows, by, ["path"], F.when(F.col("_alone").isNull(), 1).otherwise(0), "_n")
    over = F.when(F.col("_alone").isNull() & (F.col("_n") > max_files), "MAX_FILES_EXCEEDED").when(F.col("_alone").isNull() & (F.col("size_bytes") > max_file_bytes), "MAX_FILE_SIZE_EXCEEDED")
    rows = rows.withColumn("_alone", F.coalesce("_alone", over))
    rows = running_total(rows, by, ["path"], F.when(F.col("_alone").isNull(), F.coalesce("size_bytes", F.lit(0))).otherwise(0), "_bytes")
    reason = F.coalesce("_alone", F.when(F.col("_bytes") > max_total_bytes, "MAX_TOTAL_BYTES_EXCEEDED"))
    return rows.withColumn("skipped", reason).drop("_alone", "_n", "_bytes")


def walk_summary(scanned: DataFrame, by: list[str]) -> DataFrame:
    """Per scan: ``partial_walk``, sorted ``reasons``, ``visited_files``, ``accepted_bytes`` and ``skipped_files`` of what ``bounded`` gives."""
    unseen = F.coalesce(F.col("skipped").isin("SCAN_DEADLINE_EXCEEDED", "MAX_DEPTH_EXCEEDED", "MAX_FILES_EXCEEDED"), F.lit(False))
    return scanned.groupBy(*by).agg(
        (F.count("skipped") > 0).alias("partial_walk"), F.array_sort(F.collect_set("skipped")).alias("reasons"), F.count_if(~unseen).alias("visited_files"),
        F.coalesce(F.sum(F.when(F.col("skipped").isNull(), F.col("size_bytes"))), F.lit(0)).alias("accepted_bytes"), F.count("skipped").alias("skipped_files"),
    )


def json_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """``path, sha256, document`` of the JSON files below a folder; files that aren't JSON are left out."""
    files = scan(spark, root, ()).where(F.col("path").endswith(".json"))
    text = F.decode("content", "UTF-8")
    return files.select("path", F.sha2("content", 256).alias("sha256"), text.alias("document")).where(F.try_parse_json("document").isNotNull())


def discover_runs(spark: SparkSession, history: str, artifact: str = "findings.json") -> DataFrame:
    """``run, generated_at`` of the run folders that hold the artifact, newest first; a broken artifact has a null time."""
    files = scan(spark, history, ()).where(F.col("path").rlike(r"^[^/]+/" + artifact.replace(".", r"\.") + "$"))
    at = F.try_to_timestamp(F.get_json_object(F.decode("content", "UTF-8"), "$.generated_at"))
    return files.select(F.split_part("path", F.lit("/"), F.lit(1)).alias("run"), at.alias("generated_at")).orderBy(F.desc_nulls_last("generated_at"), "run")


#: Where the baseline of a folder is looked for, in order (fixed values).
BASELINES = ("findings.json", "baseline-findings.json", "release-readiness.json", "baseline-release-readiness.json")


def baseline(artifacts: DataFrame) -> DataFrame:
    """The first of ``BASELINES`` (``path, sha256, document`` of ``json_artifacts``) that holds findings, or names a findings file of the folder that does, with ``owner`` and ``expires_at``."""
    place = F.array_position(F.array(*map(F.lit, BASELINES)), F.col("path"))
    rows = artifacts.withColumn("_n", place)
    direct = rows.where("_n > 0").where(F.get_json_object("document", "$.findings").startswith("["))
    own = direct.select("path", "sha256", "document", "_n", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("string").alias("expires_at"))
    linked = rows.where("_n > 0").select(F.get_json_object("document", "$.artifactRefs.findings").alias("_to"), "_n", F.get_json_object("document", "$.baseline.owner").alias("owner"), F.get_json_object("document", "$.baseline.expiresAt").alias("expires_at"))
    files = artifacts.where(F.get_json_object("document", "$.findings").startswith("[")).select("path", "sha256", "document")
    found = linked.join(files, F.regexp_replace("_to", r"^\./", "") == files["path"]).select("path", "sha256", "document", "_n", "owner", "expires_at")
    return own.unionByName(found).orderBy("_n").limit(1).drop("_n")
