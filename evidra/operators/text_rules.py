"""Rules on the lines of source files: windows, vetoes, pattern tables, marker regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_lines(content: Column | str) -> Column:
    """The lines of a text whatever its line ends, as one array; null stays null."""
    return F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")


def lines_of(files: DataFrame) -> DataFrame:
    """``id, path, language, line_no, line, around``: lines with the array of all lines (one copy per file row until exploded)."""
    parts = F.split(F.regexp_replace(F.coalesce("content", F.lit("")), "\r\n?", "\n"), "\n")
    return files.select("id", "path", "language", F.posexplode(parts).alias("pos", "line")).withColumn("line_no", F.col("pos") + 1).drop("pos")


def hits_with_veto(files: DataFrame, pattern: str, veto: str, before: int, after: int) -> DataFrame:
    """``id, line_no``: lines that match ``pattern`` unless ``veto`` matches within the lines around.

    The lines of a file stay in one array: the window is a slice of it, no shuffle is needed.
    """
    lines = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")
    numbered = files.where(F.col("content").rlike(pattern)).select("id", lines.alias("lines"))
    hit = lambda x, i: F.when(x.rlike(pattern), i + 1)
    rows = numbered.select("id", "lines", F.explode(F.array_compact(F.transform("lines", hit))).alias("line_no"))
    low = F.greatest(F.col("line_no") - before, F.lit(1))
    window = F.slice("lines", low, F.col("line_no") + after - low + 1)
    return rows.where(~F.exists(window, lambda x: x.rlike(veto))).select("id", "line_no")


def first_marker(line: Column, markers: list[str]) -> Column:
    """The first marker of the list that stands as a word in a line, or null."""
    out = F.lit(None).cast("string")
    for marker in reversed(markers):
        out = F.when(line.rlike(rf"\b{marker}\b"), marker).otherwise(out)
    return out


def without_default(files: DataFrame, pattern: str, default: str) -> DataFrame:
    """``id, line_no``: lines with a pattern where neither the line nor the next one has a default. The last line has an empty next one."""
    lines = split_lines("content")
    rows = files.where(F.col("content").rlike(pattern)).select("id", lines.alias("lines"))
    miss = lambda x, i: F.when(x.rlike(pattern) & ~x.rlike(default) & ~F.coalesce(F.get("lines", i + 1), F.lit("")).rlike(default), i + 1)
    return rows.select("id", F.explode(F.array_compact(F.transform("lines", miss))).alias("line_no"))


def numbered_lines(files: DataFrame) -> DataFrame:
    """``id, line_no, line``, each file once."""
    rows = files.where("content is not null").select("id", split_lines("content").alias("lines")).dropDuplicates(["id"])
    return rows.select("id", F.posexplode("lines").alias("pos", "line")).select("id", (F.col("pos") + 1).alias("line_no"), "line")


def regions(files: DataFrame, begin: str, end: str) -> DataFrame:
    """``id, line_no, line`` of the lines between markers: behind a line with ``begin`` up to before the next with ``end``; markers aren't part of it."""
    state = F.when(F.col("line").rlike(end), 0).when(F.col("line").rlike(begin), 1)
    inside = F.last(state, ignorenulls=True).over(W.partitionBy("id").orderBy("line_no"))
    return numbered_lines(files).withColumn("_s", state).withColumn("_in", inside).where("_s is null and _in = 1").select("id", "line_no", "line")


def blocks(files: DataFrame, begin: str) -> DataFrame:
    """``id, block, first_line, n_lines`` of the blocks that lines with ``begin`` start; lines before the first belong to none."""
    number = F.sum(F.col("line").rlike(begin).cast("int")).over(W.partitionBy("id").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    rows = numbered_lines(files).withColumn("block", number).where("block > 0")
    return rows.groupBy("id", "block").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"))


def branch_blocks(files: DataFrame, opener: str) -> DataFrame:
    """``id, start_line, end_line``: lines with ``opener`` that open a brace, up to the line after which as many braces are open as before them.

    Depth is a running count of braces by line; the end is looked for in the array of depths of the file. A block that is never closed ends with the file.
    """
    lines = split_lines("content")
    count = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    rows = files.where(F.col("content").rlike(opener)).select("id", lines.alias("lines")).dropDuplicates(["id"])
    numbered = rows.select("id", F.posexplode("lines").alias("i", "line"))
    depth = F.sum(count(F.col("line"), "{") - count(F.col("line"), "}")).over(W.partitionBy("id").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    deep = numbered.withColumn("depth", depth)
    opens = (F.col("line").rlike(opener)) & F.contains(F.col("line"), F.lit("{"))
    per = deep.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "depth"))), lambda x: x["depth"]).alias("depths"))
    before = F.coalesce(F.lag("depth").over(W.partitionBy("id").orderBy("i")), F.lit(0))
    starts = deep.withColumn("before", before).where(opens & (F.col("depth") > F.col("before"))).select("id", "i", "before")
    joined = starts.join(per, "id")
    rest = F.slice("depths", F.col("i") + 2, F.size("depths"))
    stop = F.array_position(F.transform(rest, lambda d: (d <= F.col("before")).cast("int")), 1)
    end = F.when(stop > 0, F.col("i") + 1 + stop).otherwise(F.size("depths"))
    return joined.select("id", (F.col("i") + 1).cast("int").alias("start_line"), end.cast("int").alias("end_line"))


#: Kinds of data-flow nodes and the line patterns they come from: the first group is the name (fixed values).
FLOW_LINES = {
    "assign": r"^\s*(?:const|let|var)?\s*([A-Za-z_]\w*)\s*=\s*[^=>]", "return": r"^\s*return\s+([A-Za-z_][\w.]*)", "branch": r"^\s*(?:\}\s*else\s+)?if\s*\(?\s*([A-Za-z_][\w.]*)", "member": r"\b([A-Za-z_]\w*)\.[A-Za-z_]\w*\s*=\s*[^=]",
}


def flow_nodes(files: DataFrame) -> DataFrame:
    """``id, kind, name, line_no, node``: assignments, returned values, branch conditions and members set, with an id over file, kind, name and line."""
    found = files.where("content != ''").select("id", F.explode(F.concat(*[_named(k, p) for k, p in FLOW_LINES.items()])).alias("n")).select("id", "n.kind", "n.name", "n.line_no").distinct()
    key = F.concat_ws(":", "id", "kind", "name", F.col("line_no").cast("string"))
    return found.withColumn("node", F.substring(F.sha2(key, 256), 1, 16))


def _named(kind: str, pattern: str) -> Column:
    made = F.transform(split_lines("content"), lambda x, i: F.struct(F.lit(kind).alias("kind"), F.regexp_extract(x, pattern, 1).alias("name"), (i + 1).alias("line_no")))
    return F.filter(made, lambda s: s["name"] != "")


def backlinks(lines: DataFrame, labels: dict[str, str]) -> DataFrame:
    """``id, line_no, target``: lines (``id, line_no, line``) that hold a label (label -> target); labels are configuration, one condition each."""
    hits = F.array_compact(F.array(*[F.when(F.contains(F.col("line"), F.lit(label)), target) for label, target in labels.items()]))
    return lines.select("id", "line_no", F.explode(hits).alias("target"))
