"""Operators on the property graph of relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators import components
from evidra.session import saved


def edges(relations: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Distinct edges ``src, dst`` with both ends, normalised; optionally of some kinds only."""
    norm = lambda c: F.lower(F.trim(c))
    rows = relations if kinds is None else relations.where(F.col("kind").isin(kinds))
    return rows.select(norm("from_id").alias("src"), norm("to_id").alias("dst")).where("src != '' and dst != ''").distinct()


def reach(graph: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """``node, depth`` of everything within ``depth`` hops of the seeds, at its least depth.

    Breadth first: each round joins the frontier with the edges and drops what has
    been seen. Rounds are cut by checkpoints, so the plan doesn't grow; an empty
    frontier ends the search.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    step = saved(graph.select(F.col(a).alias("node"), F.col(b).alias("to")).where("node != to"))  # read again in every round
    seen = saved(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for i in range(1, depth + 1):
        # the frontier is distinct and the map side combines, so a hub is one row per edge at most
        found = frontier.select("node").join(step, "node").select(F.col("to").alias("node")).distinct()
        frontier = saved(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(i)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def chains(graph: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed, node, depth``: what each seed reaches, at its least depth, up to ``depth`` hops."""
    step = saved(graph.select(F.col("src").alias("node"), F.col("dst").alias("to")).where("node != to"))
    seen = saved(seeds.select(F.col("node").alias("seed"), "node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for i in range(1, depth + 1):
        found = frontier.select("seed", "node").join(step, "node").select("seed", F.col("to").alias("node")).distinct()
        frontier = saved(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(i)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def neighbours(graph: DataFrame, nodes: DataFrame, reverse: bool = False) -> DataFrame:
    """``node, to``: what each node points to, or with ``reverse`` what points to it."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return nodes.select("node").distinct().join(graph.select(F.col(a).alias("node"), F.col(b).alias("to")), "node").distinct()


def call_paths(graph: DataFrame, seeds: DataFrame, hops: int = 5) -> DataFrame:
    """``seed, node, depth, path``: the shortest way from each seed to all it reaches, as an array of nodes from the seed on.

    Of several shortest ways the least by its nodes is taken. Edges are written once; each round joins the
    frontier with them and keeps what is new.
    """
    step = saved(graph.where("src != dst").select(F.col("src").alias("node"), F.col("dst").alias("to")))
    seen = saved(seeds.select(F.col("node").alias("seed"), "node").distinct().select("seed", "node", F.lit(0).alias("depth"), F.array("node").alias("path")))
    frontier = seen
    for i in range(1, hops + 1):
        found = frontier.join(step, "node").select("seed", F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"))
        found = found.groupBy("seed", "node").agg(F.min("path").alias("path"))
        frontier = saved(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(i).alias("depth"), "path"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0")


def flows(graph: DataFrame, sources: DataFrame, sinks: DataFrame, hops: int = 10) -> DataFrame:
    """``seed, node, depth, path``: shortest ways from each source to each sink that it reaches; a source that is a sink needs a way of its own."""
    return call_paths(graph, sources, hops).join(sinks.select("node").distinct(), "node", "left_semi")


def reaches(graph: DataFrame, seeds: DataFrame, targets: DataFrame, hops: int = 10) -> DataFrame:
    """``node, reaches``: whether each seed is a target or reaches one within ``hops``; searched backwards from the targets, so hubs are met once."""
    found = reach(graph, targets, hops, reverse=True).select("node", F.lit(True).alias("_r"))
    return seeds.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("_r", F.lit(False)).alias("reaches"))


#: So many edges are held by one task at most with the names of their nodes. Results don't depend on it.
TASK_EDGES = 1_000_000
#: So many are held by one task at most when joins have put numbers in the place of names; groups of more are split by rounds of joins first. Results don't depend on it.
NUMBERED_EDGES = 10_000_000


def _core(edges: DataFrame, enough: int, most: int) -> tuple[DataFrame, int]:
    """``edges`` (written already) without nodes that have no edge in or out, and how many: taken away again and again, until ``enough`` or fewer are left or a round takes less than a half (of more than ``most``: less than a twentieth).

    All cycles lie in what is left.
    """
    size = edges.count()
    while size > enough:
        edges = saved(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
        size, before = edges.count(), size
        if size > (0.5 if size <= most else 0.95) * before:
            break
    return edges, size


def _spread(edges: DataFrame, labels: DataFrame, a: str, b: str) -> DataFrame:
    """The greatest label that reaches each node along the edges (from ``a`` to ``b``), in rounds until nothing changes."""
    while True:
        came = edges.join(labels.select(F.col("node").alias(a), F.col("label").alias("_l")), a).groupBy(F.col(b).alias("node")).agg(F.max("_l").alias("_l"))
        joined = labels.join(came, "node", "left")
        labels = saved(joined.select("node", F.greatest("label", "_l").alias("label"), (F.col("_l") > F.col("label")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")


def _numbered(edges: DataFrame, size: int, most: int) -> DataFrame:
    """As ``_in_tasks``, but tasks hold numbers only: names are joined before and after."""
    # a node without an edge out lies on no cycle: it gets no number, and the edges to it fall out
    nodes = saved(edges.select(F.col("src").alias("node")).distinct().select("node", F.monotonically_increasing_id().alias("i")))
    ends = edges.join(nodes.select(F.col("node").alias("src"), F.col("i").alias("a")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("i").alias("b")), "dst")
    ends = ends.repartition(1 + 4 * size // most, "k").select("a", "b").sortWithinPartitions("a")
    found = saved(ends.mapInArrow(components.numbered_groups_of, "i bigint, g bigint"))
    named = nodes.join(found, "i").select("node", "g")
    return named.join(named.groupBy("g").agg(F.max("node").alias("grp"), F.count("*").alias("size")), "g").select("node", "grp", "size")


def _in_tasks(edges: DataFrame, size: int, task_edges: int, most: int) -> DataFrame:
    """``node, grp, size`` of the groups in edges ``src, dst, k``, where no cycle leaves a ``k``: the edges of a ``k`` go to one task."""
    if size > task_edges:
        return _numbered(edges, size, most)
    # four parts for each ``task_edges``: what a part holds besides its largest ``k`` is little
    ends = edges.repartition(1 + 4 * size // task_edges, "k").select(F.col("src").cast("binary"), F.col("dst").cast("binary"))
    found = ends.mapInArrow(components.groups_of, "node binary, grp binary, size bigint")
    return found.select(F.col("node").cast("string"), F.col("grp").cast("string"), "size")


def _groups(edges: DataFrame, task_edges: int, numbered_edges: int) -> DataFrame:
    """``cycle_groups`` of distinct edges without loops, written already."""
    most = max(task_edges, numbered_edges)
    (edges, size), parts = _core(edges.withColumn("k", F.lit(0)), task_edges, most), []
    while size > most:
        sizes = saved(edges.groupBy("k").agg(F.count("*").alias("n")))
        fits = F.col("n") <= most
        small = sizes.where(fits).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if small:
            parts.append(_in_tasks(edges.join(sizes.where(fits).select("k"), "k", "left_semi"), small, task_edges, most))
        if small == size:
            break
        edges = saved(edges.join(sizes.where(~fits).select("k"), "k", "left_semi").select("src", "dst"))
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        start = saved(nodes.select("node", F.col("node").alias("label")))
        down, up = _spread(edges, start, "src", "dst"), _spread(edges, start, "dst", "src")
        both = saved(down.join(up.withColumnRenamed("label", "other"), "node"))
        done = both.where("label = other").select("node", F.col("label").alias("grp"))
        parts.append(done.join(done.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1"), "grp").select("node", "grp", "size"))
        rest = both.where("label != other").select("node", F.struct("label", "other").alias("k"))
        inner = edges.join(rest.select(F.col("node").alias("src"), "k"), "src").join(rest.select(F.col("node").alias("dst"), F.col("k").alias("_b")), "dst")
        edges, size = _core(saved(inner.where("k = _b").select("src", "dst", "k")), task_edges, most)
    else:
        parts.append(_in_tasks(edges, size, task_edges, most))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _proper(graph: DataFrame) -> DataFrame:
    """The distinct edges between different nodes, written once."""
    return saved(graph.where("src != dst").select("src", "dst").distinct())


def cycle_groups(graph: DataFrame, task_edges: int = TASK_EDGES, numbered_edges: int = NUMBERED_EDGES) -> DataFrame:
    """``node, grp, size``: nodes that lie on a cycle of two or more, of any length, and the strongly connected group of each, named by its greatest node.

    Up to ``task_edges`` edges are searched by one task. Of more, edges outside all cycles are taken away first; up to
    ``numbered_edges`` of the rest are searched by one task as numbers. Of more than that, each round
    gives every node the greatest node that reaches it and the greatest that it reaches; nodes for which both are one are a
    finished group, and edges between nodes that differ can't lie on a cycle. What is left falls into parts by the two, and
    parts that fit go to a task each. All rounds are joins cut by checkpoints.
    """
    return _groups(_proper(graph), task_edges, numbered_edges)


def cycles(graph: DataFrame, longest: int) -> DataFrame:
    """``path, length``: every elementary cycle of at most ``longest`` nodes, once, from its least node on.

    Ways grow only inside strongly connected groups and over nodes greater than their first. The number of longer
    cycles of a group has no useful bound: ``cycle_groups`` tells what lies on cycles of any length.
    """
    edges = _proper(graph)
    groups = saved(_groups(edges, TASK_EDGES, NUMBERED_EDGES))
    inside = edges.join(groups.select(F.col("node").alias("src"), F.col("grp").alias("_a")), "src").join(
        groups.select(F.col("node").alias("dst"), F.col("grp").alias("_b")), "dst"
    ).where("_a = _b").select("src", "dst")
    step = saved(inside)
    ways = saved(step.where("src < dst").select(F.col("src").alias("first"), F.array("src", "dst").alias("path"), F.col("dst").alias("node")))
    found = None
    for length in range(2, longest + 1):
        closed = ways.join(step.select(F.col("src").alias("node"), F.col("dst").alias("first")), ["node", "first"], "left_semi").select("path", F.lit(length).alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if length == longest or ways.isEmpty():
            break
        grown = ways.join(step.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node").where((F.col("to") > F.col("first")) & ~F.array_contains("path", F.col("to")))
        ways = saved(grown.select("first", F.concat("path", F.array("to")).alias("path"), F.col("to").alias("node")))
    return found


def dataflow(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """``src, dst, kind, confidence``: data flows against calls and along references, between symbols that are known.

    A call gives a flow from the callee to the caller (0.7), a reference one from its target (0.6), an access one to it (0.8).
    """
    norm = lambda c: F.lower(F.trim(c))
    ends = relations.where(F.col("kind").isin("calls", "references", "accesses")).select(norm("from_id").alias("a"), norm("to_id").alias("b"), "kind").distinct()
    known = symbols.select(norm("id").alias("node")).where("node != ''").distinct()
    ends = ends.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
    forward = F.col("kind") == "accesses"
    confidence = F.when(F.col("kind") == "calls", 0.7).when(forward, 0.8).otherwise(0.6)
    return ends.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), "kind", confidence.alias("confidence"))


def cross_file_flows(flows_: DataFrame, symbols: DataFrame) -> DataFrame:
    """Flows whose ends lie in different files, with the files: ``src, dst, from_file, to_file``."""
    norm = lambda c: F.lower(F.trim(c))
    place = symbols.select(norm("id").alias("node"), norm("file_id").alias("file")).where("node != '' and file != ''").groupBy("node").agg(F.min("file").alias("file"))
    rows = flows_.select("src", "dst").distinct().join(place.select(F.col("node").alias("src"), F.col("file").alias("from_file")), "src")
    return rows.join(place.select(F.col("node").alias("dst"), F.col("file").alias("to_file")), "dst").where("from_file != to_file").select("src", "dst", "from_file", "to_file")
