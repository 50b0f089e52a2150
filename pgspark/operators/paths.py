"""Variable-length paths and traversals over an edge table.

``edges`` has columns (src, dst, eid). Path operators run a bounded number of
joins, one per hop, and keep bag semantics: every walk is a row. Traversals that
only ask what is reachable keep a visited set and stop when no node is new; each
round is written to the shared folder, so plans stay short and a lost executor
costs one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgspark.plans.rounds import materialise

MODES = ("walk", "trail", "acyclic", "simple")


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions; a self-loop stays one edge."""
    back = edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "eid")
    return edges.select("src", "dst", "eid").unionAll(back)


#: Hops after which an unbounded quantifier ends.
UNBOUNDED = 64


def var_expand(starts: DataFrame, edges: DataFrame, low: int, high: int | None, mode: str = "walk", target: Column | None = None) -> DataFrame:
    """(start, node, depth, nodes, edges): all paths of ``low`` to ``high`` hops from ``starts.start``.

    Modes: walk (anything may repeat), trail (no edge repeats), acyclic (no node
    repeats), simple (only the start may come again, and ends the path). A
    ``target`` condition on ``node`` filters what is returned, not what is walked.
    Without ``high`` (the quantifiers ``*`` and ``+``) paths grow until none is
    left or to ``UNBOUNDED`` hops, and each hop is written to the shared folder.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"), F.col("eid").alias("_eid"))
    node_type, edge_type = starts.schema["start"].dataType.simpleString(), edges.schema["eid"].dataType.simpleString()
    level = starts.select("start", F.col("start").cast(node_type).alias("node"), F.lit(0).alias("depth"), F.array("start").alias("nodes"), F.array().cast(f"array<{edge_type}>").alias("edges"))
    out = level if low == 0 else None
    for depth in range(1, (UNBOUNDED if high is None else high) + 1):
        grown = level.join(step, "node")
        if mode == "trail":
            grown = grown.where(~F.array_contains("edges", F.col("_eid")))
        elif mode == "acyclic":
            grown = grown.where(~F.array_contains("nodes", F.col("_next")))
        elif mode == "simple":
            grown = grown.where(~F.array_contains("nodes", F.col("_next")) | (F.col("_next") == F.col("start")))
            grown = grown.where((F.col("depth") == 0) | (F.col("node") != F.col("start")))  # closed paths end
        level = grown.select("start", F.col("_next").alias("node"), F.lit(depth).alias("depth"), F.array_append("nodes", F.col("_next")).alias("nodes"), F.array_append("edges", F.col("_eid")).alias("edges"))
        if high is None:
            level = materialise(level, "var-expand")
            if level.isEmpty():
                break
        if depth >= low:
            out = level if out is None else out.unionAll(level)
    out = level.limit(0) if out is None else out
    return out if target is None else out.where(target)


def shortest(paths: DataFrame, every: bool, per: tuple[str, ...] = ("start",)) -> DataFrame:
    """Of the paths of each group all shortest ones, or one (the smallest by its nodes and edges)."""
    w = Window.partitionBy(*per)
    if every:
        return paths.withColumn("_r", F.rank().over(w.orderBy("depth"))).where("_r = 1").drop("_r")
    return paths.withColumn("_r", F.row_number().over(w.orderBy("depth", "nodes", "edges"))).where("_r = 1").drop("_r")


def bfs(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """(start, node, depth): every node reached from each start with its least depth; starts have depth 0."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")).distinct()
    seen = materialise(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "bfs")
    frontier, depth = seen, 0
    while hops is None or depth < hops:
        depth += 1
        reached = frontier.join(step, "node").select("start", F.col("_next").alias("node")).distinct()
        frontier = materialise(reached.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    return seen


def descendants(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """As ``bfs`` without the starts themselves."""
    return bfs(starts, edges, hops).where("node <> start")


def ancestors(starts: DataFrame, edges: DataFrame, hops: int | None = None) -> DataFrame:
    """Nodes from which each start is reached."""
    return descendants(starts, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), hops)


def is_trail(edges: Column) -> Column:
    return F.size(F.array_distinct(edges)) == F.size(edges)


def is_acyclic(nodes: Column) -> Column:
    return F.size(F.array_distinct(nodes)) == F.size(nodes)


def is_simple(nodes: Column) -> Column:
    """No node repeats, except that the first may come again as the last."""
    inner = F.slice(nodes, F.lit(1), F.greatest(F.size(nodes) - 1, F.lit(0)))
    closed = (F.size(nodes) > 1) & (F.get(nodes, F.lit(0)) == F.get(nodes, F.size(nodes) - 1))
    return is_acyclic(nodes) | (closed & is_acyclic(inner))
