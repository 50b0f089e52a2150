"""Graph algorithms over ``nodes(id)`` and ``edges(src, dst[, weight])`` as loops of joins.

Each round is written to the shared folder. Nothing but a count or a largest
change comes to the driver, except where a docstring says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pgspark.plans.rounds import dealt, discard, materialise


def project(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A projection: the nodes, and the edges whose two ends are among them."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return ids, kept


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree): parallel edges count."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    joined = nodes.select("id").join(sums, "id", "left")
    o, i = F.coalesce("o", F.lit(0)), F.coalesce("i", F.lit(0))
    return joined.select("id", o.alias("out_degree"), i.alias("in_degree"), (o + i).alias("degree"))


def wcc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component_id): the smallest id connected with each node, directions ignored.

    Every round sends the smallest label to the neighbours and then jumps to the
    label's own label, so that long chains shrink fast.
    """
    both = materialise(edges.select("src", "dst").unionAll(edges.select("dst", "src")).where("src <> dst").distinct(), "wcc-edges")
    labels, held = nodes.select("id", F.col("id").alias("c")), None
    while True:
        offered = both.join(labels, both["src"] == labels["id"]).groupBy("dst").agg(F.min("c").alias("m"))
        lower = labels.join(offered, labels["id"] == offered["dst"], "left").select("id", "c", F.least("c", F.coalesce("m", "c")).alias("n"))
        jump = lower.select(F.col("id").alias("_j"), F.col("n").alias("_n"))
        new = materialise(lower.join(jump, lower["n"] == jump["_j"], "left").select("id", "c", F.least("n", F.coalesce("_n", "n")).alias("n")), "wcc")
        changed = not new.where("n <> c").isEmpty()
        discard(held)
        labels, held = new.select("id", F.col("n").alias("c")), new
        if not changed:
            discard(both)
            return labels.select(F.col("id").alias("node_id"), F.col("c").alias("component_id"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6) -> DataFrame:
    """(node_id, score): dangling mass spreads evenly; parallel edges count; stops below the tolerance."""
    ids = nodes.select("id").distinct()
    n = ids.count()
    if n == 0:
        return ids.select(F.col("id").alias("node_id"), F.lit(0.0).alias("score"))
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("k"))
    links = materialise(edges.join(out, "src").select("src", "dst", "k"), "pagerank-links")
    base = materialise(ids.join(out.select(F.col("src").alias("id"), "k"), "id", "left"), "pagerank-nodes")
    score = base.select("id", F.col("k").isNull().alias("dangling"), F.lit(1.0 / n).alias("s"))
    held, lost = None, base.where("k IS NULL").count() / n
    for _ in range(rounds):
        sent = links.join(score, links["src"] == score["id"]).groupBy("dst").agg(F.sum(F.col("s") / F.col("k")).alias("r"))
        rank = F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("r", F.lit(0.0))
        new = materialise(score.join(sent, score["id"] == sent["dst"], "left").select("id", "dangling", F.col("s").alias("old"), rank.alias("s")), "pagerank")
        change, lost = new.agg(F.max(F.abs(F.col("s") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("s"))), F.lit(0.0))).first()
        discard(held)
        score, held = new.drop("old"), new
        if change < tolerance:
            break
    return score.select(F.col("id").alias("node_id"), F.col("s").alias("score"))


def _distances(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node_id, best<distance, hops>): least distances, and of equal ones the fewest hops."""
    step = edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"))
    start = F.struct(F.lit(0.0).alias("distance"), F.lit(0).alias("hops")).alias("best")
    best = materialise(sources.select("source", F.col("source").alias("node_id"), start).distinct(), "sssp")
    frontier = best
    while True:
        grown = F.min(F.struct((F.col("best.distance") + F.col("weight")).alias("distance"), (F.col("best.hops") + 1).alias("hops"))).alias("d")
        offered = frontier.join(step, frontier["node_id"] == step["src"]).groupBy("source", "dst").agg(grown)
        known = best.select(F.col("source").alias("_s"), F.col("node_id").alias("_n"), F.col("best").alias("_d"))
        shorter = offered.join(known, (F.col("source") == F.col("_s")) & (F.col("dst") == F.col("_n")), "left").where("_d IS NULL OR d < _d")
        last, frontier = frontier, materialise(shorter.select("source", F.col("dst").alias("node_id"), F.col("d").alias("best")), "sssp")
        if frontier.isEmpty():
            return best
        old, best = best, materialise(best.unionAll(frontier).groupBy("source", "node_id").agg(F.min("best").alias("best")), "sssp")
        discard(old, last)


def sssp(sources: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, node_id, distance): least sums of non-negative weights from each ``sources.source``; unreachable nodes are absent."""
    return _distances(sources, edges).select("source", "node_id", F.col("best.distance").alias("distance"))


def apsp(nodes: DataFrame, edges: DataFrame, most_nodes: int = 10_000) -> DataFrame:
    """(source, target, distance) of all reachable pairs without self; refused above ``most_nodes``, as its result is quadratic."""
    if nodes.count() > most_nodes:
        raise ValueError(f"more than {most_nodes} nodes")
    found = sssp(nodes.select(F.col("id").alias("source")), edges)
    return found.where("source <> node_id").select("source", F.col("node_id").alias("target"), "distance")


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """(node_id, cost, index): one shortest path; ``cost`` is the total on every row; no rows if unreachable.

    Every reached node names the node before it (of equals the smallest id).
    The way back is followed by doubling: each round joins the table of jumps
    with itself, so a path of n hops takes log2(n) rounds.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    best = materialise(_distances(spark.createDataFrame([(source,)], f"source {kind}"), edges).select("node_id", "best"), "path")
    step = edges.groupBy("src", "dst").agg(F.min("weight").cast("double").alias("weight"))
    before = step.join(best.select(F.col("node_id").alias("src"), F.col("best").alias("b")), "src").join(best.select(F.col("node_id").alias("dst"), F.col("best").alias("e")), "dst")
    before = before.where("b.distance + weight = e.distance AND b.hops + 1 = e.hops").groupBy("dst").agg(F.min("src").alias("at"))
    jumps = materialise(before.select(F.col("dst").alias("node"), "at"), "path-jumps")
    path = materialise(best.where(F.col("node_id") == F.lit(target)).select(F.col("node_id").alias("node")), "path-nodes")
    while True:
        more = path.join(jumps, "node").select(F.col("at").alias("node"))
        longer = materialise(path.unionAll(more), "path-nodes")
        ended = more.isEmpty()
        discard(path)
        path = longer
        if ended:
            break
        far = jumps.select(F.col("node").alias("at"), F.col("at").alias("_to"))
        old, jumps = jumps, materialise(jumps.join(far, "at").select("node", F.col("_to").alias("at")), "path-jumps")
        discard(old)
    discard(jumps)
    total = best.where(F.col("node_id") == F.lit(target)).select(F.col("best.distance").alias("cost"))
    return path.join(best, path["node"] == best["node_id"]).crossJoin(F.broadcast(total)).select("node_id", "cost", F.col("best.hops").alias("index"))  # one row


def triangles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, total): triangles at each node of the undirected simple graph, zeros included.

    Every edge points from the end with the smaller degree (ties by id) to the
    other, so no node has more out-edges than the square root of twice the edges.
    Along each edge whose far end has out-edges too, the lists of both ends are
    intersected; no wedge becomes a row.
    """
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    simple = materialise(dealt(ends, ends.count(), "a", "b").distinct(), "triangle-pairs")
    ends = simple.select(F.col("a").alias("id")).unionAll(simple.select(F.col("b").alias("id")))
    deg = materialise(ends.groupBy("id").agg(F.count(F.lit(1)).alias("d")), "triangle-degrees")
    ranked = simple.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pointed = materialise(ranked.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v")), "triangle-edges")
    going = pointed.select(F.col("u").alias("v"), F.lit(True).alias("goes")).distinct()
    marked = pointed.join(going, "v", "left")
    lists = materialise(marked.groupBy("u").agg(F.collect_list("v").alias("out"), F.collect_list(F.when(F.col("goes"), F.col("v"))).alias("via")), "triangle-lists")
    first = lists.where("size(out) > 1").select("u", "out", F.explode("via").alias("v"))
    closed = first.join(lists.select(F.col("u").alias("v"), F.col("out").alias("beyond")), "v").select("u", "v", F.array_intersect("out", "beyond").alias("w")).where("size(w) > 0")
    one = lambda v, n: F.struct(v.alias("id"), n.cast("long").alias("n"))
    members = F.concat(F.array(one(F.col("u"), F.size("w")), one(F.col("v"), F.size("w"))), F.transform("w", lambda x: one(x, F.lit(1))))
    counts = closed.select(F.explode(members).alias("m")).groupBy("m.id").agg(F.sum("m.n").alias("t"))
    return nodes.select("id").join(counts, "id", "left").select(F.col("id").alias("node_id"), F.coalesce("t", F.lit(0)).alias("total"))


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, level): the longest chain of edges that ends at each node; a cycle is an error."""
    left, rest = nodes.select("id").distinct(), materialise(edges.select("src", "dst").distinct(), "topo-edges")
    out, level = None, 0
    while not left.isEmpty():
        free = left.join(rest.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
        free = materialise(free.withColumn("level", F.lit(level)), "topo")
        if free.isEmpty():
            raise ValueError("the graph has a cycle")
        out = free if out is None else out.unionAll(free)
        left = materialise(left.join(free, "id", "left_anti"), "topo-left")
        rest = materialise(rest.join(free.select(F.col("id").alias("src")), "src", "left_anti"), "topo-edges")
        level += 1
    out = nodes.select("id").limit(0).withColumn("level", F.lit(0)) if out is None else out
    return out.select(F.col("id").alias("node_id"), "level")


def _ranked(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with ``rank``, counted from 0 over all of them in the order of the keys: counts of ranges, then places within each."""
    ranges = materialise(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    offsets = materialise(counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset")), "range-offsets")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    return ranges.withColumn("_place", place).join(offsets, "part").withColumn("rank", F.col("offset") + F.col("_place")).drop("part", "offset", "_place")


def topo_sort(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, position): the order of a queue that takes free nodes by id and lets each free its successors by id; a cycle is an error.

    The queue empties level after level, and within a level nodes stand in the
    order of their last predecessor's position, then of their ids.
    """
    levels = materialise(topo_levels(nodes, edges), "topo-levels")
    last = levels.agg(F.max("level")).first()[0]
    done, offset = None, 0
    for k in range(0 if last is None else last + 1):
        own = levels.where(F.col("level") == k).select(F.col("node_id").alias("id"))
        if done is None:
            rows = own.withColumn("after", F.lit(0).cast("long"))
        else:
            into = edges.select("src", F.col("dst").alias("id")).join(own, "id").join(done.select(F.col("node_id").alias("src"), "position"), "src")
            rows = into.groupBy("id").agg(F.max("position").alias("after"))
        placed = materialise(_ranked(rows, "after", "id").select(F.col("id").alias("node_id"), (F.col("rank") + offset).alias("position")), "topo-positions")
        offset += placed.count()
        done = placed if done is None else done.unionAll(placed)
    return done if done is not None else levels.select("node_id", F.lit(0).cast("long").alias("position"))


class Projections:
    """Named projections of a session: ``project`` keeps one, ``drop`` forgets it."""

    def __init__(self):
        self.held: dict[str, tuple[DataFrame, DataFrame]] = {}

    def project(self, name: str, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
        self.held[name] = project(nodes, edges)
        return self.held[name]

    def drop(self, name: str) -> bool:
        return self.held.pop(name, None) is not None

    def list(self, spark: SparkSession) -> DataFrame:
        """(name, node_count, edge_count)."""
        rows = [(name, n.count(), e.count()) for name, (n, e) in sorted(self.held.items())]
        return spark.createDataFrame(rows, "name string, node_count long, edge_count long")


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component_id): strongly connected components, named by their smallest node.

    Nodes that no edge enters or none leaves are components of their own and go
    first. Then rounds of colouring: the smallest id flows forward to a fixed
    point, then from each colour's own root backward within the colour; what is
    reached is that root's component and leaves the graph.
    """
    left = materialise(nodes.select("id").distinct(), "scc-nodes")
    links = materialise(edges.select("src", "dst").where("src <> dst").distinct(), "scc-edges")
    done = None
    while not left.isEmpty():
        inner = links.select(F.col("src").alias("id")).intersect(links.select(F.col("dst").alias("id")))
        alone = materialise(left.join(inner, "id", "left_anti").select("id", F.col("id").alias("c")), "scc-alone")
        if not alone.isEmpty():
            done = alone if done is None else done.unionAll(alone)
            left, links = _without(left, links, alone)
            continue
        colour = _flow(left.select("id", F.col("id").alias("c")), links)
        same = links.join(colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c"))
        found = materialise(colour.where("id = c"), "scc-found")
        fresh = found
        while not fresh.isEmpty():
            back = fresh.select(F.col("id").alias("dst"), "c").join(same, ["dst", "c"]).select(F.col("src").alias("id"), "c").distinct()
            fresh = materialise(back.join(found, ["id", "c"], "left_anti"), "scc-found")
            found = found.unionAll(fresh)
        found = materialise(found, "scc-part")
        done = found if done is None else done.unionAll(found)
        left, links = _without(left, links, found)
    if done is None:
        done = nodes.select("id", F.col("id").alias("c")).limit(0)
    return done.select(F.col("id").alias("node_id"), F.col("c").alias("component_id"))


def _without(left: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    ids = gone.select("id")
    kept = links.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return materialise(left.join(ids, "id", "left_anti"), "scc-nodes"), materialise(kept.select("src", "dst"), "scc-edges")


def _flow(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The smallest label that reaches each node along the links."""
    while True:
        offered = links.join(labels, links["src"] == labels["id"]).groupBy("dst").agg(F.min("c").alias("m"))
        new = materialise(labels.join(offered, labels["id"] == offered["dst"], "left").select("id", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")), "flow")
        if new.where("old <> c").isEmpty():
            return new.select("id", "c")
        labels = new.select("id", "c")


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node_id, community_id): synchronous propagation of the most frequent neighbour label, ties to the smallest.

    All nodes change at once, so results differ from an implementation that
    updates one node after another; both end in communities of the same kind.
    """
    both = materialise(edges.select("src", "dst").unionAll(edges.select("dst", "src")), "lpa-edges")
    rows = both.count()
    labels = nodes.select("id", F.col("id").alias("c"))
    for _ in range(rounds):
        cast = both.join(labels, both["src"] == labels["id"]).select("dst", "c")
        votes = dealt(cast, rows, "dst", "c").groupBy("dst", "c").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("dst").agg(F.max(F.struct(F.col("n"), -F.col("c"))).alias("b")).select("dst", (-F.col("b.col2")).alias("m"))
        new = materialise(labels.join(best, labels["id"] == best["dst"], "left").select("id", F.col("c").alias("old"), F.coalesce("m", "c").alias("c")), "lpa")
        stable = new.where("old <> c").isEmpty()
        labels = new.select("id", "c")
        if stable:
            break
    return labels.select(F.col("id").alias("node_id"), F.col("c").alias("community_id"))


def betweenness(nodes: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node_id, score): Brandes' sums over ``sources(id)`` (all nodes by default), directed, unweighted, unnormalised.

    Forward levels count shortest paths from all sources at once; dependencies
    flow back level by level. State is one row for each source and node reached.
    """
    ids = nodes.select("id").distinct()
    step = materialise(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("k")), "between-edges")
    frontier = materialise((ids if sources is None else sources).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")), "between")
    seen, levels = frontier, [frontier]
    while True:
        reached = frontier.join(step, frontier["v"] == step["src"]).groupBy("s", F.col("dst").alias("v")).agg(F.sum(F.col("paths") * F.col("k")).alias("paths"))
        frontier = materialise(reached.join(seen.select("s", "v"), ["s", "v"], "left_anti").select("s", "v", F.lit(len(levels)).alias("d"), "paths"), "between")
        if frontier.isEmpty():
            break
        levels.append(frontier)
        seen = seen.unionAll(frontier)
    below, total = None, None
    for level in reversed(levels):
        if below is None:
            own = level.select("s", "v", "paths", F.lit(0.0).alias("dep"))
        else:
            w = below.select("s", F.col("v").alias("w"), ((1 + F.col("dep")) / F.col("paths")).alias("share"))
            back = level.join(step, level["v"] == step["src"]).join(w, (level["s"] == w["s"]) & (step["dst"] == w["w"])).groupBy(level["s"], level["v"]).agg(F.sum(F.col("paths") * F.col("k") * F.col("share")).alias("dep"))
            own = level.join(back, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("dep", F.lit(0.0)).alias("dep"))
        below = materialise(own, "between-back")
        part = below.where("s <> v").select("v", "dep")
        total = part if total is None else total.unionAll(part)
    sums = total.groupBy("v").agg(F.sum("dep").alias("score"))
    return ids.join(sums, ids["id"] == sums["v"], "left").select(F.col("id").alias("node_id"), F.coalesce("score", F.lit(0.0)).alias("score"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    ids = nodes.select("id")
    src = edges.join(ids, edges["src"] == ids["id"], "left_anti")
    return src.unionAll(edges.join(ids, edges["dst"] == ids["id"], "left_anti")).distinct()


def duplicates(edges: DataFrame, *by: str) -> DataFrame:
    """Groups of edges that are equal in all of ``by``, with their number."""
    return edges.groupBy(*by).agg(F.count(F.lit(1)).alias("total")).where("total > 1")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.select("id").join(ends, "id", "left_anti")


def _forest(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(undirected pairs a < b with their number k, breadth-first forest of (v, parent p, depth d), its depth)."""
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    pairs = materialise(pairs, "forest-pairs")
    both = materialise(pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(pairs.select("b", "a")), "forest-both")
    roots = wcc(nodes, edges).where("node_id = component_id").select(F.col("node_id").alias("v"))
    frontier = materialise(roots.select("v", F.lit(None).cast("long").alias("p"), F.lit(0).alias("d")), "forest")
    tree, depth = frontier, 0
    while True:
        depth += 1
        next_ = both.join(frontier.select(F.col("v").alias("x")), "x").groupBy("y").agg(F.min("x").alias("p")).select(F.col("y").alias("v"), "p", F.lit(depth).alias("d"))
        frontier = materialise(next_.join(tree.select("v"), "v", "left_anti"), "forest")
        if frontier.isEmpty():
            break
        tree = tree.unionAll(frontier)
    return pairs, materialise(tree, "forest"), depth


def _in_tree(tree: DataFrame) -> DataFrame:
    return tree.where("p IS NOT NULL").select(F.least("v", "p").alias("a"), F.greatest("v", "p").alias("b"), F.lit(True).alias("t"))


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id): undirected edges whose removal disconnects their ends; parallel edges are never bridges.

    Every non-tree edge of a breadth-first forest gets 64 pseudo-random bits. A
    tree edge's bits are the exclusive or of all that touch the subtree below it,
    summed level by level; they are zero exactly if no non-tree edge leaves the
    subtree (up to a chance of 2^-64 for each edge).
    """
    pairs, tree, depth = _forest(nodes, edges)
    # A second parallel edge of a tree edge is a non-tree edge.
    rest = pairs.join(_in_tree(tree), ["a", "b"], "left").where("t IS NULL OR k > 1").select("a", "b", F.xxhash64("a", "b", F.lit("bridge")).alias("r"))
    own = rest.select(F.col("a").alias("v"), "r").unionAll(rest.select("b", "r")).groupBy("v").agg(F.bit_xor("r").alias("r"))
    level = materialise(tree.join(own, "v", "left").select("v", "p", "d", F.coalesce("r", F.lit(0).cast("long")).alias("r")), "bridge-own")
    below, found = None, None
    for d in range(depth - 1, 0, -1):
        now = level.where(F.col("d") == d)
        if below is not None:
            now = now.select("v", "p", "r").unionAll(below.select(F.col("p").alias("v"), F.lit(None).cast("long").alias("p"), "r")).groupBy("v").agg(F.max("p").alias("p"), F.bit_xor("r").alias("r"))
        below = materialise(now.select("v", "p", "r"), "bridge-up")
        part = below.where("r = 0").select(F.least("v", "p").alias("source_id"), F.greatest("v", "p").alias("target_id"))
        found = part if found is None else found.unionAll(part)
    return found if found is not None else pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id")).limit(0)


def _before_siblings(rows: DataFrame) -> DataFrame:
    """``rows(v, p, size)`` with ``before``: the sizes of the smaller children of the same parent.

    Sums run over ranges of all rows in the order of (p, v), so a parent with a
    third of all nodes is spread over as many ranges as its children fill.
    """
    ranges = materialise(rows.repartitionByRange("p", "v").withColumn("part", F.spark_partition_id()), "sibling-ranges")
    sums = ranges.groupBy("part").agg(F.sum("size").alias("s"))  # a row for each range
    offsets = materialise(sums.select("part", (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("offset")), "sibling-offsets")
    within = F.sum("size").over(Window.partitionBy("part").orderBy("p", "v"))
    run = ranges.withColumn("r", within - F.col("size")).join(offsets, "part").select("v", "p", "size", (F.col("r") + F.col("offset")).alias("r"))
    run = materialise(run, "sibling-sums")
    first = run.groupBy("p").agg(F.min("r").alias("least"))
    return run.join(first, "p").select("v", "p", "size", (F.col("r") - F.col("least")).alias("before"))


def articulation_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id): nodes whose removal disconnects their component.

    Blocks after Tarjan and Vishkin over a breadth-first forest: subtree sizes go
    up and preorder numbers down the levels, then each subtree's least and
    largest number among the ends of its non-tree edges goes up. Tree edges (named
    by their lower ends) of one block become connected, and a node whose tree
    edges lie in several blocks is an articulation point.
    """
    pairs, tree, depth = _forest(nodes, edges)
    levels: list[DataFrame] = [None] * depth
    below = None
    for d in range(depth - 1, -1, -1):
        now = tree.where(F.col("d") == d).select("v", "p")
        if below is None:
            now = now.withColumn("size", F.lit(1).cast("long"))
        else:
            inner = below.groupBy("p").agg(F.sum("size").alias("inner")).withColumnRenamed("p", "v")
            now = now.join(inner, "v", "left").select("v", "p", (1 + F.coalesce("inner", F.lit(0))).alias("size"))
        below = levels[d] = materialise(now, "block-sizes")
    numbered = levels[0].select("v", "p", "size", F.lit(0).cast("long").alias("pre"))  # each tree has numbers of its own
    placed = [numbered]
    for d in range(1, depth):
        up = placed[-1].select(F.col("v").alias("p"), F.col("pre").alias("pp"))
        placed.append(materialise(_before_siblings(levels[d]).join(up, "p").select("v", "p", "size", (F.col("pp") + 1 + F.col("before")).alias("pre")), "block-numbers"))
    number = placed[0]
    for part in placed[1:]:
        number = number.unionAll(part)
    number = materialise(number, "block-numbers")
    rest = pairs.join(_in_tree(tree), ["a", "b"], "left").where("t IS NULL").select("a", "b")
    ends = lambda c: number.select(F.col("v").alias(c), F.col("pre").alias(f"pre_{c}"), F.col("size").alias(f"size_{c}"))
    rest = materialise(rest.join(ends("a"), "a").join(ends("b"), "b"), "block-rest")
    reach = rest.select(F.col("a").alias("v"), F.col("pre_b").alias("r")).unionAll(rest.select("b", "pre_a"))
    own = number.select("v", F.col("pre").alias("r")).unionAll(reach).groupBy("v").agg(F.min("r").alias("low"), F.max("r").alias("high"))
    own = materialise(tree.join(own, "v").select("v", "p", "d", "low", "high"), "block-own")
    up, reaches = None, None
    for d in range(depth - 1, 0, -1):
        now = own.where(F.col("d") == d).select("v", "p", "low", "high")
        if up is not None:
            now = now.unionAll(up.select(F.col("p").alias("v"), F.lit(None).cast("long").alias("p"), "low", "high")).groupBy("v").agg(F.max("p").alias("p"), F.min("low").alias("low"), F.max("high").alias("high"))
        up = materialise(now, "block-reach")
        reaches = up if reaches is None else reaches.unionAll(up)
    if reaches is None:
        return nodes.select(F.col("id").alias("node_id")).limit(0)
    apart = (F.col("pre_a") + F.col("size_a") <= F.col("pre_b")) | (F.col("pre_b") + F.col("size_b") <= F.col("pre_a"))
    sideways = rest.where(apart).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parent = number.where("p IS NOT NULL").select(F.col("v").alias("p"), "pre", "size")  # a root's edges join through none above
    over = reaches.join(parent, "p").where("low < pre OR high >= pre + size").select(F.col("v").alias("src"), F.col("p").alias("dst"))
    lower = tree.where("p IS NOT NULL").select(F.col("v").alias("id"))
    blocks = wcc(lower, materialise(sideways.unionAll(over), "block-links")).select(F.col("node_id").alias("v"), "component_id")
    touched = tree.where("p IS NOT NULL").join(blocks, "v").select(F.explode(F.array("v", "p")).alias("node_id"), "component_id")
    return touched.groupBy("node_id").agg(F.min("component_id").alias("x"), F.max("component_id").alias("y")).where("x < y").select("node_id")


#: Fixed value: the slices, by hash, of a community's moves with gains between two powers of two.
MOVE_SLICES = 16
#: Fixed value: ends of edges up to which gains, at most their square, are 64-bit numbers; beyond, decimal ones.
LONG_ENDS = 3 * 10**9


def _joint_moves(moves: DataFrame) -> DataFrame:
    """(id, b): those of ``moves(id, a, b, k, up)`` from community a to b that raise modularity together; the greatest is always among them.

    A community only gives or only takes, as the greatest move at it does. Then two
    moves that share a community gain less together by the product of their degrees
    at most. A community puts its greatest move first, then slices of the others,
    greater gains before. A move is made if it gains more than its degree times the
    other degrees up to the end of its slice, on both sides.
    """
    move = lambda takes: F.struct("up", (-F.col("id")).alias("n"), F.lit(takes).alias("takes"))
    ends = moves.select(F.col("a").alias("c"), move(False).alias("m")).unionAll(moves.select("b", move(True)))
    first = ends.groupBy("c").agg(F.max("m").alias("m")).select("c", (-F.col("m.n")).alias("first"), "m.takes")
    gives = first.where("NOT takes").select(F.col("c").alias("a"), F.col("first").alias("first_a"))
    takes = first.where("takes").select(F.col("c").alias("b"), F.col("first").alias("first_b"))
    place = F.pmod(F.xxhash64("id"), F.lit(MOVE_SLICES)) - MOVE_SLICES * F.floor(F.log2(F.col("up").cast("double")))
    fit = moves.join(gives, "a").join(takes, "b").select("id", "a", "b", "k", "up", *(F.when(F.col("id") != F.col(f"first_{x}"), place).alias(f"place_{x}") for x in "ab"))
    made = fit
    for x in "ab":
        upto = F.sum(F.sum("k")).over(Window.partitionBy(x).orderBy(f"place_{x}"))  # null, the greatest move's place, is first
        sums = fit.groupBy(x, f"place_{x}").agg(upto.alias(f"upto_{x}")).select(F.col(x).alias("c"), F.col(f"place_{x}").alias("p"), f"upto_{x}")
        made = made.join(sums, (F.col(x) == F.col("c")) & F.col(f"place_{x}").eqNullSafe(F.col("p"))).drop("c", "p")
    return made.where(F.col("up") > F.col("k") * (F.col("upto_a") + F.col("upto_b") - 2 * F.col("k"))).select("id", "b")


def louvain(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, community_id, level): one level of modularity moves, until no node's move raises modularity; level is always 0.

    In each round every node looks at its neighbours' communities and picks the
    one of greatest gain, of equals the smallest; those of these moves are made
    that raise modularity together, so the rounds end without a limit. Gains are
    whole numbers: what modularity gains, times half the square of the ends of edges.
    """
    ends = materialise(edges.select("src", "dst").where("src <> dst"), "louvain-ends")
    rows = 2 * ends.count()
    both = materialise(dealt(ends.unionAll(ends.select("dst", "src")), rows, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")), "louvain-edges")
    discard(ends)
    number = "long" if rows <= LONG_ENDS else "decimal(18,0)"
    strength = both.groupBy("src").agg(F.sum("w").alias("k"))
    state = materialise(nodes.select("id").join(strength, F.col("id") == F.col("src"), "left").select("id", F.col("id").alias("c"), F.coalesce("k", F.lit(0)).alias("k")), "louvain")
    while True:
        placed = state.join(state.groupBy("c").agg(F.sum("k").alias("tot")), "c")
        offered = both.join(placed.select(F.col("id").alias("dst"), "c", "tot"), "dst").select("src", "c", "w", "tot")
        to = dealt(offered, rows, "src", "c").groupBy("src", "c").agg(F.sum("w").cast(number).alias("w"), F.max("tot").cast(number).alias("tot"))  # one total a community
        mine = placed.select("id", F.col("c").alias("a"), F.col("k").cast(number).alias("k"), (F.col("tot") - F.col("k")).cast(number).alias("others"))
        own = F.col("c") == F.col("a")
        gain = F.col("w") * F.lit(rows).cast(number) - F.col("k") * F.when(own, F.col("others")).otherwise(F.col("tot"))
        best = to.join(mine, to["src"] == mine["id"]).groupBy("id", "a", "k", "others").agg(F.max(F.when(own, gain)).alias("stay"), F.max(F.when(~own, F.struct(gain.alias("g"), (-F.col("c")).alias("n")))).alias("m"))
        up = F.col("m.g") - F.coalesce("stay", -F.col("k") * F.col("others"))
        moves = materialise(best.select("id", "a", (-F.col("m.n")).alias("b"), "k", up.alias("up")).where("up > 0"), "louvain-moves")
        if moves.isEmpty():
            discard(both, moves)
            return state.select(F.col("id").alias("node_id"), F.col("c").alias("community_id"), F.lit(0).alias("level"))
        new = materialise(state.join(_joint_moves(moves), "id", "left").select("id", F.coalesce("b", "c").alias("c"), "k"), "louvain")
        discard(state, moves)
        state = new


def modularity(communities: DataFrame, edges: DataFrame) -> float:
    """Modularity of (node_id, community_id) on the undirected edges."""
    e = edges.where("src <> dst").join(communities.select(F.col("node_id").alias("src"), F.col("community_id").alias("a")), "src").join(communities.select(F.col("node_id").alias("dst"), F.col("community_id").alias("b")), "dst")
    ends = e.select(F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    m, inside = e.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("a") == F.col("b")).cast("long")), F.lit(0))).first()
    return inside / m - (ends.agg(F.sum(F.pow("k", 2))).first()[0] or 0) / (4.0 * m * m) if m else 0.0
