"""Operators on small graphs with rows worked out by hand."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pgspark import graph as graph_module
from pgspark import queries, tables
from pgspark.functions import scalar, spatial
from pgspark.graph import Bindings, EdgeTable, Graph, NodeTable, prop
from pgspark.operators import mutations, paths, rows
from pgspark.plans import algorithms, catalog, rounds, search, timeseries
from pgspark.sources import files


@pytest.fixture(scope="module")
def orchard(spark):
    """A farm with one plot, which grows three trees."""
    farm = spark.createDataFrame([(5, "Westside")], "id long, name string")
    plot = spark.createDataFrame([(50, "slope")], "id long, name string")
    tree = spark.createDataFrame([(501, "pear", 3.5), (502, "plum", 4.25), (503, "quince", 2.0)], "id long, name string, height double")
    owns = EdgeTable(spark.createDataFrame([(1, 5, 50)], "eid long, src long, dst long"), "src", "dst", "farm", "plot", "eid")
    grows = EdgeTable(spark.createDataFrame([(2, 50, 501), (3, 50, 502), (4, 50, 503)], "eid long, src long, dst long"), "src", "dst", "plot", "tree", "eid")
    return Graph({"farm": NodeTable(farm, "id"), "plot": NodeTable(plot, "id"), "tree": NodeTable(tree, "id")}, {"owns": owns, "grows": grows})


def test_two_hops(orchard):
    b = orchard.match("f", "farm").expand("f", "owns", "p").expand("p", "grows", "t")
    got = b.where(prop("t.height") > 3).select(prop("f.name").alias("f"), prop("t.name").alias("t")).collect()
    assert sorted(tuple(r) for r in got) == [("Westside", "pear"), ("Westside", "plum")]


def test_optional_keeps_rows_and_where_after_sees_nulls(orchard):
    tall = orchard.match("p", "plot").expand("p", "grows", "t").where(prop("t.height") > 30)
    b = orchard.match("p", "plot").optional(tall)
    assert [tuple(r) for r in b.select(prop("p").alias("p"), prop("t").alias("t")).collect()] == [(50, None)]
    assert b.where(prop("t").isNotNull()).df.count() == 0


def test_parallel_edges_stay(spark, orchard):
    twice = EdgeTable(spark.createDataFrame([(5, 50), (5, 50)], "src long, dst long"), "src", "dst", "farm", "plot")
    g = Graph(orchard.nodes, {"owns": twice})
    assert g.match("f", "farm").expand("f", "owns", "p").df.count() == 2


def test_one_row_of_parallel_edges_on_request(spark, orchard):
    twice = EdgeTable(spark.createDataFrame([(5, 50), (5, 50)], "src long, dst long"), "src", "dst", "farm", "plot")
    g = Graph(orchard.nodes, {"owns": twice})
    b = g.match("f", "farm").expand("f", "owns", "p", distinct=True)
    assert [(r.f, r.p) for r in b.df.collect()] == [(5, 50)]
    assert b.expand("p", "owns", "f", "in").df.count() == 1  # closed again


def test_values_of_many_matches_are_dealt(spark, orchard, monkeypatch):
    """A third of the rows on one value: the join has no task of its size, and the rows of a plain join."""
    monkeypatch.setattr(graph_module, "DEAL_ROWS", 100)
    left = spark.range(300).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("p"), F.col("id").alias("a"))
    right = spark.range(50).select(F.when(F.col("id") < 40, 7).when(F.col("id") < 49, F.col("id")).cast("long").alias("p"), F.col("id").alias("b"))
    x, y = Bindings(orchard, left, {"p": "plot", "a": "tree"}), Bindings(orchard, right, {"p": "plot", "b": "tree"})
    got, plain = x.join(y, many=True).df, x.join(y).df
    assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    sizes = [r["count"] for r in got.where("p = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes)


def broken(spark):
    """Nodes and edges with repeats, nulls, missing ends, an unknown label and keys of several types."""
    room = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "id int")
    door = spark.createDataFrame([("1",), ("2",), ("9",)], "id string")
    leads = spark.createDataFrame([(1, "1"), (1, "1"), (1, "1"), (8, "2"), (8, "2"), (None, "7")], "src long, dst string")
    faces = spark.createDataFrame([(2, 4), (2, 4), (None, 4)], "src long, dst long")
    return Graph({"room": NodeTable(room, "id"), "door": NodeTable(door, "id")}, {"leads": EdgeTable(leads, "src", "dst", "room", "door"), "faces": EdgeTable(faces, "src", "dst", "room", "yard")})


def test_checks_of_a_broken_graph(spark):
    got = {r.check: (r.status, r.total) for r in catalog.validate(broken(spark)).collect()}
    # Dangling: 8-2, null-7 (7 is no door), 2-4 and null-4 (no yard is known). Orphans: room 3 and door 9.
    assert got == {"dangling_edges": ("error", 4), "duplicate_edges": ("warning", 3), "orphaned_nodes": ("warning", 2)}
    found = sorted(r.detail for r in catalog.repair(broken(spark)).collect())
    assert found == sorted(["(room:8)-[:leads]->(door:2): an end is missing", "(room)-[:leads]->(door:7): an end is missing", "(room:2)-[:faces]->(yard:4): an end is missing", "(room)-[:faces]->(yard:4): an end is missing", "(room:1)-[:leads]->(door:1): keep 1, remove 2", "(room:8)-[:leads]->(door:2): keep 1, remove 1", "(room:2)-[:faces]->(yard:4): keep 1, remove 1"])


def test_checks_group_keys_in_their_own_type(spark):
    """Texts are made of what is found only, not of every edge before the grouping."""
    plan = catalog._repeated(broken(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [src" in plan and "concat" not in plan


def test_triangles_against_enumeration(spark):
    r = random.Random(5)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(300)] + [(0, k) for k in range(40)] + [(1, 1)]
    near = {v: {b if a == v else a for a, b in edges if v in (a, b) and a != b} for v in range(41)}
    want = {v: sum(b in near[a] for a, b in itertools.combinations(sorted(near[v]), 2)) for v in near}
    got = algorithms.triangles(*graph_of(spark, range(41), edges))
    assert {x.node_id: x.total for x in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "array_intersect" in plan  # no wedge is a row


def test_counts_in_partitions_that_follow_the_rows(spark, monkeypatch):
    """Label propagation, Louvain and the driver's graph deal what they count, however few partitions the session asks for."""
    monkeypatch.setattr(rounds, "PART_ROWS", 100)
    assert rounds.dealt(spark.range(1000), 1000, "id").rdd.getNumPartitions() == 10
    edges = [(a, b) for k in range(8) for a, b in itertools.combinations(range(10 * k, 10 * k + 10), 2)]
    n, e = graph_of(spark, range(80), edges)
    for f in (algorithms.label_propagation, algorithms.louvain):
        got = {}
        for x in f(n, e).collect():
            got.setdefault(x.community_id, set()).add(x.node_id)
        assert sorted(map(sorted, got.values())) == [list(range(10 * k, 10 * k + 10)) for k in range(8)]
    lines = spark.createDataFrame([(k % 7, k % 5) for k in range(1000)], "l_partkey long, l_suppkey long")
    folder = f"{rounds.shared_folder(spark)}/dealt-lines"
    lines.write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    found = tables.sells_with(spark, folder)[1]
    assert found.rdd.getNumPartitions() == 10 and found.count() == 35


def test_undirected_pairs_between_equal_labels(spark, orchard):
    near = EdgeTable(spark.createDataFrame([(501, 503), (503, 503)], "src long, dst long"), "src", "dst", "tree", "tree")
    g = Graph(orchard.nodes, {"near": near})
    one = g.match("a", "tree").expand("a", "near", "b", "any").select(prop("a").alias("a"), prop("b").alias("b")).collect()
    assert [tuple(r) for r in one] == [(501, 503)]
    both = g.match("a", "tree").expand("a", "near", "b", "any", ordered_pairs=True).select(prop("a").alias("a"), prop("b").alias("b")).collect()
    assert sorted(tuple(r) for r in both) == [(501, 503), (503, 501), (503, 503)]


def test_value_of_several_matches_is_an_error(orchard):
    with pytest.raises(Exception, match="more than one match"):
        orchard.match("p", "plot").value_of(orchard.match("p", "plot").expand("p", "grows", "t"), prop("t.name"), "n").df.collect()


def test_cross_refuses_large(orchard):
    with pytest.raises(ValueError):
        orchard.match("a", "tree").cross(orchard.match("b", "farm"), most_rows=1)


def test_null_order(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "i int, v string")
    assert [r.i for r in rows.order_by(df, ("v", True)).collect()] == [2, 3, 1]
    assert [r.i for r in rows.order_by(df, ("v", False)).collect()] == [1, 3, 2]


def test_set_operations_with_nulls(spark):
    a = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "v int")
    b = spark.createDataFrame([(None,), (1,), (3,)], "w int")
    got = lambda df: sorted((r[0] for r in df.collect()), key=str)
    assert got(rows.intersect_all(a, b)) == [1, 1, None, None]
    assert got(rows.except_all(a, b)) == [2]
    assert got(rows.otherwise(a.where("v > 9"), b)) == [1, 3, None]


EDGES = [(1, 2, 10), (2, 3, 11), (3, 1, 12), (2, 1, 13), (3, 3, 14)]


def walks(low, high, mode, start=1):
    """Brute force over all edge sequences."""
    out = []
    for n in range(low, high + 1):
        for seq in itertools.product(EDGES, repeat=n):
            nodes = [start]
            if any(e[0] != p for e, p in zip(seq, [start] + [e[1] for e in seq])):
                continue
            nodes += [e[1] for e in seq]
            if mode == "trail" and len({e[2] for e in seq}) < n:
                continue
            if mode == "acyclic" and len(set(nodes)) < len(nodes):
                continue
            if mode == "simple" and not (len(set(nodes)) == len(nodes) or (n and nodes[0] == nodes[-1] and len(set(nodes[:-1])) == n)):
                continue
            out.append((n, nodes[-1]))
    return sorted(out)


@pytest.mark.parametrize("mode", paths.MODES)
@pytest.mark.parametrize("low,high", [(0, 2), (1, 4), (3, 3)])
def test_paths_against_enumeration(spark, mode, low, high):
    edges = spark.createDataFrame(EDGES, "src long, dst long, eid long")
    got = paths.var_expand(spark.createDataFrame([(1,)], "start long"), edges, low, high, mode)
    assert sorted((r.depth, r.node) for r in got.collect()) == walks(low, high, mode)


def graph_of(spark, nodes, edges):
    return spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges or [(0, 0)], "src long, dst long").where(F.lit(bool(edges)))


def test_components_cycles_and_bridgeless_parts(spark):
    nodes, edges = graph_of(spark, range(1, 9), [(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (6, 5), (7, 7)])
    wcc = {r.node_id: r.component_id for r in algorithms.wcc(nodes, edges).collect()}
    assert wcc == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8}
    scc = {r.node_id: r.component_id for r in algorithms.scc(nodes, edges).collect()}
    assert scc == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8}
    with pytest.raises(ValueError):
        algorithms.topo_levels(nodes, edges)


def test_betweenness_on_a_path(spark):
    nodes, edges = graph_of(spark, [1, 2, 3, 4], [(1, 2), (2, 3), (3, 4)])
    assert {r.node_id: r.score for r in algorithms.betweenness(nodes, edges).collect()} == {1: 0.0, 2: 2.0, 3: 2.0, 4: 0.0}


def test_shortest_path_and_all_pairs(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0)], "src long, dst long, weight double")
    got = [(r["node_id"], r["cost"], r["index"]) for r in algorithms.shortest_path(edges, 1, 3).orderBy("index").collect()]
    assert got == [(1, 2.0, 0), (2, 2.0, 1), (3, 2.0, 2)]
    assert algorithms.shortest_path(edges, 1, 4).count() == 0
    assert sorted(tuple(r) for r in algorithms.apsp(nodes, edges).collect()) == [(1, 2, 1.0), (1, 3, 2.0), (2, 3, 1.0)]


def test_pagerank_of_nothing_and_dangling(spark):
    nodes, edges = graph_of(spark, [], [])
    assert algorithms.pagerank(nodes, edges).count() == 0
    nodes, edges = graph_of(spark, [1, 2], [(1, 2)])
    assert sum(r.score for r in algorithms.pagerank(nodes, edges).collect()) == pytest.approx(1.0)


def test_scalars(spark):
    one = spark.createDataFrame([("\t a　", -9.0, 2.5)], "s string, x double, y double")
    c = F.col
    r = one.select(scalar.trim(c("s")).alias("t"), scalar.sqrt(c("x")).alias("q"), scalar.round_half_away(c("y")).alias("r"), scalar.substring(F.lit("hello"), F.lit(-2), F.lit(2)).alias("u"), scalar.like(F.lit("a\\b"), "a\\_").alias("l"), scalar.between(F.lit(5), F.lit(None).cast("int"), F.lit(3)).alias("b"), scalar.last(F.array().cast("array<int>")).alias("e"), scalar.list_slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), F.lit(9)).alias("z"), scalar.int_range(F.lit(3), F.lit(1)).alias("n"), scalar.float_text(F.lit(1.0)).alias("f"), scalar.normalize(F.lit("é")).alias("m")).first()
    assert (r.t, r.q, r.r, r.u, r.l, r.b, r.e, r.z, r.n, r.f, r.m) == ("a", None, 3.0, "he", True, None, None, [2, 3], [], "1", "é")


def test_shapes(spark):
    square = spatial.st_geomfromgeojson(F.lit('{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[1,1],[2,1],[2,2],[1,2],[1,1]]]}'))
    p = lambda x, y: spatial.st_point(F.lit(float(x)), F.lit(float(y)))
    r = spark.range(1).select(spatial.st_area(square).alias("a"), spatial.st_contains(square, p(3, 3)).alias("i"), spatial.st_contains(square, p(1.5, 1.5)).alias("h"), spatial.st_isvalid(square).alias("v"), spatial.st_length(square).alias("l"), spatial.st_intersects(square, p(9, 9)).alias("n"), spatial.st_distance(p(0, 0), p(0, 1)).alias("d"), spatial.st_asgeojson(p(1, 2)).alias("j")).first()
    assert (r.a, r.i, r.h, r.v, r.l, r.n, r.j) == (15.0, True, False, True, 20.0, False, '{"type":"Point","coordinates":[1.0,2.0]}')
    assert r.d == pytest.approx(111195.08, abs=0.1)


def test_versions(spark, tmp_path):
    t = mutations.VersionedTable(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    assert t.commit(a) == 1
    b = mutations.merge(a, spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string"), ["id"], {"v": F.col("new_v")})
    assert t.commit(b) == 2
    assert sorted(tuple(r) for r in t.read().collect()) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted(tuple(r) for r in mutations.changes(t.read(1), t.read(2), "id").collect()) == [(2, "updated"), (3, "created")]
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    with pytest.raises(ValueError):
        mutations.delete(a, "id", a.where("id = 2"), edges)
    nodes, left = mutations.detach_delete(a, "id", a.where("id = 2"), edges)
    assert nodes.count() == 1 and left.count() == 0


def test_property_at(spark):
    now = spark.createDataFrame([(1, "t", "c", 30)], "node_id long, key string, value string, updated_at long")
    old = spark.createDataFrame([(1, "t", "a", 10), (1, "t", "b", 30)], "node_id long, key string, value string, superseded_at long")
    at = lambda t: [r.value for r in catalog.property_at(now, old, t).collect()]
    assert (at(5), at(10), at(29), at(30)) == (["a"], ["b"], ["b"], ["c"])


def test_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("id,parent,size,ok,name\na,,1,true,x\nb,a,2.5,no,7\n")
    nodes, edges = files.read_nodes_csv(spark, str(tmp_path / "n.csv"), "id", parent="parent")
    got = {r.id: (r.size, r.ok, r.name) for r in nodes.select("id", *[F.schema_of_variant(c).alias(c) for c in ("size", "ok", "name")]).collect()}
    assert got["a"] == ("BIGINT", "BOOLEAN", "STRING") and got["b"][1:] == ("STRING", "BIGINT")
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "contains")]
    n = spark.createDataFrame([(1, ["sensor"], {"name": 'a "b"\n'})], "id long, labels array<string>, props map<string,string>")
    e = spark.createDataFrame([(1, "near", 2)], "src long, label string, dst long")
    triples = files.to_triples(n, e)
    files.write_ntriples(triples, str(tmp_path / "nt"))
    back = files.read_ntriples(spark, str(tmp_path / "nt")).drop("graph")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, triples.collect()))
    found = files.basic_pattern(triples, ("?x", files.RDF_TYPE, "?t"), ("?x", "urn:graph:rel/near", "?y")).collect()
    assert [r.y for r in found] == ["urn:graph:node/2"]


def test_samples_by_day(spark, tmp_path):
    day = 86_400_000_000_000
    s = spark.createDataFrame([(1, "t", i * day // 2, float(i)) for i in range(8)], "entity_id long, property string, timestamp long, value double")
    files.write_samples(s, str(tmp_path / "s"))
    got = files.read_samples(spark, str(tmp_path / "s"), day, 2 * day)
    assert sorted(r.value for r in got.collect()) == [2.0, 3.0, 4.0]


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "node_id long, score double")
    b = spark.createDataFrame([(2, 5.0), (3, 4.0)], "node_id long, score double")
    assert [r.node_id for r in search.fuse(a, b, k=3).collect()] == [2, 1, 3]


def components_without(nodes, edges, skip):
    left = {n: n for n in nodes}

    def root(x):
        while left[x] != x:
            x = left[x]
        return x

    for i, (a, b) in enumerate(edges):
        if i != skip:
            left[root(a)] = root(b)
    return len({root(n) for n in nodes})


def test_bridges_against_removal(spark):
    import random

    r = random.Random(4)
    nodes = list(range(24))
    edges = [(r.randrange(24), r.randrange(24)) for _ in range(24)] + [(0, 1), (1, 0)]
    want = {(min(e), max(e)) for i, e in enumerate(edges) if e[0] != e[1] and components_without(nodes, edges, i) > components_without(nodes, edges, None)}
    n, e = graph_of(spark, nodes, edges)
    assert {tuple(x) for x in algorithms.bridges(n, e).collect()} == want


def test_louvain_finds_two_cliques(spark):
    clique = [(a, b) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)]
    n, e = graph_of(spark, [*range(5), *range(10, 15)], clique + [(4, 10)])
    got = algorithms.louvain(n, e)
    assert algorithms.modularity(got, e) > 0.4


def moves_that_gain(communities, edges):
    """(node, community) of the moves of one node to a neighbour's community that raise modularity, by brute force."""
    near, degree = {v: {} for v in communities}, dict.fromkeys(communities, 0)
    for a, b in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                near[x][communities[y]] = near[x].get(communities[y], 0) + 1
                degree[x] += 1
    total = {}
    for v, c in communities.items():
        total[c] = total.get(c, 0) + degree[v]
    all_ends = sum(degree.values())
    gain = lambda v, c: near[v].get(c, 0) * all_ends - degree[v] * (total[c] - (degree[v] if c == communities[v] else 0))
    return [(v, c) for v in communities for c in near[v] if c != communities[v] and gain(v, c) > gain(v, communities[v])]


def test_louvain_goes_on_until_no_move_gains(spark, monkeypatch):
    """A weakly clustered graph, on which moves of all nodes at once swing to and fro, with a hub, parallel edges, loops and a lone node."""
    r = random.Random(7)
    edges = [(r.randrange(16), 100 + r.randrange(5)) for _ in range(60)] + [(0, k) for k in range(1, 12)] + [(3, 3)]
    n, e = graph_of(spark, [*range(16), *range(100, 105), 500], edges)
    got = {x.node_id: x.community_id for x in algorithms.louvain(n, e).collect()}
    assert len(got) == 22 and got[500] == 500
    assert moves_that_gain(got, edges) == []
    monkeypatch.setattr(algorithms, "LONG_ENDS", 0)  # the same by decimal numbers
    assert {x.node_id: x.community_id for x in algorithms.louvain(n, e).collect()} == got
    assert algorithms.louvain(*graph_of(spark, [1, 2], [(1, 1)])).count() == 2


def test_joint_moves_raise_modularity(spark):
    """Of single nodes that all want one hub so many move that modularity rises, the greatest move among them."""
    edges = [(0, k) for k in range(1, 60)] + [(k, k + 100) for k in range(1, 60)]
    nodes = sorted({v for x in edges for v in x})
    _, e = graph_of(spark, nodes, edges)
    ends, degree = 2 * len(edges), {v: sum(v in x for x in edges) for v in nodes}
    rows = [(v, v, 0, degree[v], ends - degree[v] * degree[0]) for v in range(1, 60)]
    found = {x.id: x.b for x in algorithms._joint_moves(spark.createDataFrame(rows, "id long, a long, b long, k long, up long")).collect()}
    before = spark.createDataFrame([(v, v) for v in nodes], "node_id long, community_id long")
    after = spark.createDataFrame([(v, found.get(v, v)) for v in nodes], "node_id long, community_id long")
    assert 1 in found and algorithms.modularity(after, e) > algorithms.modularity(before, e)
    assert {x.id for x in algorithms._joint_moves(spark.createDataFrame([(1, 1, 2, 1, 5), (2, 2, 1, 1, 5)], "id long, a long, b long, k long, up long")).collect()} == {1}


def test_louvain_query_does_all_rounds(spark):
    r = random.Random(11)
    folder = f"{rounds.shared_folder(spark)}/louvain-lines"
    edges = [(r.randrange(40), r.randrange(6)) for _ in range(150)]
    spark.createDataFrame(edges, "l_partkey long, l_suppkey long").write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    got = {x.node_id: x.community_id for x in queries.QUERIES["louvain"](spark, folder).collect()}
    assert moves_that_gain(got, {(p, s + tables.SUPPLIERS) for p, s in edges}) == []


def test_durations_and_paths(spark):
    c = F.col
    r = spark.range(1).select(scalar.duration(F.lit("PT1H30M")).alias("a"), scalar.duration(F.lit("1h30m")).alias("b"), scalar.duration(F.lit("P2DT0.5S")).alias("c"), scalar.duration(F.lit("-250ms")).alias("d"), scalar.duration(F.lit("soon")).alias("e"), scalar.zoned_time(F.lit("10:20:30+02:00")).alias("z")).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (5400 * 10**9, 5400 * 10**9, 2 * 86400 * 10**9 + 5 * 10**8, -25 * 10**7, None)
    assert (r.z.time, r.z.offset_s) == (37230 * 10**9, 7200)
    path = spark.createDataFrame([([1, 2, 1], [7, 8])], "nodes array<long>, edges array<long>").select(F.struct("nodes", "edges").alias("p"))
    f = scalar.FUNCTIONS
    got = path.select(f["path_length"](c("p")).alias("n"), f["is_acyclic"](c("p")).alias("a"), f["is_trail"](c("p")).alias("t"), f["is_simple"](c("p")).alias("s")).first()
    assert tuple(got) == (2, False, True, True)


def test_containment_paths_of_hits(spark):
    up = spark.createDataFrame([(501, 50), (502, 50), (50, 5)], "child long, parent long")
    names = spark.createDataFrame([(5, "Westside"), (50, "slope"), (501, "pear")], "id long, name string")
    hits = spark.createDataFrame([(501, 0.75), (5, 0.25)], "node_id long, score double")
    assert sorted(tuple(r) for r in search.with_path(hits, up, names, 5).collect()) == [(5, 0.25, "Westside"), (501, 0.75, "Westside > slope > pear")]


def test_properties_of_a_variable(orchard):
    b = orchard.match("t", "tree")
    r = b.where(prop("t") == 502).df.select(b.properties("t").alias("p"), b.property_names("t").alias("k")).first()
    assert r.p.asDict() == {"name": "plum", "height": 4.25} and r.k == ["name", "height"]


def articulation_of(nodes, edges):
    """Nodes whose removal leaves more components than there were, not counting the node's own."""
    def parts(left):
        return components_without(left, [e for e in edges if e[0] in left and e[1] in left], None)

    return {n for n in nodes if parts([m for m in nodes if m != n]) > parts(nodes) - (not any(n in e and e[0] != e[1] for e in edges))}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_articulation_points_against_removal(spark, seed):
    import random

    r = random.Random(seed)
    nodes = list(range(22))
    edges = [(r.randrange(22), r.randrange(22)) for _ in range(12 + 7 * seed)] + [(0, 1), (1, 0), (3, 3)]
    n, e = graph_of(spark, nodes, edges)
    assert {x.node_id for x in algorithms.articulation_points(n, e).collect()} == articulation_of(nodes, edges)
    assert algorithms.articulation_points(n, e.limit(0)).count() == 0


def test_articulation_point_of_a_hub(spark):
    n, e = graph_of(spark, range(40), [(0, k) for k in range(1, 40)] + [(1, 2), (3, 4)])
    assert [x.node_id for x in algorithms.articulation_points(n, e).collect()] == [0]


def test_longer_shortest_path(spark):
    edges = spark.createDataFrame([(k, k + 1, 1.0) for k in range(20)] + [(0, 20, 50.0), (4, 9, 0.0), (9, 4, 0.0)], "src long, dst long, weight double")
    got = [r["node_id"] for r in algorithms.shortest_path(edges, 0, 20).orderBy("index").collect()]
    assert got == [0, 1, 2, 3, 4, *range(9, 21)]
    assert [tuple(r) for r in algorithms.shortest_path(edges, 7, 7).collect()] == [(7, 0.0, 0)]


def test_unbounded_paths_end(spark):
    edges = spark.createDataFrame([(1, 2, 10), (2, 3, 11), (3, 1, 12)], "src long, dst long, eid long")
    start = spark.createDataFrame([(1,)], "start long")
    assert sorted(r.depth for r in paths.var_expand(start, edges, 0, None, "trail").collect()) == [0, 1, 2, 3]
    assert paths.var_expand(start, edges, 1, None, "walk").count() == paths.UNBOUNDED


def test_turtle(spark, tmp_path):
    text = '@prefix ex: <http://ex.org/> .\nPREFIX b: <urn:b:>\nex:pear a ex:Tree ; ex:name "Pear \\"old\\""@en , "Birne" ; # note\n  ex:height 3.5 ; ex:near _:x .\nb:x ex:tall true .\n<urn:y> <urn:p> """two\nlines"""^^ex:t .\n'
    (tmp_path / "t.ttl").write_text(text)
    ex = "http://ex.org/"
    want = [(ex + "pear", files.RDF_TYPE, ex + "Tree", False), (ex + "pear", ex + "name", 'Pear "old"', True), (ex + "pear", ex + "name", "Birne", True), (ex + "pear", ex + "height", "3.5", True), (ex + "pear", ex + "near", "_:x", False), ("urn:b:x", ex + "tall", "true", True), ("urn:y", "urn:p", "two\nlines", True)]
    got = files.read_turtle(spark, str(tmp_path / "t.ttl"))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    named = got.where("o NOT LIKE '\\_:%'")
    files.write_turtle(named, str(tmp_path / "out"))
    assert sorted(map(tuple, files.read_turtle(spark, str(tmp_path / "out")).collect())) == sorted(t for t in want if not t[2].startswith("_:"))
    with pytest.raises(ValueError):
        files.turtle_triples("( 1 2 )")


def test_quads_unions_and_unshared_patterns(spark, tmp_path):
    quads = spark.createDataFrame([("urn:a", "urn:p", "urn:b", False, "urn:g"), ("urn:b", "urn:q", "x", True, None)], "s string, p string, o string, literal boolean, graph string")
    files.write_ntriples(quads, str(tmp_path / "nq"))
    assert sorted(map(str, files.read_ntriples(spark, str(tmp_path / "nq")).collect())) == sorted(map(str, quads.collect()))
    both = files.union_patterns(files.basic_pattern(quads, ("?x", "urn:p", "?y")), files.basic_pattern(quads, ("?x", "urn:q", "?z")))
    assert sorted(map(tuple, both.collect()), key=str) == [("urn:a", "urn:b", None), ("urn:b", None, "x")]
    with pytest.raises(ValueError):
        files.basic_pattern(quads, ("?x", "urn:p", "?y"), ("?a", "urn:q", "?b"))


def test_topological_order_of_a_queue(spark):
    import random
    from collections import deque

    for seed in range(2):
        r = random.Random(seed)
        edges = [(a, b) for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(45)) if a < b] + [(0, 24), (0, 24)]
        into = {n: sum(b == n for _, b in edges) for n in range(25)}
        queue, want = deque(sorted(n for n in into if not into[n])), []
        while queue:
            n = queue.popleft()
            want.append(n)
            for m in sorted(b for a, b in edges if a == n):
                into[m] -= 1
                if not into[m]:
                    queue.append(m)
        n, e = graph_of(spark, range(25), edges)
        assert [x.node_id for x in algorithms.topo_sort(n, e).orderBy("position").collect()] == want


def test_projections_by_name(spark):
    n, e = graph_of(spark, [1, 2, 3], [(1, 2), (2, 9)])
    p = algorithms.Projections()
    p.project("a", n, e)
    assert [tuple(r) for r in p.list(spark).collect()] == [("a", 3, 1)]
    assert p.drop("a") and not p.drop("a") and p.list(spark).count() == 0


def test_updates_of_triples(spark):
    t = spark.createDataFrame([("a", "age", "3", True), ("b", "age", "4", True), ("a", "near", "b", False)], "s string, p string, o string, literal boolean")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(files.insert_triples(t, t.limit(1))) == got(t)
    assert got(files.delete_triples(t, t.where("s = 'a'"))) == [("b", "age", "4", True)]
    found = files.basic_pattern(t, ("?x", "age", "?n"))
    moved = files.delete_insert_where(t, found, [("?x", "age", "?n", True)], [("?x", "years", "?n", True), ("?x", "kind", "old", False)])
    assert got(moved) == sorted([("a", "near", "b", False), ("a", "years", "3", True), ("b", "years", "4", True), ("a", "kind", "old", False), ("b", "kind", "old", False)])


def test_arrow_streams(spark):
    import pyarrow as pa

    rows = [r for x in files.arrow_streams(spark.range(100).repartition(3)).collect() for r in pa.ipc.open_stream(x.stream).read_all()["id"].to_pylist()]
    assert sorted(rows) == list(range(100))


def test_long_series_across_slices(spark):
    """Neighbours several slices apart, against one sorted list."""
    import random

    r, day = random.Random(4), 86_400_000_000_000
    times = sorted(r.sample(range(40 * 24), 60))
    rows = [(1, "t", t * day // 24, float(i)) for i, t in enumerate(times)]
    s = spark.createDataFrame(rows, "entity_id long, property string, timestamp long, value double")
    probes = spark.createDataFrame([(1, "t", k * day // 3) for k in range(150)], "entity_id long, property string, at long")
    want = []
    for k in range(150):
        at = k * day // 3
        p = max((x[2:] for x in rows if x[2] <= at), default=None)
        n = min((x[2:] for x in rows if x[2] >= at), default=None)
        if p is not None:
            want.append((at, p[1] if n is None or p[0] == at else p[1] + (n[1] - p[1]) * (at - p[0]) / (n[0] - p[0])))
    got = sorted((x["at"], x.value) for x in timeseries.value_at(s, probes, "linear").collect())
    assert [a for a, _ in got] == [a for a, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want])
    gaps = [(a[2], b[2]) for a, b in zip(rows, rows[1:]) if b[2] - a[2] > day]
    assert sorted((x.gap_start, x.gap_end) for x in timeseries.gaps(s, day).collect()) == gaps


def test_edges_csv(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", "near", 3), ("b", "c", "near", 4)], "source_id string, target_id string, label string, weight int")
    files.write_csv(edges, str(tmp_path / "e"))
    got = files.read_edges_csv(spark, str(tmp_path / "e")).select("src", "dst", "label", F.col("weight").cast("int").alias("weight"))
    assert sorted(map(tuple, got.collect())) == [("a", "b", "near", 3), ("b", "c", "near", 4)]


def test_merge_refuses_repeated_keys(spark):
    a = spark.createDataFrame([(1, "x")], "id long, v string")
    with pytest.raises(ValueError):
        mutations.merge(a, spark.createDataFrame([(2, "y"), (2, "z")], "id long, v string"), ["id"])


def test_writers_get_versions_of_their_own(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    t = mutations.VersionedTable(spark, str(tmp_path / "t"))
    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(lambda k: t.commit(spark.range(k)), range(4))) == [1, 2, 3, 4]
    assert {t.read(v).count() for v in (1, 2, 3, 4)} == {0, 1, 2, 3}


def test_whole_numbers_near_a_boundary(spark):
    last = 1_706_399_999_999_999_999
    s = spark.createDataFrame([(1, "t", last, 2.0)], "entity_id long, property string, timestamp long, value double")
    r = timeseries.warm(s).first()
    assert (r.window_start, r.stddev, r.p50) == (1_706_399_940_000_000_000, None, None)
    assert spark.range(1).select(scalar.timestamp_to_string(F.lit(last))).first()[0] == "2024-01-27T23:59:59Z"
    assert spark.range(1).select(scalar.timestamp_to_string(F.lit(-1).cast("long"))).first()[0] == "1969-12-31T23:59:59Z"
    assert timeseries.windows(s.unionAll(s.withColumn("timestamp", F.lit(7).cast("long"))), 10, "max").agg(F.max("window_start")).first()[0] == last - (last - 7) % 10


def test_type_names_and_sizes(spark):
    path = F.struct(F.array(F.lit(1), F.lit(2)).alias("nodes"), F.array(F.lit(9)).alias("edges"))
    values = {"NULL": F.lit(None), "INT": F.lit(3), "FLOAT": F.lit(1.5), "STRING": F.lit("abc"), "BOOL": F.lit(True), "LIST": F.array(F.lit(1), F.lit(None)), "PATH": path, "DATE": F.current_date(), "ZONED_DATETIME": F.now(), "VECTOR": F.array(F.lit(1.0).cast("float")), "RECORD": F.struct(F.lit(1).alias("a"))}
    r = spark.range(1).select(*[scalar.value_type(c).alias(k) for k, c in values.items()]).first()
    assert r.asDict() == {k: k for k in values}
    size = scalar.FUNCTIONS["size"]
    assert tuple(spark.range(1).select(size(values["STRING"]), size(values["LIST"]), size(path), size(F.lit(None).cast("string")), size(F.array().cast("array<int>"))).first()) == (3, 2, 1, None, 0)


def test_compaction_and_retention(spark, tmp_path):
    day = 86_400_000_000_000
    s = spark.createDataFrame([(1, "t", i * day, float(i)) for i in range(4)], "entity_id long, property string, timestamp long, value double")
    for _ in range(2):
        files.write_samples(s, str(tmp_path / "s"))
    files.compact_samples(spark, str(tmp_path / "s"), str(tmp_path / "c"), keep_from=2 * day)
    assert sorted(r.value for r in files.read_samples(spark, str(tmp_path / "c"), 0, 9 * day).collect()) == [2.0, 3.0]


def test_procedure_list(spark):
    names = {r.name for r in catalog.procedures(spark).collect()}
    assert {"timeseries.value_at", "algorithms.pagerank", "search.text_search"} <= names
