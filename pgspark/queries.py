"""Queries over the driver's tables, each with DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pgspark.functions import scalar, spatial, vector
from pgspark.graph import Label, prop
from pgspark.operators import mutations, paths, rows
from pgspark.plans import algorithms, catalog, search
from pgspark.plans import timeseries as ts
from pgspark.sources import files
from pgspark.tables import CUSTOMERS, NATIONS, ORDERS, SUPPLIERS, deliveries, ends, graph, ordered, reach, samples, sells_with, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86_400 * ts.SECOND
NOW = 1_706_400_000 * ts.SECOND  # 2024-01-28, inside the events


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def money(c) -> F.Column:
    """Sums of doubles differ in their last bits between engines."""
    return F.round(c, 2)


# -- patterns ----------------------------------------------------------------------


@query("SELECT r_name AS region, count(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name ORDER BY nations DESC, region LIMIT 3")
def nations_by_region(spark, d):
    b = graph(spark, d).match("n", "nation").expand("n", "in_region", "r")
    return rows.page(b.aggregate({"region": prop("r.r_name")}, {"nations": F.count(F.lit(1))}), ("nations", False), ("region", True), limit=3)


@query("SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'O'")
def label_scan_filter(spark, d):
    b = graph(spark, d).match("o", "orders").where((prop("o.o_totalprice") > 200000) & (prop("o.o_orderstatus") == "O"))
    return b.select(prop("o").alias("id"), prop("o.o_orderpriority").alias("priority"))


@query("SELECT 'region' AS label, r_regionkey::VARCHAR AS id FROM region UNION ALL SELECT 'nation', n_nationkey::VARCHAR FROM nation UNION ALL SELECT 'supplier', s_suppkey::VARCHAR FROM supplier")
def label_expression(spark, d):
    return graph(spark, d).scan((Label("place") | Label("party")) & ~Label("customer")).select("label", "id")


@query("SELECT count(*) AS total FROM customer")
def count_only(spark, d):
    return graph(spark, d).match("c", "customer").df.agg(F.count(F.lit(1)).alias("total"))


@query("SELECT c_custkey AS c, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def expand_1hop(spark, d):
    return graph(spark, d).match("c", "customer").expand("c", "customer_in", "n").select(prop("c").alias("c"), prop("n.n_name").alias("nation"))


@query("SELECT c_custkey AS c, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000")
def expand_2hop(spark, d):
    b = graph(spark, d).match("c", "customer").where(prop("c.c_acctbal") > 5000).expand("c", "customer_in", "n").expand("n", "in_region", "r")
    return b.select(prop("c").alias("c"), prop("r.r_name").alias("region"))


@query("SELECT n_name AS nation, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def expand_in(spark, d):
    b = graph(spark, d).match("n", "nation").expand("n", "customer_in", "c", "in")
    return b.aggregate({"nation": prop("n.n_name")}, {"customers": F.count(F.lit(1))})


@query("SELECT s_suppkey AS s, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def expand_any(spark, d):
    return graph(spark, d).match("s", "supplier").expand("s", "supplier_in", "n", "any").select(prop("s").alias("s"), prop("n.n_name").alias("nation"))


@query("SELECT o_orderpriority AS priority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size > 25 AND l_quantity < 20 GROUP BY 1")
def edge_properties(spark, d):
    b = graph(spark, d).match("o", "orders").expand("o", "contains", "p", edge_var="e").where((prop("p.p_size") > 25) & (prop("e.l_quantity") < 20))
    revenue = F.sum(prop("e.l_extendedprice") * (1 - prop("e.l_discount")))
    return b.aggregate({"priority": prop("o.o_orderpriority")}, {"n": F.count(F.lit(1)), "revenue": money(revenue)})


@query("SELECT c_custkey AS c, o_orderkey AS o FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON o_custkey = c_custkey")
def optional_match(spark, d):
    g = graph(spark, d)
    found = g.match("c", "customer").expand("c", "placed", "o").where(prop("o.o_totalprice") > 250000)
    return g.match("c", "customer").optional(found).select(prop("c").alias("c"), prop("o").alias("o"))


@query("SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def exists_semi(spark, d):
    g = graph(spark, d)
    return g.match("c", "customer").exists(g.match("c", "customer").expand("c", "placed", "o").where(prop("o.o_orderstatus") == "F")).select(prop("c").alias("c"))


@query("SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def not_exists_anti(spark, d):
    g = graph(spark, d)
    return g.match("c", "customer").not_exists(g.match("c", "customer").expand("c", "placed", "o").where(prop("o.o_totalprice") > 100000)).select(prop("c").alias("c"))


@query("SELECT c_custkey AS c, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def count_subquery(spark, d):
    g = graph(spark, d)
    return g.match("c", "customer").count_of(g.match("c", "customer").expand("c", "placed", "o"), "orders").select(prop("c").alias("c"), "orders")


@query("SELECT n_name AS nation, c_custkey AS c, s_suppkey AS s FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_acctbal > 9000 AND s_acctbal > 5000")
def pattern_join(spark, d):
    g = graph(spark, d)
    c = g.match("n", "nation").expand("n", "customer_in", "c", "in").where(prop("c.c_acctbal") > 9000)
    s = g.match("n", "nation").expand("n", "supplier_in", "s", "in").where(prop("s.s_acctbal") > 5000)
    return c.join(s, many=True).select(prop("n.n_name").alias("nation"), prop("c").alias("c"), prop("s").alias("s"))


@query("SELECT count(*) AS pairs FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE NOT (a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity = b.l_quantity AND a.l_extendedprice = b.l_extendedprice AND a.l_discount = b.l_discount AND a.l_tax = b.l_tax AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus AND a.l_shipdate = b.l_shipdate) AND a.l_quantity > 40 AND b.l_quantity > 40")
def different_edges(spark, d):
    g = graph(spark, d)
    b = g.match("o", "orders").expand("o", "contains", "p", edge_var="a").expand("o", "contains", "q", edge_var="b")
    return b.different_edges("a", "b").where((prop("a.l_quantity") > 40) & (prop("b.l_quantity") > 40)).df.agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT o_orderkey AS o, s_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey)")
def cycle_join(spark, d):
    """Round the cycle by its narrow hops; the hop from nations to all their suppliers only closes it."""
    b = graph(spark, d).match("c", "customer").expand("c", "customer_in", "n").expand("c", "placed", "o").expand("o", "supplied_by", "s", distinct=True)
    return b.expand("s", "supplier_in", "n").select(prop("o").alias("o"), prop("s").alias("s"))


@query("SELECT r_name || '/' || n_name AS pair FROM region CROSS JOIN nation WHERE n_nationkey < 5")
def cartesian(spark, d):
    g = graph(spark, d)
    return g.match("r", "region").cross(g.match("n", "nation").where(prop("n") < 5)).select(F.concat(prop("r.r_name"), F.lit("/"), prop("n.n_name")).alias("pair"))


@query("SELECT n_nationkey AS n, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS degree FROM nation")
def degree_of(spark, d):
    return graph(spark, d).match("n", "nation").degree("n", "customer_in", "in").select(prop("n").alias("n"), "degree")


# -- clauses -----------------------------------------------------------------------


@query("SELECT n_name AS nation, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 500")
def group_having(spark, d):
    b = graph(spark, d).match("o", "orders").expand("o", "placed", "c", "in").expand("c", "customer_in", "n")
    out = b.aggregate({"nation": prop("n.n_name")}, {"revenue": money(F.sum(prop("o.o_totalprice"))), "n": F.count(F.lit(1))})
    return out.where("n > 500").drop("n")


@query("SELECT count(*) + 1 AS a, sum(p_size) * 2 AS b, max(p_size) - min(p_size) AS c, round(avg(p_retailprice), 4) AS d, round(stddev_samp(p_size), 6) AS e, round(stddev_pop(p_size), 6) AS f, count(DISTINCT p_brand) AS g FROM part")
def aggregates(spark, d):
    p = graph(spark, d).match("p", "part").df
    size = prop("p.p_size")
    return p.agg((F.count(F.lit(1)) + 1).alias("a"), (F.sum(size) * 2).alias("b"), (F.max(size) - F.min(size)).alias("c"), F.round(F.avg(prop("p.p_retailprice")), 4).alias("d"), F.round(F.stddev_samp(size), 6).alias("e"), F.round(F.stddev_pop(size), 6).alias("f"), F.countDistinct(prop("p.p_brand")).alias("g"))


@query("SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def collect(spark, d):
    g = graph(spark, d).match("n", "nation")
    return g.aggregate({"region": prop("n.n_regionkey")}, {"names": F.array_join(rows.collect_sorted(prop("n.n_name"), prop("n.n_name")), ",")})


@query("SELECT DISTINCT c_mktsegment AS segment, n_regionkey AS region FROM customer JOIN nation ON c_nationkey = n_nationkey")
def distinct(spark, d):
    return graph(spark, d).match("c", "customer").expand("c", "customer_in", "n").select(prop("c.c_mktsegment").alias("segment"), prop("n.n_regionkey").alias("region")).distinct()


@query("WITH w AS (SELECT o_custkey AS c, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) SELECT c, total, c_mktsegment AS segment FROM w JOIN customer ON c = c_custkey WHERE total > 1000000")
def with_where(spark, d):
    g = graph(spark, d)
    w = g.match("c", "customer").expand("c", "placed", "o")
    totals = w.df.groupBy("c", "c__c_mktsegment").agg(money(F.sum("o__o_totalprice")).alias("total")).where("total > 1000000")
    return totals.select("c", "total", F.col("c__c_mktsegment").alias("segment"))


@query("SELECT o_orderkey AS o, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status ASC NULLS LAST, o LIMIT 50")
def order_asc_nulls(spark, d):
    b = graph(spark, d).match("o", "orders").select(prop("o").alias("o"), F.nullif(prop("o.o_orderstatus"), F.lit("F")).alias("status"))
    return rows.page(b, ("status", True), ("o", True), limit=50)


@query("SELECT o_orderkey AS o, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status DESC NULLS FIRST, o LIMIT 50 OFFSET 20")
def order_desc_offset(spark, d):
    b = graph(spark, d).match("o", "orders").select(prop("o").alias("o"), F.nullif(prop("o.o_orderstatus"), F.lit("F")).alias("status"))
    return rows.page(b, ("status", False), ("o", True), offset=20, limit=50)


@query("SELECT p_partkey AS p, unnest(string_split(p_type, ' ')) AS word FROM part")
def unwind(spark, d):
    p = graph(spark, d).match("p", "part").select(prop("p").alias("p"), F.split(prop("p.p_type"), " ").alias("ws"))
    return rows.unwind(p, F.col("ws"), "word").drop("ws")


@query("SELECT c_custkey AS c, round(c_acctbal * 2, 2) AS twice FROM customer WHERE c_acctbal * 2 > 10000")
def let(spark, d):
    b = graph(spark, d).match("c", "customer").let(twice=money(prop("c.c_acctbal") * 2))
    return b.where(F.col("twice") > 10000).select(prop("c").alias("c"), F.col("twice"))


@query("SELECT c_custkey AS c, coalesce((SELECT string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000), '') AS orders FROM customer")
def collect_subquery(spark, d):
    g = graph(spark, d)
    found = g.match("c", "customer").expand("c", "placed", "o").where(prop("o.o_totalprice") > 300000)
    return g.match("c", "customer").collect_of(found, prop("o"), "os").select(prop("c").alias("c"), F.array_join(F.transform("os", lambda x: x.cast("string")), ",").alias("orders"))


@query("SELECT c_custkey AS c, CASE WHEN n_regionkey <> 2 THEN n_name END AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey")
def value_subquery(spark, d):
    g = graph(spark, d)
    found = g.match("c", "customer").expand("c", "customer_in", "n").where(prop("n.n_regionkey") != 2)
    return g.match("c", "customer").value_of(found, prop("n.n_name"), "nation").select(prop("c").alias("c"), F.col("nation"))


@query("SELECT n_name AS nation, richest, customers FROM nation, LATERAL (SELECT max(c_acctbal) AS richest, count(*) AS customers FROM customer WHERE c_nationkey = n_nationkey)")
def call_subquery(spark, d):
    g, c = graph(spark, d), table(spark, d, "customer")
    b = g.match("n", "nation").call(lambda outer: c.where(F.col("c_nationkey") == outer("n")).select(F.max("c_acctbal").alias("richest"), F.count(F.lit(1)).alias("customers")))
    return b.select(prop("n.n_name").alias("nation"), F.col("richest"), F.col("customers"))


@query("SELECT c_custkey AS c, property, arg_max(value, ts) AS value FROM customer JOIN (SELECT user_id, event_type AS property, ts, value FROM events) ON user_id = c_custkey GROUP BY 1, 2")
def call_procedure(spark, d):
    b = graph(spark, d).match("c", "customer").call_procedure(ts.latest(samples(spark, d)), {"c": "entity_id"}, {"property": "property", "value": "value"})
    return b.select(prop("c").alias("c"), F.col("property"), F.col("value"))


@query("SELECT n_name AS nation, n, r_name AS region FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n > 5")
def next_statement(spark, d):
    b = graph(spark, d).match("n", "nation").expand("n", "customer_in", "c", "in")
    b = b._with(b.df.groupBy("n", "n__n_name").agg(F.count(F.lit(1)).alias("count"))).next({"n": prop("n"), "name": prop("n.n_name"), "count": F.col("count")})
    return b.where("count > 5").expand("n", "in_region", "r").select(F.col("name").alias("nation"), F.col("count").alias("n"), prop("r.r_name").alias("region"))


@query("SELECT o_orderkey AS id, l_orderkey::VARCHAR AS element, 'contains' AS kind, l_orderkey AS a, l_partkey AS b, true AS source, p_size > 25 AS destination, 'part' AS labels, false AS party, l_discount IS NOT NULL AS has, false AS lacks, 'p_name,p_brand,p_type,p_size,p_retailprice' AS keys FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
def element_functions(spark, d):
    b = graph(spark, d).match("o", "orders").expand("o", "contains", "p", edge_var="e").where(prop("e.l_quantity") > 45)
    return b.select(b.id("o").alias("id"), b.element_id("o").alias("element"), b.type("e").alias("kind"), b.start_node("e").alias("a"), b.end_node("e").alias("b"), b.is_source_of("o", "e").alias("source"), (b.is_destination_of("p", "e") & (prop("p.p_size") > 25)).alias("destination"), F.array_join(b.labels_of("p"), ",").alias("labels"), b.is_labeled("p", Label("party")).alias("party"), b.property_exists("e", "l_discount").alias("has"), b.property_exists("p", "weight").alias("lacks"), F.array_join(b.keys("p"), ",").alias("keys"))


_A = "SELECT c_mktsegment AS v FROM customer WHERE c_acctbal > 8000"
_B = "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'OTHER' END AS v FROM supplier"


def _ab(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_mktsegment").alias("v"))
    b = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("OTHER").alias("v"))
    return a, b


@query(f"{_A} UNION ALL {_B}")
def union_all(spark, d):
    return rows.union_all(*_ab(spark, d))


@query(f"{_A} UNION {_B}")
def union_distinct(spark, d):
    return rows.union_distinct(*_ab(spark, d))


@query(f"{_A} INTERSECT {_B}")
def intersect_distinct(spark, d):
    return rows.intersect_distinct(*_ab(spark, d))


@query(f"SELECT v FROM ({_A}) a WHERE EXISTS (SELECT 1 FROM ({_B}) b WHERE b.v IS NOT DISTINCT FROM a.v)")
def intersect_all_ref(spark, d):
    return rows.intersect_all(*_ab(spark, d))


@query(f"{_A} EXCEPT {_B}")
def except_distinct(spark, d):
    return rows.except_distinct(*_ab(spark, d))


@query(f"SELECT v FROM ({_A}) a WHERE NOT EXISTS (SELECT 1 FROM ({_B}) b WHERE b.v IS NOT DISTINCT FROM a.v)")
def except_all_ref(spark, d):
    return rows.except_all(*_ab(spark, d))


@query(f"{_B}")
def otherwise_taken(spark, d):
    a, b = _ab(spark, d)
    return rows.otherwise(a.where("v = 'none'"), b)


@query(f"{_A}")
def otherwise_not_taken(spark, d):
    return rows.otherwise(*_ab(spark, d))


@query("SELECT n_name AS nation, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(*) > 5")
def view_scan(spark, d):
    g = graph(spark, d)
    g.views["by_nation"] = expand_1hop(spark, d).groupBy("nation").agg(F.count(F.lit(1)).alias("n"))
    return g.view("by_nation", nation="nation", customers="n").where("customers > 5").df


# -- expressions -------------------------------------------------------------------


@query("SELECT p_partkey AS p, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS k, p_name LIKE '%a_' AS l, p_size BETWEEN 10 AND 20 AS b, p_brand IN ('Brand#11', 'Brand#12') AS i, starts_with(p_type, 'S') AS s, contains(p_name, 'e') AS e FROM part")
def predicates(spark, d):
    p = table(spark, d, "part")
    size = F.col("p_size")
    case = F.when(size % 3 == 0, "a").when(size % 3 == 1, "b").otherwise("c")
    return p.select(F.col("p_partkey").alias("p"), case.alias("k"), scalar.like(F.col("p_name"), "%a_").alias("l"), scalar.between(size, F.lit(10), F.lit(20)).alias("b"), F.col("p_brand").isin("Brand#11", "Brand#12").alias("i"), F.startswith("p_type", F.lit("S")).alias("s"), F.contains("p_name", F.lit("e")).alias("e"))


@query("SELECT p_partkey AS p, CASE WHEN nullif(p_size, 5) IS NULL THEN NULL ELSE p_size BETWEEN 3 AND 7 END AS b, (p_size > 5) <> (p_size < 20) AS x FROM part")
def three_valued(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").select(F.col("p_partkey").alias("p"), scalar.between(F.nullif(size, F.lit(5)), F.lit(3), F.lit(7)).alias("b"), scalar.xor(size > 5, size < 20).alias("x"))


@query("WITH l AS (SELECT p_partkey AS p, range(1, p_size % 7 + 1) AS xs FROM part) SELECT p, list_sum(list_transform(list_filter(xs, lambda x: x % 2 = 1), lambda x: x * x))::BIGINT AS odd_squares, len(list_filter(xs, lambda x: x > 4)) > 0 AS some, len(list_filter(xs, lambda x: x < 6)) = len(xs) AS every, len(list_filter(xs, lambda x: x = 3)) = 1 AS one, list_reduce(list_prepend(0, xs), lambda a, x: a * 2 + x) AS folded FROM l")
def lists(spark, d):
    xs = F.col("xs")
    base = table(spark, d, "part").select(F.col("p_partkey").alias("p"), scalar.int_range(F.lit(1), F.col("p_size") % 7).cast("array<long>").alias("xs"))
    squares = F.transform(F.filter(xs, lambda x: x % 2 == 1), lambda x: x * x)
    return base.select("p", F.when(F.size(squares) > 0, F.aggregate(squares, F.lit(0).cast("long"), lambda a, x: a + x)).alias("odd_squares"), F.exists(xs, lambda x: x > 4).alias("some"), F.forall(xs, lambda x: x < 6).alias("every"), scalar.single(xs, lambda x: x == 3).alias("one"), F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a * 2 + x).alias("folded"))


@query("SELECT s_suppkey AS s, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 6) END AS r, round(CASE WHEN s_acctbal > 0 THEN ln(s_acctbal) END, 6) AS l, sign(s_acctbal)::BIGINT AS g, ceil(s_acctbal)::BIGINT AS c, floor(s_acctbal)::BIGINT AS f, s_suppkey // 7 AS q, s_suppkey % 7 AS m, round(degrees(atan2(s_acctbal, 100)), 6) AS t FROM supplier")
def numbers(spark, d):
    x, k = F.col("s_acctbal"), F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("s"), F.round(scalar.sqrt(x), 6).alias("r"), F.round(scalar.log(x), 6).alias("l"), scalar.sign(x).alias("g"), F.ceil(x).alias("c"), F.floor(x).alias("f"), scalar.int_divide(k, F.lit(7)).alias("q"), (k % 7).alias("m"), F.round(F.degrees(F.atan2(x, F.lit(100.0))), 6).alias("t"))


@query("SELECT c_custkey AS c, upper(c_name) AS u, reverse(c_name) AS r, substring(c_name, 3, 4) AS s, left(c_name, 3) AS l, right(c_name, 3) AS t, length(c_name) AS n, replace(c_name, '0', 'o') AS p, concat_ws('-', c_mktsegment, c_nationkey) AS j FROM customer")
def texts(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.upper(n).alias("u"), F.reverse(n).alias("r"), scalar.substring(n, F.lit(2), F.lit(4)).alias("s"), scalar.left(n, F.lit(3)).alias("l"), scalar.right(n, F.lit(3)).alias("t"), F.length(n).cast("long").alias("n"), F.replace(n, F.lit("0"), F.lit("o")).alias("p"), F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("j"))


@query("SELECT o_orderkey AS o, year(o_orderdate) AS y, month(o_orderdate) AS m, epoch(o_orderdate)::BIGINT AS e, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS s FROM orders")
def temporal(spark, d):
    t = F.col("o_orderdate")
    nanos = F.unix_micros(t.cast("timestamp")) * 1000
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), scalar.extract("YEAR", t).alias("y"), scalar.extract("MONTH", t).alias("m"), scalar.extract("EPOCH", t).alias("e"), scalar.timestamp_to_string(nanos).alias("s"))


@query("SELECT a.s_suppkey AS a, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians((b.s_suppkey % 90 - a.s_suppkey % 90)) / 2), 2) + cos(radians(a.s_suppkey % 90)) * cos(radians(b.s_suppkey % 90)) * pow(sin(radians((b.s_acctbal - a.s_acctbal) / 100) / 2), 2))), 1) AS m FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1")
def spatial_distance(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), spatial.st_point(F.col("s_acctbal") / 100, F.col("s_suppkey") % 90).alias("g"))
    pairs = s.alias("a").join(s.select((F.col("k") - 1).alias("k"), F.col("g").alias("h")), "k")
    return pairs.select(F.col("k").alias("a"), F.round(spatial.st_distancesphere(F.col("g"), F.col("h")), 1).alias("m"))


@query("SELECT c_custkey AS c, lower(c_name) AS lo, trim('  ' || c_name || ' ') AS t, ltrim('  ' || c_name) AS lt, rtrim(c_name || '  ') AS rt, ends_with(c_name, '1') AS e, starts_with(c_name, 'C') AS s, contains(c_name, '00') AS k, length(c_name) AS n, length(c_name) AS m, nfc_normalize(c_name) AS nf, true AS norm, contains(lower(c_name), 'customer') AND contains(lower(c_name), '01') AS tm, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS co, c_custkey::VARCHAR AS st, try_cast(substring(c_name, 10) AS BIGINT) AS i, c_acctbal AS f, c_custkey % 2 <> 0 AS b, 'STRING' AS ty, trim(c_mktsegment, 'BG') AS tr, true AS typed FROM customer")
def text_functions(spark, d):
    f, n, c = scalar.FUNCTIONS, F.col("c_name"), F.col
    pad = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    return table(spark, d, "customer").select(
        c("c_custkey").alias("c"), f["lower"](n).alias("lo"), f["trim"](pad("  ", " ")).alias("t"), f["ltrim"](pad("  ", "")).alias("lt"), f["rtrim"](pad("", "  ")).alias("rt"), f["ends_with"](n, F.lit("1")).alias("e"), f["starts_with"](n, F.lit("C")).alias("s"), f["contains"](n, F.lit("00")).alias("k"),
        f["size"](n).cast("long").alias("n"), f["length"](n).cast("long").alias("m"), f["normalize"](n).alias("nf"), f["is_normalized"](n).alias("norm"), f["text_match"](n, F.lit("Customer 01")).alias("tm"), f["coalesce"](f["nullif"](c("c_mktsegment"), F.lit("BUILDING")), F.lit("none")).alias("co"),
        f["to_string"](c("c_custkey")).alias("st"), f["tointeger"](F.substring(n, 10, 99)).alias("i"), f["tofloat"](c("c_acctbal").cast("string")).alias("f"), f["toboolean"](c("c_custkey") % 2).alias("b"), f["value_type"](n).alias("ty"), f["trim_of"](c("c_mktsegment"), "BG").alias("tr"), f["is_typed"](n, "string").alias("typed"),
    )


@query("SELECT p_partkey AS p, abs(10 - p_size) AS a, round(p_size / 4.0) AS r, round(pow(p_size, 1.5), 6) AS w, round(log10(p_size), 8) AS l, round(exp(x), 6) AS e, round(sin(x), 8) AS s, round(cos(x), 8) AS c, round(tan(x), 6) AS t, round(cot(x), 6) AS ct, round(sinh(x), 6) AS sh, round(cosh(x), 6) AS ch, round(tanh(x), 8) AS th, round(asin(x / 8), 8) AS asn, round(acos(x / 8), 8) AS acs, round(atan(x), 8) AS atn, round(radians(p_size), 8) AS rd, round(pi(), 8) AS pi, p_size % 7 AS m, (4611686018427387904 + p_partkey) // 7 AS q, -((4611686018427387904 + p_partkey) // 7) AS nq FROM (SELECT *, p_size % 7 + 0.5::DOUBLE AS x FROM part)")
def math_functions(spark, d):
    f, size, x = scalar.FUNCTIONS, F.col("p_size"), F.col("x")
    big = F.lit(1 << 62) + F.col("p_partkey")
    df = table(spark, d, "part").withColumn("x", size % 7 + F.lit(0.5))
    rounded = {"e": ("exp", x, 6), "s": ("sin", x, 8), "c": ("cos", x, 8), "t": ("tan", x, 6), "ct": ("cot", x, 6), "sh": ("sinh", x, 6), "ch": ("cosh", x, 6), "th": ("tanh", x, 8), "asn": ("asin", x / 8, 8), "acs": ("acos", x / 8, 8), "atn": ("atan", x, 8), "rd": ("radians", size, 8), "l": ("log10", size, 8)}
    return df.select(F.col("p_partkey").alias("p"), f["abs"](10 - size).alias("a"), f["round"](size / 4).alias("r"), F.round(f["power"](size, F.lit(1.5)), 6).alias("w"), *[F.round(f[name](v), k).alias(c) for c, (name, v, k) in rounded.items()], F.round(f["pi"](), 8).alias("pi"), f["mod"](size, F.lit(7)).alias("m"), f["div"](big, F.lit(7)).alias("q"), f["div"](-big, F.lit(7)).alias("nq"))


@query("WITH l AS (SELECT p_partkey AS p, range(1, p_size % 7 + 1) AS xs FROM part) SELECT p, xs[1] AS h, xs[-1] AS z, array_to_string(xs[2:], ',') AS tl, array_to_string(list_append(xs, 9), ',') AS ap, array_to_string(list_prepend(9, xs), ',') AS pp, array_to_string(list_reverse(xs), ',') AS rv, array_to_string(list_sort(list_reverse(xs)), ',') AS so, list_contains(xs, 3) AS co, len(xs)::INTEGER AS n, len(xs)::INTEGER AS m, array_to_string(xs[2:4], ',') AS sl, list_sum(xs)::DOUBLE AS su, list_avg(xs) AS av, list_min(xs) AS mi, list_max(xs) AS ma, len(xs) AS ct, len(list_distinct(list_transform(xs, lambda x: x % 2))) = len(xs) AS df, 'LIST' AS ty FROM l")
def list_functions(spark, d):
    f, xs = scalar.FUNCTIONS, F.col("xs")
    base = table(spark, d, "part").select(F.col("p_partkey").alias("p"), scalar.int_range(F.lit(1), F.col("p_size") % 7).cast("array<long>").alias("xs"))
    nine = F.lit(9).cast("long")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    odd = F.transform(xs, lambda x: x % 2)
    return base.select("p", f["head"](xs).alias("h"), f["last"](xs).alias("z"), joined(f["tail"](xs)).alias("tl"), joined(f["list_append"](xs, nine)).alias("ap"), joined(f["list_prepend"](xs, nine)).alias("pp"), joined(f["list_reverse"](xs)).alias("rv"), joined(f["list_sort"](F.reverse(xs))).alias("so"), f["list_contains"](xs, F.lit(3).cast("long")).alias("co"), f["size"](xs).alias("n"), f["length"](xs).alias("m"), joined(f["list_slice"](xs, F.lit(1), F.lit(4))).alias("sl"), rows.list_sum(xs).alias("su"), rows.list_avg(xs).alias("av"), rows.list_min(xs).alias("mi"), rows.list_max(xs).alias("ma"), rows.list_count(xs).alias("ct"), (F.size(F.array_distinct(odd)) == F.size(odd)).alias("df"), f["value_type"](xs).alias("ty"))


@query("SELECT o_orderkey AS o, strftime(o_orderdate - INTERVAL 1 MICROSECOND, '%Y-%m-%dT%H:%M:%SZ') AS s, epoch_us(o_orderdate) * 1000 + 5400000000000 AS a, epoch_us(o_orderdate) * 1000 - 90000000000 AS b, 5400000000000 AS dur, day(o_orderdate) AS dy, hour(o_orderdate) AS h, minute(o_orderdate) AS mi, strftime(o_orderdate::DATE + INTERVAL 1 DAY, '%Y-%m-%d') AS nx, strftime(o_orderdate::DATE - INTERVAL 1 DAY, '%Y-%m-%d') AS pv, epoch_us(o_orderdate) * 1000 - 90000000000 - 7 AS btw, 37230000000000 AS tod, 'DATE' AS ty FROM orders")
def time_functions(spark, d):
    f, t = scalar.FUNCTIONS, F.col("o_orderdate")
    nanos = F.unix_micros(t.cast("timestamp")) * 1000
    day = f["date"](t)
    long = lambda n: F.lit(n).cast("long")
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    back = f["date_sub"](nanos, f["duration"](F.lit("90s")))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("o"), f["timestamp_to_string"](nanos - 1).alias("s"), f["date_add"](nanos, f["duration"](F.lit("PT1H30M"))).alias("a"), back.alias("b"), f["duration"](F.lit("1h30m")).alias("dur"), f["extract"]("DAY", t).alias("dy"), f["extract"]("HOUR", t).alias("h"), f["extract"]("MINUTE", t).alias("mi"), shown(scalar.date_plus(day, long(86_400_000_000_000))).alias("nx"), shown(scalar.date_plus(day, long(-1))).alias("pv"), f["duration_between"](back, long(7)).alias("btw"), f["time"](F.lit("10:20:30")).alias("tod"), f["value_type"](day).alias("ty"))


@query("SELECT s_suppkey AS s, w * w AS area, 4.0 * w AS ring, 'Polygon' AS kind, w > 1.5 AS holds, w > 1.5 AS within, true AS valid, w * w AS box, w = 3 AS same, 1.5::DOUBLE AS x, 1.5::DOUBLE AS y, 111195.08 * w <= 250000 AS near, w >= 2 AS meets, 'GEOMETRY' AS ty FROM (SELECT s_suppkey, (s_suppkey % 5 + 1)::DOUBLE AS w FROM supplier)")
def spatial_functions(spark, d):
    f, w, zero = scalar.FUNCTIONS, F.col("w"), F.lit(0.0)
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    square = lambda side: f["st_makepolygon"](F.array(at(zero, zero), at(side, zero), at(side, side), at(zero, side)))
    g, p = square(w), f["st_point"](F.lit(1.5), F.lit(1.5))
    df = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5 + 1).cast("double").alias("w"))
    near = f["st_dwithin"](f["st_point"](zero, zero), f["st_point"](zero, w), F.lit(250000.0))
    return df.select(F.col("s_suppkey").alias("s"), f["st_area"](g).alias("area"), f["st_length"](g).alias("ring"), f["st_geometrytype"](g).alias("kind"), f["st_contains"](g, p).alias("holds"), f["st_within"](p, g).alias("within"), f["st_isvalid"](g).alias("valid"), f["st_area"](f["st_envelope"](g)).alias("box"), f["st_equals"](g, square(F.lit(3.0))).alias("same"), f["st_x"](p).alias("x"), f["st_y"](p).alias("y"), near.alias("near"), f["st_intersects"](g, p).alias("meets"), f["value_type"](g).alias("ty"))


# -- paths -------------------------------------------------------------------------


def _contains(spark, d):
    """Region to nation to supplier, as one containment tree with disjoint ids."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    up = n.select((F.col("n_regionkey") + 1000).cast("long").alias("src"), (F.col("n_nationkey") + 2000).cast("long").alias("dst"))
    down = s.select((F.col("s_nationkey") + 2000).cast("long").alias("src"), (F.col("s_suppkey") + 10000).cast("long").alias("dst"))
    return up.unionAll(down).withColumn("eid", F.xxhash64("src", "dst"))


_TREE = "SELECT n_regionkey::BIGINT + 1000 AS src, n_nationkey::BIGINT + 2000 AS dst FROM nation UNION ALL SELECT s_nationkey::BIGINT + 2000, s_suppkey + 10000 FROM supplier"


@query(f"WITH RECURSIVE e AS ({_TREE}), p AS (SELECT r_regionkey::BIGINT + 1000 AS start, r_regionkey::BIGINT + 1000 AS node, 0 AS depth FROM region UNION ALL SELECT start, dst, depth + 1 FROM p JOIN e ON node = src WHERE depth < 3) SELECT start, node, depth FROM p WHERE depth >= 1")
def var_expand_walk(spark, d):
    starts = table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("start"))
    return paths.var_expand(starts, _contains(spark, d), 1, 3).select("start", "node", "depth")


_RING = "SELECT n_nationkey::BIGINT AS src, (n_nationkey::BIGINT * 3 + 1) % 25 AS dst FROM nation UNION ALL SELECT n_nationkey::BIGINT, (n_nationkey::BIGINT + 1) % 25 FROM nation"


def _ring(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"))
    both = n.withColumn("dst", (F.col("src") * 3 + 1) % 25).unionAll(n.withColumn("dst", (F.col("src") + 1) % 25))
    return both.withColumn("eid", F.col("src") * 100 + F.col("dst"))


@query(f"WITH RECURSIVE e AS (SELECT src, dst, src * 100 + dst AS eid FROM ({_RING})), p AS (SELECT 0::BIGINT AS node, 0 AS depth, []::BIGINT[] AS es UNION ALL SELECT dst, depth + 1, list_append(es, eid) FROM p JOIN e ON node = src WHERE depth < 5 AND NOT list_contains(es, eid)) SELECT node, depth, count(*) AS paths FROM p WHERE depth >= 2 GROUP BY ALL")
def var_expand_trail(spark, d):
    found = paths.var_expand(spark.createDataFrame([(0,)], "start long"), _ring(spark, d), 2, 5, "trail")
    return found.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("paths"))


@query(f"WITH RECURSIVE e AS ({_RING}), p AS (SELECT 0::BIGINT AS node, 0 AS depth, [0]::BIGINT[] AS ns UNION ALL SELECT dst, depth + 1, list_append(ns, dst) FROM p JOIN e ON node = src WHERE depth < 6 AND NOT list_contains(ns, dst)) SELECT node, depth, count(*) AS paths FROM p WHERE depth >= 1 GROUP BY ALL")
def var_expand_acyclic(spark, d):
    found = paths.var_expand(spark.createDataFrame([(0,)], "start long"), _ring(spark, d), 1, 6, "acyclic")
    return found.groupBy("node", "depth").agg(F.count(F.lit(1)).alias("paths"))


_ALL_STARTS = f"WITH RECURSIVE e AS ({_RING}), p AS (SELECT n_nationkey::BIGINT AS start, n_nationkey::BIGINT AS node, 0 AS depth FROM nation UNION ALL SELECT start, dst, depth + 1 FROM p JOIN e ON node = src WHERE depth < 4)"


def _nations(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("start"))


@query(_ALL_STARTS + " SELECT start, node, depth, count(*) AS paths FROM (SELECT *, rank() OVER (PARTITION BY start, node ORDER BY depth) AS r FROM p WHERE depth >= 1) WHERE r = 1 GROUP BY ALL")
def all_shortest(spark, d):
    found = paths.shortest(paths.var_expand(_nations(spark, d), _ring(spark, d), 1, 4), every=True, per=("start", "node"))
    return found.groupBy("start", "node", "depth").agg(F.count(F.lit(1)).alias("paths"))


@query(_ALL_STARTS + " SELECT start, node, min(depth) AS depth FROM p WHERE depth >= 1 GROUP BY ALL")
def any_shortest(spark, d):
    return paths.shortest(paths.var_expand(_nations(spark, d), _ring(spark, d), 1, 4), every=False, per=("start", "node")).select("start", "node", "depth")


@query(f"WITH RECURSIVE e AS ({_RING}), p AS (SELECT n_nationkey::BIGINT AS start, n_nationkey::BIGINT AS node, 0 AS depth, [n_nationkey::BIGINT] AS ns FROM nation UNION ALL SELECT start, dst, depth + 1, list_append(ns, dst) FROM p JOIN e ON node = src WHERE depth < 4 AND (depth = 0 OR node <> start) AND (dst = start OR NOT list_contains(ns, dst))) SELECT start, node, depth, count(*) AS paths FROM p WHERE depth >= 1 GROUP BY ALL")
def var_expand_simple(spark, d):
    return paths.var_expand(_nations(spark, d), _ring(spark, d), 1, 4, "simple").groupBy("start", "node", "depth").agg(F.count(F.lit(1)).alias("paths"))


@query(f"WITH RECURSIVE e AS ({_TREE}), p AS (SELECT r_regionkey::BIGINT + 1000 AS start, r_regionkey::BIGINT + 1000 AS node, 0 AS depth FROM region UNION ALL SELECT start, dst, depth + 1 FROM p JOIN e ON node = src) SELECT start, node, depth, depth AS edges, true AS trail, true AS acyclic, true AS simple FROM p")
def var_expand_unbounded(spark, d):
    """The quantifier ``*``, with the functions of a path variable."""
    starts, f = table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("start")), scalar.FUNCTIONS
    path = F.struct("nodes", "edges")
    return paths.var_expand(starts, _contains(spark, d), 0, None, "trail").select("start", "node", "depth", f["path_length"](path).alias("edges"), f["is_trail"](path).alias("trail"), f["is_acyclic"](path).alias("acyclic"), f["is_simple"](path).alias("simple"))


_REACH = f"""
n AS (SELECT n_regionkey::BIGINT AS start, n_nationkey::BIGINT + {NATIONS} AS node, 1 AS depth, 1.0::DOUBLE + n_nationkey % 4 AS w FROM nation),
c AS (SELECT start, c_custkey + {CUSTOMERS} AS node, 2 AS depth, w + 1 + c_custkey % 5 AS w FROM customer JOIN n ON c_nationkey + {NATIONS} = node),
o AS (SELECT start, o_orderkey + {ORDERS} AS node, 3 AS depth, w + 1 + o_orderkey % 3 AS w FROM orders JOIN c ON o_custkey + {CUSTOMERS} = node),
a AS (SELECT DISTINCT start, start AS node, 0 AS depth, 0.0::DOUBLE AS w FROM n UNION ALL SELECT * FROM n UNION ALL SELECT * FROM c UNION ALL SELECT * FROM o)
"""


def _regions(spark, d):
    return table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("start"))


@query(f"WITH {_REACH} SELECT start, node, depth FROM a")
def bfs_depth(spark, d):
    return paths.bfs(_regions(spark, d), reach(spark, d))


@query(f"WITH RECURSIVE e AS ({_TREE}), p AS (SELECT s_suppkey + 10000 AS start, s_suppkey + 10000 AS node FROM supplier UNION SELECT start, src FROM p JOIN e ON node = dst) SELECT start, count(*) AS ancestors FROM p WHERE node <> start GROUP BY 1")
def ancestor_count(spark, d):
    starts = table(spark, d, "supplier").select((F.col("s_suppkey") + 10000).alias("start"))
    return paths.ancestors(starts, _contains(spark, d)).groupBy("start").agg(F.count(F.lit(1)).alias("ancestors"))


# -- algorithms --------------------------------------------------------------------

_PS = f"SELECT DISTINCT l_partkey AS src, l_suppkey + {SUPPLIERS} AS dst FROM lineitem"
_PN = "SELECT src AS id FROM e UNION SELECT dst FROM e"


@query(f"WITH e AS ({_PS}) SELECT id, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree, coalesce(o, 0) + coalesce(i, 0) AS degree FROM ({_PN}) LEFT JOIN (SELECT src, count(*) AS o FROM e GROUP BY 1) ON id = src LEFT JOIN (SELECT dst, count(*) AS i FROM e GROUP BY 1) ON id = dst")
def degrees(spark, d):
    return algorithms.degrees(*sells_with(spark, d))


@query(f"SELECT c_custkey AS node_id, c_custkey AS component_id FROM customer UNION ALL SELECT o_orderkey + {ORDERS}, o_custkey FROM orders")
def wcc(spark, d):
    return algorithms.wcc(*ordered(spark, d))


def _pagerank_sql(rounds: int) -> str:
    steps = [f"WITH e AS MATERIALIZED ({_PS}), k AS MATERIALIZED (SELECT src, count(*) AS k FROM e GROUP BY 1), n AS MATERIALIZED (SELECT id, count(*) OVER () AS n FROM ({_PN})), s0 AS MATERIALIZED (SELECT id, n, 1.0::DOUBLE / n AS s FROM n)"]
    for i in range(rounds):
        lost = f"(SELECT coalesce(sum(s), 0) FROM s{i} WHERE id NOT IN (SELECT src FROM k))"
        steps.append(f"s{i + 1} AS MATERIALIZED (SELECT id, n, 0.15 / n + 0.85 * {lost} / n + 0.85 * coalesce(r, 0) AS s FROM s{i} LEFT JOIN (SELECT dst, sum(s / k) AS r FROM e JOIN s{i} ON id = src JOIN k USING (src) GROUP BY dst) ON dst = id)")
    return ", ".join(steps) + f" SELECT id AS node_id, round(s, 8) AS score FROM s{rounds}"


@query(_pagerank_sql(10))
def pagerank_10(spark, d):
    return algorithms.pagerank(*sells_with(spark, d), rounds=10, tolerance=0.0).select("node_id", F.round("score", 8).alias("score"))


_OPS = f"l AS (SELECT DISTINCT l_orderkey + {ORDERS} AS o, l_partkey AS p, l_suppkey + {SUPPLIERS} AS s FROM lineitem)"


@query(f"WITH {_OPS}, t AS (SELECT x.o, x.p, y.s FROM (SELECT DISTINCT o, p FROM l) x JOIN (SELECT DISTINCT o, s FROM l) y USING (o) JOIN (SELECT DISTINCT p, s FROM l) z ON x.p = z.p AND y.s = z.s), c AS (SELECT o AS v, count(*) AS n FROM t GROUP BY 1 UNION ALL SELECT p, count(*) FROM t GROUP BY 1 UNION ALL SELECT s, count(*) FROM t GROUP BY 1) SELECT v AS node_id, n AS total FROM c")
def triangle_count(spark, d):
    edges = deliveries(spark, d)
    return algorithms.triangles(ends(edges), edges)


@query(f"WITH {_REACH} SELECT start AS source, node AS node_id, w AS distance FROM a")
def sssp(spark, d):
    return algorithms.sssp(_regions(spark, d).withColumnRenamed("start", "source"), reach(spark, d))


@query("SELECT unnest([0, n_regionkey::BIGINT + 1000, n_nationkey::BIGINT + 2000, s_suppkey + 10000]) AS node_id, 3.0::DOUBLE AS cost, unnest([0, 1, 2, 3]) AS index FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1")
def shortest_path(spark, d):
    top = table(spark, d, "region").select(F.lit(0).cast("long").alias("src"), (F.col("r_regionkey") + 1000).cast("long").alias("dst"))
    edges = top.unionAll(_contains(spark, d).select("src", "dst")).withColumn("weight", F.lit(1.0))
    return algorithms.shortest_path(edges, 0, 10001)


@query(f"SELECT least(src, dst) AS source_id, greatest(src, dst) AS target_id FROM ({_TREE})")
def bridges(spark, d):
    edges = _contains(spark, d)
    return algorithms.bridges(ends(edges), edges)


@query(f"SELECT v AS node_id FROM (SELECT src AS v FROM ({_TREE}) UNION ALL SELECT dst FROM ({_TREE})) GROUP BY v HAVING count(*) > 1")
def articulation_points(spark, d):
    edges = _contains(spark, d)
    return algorithms.articulation_points(ends(edges), edges)


@query()
def louvain(spark, d):
    return algorithms.louvain(*sells_with(spark, d))


@query(f"WITH RECURSIVE e AS ({_TREE}), p AS (SELECT DISTINCT src AS node, 0 AS level FROM e WHERE src NOT IN (SELECT dst FROM e) UNION ALL SELECT dst, level + 1 FROM p JOIN e ON node = src) SELECT node AS node_id, max(level) AS level FROM p GROUP BY node")
def topo_levels(spark, d):
    edges = _contains(spark, d)
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return algorithms.topo_levels(nodes, edges)


@query(f"SELECT c_custkey AS node_id, c_custkey AS component_id FROM customer UNION ALL SELECT o_orderkey + {ORDERS}, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE o_orderkey + {ORDERS} END FROM orders")
def scc(spark, d):
    """Finished orders point back at their customer, so each customer and these are one component."""
    nodes, edges = ordered(spark, d)
    back = edges.where("o_orderstatus = 'F'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return algorithms.scc(nodes, edges.select("src", "dst").unionAll(back))


@query("SELECT id AS node_id, row_number() OVER (ORDER BY level, r, n, id) - 1 AS position FROM (SELECT r_regionkey::BIGINT + 1000 AS id, 0 AS level, r_regionkey AS r, 0 AS n FROM region UNION ALL SELECT n_nationkey::BIGINT + 2000, 1, n_regionkey, n_nationkey FROM nation UNION ALL SELECT s_suppkey + 10000, 2, n_regionkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE level > 0 OR r IN (SELECT n_regionkey FROM nation)")
def topo_sort(spark, d):
    edges = _contains(spark, d)
    return algorithms.topo_sort(ends(edges), edges)


@query()
def label_propagation(spark, d):
    return algorithms.label_propagation(*sells_with(spark, d), rounds=5)


@query()
def betweenness(spark, d):
    nodes = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return algorithms.betweenness(nodes, _ring(spark, d)).select("node_id", F.round("score", 6).alias("score"))


# -- time series -------------------------------------------------------------------

_S = "(SELECT user_id AS entity_id, event_type AS property, epoch_us(ts) * 1000 AS timestamp, value FROM events)"


@query(f"SELECT entity_id, property, max(timestamp) AS timestamp, arg_max(value, timestamp) AS value FROM {_S} GROUP BY ALL")
def ts_latest(spark, d):
    return ts.latest(samples(spark, d))


@query(f"SELECT entity_id, property, timestamp, value FROM {_S} WHERE timestamp BETWEEN {NOW - 2 * DAY} AND {NOW}")
def ts_range(spark, d):
    return ts.value_range(samples(spark, d), NOW - 2 * DAY, NOW)


@query(f"SELECT entity_id, property, round(avg(value), 8) AS value FROM {_S} WHERE timestamp BETWEEN {NOW - 7 * DAY} AND {NOW} GROUP BY ALL")
def ts_aggregate(spark, d):
    return ts.aggregate(samples(spark, d), NOW, 7 * DAY, "avg").select("entity_id", "property", F.round("value", 8).alias("value"))


@query(f"WITH s AS (SELECT * FROM {_S}), i AS (SELECT * FROM s WHERE timestamp BETWEEN {NOW - 7 * DAY} AND {NOW}), h AS (SELECT entity_id, property, {NOW - 7 * DAY} AS timestamp, arg_max(value, timestamp) AS value FROM s WHERE timestamp < {NOW - 7 * DAY} GROUP BY ALL), a AS (SELECT * FROM i UNION ALL SELECT * FROM h WHERE (entity_id, property) IN (SELECT (entity_id, property) FROM i)), w AS (SELECT *, value * (coalesce(lead(timestamp) OVER (PARTITION BY entity_id, property ORDER BY timestamp), {NOW}) - timestamp) AS x FROM a) SELECT entity_id, property, round(sum(x) / {7 * DAY}, 6) AS value FROM w GROUP BY ALL")
def ts_twa(spark, d):
    return ts.aggregate(samples(spark, d), NOW, 7 * DAY, "twa").select("entity_id", "property", F.round("value", 6).alias("value"))


@query(f"WITH s AS (SELECT *, min(timestamp) OVER (PARTITION BY entity_id, property) AS f FROM {_S}), w AS (SELECT entity_id, property, value, f + (timestamp - f) // {DAY} * {DAY} AS window_start FROM s) SELECT entity_id, property, window_start, window_start + {DAY} AS window_end, max(value) AS value FROM w GROUP BY ALL")
def ts_window(spark, d):
    return ts.windows(samples(spark, d), DAY, "max")


@query(f"SELECT * FROM (SELECT entity_id, property, lag(timestamp) OVER w AS gap_start, timestamp AS gap_end, timestamp - lag(timestamp) OVER w AS duration_nanos FROM {_S} WINDOW w AS (PARTITION BY entity_id, property ORDER BY timestamp)) WHERE duration_nanos > {5 * DAY}")
def ts_gaps(spark, d):
    return ts.gaps(samples(spark, d), 5 * DAY)


@query(f"WITH s AS (SELECT * FROM {_S}), p AS (SELECT DISTINCT entity_id, property, {NOW}::BIGINT AS \"at\" FROM s) SELECT p.entity_id, p.property, p.\"at\", s.value, s.timestamp AS actual_timestamp, s.timestamp <> p.\"at\" AS interpolated FROM p ASOF JOIN s ON p.entity_id = s.entity_id AND p.property = s.property AND p.\"at\" >= s.timestamp")
def ts_value_at(spark, d):
    s = samples(spark, d)
    return ts.value_at(s, s.select("entity_id", "property", F.lit(NOW).alias("at")).distinct())


@query(f"WITH s AS (SELECT * FROM {_S}), p AS (SELECT DISTINCT entity_id, property, unnest(range({NOW - 4 * DAY}, {NOW} + 1, {DAY})) AS t FROM s), q AS (SELECT p.*, s.timestamp AS pt, s.value AS pv FROM p ASOF JOIN s ON p.entity_id = s.entity_id AND p.property = s.property AND p.t >= s.timestamp), n AS (SELECT q.*, s.timestamp AS nt, s.value AS nv FROM q ASOF LEFT JOIN s ON q.entity_id = s.entity_id AND q.property = s.property AND q.t <= s.timestamp) SELECT entity_id, property, t AS \"at\", round(CASE WHEN pt = t OR nt IS NULL THEN pv ELSE pv + (nv - pv) * (t - pt) / (nt - pt) END, 6) AS value FROM n")
def ts_gapfill_linear(spark, d):
    out = ts.gap_fill(samples(spark, d), NOW - 4 * DAY, NOW, DAY, "linear")
    return out.select("entity_id", "property", "at", F.round("value", 6).alias("value"))


@query(f"WITH s AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM {_S} WINDOW w AS (PARTITION BY entity_id, property)) SELECT entity_id, property, timestamp, value, round((value - m) / sd, 6) AS z_score FROM s WHERE sd > 1e-12 AND abs((value - m) / sd) > 2")
def ts_anomalies(spark, d):
    return ts.anomalies(samples(spark, d), 2.0).select("entity_id", "property", "timestamp", "value", F.round("z_score", 6).alias("z_score"))


@query(f"WITH l AS (SELECT entity_id, arg_max(value, timestamp) AS value FROM {_S} WHERE property = 'click' GROUP BY 1), z AS (SELECT *, avg(value) OVER () AS m, stddev_pop(value) OVER () AS sd FROM l) SELECT entity_id, value, round((value - m) / sd, 6) AS z_score FROM z WHERE abs((value - m) / sd) > 1.5")
def ts_peer_anomalies(spark, d):
    s = samples(spark, d).where("property = 'click'")
    return ts.peer_anomalies(s, s.select("entity_id"), 1.5).select("entity_id", "value", F.round("z_score", 6).alias("z_score"))


@query(f"SELECT property, round(sum(value), 4) AS value, count(DISTINCT entity_id) AS node_count, count(*) AS sample_count FROM {_S} WHERE entity_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1")
def ts_scoped_aggregate(spark, d):
    s = samples(spark, d)
    return ts.scoped_aggregate(s, s.where("property = 'purchase'").select("entity_id"), "sum").withColumn("value", F.round("value", 4))


@query(f"SELECT entity_id, property, timestamp // {DAY} * {DAY} AS window_start, min(value) AS min, max(value) AS max, round(avg(value), 8) AS mean, count(*) AS total FROM {_S} GROUP BY ALL")
def ts_downsample(spark, d):
    out = ts.downsample(ts.warm(samples(spark, d), DAY), 0, 1 << 62)
    return out.withColumn("mean", F.round("mean", 8))


_LATE = f"(SELECT entity_id, property, timestamp, floor(value / 50) AS value, timestamp + floor(value)::BIGINT % 4 * {DAY} AS arrival FROM {_S})"


@query(f"WITH a AS (SELECT *, max(timestamp) OVER (PARTITION BY entity_id, property ORDER BY arrival, timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM {_LATE}), s AS (SELECT *, lag(value) OVER (PARTITION BY entity_id, property ORDER BY timestamp) AS b FROM a WHERE seen IS NULL OR timestamp >= seen - {DAY // 2}) SELECT entity_id, property, timestamp, value FROM s WHERE b IS NULL OR b <> value")
def ts_ingest(spark, d):
    """Samples arrive up to three days after their time; half a day is tolerated."""
    late = F.floor("value").cast("long") % 4 * DAY
    s = samples(spark, d).withColumn("arrival", F.struct((F.col("timestamp") + late).alias("at"), "timestamp")).withColumn("value", F.floor(F.col("value") / 50).cast("double"))
    return ts.ingest(s, DAY // 2).drop("arrival")


@query(f"WITH s AS (SELECT entity_id, property, timestamp // 60000000000 * 60000000000 - 1 AS timestamp, value FROM {_S}) SELECT entity_id, property, timestamp // 60000000000 * 60000000000 AS window_start, min(value) AS min, max(value) AS max, count(*) AS count, round(CASE WHEN count(*) > 1 THEN stddev_pop(value) END, 6) AS stddev, CASE WHEN count(*) > 1 THEN quantile_disc(value, 0.5) END AS p50 FROM s GROUP BY ALL")
def ts_warm_boundary(spark, d):
    """Every sample one nanosecond before a full minute."""
    s = samples(spark, d).withColumn("timestamp", scalar.floor_to(F.col("timestamp"), 60 * ts.SECOND) - 1)
    return ts.warm(s).select("entity_id", "property", "window_start", "min", "max", "count", F.round("stddev", 6).alias("stddev"), "p50")


@query(f"WITH s AS (SELECT entity_id, property, timestamp // {7 * DAY} AS w, quantile_disc(value, 0.9) AS q, count(*) AS c FROM {_S} GROUP BY ALL HAVING count(*) > 1) SELECT a.entity_id, a.property, round(v, 6) AS value FROM (SELECT DISTINCT entity_id, property FROM {_S}) a LEFT JOIN (SELECT entity_id, property, sum(q * c) / sum(c) AS v FROM s GROUP BY ALL) b ON a.entity_id = b.entity_id AND a.property = b.property")
def ts_percentile(spark, d):
    return ts.percentile(samples(spark, d), 0.9, 7 * DAY).select("entity_id", "property", F.round("value", 6).alias("value"))


@query(f"SELECT entity_id, property, timestamp // {3600 * ts.SECOND} * {3600 * ts.SECOND} AS window_start, min(value) AS min, max(value) AS max, round(avg(value), 8) AS mean, count(*) AS total FROM {_S} GROUP BY ALL")
def ts_trends(spark, d):
    return ts.hourly(ts.warm(samples(spark, d))).withColumn("mean", F.round("mean", 8))


@query(f"SELECT entity_id, property, timestamp, CASE WHEN entity_id % 2 = 0 THEN value + 1 ELSE value END AS value FROM {_S} WHERE timestamp BETWEEN {NOW - DAY} AND {NOW}")
def ts_full_range(spark, d):
    s = samples(spark, d)
    return ts.full_range(s.where("entity_id % 2 = 0").withColumn("value", F.col("value") + 1), s, NOW - DAY, NOW)


@query(f"SELECT entity_id, property, timestamp, max(CASE WHEN property = 'click' THEN value + 1 ELSE value END) AS value FROM {_S} GROUP BY ALL")
def observation_upsert(spark, d):
    s = samples(spark, d)
    return ts.upsert(s, s.where("property = 'click'").withColumn("value", F.col("value") + 1))


# -- vectors and texts -------------------------------------------------------------

_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@query(f"SELECT a.vec_id AS node_id, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b WHERE a.vec_id <> 7 ORDER BY {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) DESC, node_id LIMIT 10")
def vector_similar(spark, d):
    return search.similar(table(spark, d, "embeddings"), "vec_id", "embedding", 7, 10).select("node_id", F.round("score", 6).alias("score"))


@query("SELECT a.vec_id AS v, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(p[1]::DOUBLE - p[2]::DOUBLE, 2)))), 5) AS dist FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_distance(spark, d):
    e = table(spark, d, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(n, "vec_id").select(F.col("vec_id").alias("v"), F.round(vector.euclidean_distance(F.col("embedding"), F.col("other")), 5).alias("dist"))


_BM = r"""
WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents), c AS (SELECT id, len(ws) AS n, len(list_filter(ws, lambda x: x = 'that')) AS t0, len(list_filter(ws, lambda x: x = 'with')) AS t1 FROM w),
s AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM c)
SELECT id AS node_id, round(score, 6) AS score FROM (SELECT id, ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / mean)) AS score FROM c, s WHERE t0 > 0 OR t1 > 0) ORDER BY score DESC, node_id LIMIT 20
"""


@query(_BM)
def text_search(spark, d):
    return search.text_search(table(spark, d, "documents"), "doc_id", "text", "with that", 20).select("node_id", F.round("score", 6).alias("score"))


_SCORED = f"(SELECT a.vec_id AS node_id, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 7) b)"
_TEXTS = _BM[: _BM.index("SELECT id AS node_id")]
_TEXT_SCORE = _BM[_BM.index("FROM (SELECT id, ln") : _BM.index(" ORDER BY score")]


@query(f"{_TEXTS.rstrip()}, t AS (SELECT id AS node_id, row_number() OVER (ORDER BY score DESC, id) AS r {_TEXT_SCORE}), v AS (SELECT node_id, row_number() OVER (ORDER BY score DESC, node_id) AS r FROM {_SCORED} WHERE node_id <> 7) SELECT node_id, round(sum(1.0 / (60 + r)), 8) AS score FROM (SELECT * FROM t WHERE r <= 20 UNION ALL SELECT * FROM v WHERE r <= 20) GROUP BY 1 ORDER BY sum(1.0 / (60 + r)) DESC, node_id LIMIT 10")
def hybrid_search(spark, d):
    text = search.text_search(table(spark, d, "documents"), "doc_id", "text", "with that", 20)
    near = search.similar(table(spark, d, "embeddings"), "vec_id", "embedding", 7, 20)
    return search.fuse(text, near, k=10).select("node_id", F.round("score", 8).alias("score"))


def _query_vector(spark, d):
    """A fixed vector of the table's dimension."""
    width = len(table(spark, d, "embeddings").first()["embedding"])
    return [((i * 7) % 11 - 5) / 5 for i in range(width)]


_Q = "(SELECT list_transform(range(len(embedding)), lambda i: ((i * 7) % 11 - 5) / 5) AS embedding FROM embeddings LIMIT 1)"
_ASKED = f"(SELECT a.vec_id AS node_id, a.label, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) AS score FROM embeddings a, {_Q} b)"


def _top(spark, d, k=10):
    return search.vector_search(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), k)


def _next_vector(spark, d):
    """Edges from every vector to the next."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"), F.col("vec_id").alias("eid")).join(e.select(F.col("vec_id").alias("dst")), "dst", "left_semi").select("src", "dst", "eid")


@query(f"SELECT node_id, round(score, 6) AS score FROM (SELECT * FROM {_ASKED} ORDER BY score DESC, node_id LIMIT 10)")
def vector_search(spark, d):
    return _top(spark, d).select("node_id", F.round("score", 6).alias("score"))


@query(f"SELECT node_id, round(score, 6) AS score FROM (SELECT * FROM {_ASKED} WHERE node_id BETWEEN 10 AND 16 ORDER BY score DESC, node_id LIMIT 4)")
def scoped_vector_search(spark, d):
    found = search.scoped_vector_search(table(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 4, spark.createDataFrame([(10,)], "start long"), _next_vector(spark, d), 6)
    return found.select("node_id", F.round("score", 6).alias("score"))


_RETRIEVED = f"h AS (SELECT node_id, score FROM {_ASKED} ORDER BY score DESC, node_id LIMIT 10), s AS (SELECT node_id + k AS node_id, score / (k + 1) AS score, CASE WHEN k = 0 THEN 'vector' ELSE 'graph' END AS source, k AS depth FROM h, range(0, 3) r(k) WHERE node_id + k IN (SELECT vec_id FROM embeddings)), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, depth, source DESC) AS r FROM s) WHERE r = 1)"


@query(f"WITH {_RETRIEVED} SELECT node_id, round(score, 6) AS score, source, depth::INTEGER AS depth FROM b")
def graph_retrieval(spark, d):
    return search.graph_retrieval(_top(spark, d), _next_vector(spark, d), 2).withColumn("score", F.round("score", 6))


@query(f"WITH {_RETRIEVED}, t AS (SELECT b.*, '[' || source || ' ' || depth || '] ' || label AS line FROM b JOIN embeddings ON node_id = vec_id ORDER BY score DESC, node_id LIMIT 5) SELECT count(*) AS nodes, string_agg(line, chr(10) ORDER BY score DESC, node_id) AS context FROM t")
def graph_context(spark, d):
    found = search.graph_retrieval(_top(spark, d), _next_vector(spark, d), 2)
    return search.context(found, table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").cast("string").alias("text")), 5)


def _communities(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.col("label").alias("community_id"))


@query(f"SELECT node_id, round(score, 6) AS score, label AS community_id, size FROM (SELECT * FROM {_ASKED} ORDER BY score DESC, node_id LIMIT 10) JOIN (SELECT label, count(*) AS size FROM embeddings GROUP BY 1) USING (label)")
def community_search(spark, d):
    return search.community_search(_top(spark, d), _communities(spark, d)).withColumn("score", F.round("score", 6))


@query(f"SELECT e.label AS community_id, round(m, 6) AS score, vec_id AS node_id, 'v' || vec_id AS label FROM embeddings e JOIN (SELECT label, max(score) AS m FROM (SELECT * FROM {_ASKED} ORDER BY score DESC, node_id LIMIT 3) GROUP BY 1) USING (label)")
def community_members(spark, d):
    names = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("label"))
    return search.community_members(_top(spark, d, 3), _communities(spark, d), names).withColumn("score", F.round("score", 6))


# -- catalog and changes -----------------------------------------------------------


_NODES = {"region": ("r_regionkey", {"r_name": "string"}), "nation": ("n_nationkey", {"n_name": "string", "n_regionkey": "int"}), "customer": ("c_custkey", {"c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}), "supplier": ("s_suppkey", {"s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}), "part": ("p_partkey", {"p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int", "p_retailprice": "double"}), "orders": ("o_orderkey", {"o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"})}
_EDGES = {"in_region": "nation", "customer_in": "customer", "supplier_in": "supplier", "placed": "orders", "contains": "lineitem", "supplied_by": "lineitem"}


@query(" UNION ALL ".join(f"SELECT '{x}' AS label FROM {x} GROUP BY 1" for x in _NODES) + " UNION ALL SELECT 'place' FROM nation GROUP BY 1 UNION ALL SELECT 'party' FROM customer GROUP BY 1")
def catalog_labels(spark, d):
    return catalog.labels(graph(spark, d))


@query(" UNION ALL ".join(f"SELECT '{label}' AS type FROM {t} GROUP BY 1" for label, t in _EDGES.items()))
def edge_types(spark, d):
    return catalog.edge_types(graph(spark, d))


@query("SELECT " + " + ".join(f"(SELECT count(*) FROM {x})" for x in _NODES) + " AS nodes, " + " + ".join(f"(SELECT count(*) FROM {x})" for x in _EDGES.values()) + " AS edges")
def graph_size(spark, d):
    g = graph(spark, d)
    return catalog.node_count(g).withColumnRenamed("total", "nodes").crossJoin(catalog.edge_count(g).withColumnRenamed("total", "edges"))  # one row each


@query(" UNION ALL ".join(f"SELECT '{label}' AS label, '{c}' AS property, '{kind}' AS inferred_type, round(1 - count({c}) / count(*), 8) AS null_rate, round(count(DISTINCT {c}) / count({c}), 8) AS unique_rate, count(*) AS sample_size FROM {label}" for label, (_, columns) in _NODES.items() for c, kind in columns.items()))
def discover_schema(spark, d):
    return catalog.discover_schema(graph(spark, d)).withColumn("null_rate", F.round("null_rate", 8)).withColumn("unique_rate", F.round("unique_rate", 8))


_TYPES = {"customer": (catalog.Property("c_custkey", "INT", required=True, unique=True), catalog.Property("c_acctbal", "FLOAT", low=0), catalog.Property("c_mktsegment", "STRING", allowed=("BUILDING", "MACHINERY"))), "region": (catalog.Property("r_name", "STRING", required=True, immutable=True),)}


@query("SELECT * FROM (VALUES ('customer', 'unique', 'c_custkey', 'Property ''c_custkey'' must be unique'), ('customer', 'range', 'c_acctbal', 'Property ''c_acctbal'' must be >= 0'), ('customer', 'enum', 'c_mktsegment', 'Property ''c_mktsegment'' must be one of 2 allowed values'), ('region', 'immutable', 'r_name', 'Property ''r_name'' cannot be changed after creation')) t(label, constraint_type, properties, description)")
def graph_constraints(spark, d):
    return catalog.constraints(spark, _TYPES)


@query("SELECT * FROM (VALUES ('c_custkey', 'INT', true, NULL::VARCHAR), ('c_acctbal', 'FLOAT', false, NULL), ('c_mktsegment', 'STRING', false, NULL)) t(property, value_type, required, \"default\")")
def graph_schema(spark, d):
    return catalog.schema(spark, _TYPES, "customer")


@query("SELECT '(:customer {c_custkey: INT required unique, c_acctbal: FLOAT, c_mktsegment: STRING})' || chr(10) || '(:region {r_name: STRING required})' || chr(10) || '(:orders)-[:contains]->(:part)' || chr(10) || '(:customer)-[:customer_in]->(:nation)' || chr(10) || '(:nation)-[:in_region]->(:region)' || chr(10) || '(:customer)-[:placed]->(:orders)' || chr(10) || '(:orders)-[:supplied_by]->(:supplier)' || chr(10) || '(:supplier)-[:supplier_in]->(:nation)' AS schema")
def schema_dump(spark, d):
    return catalog.schema_dump(spark, _TYPES, graph(spark, d))


@query("SELECT 'delete_duplicate_edges' AS action, '(orders:' || l_orderkey || ')-[:contains]->(part:' || l_partkey || '): keep 1, remove ' || (count(*) - 1) AS detail FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1 UNION ALL SELECT 'delete_duplicate_edges', '(orders:' || l_orderkey || ')-[:supplied_by]->(supplier:' || l_suppkey || '): keep 1, remove ' || (count(*) - 1) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1")
def graph_repair(spark, d):
    return catalog.repair(graph(spark, d))


@query("WITH n AS (SELECT ['orders', 'x'] AS labels, epoch(o_orderdate)::BIGINT AS c, epoch(o_orderdate)::BIGINT + o_orderkey % 1000 * 86400 AS u FROM orders), e AS (SELECT epoch(l_shipdate)::BIGINT AS c FROM lineitem) SELECT 'node' AS entity_type, CASE WHEN c >= 820454400 THEN 'created' ELSE 'updated' END AS change_type, 'orders' AS label, count(*) AS total FROM n WHERE c >= 820454400 OR u >= 820454400 GROUP BY 2 UNION ALL SELECT 'edge', 'created', 'contains', count(*) FROM e WHERE c >= 820454400 HAVING count(*) > 0")
def graph_diff(spark, d):
    o = table(spark, d, "orders")
    made = scalar.extract("EPOCH", F.col("o_orderdate"))
    nodes = o.select(F.array(F.lit("orders"), F.lit("x")).alias("labels"), made.alias("created_at"), (made + F.col("o_orderkey") % 1000 * 86400).alias("updated_at"))
    edges = table(spark, d, "lineitem").select(F.lit("contains").alias("label"), scalar.extract("EPOCH", F.col("l_shipdate")).alias("created_at"))
    return catalog.diff(nodes, edges, 820454400)


_VERSIONS = f"v AS (SELECT entity_id AS node_id, property AS key, value, timestamp, lead(timestamp) OVER (PARTITION BY entity_id, property ORDER BY timestamp, value) AS superseded_at FROM {_S})"


def _versions(spark, d):
    """(current properties, superseded values) of the events."""
    s = samples(spark, d).select(F.col("entity_id").alias("node_id"), F.col("property").alias("key"), "value", "timestamp")
    v = s.withColumn("superseded_at", F.lead("timestamp").over(Window.partitionBy("node_id", "key").orderBy("timestamp", "value")))
    return v.where("superseded_at IS NULL").select("node_id", "key", "value", F.col("timestamp").alias("updated_at")), v.where("superseded_at IS NOT NULL").drop("timestamp")


@query(f"WITH {_VERSIONS}, o AS (SELECT node_id, key, arg_min(value, superseded_at) AS old FROM v WHERE superseded_at > {NOW} GROUP BY ALL) SELECT c.node_id, c.key, CASE WHEN c.timestamp <= {NOW} THEN c.value ELSE old END AS value FROM (SELECT * FROM v WHERE superseded_at IS NULL) c LEFT JOIN o ON o.node_id = c.node_id AND o.key = c.key WHERE c.timestamp <= {NOW} OR old IS NOT NULL")
def property_at(spark, d):
    return catalog.property_at(*_versions(spark, d), NOW)


@query(f"WITH {_VERSIONS} SELECT node_id, key, value, superseded_at FROM v WHERE superseded_at BETWEEN {NOW - DAY} AND {NOW}")
def property_history(spark, d):
    return catalog.property_history(_versions(spark, d)[1], NOW - DAY, NOW)


@query(f"WITH {_VERSIONS}, h AS (SELECT *, lead(value) OVER (PARTITION BY node_id, key ORDER BY superseded_at NULLS LAST, value) AS new_value FROM v) SELECT node_id, 'set' AS change_type, key, value AS old_value, new_value, superseded_at AS timestamp FROM h WHERE superseded_at BETWEEN {NOW - 2 * DAY} AND {NOW}")
def graph_history(spark, d):
    return catalog.history(*_versions(spark, d), start=NOW - 2 * DAY, end=NOW)


@query("SELECT s_suppkey AS node_id, 'balance' AS key, CASE WHEN s_suppkey % 3 >= s_suppkey % 2 THEN s_acctbal ELSE -1.0 END AS value FROM supplier")
def merge_last_write(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit("balance").alias("key"), F.col("s_acctbal").alias("value"))
    return catalog.merge_last_write(s.withColumn("clock", F.col("node_id") % 3), s.withColumn("value", F.lit(-1.0)).withColumn("clock", F.col("node_id") % 2))


@query("SELECT s_suppkey AS k, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS balance FROM supplier")
def remove_properties(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    return mutations.remove_properties(s, F.col("balance") < 0, "balance")


@query("SELECT s_suppkey::VARCHAR AS id, 'supplier' AS label, s_name AS name, s_nationkey::VARCHAR AS nation FROM supplier")
def json_graph(spark, d):
    """Nodes and edges as JSON objects and back."""
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("label"), "s_name")
    edges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("src"), F.lit("supplier_in").alias("label"), F.col("s_nationkey").alias("dst"))
    n, e = files.from_json_graph(files.to_json_graph(nodes, edges))
    return n.join(e.select(F.col("src").alias("id"), "dst"), "id").select("id", "label", F.try_element_at("props", F.lit("s_name")).alias("name"), F.col("dst").alias("nation"))


@query("SELECT 'customer' AS kind, count(*) AS total FROM customer UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer_in', count(*) FROM customer")
def slice_by_labels(spark, d):
    g = files.slice_by_labels(graph(spark, d), ["customer", "nation"])
    counts = g.all_nodes().select(F.col("label").alias("kind")).unionAll(g.all_edges().select("label"))
    return counts.groupBy("kind").agg(F.count(F.lit(1)).alias("total"))


@query(f"SELECT n_nationkey::BIGINT + 2000 AS src, s_suppkey + 10000 AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1 UNION ALL SELECT 1001, n_nationkey + 2000 FROM nation WHERE n_regionkey = 1")
def slice_by_containment(spark, d):
    tree = _contains(spark, d)
    return files.slice_by_containment(spark.createDataFrame([(1001,)], "start long"), tree, tree)[1].select("src", "dst")


@query("SELECT s_suppkey AS s, 'urn:graph:node/' || s_nationkey AS nation, CASE WHEN s_acctbal > 5000 THEN s_name END AS rich FROM supplier")
def rdf_patterns(spark, d):
    """Triples of the suppliers, a basic pattern and an optional one."""
    s = table(spark, d, "supplier")
    nodes = s.select((F.col("s_suppkey") + 1000).alias("id"), F.array(F.lit("supplier")).alias("labels"), F.create_map(F.lit("key"), F.col("s_suppkey").cast("string"), F.lit("rich"), F.when(F.col("s_acctbal") > 5000, F.col("s_name"))).alias("props"))
    triples = files.to_triples(nodes, s.select((F.col("s_suppkey") + 1000).alias("src"), F.lit("in").alias("label"), F.col("s_nationkey").alias("dst")))
    found = files.basic_pattern(triples, ("?x", files.RDF_TYPE, "urn:graph:type/supplier"), ("?x", "urn:graph:prop/key", "?k"), ("?x", "urn:graph:rel/in", "?n"))
    both = files.optional_pattern(found, files.basic_pattern(triples, ("?x", "urn:graph:prop/rich", "?r")))
    return both.select(F.col("k").cast("long").alias("s"), F.col("n").alias("nation"), F.col("r").alias("rich"))


@query("SELECT 'dangling_edges' AS \"check\", 'ok' AS status, 0::BIGINT AS total UNION ALL SELECT 'duplicate_edges', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END, n FROM (SELECT (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)) + (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1)) AS n) UNION ALL SELECT 'orphaned_nodes', CASE WHEN n > 0 THEN 'warning' ELSE 'ok' END, n FROM (SELECT (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)) AS n)")
def validate(spark, d):
    return catalog.validate(graph(spark, d))


@query("SELECT c_custkey::VARCHAR AS node_id, 'c_acctbal.min' AS rule FROM customer WHERE c_acctbal < 0 UNION ALL SELECT c_custkey::VARCHAR, 'c_mktsegment.allowed' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def schema_audit(spark, d):
    rules = catalog.rule("c_acctbal", required=True, low=0) | catalog.rule("c_mktsegment", allowed=["BUILDING", "MACHINERY"])
    return catalog.violations(table(spark, d, "customer"), "c_custkey", rules, unique=["c_name"])


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS balance FROM supplier WHERE s_nationkey <> 3 UNION ALL SELECT 100000 + n_nationkey, 0.0 FROM nation WHERE n_nationkey < 2")
def mutate(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"), "s_nationkey")
    s = mutations.set_properties(s, F.col("k") % 4 == 0, balance=F.col("balance") + 1)
    s = mutations.delete(s, "k", s.where("s_nationkey = 3").select("k")).drop("s_nationkey")
    return mutations.insert(s, table(spark, d, "nation").where("n_nationkey < 2").select((F.col("n_nationkey") + 100000).cast("long").alias("k"), F.lit(0.0).alias("balance")))


@query("SELECT s_suppkey AS k, CASE WHEN s_suppkey BETWEEN 1 AND 10 THEN -1.0 ELSE s_acctbal END AS balance FROM supplier UNION ALL SELECT k, -1.0 FROM (SELECT unnest(range(1, 11)) AS k UNION ALL SELECT unnest(range(1, 11)) * 1000000) WHERE k NOT IN (SELECT s_suppkey FROM supplier)")
def merge(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("balance"))
    new = spark.range(1, 11).select(F.explode(F.array("id", F.col("id") * 1000000)).alias("k"), F.lit(-1.0).alias("balance"))
    return mutations.merge(s, new, ["k"], {"balance": F.col("new_balance")})
