"""What a graph holds: labels, counts, discovered schemas, differences, audits and versions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from pgspark.graph import Graph
from pgspark.plans.rounds import materialise


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def labels(graph: Graph) -> DataFrame:
    """(label): the distinct labels that nodes carry."""
    return graph.all_nodes().select(F.explode("labels").alias("label")).distinct()


def edge_types(graph: Graph) -> DataFrame:
    return graph.all_edges().select(F.col("label").alias("type")).distinct()


def node_count(graph: Graph) -> DataFrame:
    return graph.all_nodes().agg(F.count(F.lit(1)).alias("total"))


def edge_count(graph: Graph) -> DataFrame:
    return graph.all_edges().agg(F.count(F.lit(1)).alias("total"))


def discover_schema(graph: Graph) -> DataFrame:
    """(label, property, inferred_type, null_rate, unique_rate, sample_size): one pass per label."""
    out = []
    for name, t in graph.nodes.items():
        props = [(c, k) for c, k in t.df.dtypes if c != t.key]
        counts = [F.count(c).alias(f"n{i}") for i, (c, _) in enumerate(props)] + [F.countDistinct(c).alias(f"d{i}") for i, (c, _) in enumerate(props)]
        one = t.df.agg(F.count(F.lit(1)).alias("total"), *counts)
        rows = F.explode(F.array(*[F.struct(F.lit(name).alias("label"), F.lit(c).alias("property"), F.lit(k).alias("inferred_type"), F.col(f"n{i}").alias("n"), F.col(f"d{i}").alias("d")) for i, (c, k) in enumerate(props)]))
        out.append(one.select("total", rows.alias("r")).select("r.label", "r.property", "r.inferred_type", (1 - F.col("r.n") / F.nullif("total", F.lit(0))).alias("null_rate"), (F.col("r.d") / F.nullif("r.n", F.lit(0))).alias("unique_rate"), F.col("total").alias("sample_size")))
    return _union(out)


def diff(nodes: DataFrame, edges: DataFrame, since: int) -> DataFrame:
    """(entity_type, change_type, label, total) of ``nodes(labels, created_at, updated_at)`` and ``edges(label, created_at)``; a node counts by its first label."""
    change = F.when(F.col("created_at") >= since, "created").when(F.col("updated_at") >= since, "updated")
    n = nodes.select(F.lit("node").alias("entity_type"), change.alias("change_type"), F.get("labels", F.lit(0)).alias("label"))
    e = edges.select(F.lit("edge").alias("entity_type"), F.when(F.col("created_at") >= since, "created").alias("change_type"), "label")
    return n.unionAll(e).where("change_type IS NOT NULL").groupBy("entity_type", "change_type", "label").agg(F.count(F.lit(1)).alias("total"))


def _unmatched(graph: Graph) -> DataFrame:
    """(label, id, nodes): keys of which there are nodes only (with their number) or ends of edges only (0), by one grouping of each label's keys.

    Keys stay in their own type, and become text only here, where few are left.
    """
    ends = {}  # the same column of the same table counts once, whichever edges it serves
    for e in graph.edges.values():
        for c, label in ((e.src, e.src_label), (e.dst, e.dst_label)):
            ends.setdefault(label, {})[id(e.df), c] = e.df.select(F.col(c).alias("id"), F.lit(0).alias("node"))
    parts = []
    for name in sorted({*graph.nodes, *ends}):
        keys = list(ends.get(name, {}).values())
        if name in graph.nodes:
            keys.append(graph.nodes[name].df.select(F.col(graph.nodes[name].key).alias("id"), F.lit(1).alias("node")))
        if not all(_comparable(x.schema["id"].dataType, keys[0].schema["id"].dataType) for x in keys):
            keys = [x.select(F.col("id").cast("string").alias("id"), "node") for x in keys]
        seen = _union(keys).groupBy("id").agg(F.sum("node").alias("nodes"), F.min("node").alias("least"), F.max("node").alias("most"))
        parts.append(seen.where("least = most").select(F.lit(name).alias("label"), F.col("id").cast("string").alias("id"), "nodes"))
    return _union(parts)


def _comparable(a: DataType, b: DataType) -> bool:
    """Whether keys of both types are equal just when their texts are."""
    return a == b or (isinstance(a, IntegralType) and isinstance(b, IntegralType))


def _dangling(graph: Graph, unmatched: DataFrame) -> DataFrame:
    """(label, src_label, src, dst_label, dst): the different edges with an end that is no node; ends are texts."""
    lost = unmatched.where("nodes = 0")
    parts = []
    for name, e in graph.edges.items():
        pairs = e.df.select(F.col(e.src).cast("string").alias("src"), F.col(e.dst).cast("string").alias("dst"))
        for c, label in (("src", e.src_label), ("dst", e.dst_label)):
            keys = lost.where(F.col("label") == label).select(F.col("id").alias("_lost"))
            found = pairs.join(keys, pairs[c].eqNullSafe(keys["_lost"]), "left_semi")
            parts.append(found.select(F.lit(name).alias("label"), F.lit(e.src_label).alias("src_label"), "src", F.lit(e.dst_label).alias("dst_label"), "dst"))
    return _union(parts).distinct()


def _repeated(graph: Graph) -> DataFrame:
    """(label, src_label, src, dst_label, dst, total): pairs of ends with several edges of one label, grouped by their own keys."""
    from pgspark.plans import algorithms

    parts = []
    for name, e in graph.edges.items():
        again = algorithms.duplicates(e.df.select(F.col(e.src).alias("src"), F.col(e.dst).alias("dst")), "src", "dst")
        parts.append(again.select(F.lit(name).alias("label"), F.lit(e.src_label).alias("src_label"), F.col("src").cast("string").alias("src"), F.lit(e.dst_label).alias("dst_label"), F.col("dst").cast("string").alias("dst"), "total"))
    return _union(parts)


def validate(graph: Graph) -> DataFrame:
    """(check, status, total): dangling edges, duplicate edges (a warning), orphaned nodes."""
    unmatched = materialise(_unmatched(graph), "unmatched")
    count = F.count(F.lit(1))
    bad = {"dangling_edges": (_dangling(graph, unmatched), count), "duplicate_edges": (_repeated(graph), count), "orphaned_nodes": (unmatched.where("nodes > 0"), F.coalesce(F.sum("nodes"), F.lit(0)))}
    severity = {"dangling_edges": "error", "duplicate_edges": "warning", "orphaned_nodes": "warning"}
    return _union([df.agg(total.alias("total")).select(F.lit(k).alias("check"), F.when(F.col("total") == 0, "ok").otherwise(severity[k]).alias("status"), "total") for k, (df, total) in bad.items()])


def procedures(spark: SparkSession) -> DataFrame:
    """(name, params, summary): the public functions of the plans."""
    import inspect

    from pgspark.plans import algorithms, search, timeseries

    rows = []
    for module in (algorithms, search, timeseries):
        short = module.__name__.rpartition(".")[2]
        for name, f in inspect.getmembers(module, inspect.isfunction):
            if f.__module__ == module.__name__ and not name.startswith("_"):
                rows.append((f"{short}.{name}", list(inspect.signature(f).parameters), (f.__doc__ or "").strip().split("\n")[0]))
    return spark.createDataFrame(rows, "name string, params array<string>, summary string")


# -- schema rules -----------------------------------------------------------------


def rule(column: str, required: bool = False, low=None, high=None, min_length: int | None = None, max_length: int | None = None, allowed: list | None = None, pattern: str | None = None) -> dict[str, Column]:
    """The conditions a property has to meet, by name; a null meets all but ``required``."""
    c, out = F.col(column), {}
    if required:
        out["required"] = c.isNotNull()
    for name, value, test in (("min", low, lambda v: c >= v), ("max", high, lambda v: c <= v), ("min_length", min_length, lambda v: F.length(c) >= v), ("max_length", max_length, lambda v: F.length(c) <= v), ("allowed", allowed, lambda v: c.isin(v)), ("pattern", pattern, lambda v: c.rlike(v))):
        if value is not None:
            out[name] = c.isNull() | test(value)
    return {f"{column}.{k}": v for k, v in out.items()}


def violations(df: DataFrame, key: str, rules: dict[str, Column], unique: list[str] = ()) -> DataFrame:
    """(node_id, rule): every broken rule of every row; the table is read once for all row rules."""
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    out = df.select(F.col(key).cast("string").alias("node_id"), F.explode(broken).alias("rule"))
    for c in unique:
        again = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(c)
        out = out.unionAll(df.join(again, c, "left_semi").select(F.col(key).cast("string").alias("node_id"), F.lit(f"{c}.unique").alias("rule")))
    return out


@dataclass(frozen=True)
class Property:
    """One declared property of a node type."""

    name: str
    value_type: str
    required: bool = False
    unique: bool = False
    immutable: bool = False
    low: float | None = None
    high: float | None = None
    allowed: tuple = ()
    default: str | None = None

    def rules(self) -> dict[str, Column]:
        return rule(self.name, self.required, self.low, self.high, allowed=list(self.allowed) or None)

    def constraints(self) -> list[tuple[str, str]]:
        """(type, description) of what values have to meet."""
        out = [("unique", f"Property '{self.name}' must be unique")] if self.unique else []
        if self.immutable:
            out.append(("immutable", f"Property '{self.name}' cannot be changed after creation"))
        if self.low is not None or self.high is not None:
            sides = [f"{sign} {x}" for sign, x in ((">=", self.low), ("<=", self.high)) if x is not None]
            out.append(("range", f"Property '{self.name}' must be " + (f"in range [{self.low}, {self.high}]" if len(sides) == 2 else sides[0])))
        if self.allowed:
            out.append(("enum", f"Property '{self.name}' must be one of {len(self.allowed)} allowed values"))
        return out


Types = dict[str, tuple[Property, ...]]


def schema(spark: SparkSession, types: Types, label: str) -> DataFrame:
    """(property, value_type, required, default) of a declared label; no rows for another."""
    rows = [(p.name, p.value_type, p.required, p.default) for p in types.get(label, ())]
    return spark.createDataFrame(rows, "property string, value_type string, required boolean, default string")


def constraints(spark: SparkSession, types: Types) -> DataFrame:
    """(label, constraint_type, properties, description) of all declared types."""
    rows = [(label, kind, p.name, said) for label, properties in types.items() for p in properties for kind, said in p.constraints()]
    return spark.createDataFrame(rows, "label string, constraint_type string, properties string, description string")


def schema_dump(spark: SparkSession, types: Types, graph: Graph) -> DataFrame:
    """(schema): one text of all declared node types and the graph's edge types, in the order of their labels."""
    nodes = [f"(:{label} {{" + ", ".join(p.name + ": " + p.value_type + " required" * p.required + " unique" * p.unique for p in types[label]) + "})" for label in sorted(types)]
    edges = [f"(:{t.src_label})-[:{label}]->(:{t.dst_label})" for label, t in sorted(graph.edges.items())]
    return spark.createDataFrame([("\n".join(nodes + edges),)], "schema string")


def repair(graph: Graph) -> DataFrame:
    """(action, detail): what would mend the graph, without doing it: edges to delete as an end is missing, and repeats of an edge to delete."""
    end = lambda side: F.concat_ws(":", f"{side}_label", side)
    named = F.concat(F.lit("("), end("src"), F.lit(")-[:"), "label", F.lit("]->("), end("dst"), F.lit(")"))
    lost = _dangling(graph, materialise(_unmatched(graph), "unmatched")).select(F.lit("delete_dangling_edge").alias("action"), F.concat(named, F.lit(": an end is missing")).alias("detail"))
    again = _repeated(graph).select(F.lit("delete_duplicate_edges").alias("action"), F.concat(named, F.lit(": keep 1, remove "), (F.col("total") - 1).cast("string")).alias("detail"))
    return lost.unionAll(again)


# -- versions ----------------------------------------------------------------------


def property_at(current: DataFrame, versions: DataFrame, at: int) -> DataFrame:
    """(node_id, key, value): each property as of ``at``.

    ``current`` is (node_id, key, value, updated_at), ``versions`` is (node_id,
    key, value, superseded_at). At or after the last update the current value
    holds, before it the oldest version superseded later than ``at``.
    """
    old = versions.where(F.col("superseded_at") > at).groupBy("node_id", "key").agg(F.min_by("value", "superseded_at").alias("old"))
    now = current.withColumn("_live", F.col("updated_at") <= at)
    joined = now.join(old, ["node_id", "key"], "left")
    return joined.where("_live OR old IS NOT NULL").select("node_id", "key", F.when(F.col("_live"), F.col("value")).otherwise(F.col("old")).alias("value"))


def property_history(versions: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    out = versions if start is None else versions.where(F.col("superseded_at") >= start)
    return out if end is None else out.where(F.col("superseded_at") <= end)


def history(current: DataFrame, versions: DataFrame, nodes: DataFrame | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """(node_id, change_type, key, old_value, new_value, timestamp): every change of a property, of ``nodes(node_id)`` or of all.

    ``current`` and ``versions`` are as in ``property_at``; a change is ``set``, or ``removed`` where no value followed.
    """
    rows = versions.select("node_id", "key", "value", F.col("superseded_at").alias("at")).unionByName(current.select("node_id", "key", "value", F.lit(None).cast("long").alias("at")))
    rows = rows if nodes is None else rows.join(nodes.select("node_id").distinct(), "node_id", "left_semi")
    follows = F.lead("value").over(Window.partitionBy("node_id", "key").orderBy(F.col("at").asc_nulls_last(), "value"))
    out = rows.withColumn("new_value", follows).where("at IS NOT NULL")
    out = out if start is None else out.where(F.col("at") >= start)
    out = out if end is None else out.where(F.col("at") <= end)
    return out.select("node_id", F.when(F.col("new_value").isNull(), "removed").otherwise("set").alias("change_type"), "key", F.col("value").alias("old_value"), "new_value", F.col("at").alias("timestamp"))


def merge_last_write(*sides: DataFrame, keys: tuple[str, ...] = ("node_id", "key")) -> DataFrame:
    """(keys, value): per property the value with the latest clock; of equal clocks the first side wins."""
    marked = _union([s.select(*keys, "value", "clock", F.lit(-i).alias("_side")) for i, s in enumerate(sides)])
    return marked.groupBy(*keys).agg(F.max_by("value", F.struct("clock", "_side")).alias("value"))
