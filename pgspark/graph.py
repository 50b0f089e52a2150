"""A property graph over ordinary tables.

Each node label and each edge label is one DataFrame. Nothing is copied: a
pattern becomes joins on the key columns and Catalyst prunes the columns that a
query does not use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pgspark.plans.rounds import materialise

#: Matches of one value from which ``Bindings.join`` deals its rows.
DEAL_ROWS = 1 << 20


@dataclass(frozen=True)
class NodeTable:
    """Nodes of one label; ``also`` are further labels that all of them carry."""

    df: DataFrame
    key: str
    also: tuple[str, ...] = ()


@dataclass(frozen=True)
class EdgeTable:
    """Edges of one label. Parallel edges stay: the table is never deduplicated."""

    df: DataFrame
    src: str
    dst: str
    src_label: str
    dst_label: str
    key: str | None = None


class Label:
    """A label expression: ``Label("a") & ~Label("b") | Label.any()``."""

    def __init__(self, test):
        self.test = test if callable(test) else lambda labels, name=test: F.array_contains(labels, name)

    @staticmethod
    def any() -> Label:
        return Label(lambda labels: F.lit(True))

    def __and__(self, other: Label) -> Label:
        return Label(lambda labels: self.test(labels) & other.test(labels))

    def __or__(self, other: Label) -> Label:
        return Label(lambda labels: self.test(labels) | other.test(labels))

    def __invert__(self) -> Label:
        return Label(lambda labels: ~self.test(labels))


@dataclass
class Graph:
    nodes: dict[str, NodeTable] = field(default_factory=dict)
    edges: dict[str, EdgeTable] = field(default_factory=dict)
    views: dict[str, DataFrame] = field(default_factory=dict)

    def view(self, name: str, **yields: str) -> Bindings:
        """``MATCH VIEW name YIELD``: the rows of a materialised view; ``yields`` gives each new name its column."""
        df = self.views[name]
        return Bindings(self, df.select(*[F.col(c).alias(new) for new, c in yields.items()]) if yields else df, {})

    def all_nodes(self) -> DataFrame:
        """(label, id, labels): every node; ids are strings, as keys differ in type between labels."""
        parts = [t.df.select(F.lit(name).alias("label"), F.col(t.key).cast("string").alias("id"), F.array(*[F.lit(x) for x in sorted({name, *t.also})]).alias("labels")) for name, t in self.nodes.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def all_edges(self) -> DataFrame:
        """(label, src_label, src, dst_label, dst): every edge, with ids as in ``all_nodes``."""
        parts = [t.df.select(F.lit(name).alias("label"), F.lit(t.src_label).alias("src_label"), F.col(t.src).cast("string").alias("src"), F.lit(t.dst_label).alias("dst_label"), F.col(t.dst).cast("string").alias("dst")) for name, t in self.edges.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def scan(self, expression: Label) -> DataFrame:
        """Nodes whose labels satisfy an expression."""
        return self.all_nodes().where(expression.test(F.col("labels")))

    def match(self, var: str, label: str) -> Bindings:
        """Rows of one variable: ``var`` is the node's key, ``var__p`` its properties."""
        return Bindings(self, self._node(var, label), {var: label})

    def _node(self, var: str, label: str) -> DataFrame:
        t = self.nodes[label]
        return t.df.select(F.col(t.key).alias(var), *[F.col(c).alias(f"{var}__{c}") for c in t.df.columns if c != t.key])


def prop(name: str) -> Column:
    """``prop("n.p")`` is property p of variable n; ``prop("n")`` is its key."""
    return F.col(name.replace(".", "__", 1))


class Bindings:
    """Rows of pattern variables. Every method returns new bindings; nothing runs until an action."""

    def __init__(self, graph: Graph, df: DataFrame, labels: dict[str, str], edge_vars: dict[str, str] | None = None):
        self.graph, self.df, self.labels, self.edge_vars = graph, df, labels, edge_vars or {}

    def _with(self, df: DataFrame, labels: dict[str, str] | None = None, edge_vars: dict[str, str] | None = None) -> Bindings:
        return Bindings(self.graph, df, self.labels if labels is None else labels, self.edge_vars if edge_vars is None else edge_vars)

    # -- expansion -------------------------------------------------------------

    def _hop(self, src: str, edge: str, dst: str, direction: str, edge_var: str | None) -> tuple[DataFrame, str]:
        """(edge rows with columns src, dst and the edge's properties, label at the far end)."""
        t = self.graph.edges[edge]
        props = [F.col(c).alias(f"{edge_var}__{c}") for c in t.df.columns] if edge_var else []
        out = t.df.select(F.col(t.src).alias(src), F.col(t.dst).alias(dst), *props)
        back = t.df.select(F.col(t.dst).alias(src), F.col(t.src).alias(dst), *props)
        if direction == "out":
            return out, t.dst_label
        if direction == "in":
            return back, t.src_label
        if t.src_label != t.dst_label:
            return (out, t.dst_label) if self.labels[src] == t.src_label else (back, t.src_label)
        return out.unionAll(back.where(F.col(src) != F.col(dst))), t.dst_label  # a self-loop is one edge either way

    def expand(self, src: str, edge: str, dst: str, direction: str = "out", edge_var: str | None = None, ordered_pairs: bool = False, distinct: bool = False) -> Bindings:
        """One hop from a bound variable to a new one: two equi-joins.

        ``distinct`` asks for one row of each pair of ends, however many edges join them.

        If ``dst`` is bound already the hop closes a cycle: with an edge variable
        all its edges are bound, without one it is a semi-join. An undirected hop
        between equal labels keeps one of each mirrored pair, the one with the
        smaller key first, unless ``ordered_pairs`` asks for both.
        """
        rows, label = self._hop(src, edge, dst, direction, edge_var)
        mirrored = direction == "any" and self.labels[src] == label and not ordered_pairs
        if mirrored:
            rows = rows.where(F.col(src) < F.col(dst))
        if distinct:
            rows = rows.select(src, dst).distinct()
        edge_vars = self.edge_vars | ({edge_var: edge} if edge_var else {})
        if dst in self.labels:
            return self._with(self.df.join(rows, [src, dst], "inner" if edge_var else "left_semi"), edge_vars=edge_vars)
        joined = self.df.join(rows, src).join(self.graph._node(dst, label), dst)
        return self._with(joined, self.labels | {dst: label}, edge_vars)

    def where(self, condition: Column | str) -> Bindings:
        return self._with(self.df.where(condition))

    def let(self, **columns: Column) -> Bindings:
        return self._with(self.df.withColumns(columns))

    # -- joins of patterns -----------------------------------------------------

    def _shared(self, other: Bindings) -> list[str]:
        return [v for v in self.labels if v in other.labels]

    def _fresh(self, other: Bindings, shared: list[str]) -> DataFrame:
        repeated = [c for c in other.df.columns if c in self.df.columns and c not in shared]
        return other.df.drop(*repeated)

    def join(self, other: Bindings, many: bool = False) -> Bindings:
        """Both patterns, equal in the shared variables.

        ``many`` says that single values may have many rows on both sides: values
        of more than ``DEAL_ROWS`` matches are counted first, and their left rows
        dealt to parts that each meet a copy of the right ones.
        """
        shared = self._shared(other)
        if not shared:
            raise ValueError("the patterns share no variable; say cross() if all combinations are meant")
        left, right, on = self.df, self._fresh(other, shared), shared
        if many:
            left, right, on = self._dealt(left, right, shared)
        joined = left.join(right, on)
        return self._with(joined.drop("_part") if many else joined, self.labels | other.labels, self.edge_vars | other.edge_vars)

    def _dealt(self, left: DataFrame, right: DataFrame, shared: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides with the part of each row, in as many partitions as there are parts."""
        counts = [df.groupBy(*shared).agg(F.count(F.lit(1)).cast("double").alias(n)) for df, n in ((left, "_l"), (right, "_r"))]
        often = counts[0].join(counts[1], shared).where(F.col("_l") * F.col("_r") > DEAL_ROWS).select(*shared, F.least("_l", F.ceil(F.col("_l") * F.col("_r") / DEAL_ROWS)).cast("int").alias("_parts"))
        often = materialise(often, "join-parts")  # at most a row for each DEAL_ROWS of the result
        total = often.agg(F.coalesce(F.sum("_parts"), F.lit(0))).first()[0]
        parts = F.coalesce("_parts", F.lit(1))
        left = left.join(F.broadcast(often), shared, "left").withColumn("_part", F.pmod(F.xxhash64(*self.labels), parts.cast("long")).cast("int")).drop("_parts")
        right = right.join(F.broadcast(often), shared, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
        n = max(total, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return left.repartition(n, *shared, "_part"), right.repartition(n, *shared, "_part"), [*shared, "_part"]

    def cross(self, other: Bindings, most_rows: int = 100_000) -> Bindings:
        """All combinations, refused above ``most_rows``; one side is counted first and must be small."""
        n = other.df.limit(most_rows + 1).count()
        if n > most_rows or n * self.df.limit(most_rows + 1).count() > most_rows:
            raise ValueError(f"more than {most_rows} combinations")
        return self._with(self.df.crossJoin(other.df), self.labels | other.labels, self.edge_vars | other.edge_vars)

    def optional(self, other: Bindings) -> Bindings:
        """Left outer: ``other`` keeps its own conditions; later ``where`` sees the nulls."""
        shared = self._shared(other)
        return self._with(self.df.join(self._fresh(other, shared), shared, "left_outer"), self.labels | other.labels, self.edge_vars | other.edge_vars)

    def exists(self, other: Bindings) -> Bindings:
        shared = self._shared(other)
        return self._with(self.df.join(other.df.select(*shared), shared, "left_semi"))

    def not_exists(self, other: Bindings) -> Bindings:
        shared = self._shared(other)
        return self._with(self.df.join(other.df.select(*shared), shared, "left_anti"))

    def count_of(self, other: Bindings, name: str) -> Bindings:
        """The number of matches of a correlated pattern, 0 where there is none."""
        shared = self._shared(other)
        counts = other.df.groupBy(*shared).agg(F.count(F.lit(1)).alias("_count"))
        joined = self.df.join(counts, shared, "left").withColumn(name, F.coalesce("_count", F.lit(0)))
        return self._with(joined.drop("_count"))

    def different_edges(self, *edge_vars: str) -> Bindings:
        """Edges of the same table that are bound to these variables differ pairwise."""
        df = self.df
        for i, a in enumerate(edge_vars):
            for b in edge_vars[i + 1 :]:
                key = self.graph.edges[self.edge_vars[a]].key
                if self.edge_vars[a] == self.edge_vars[b] and key:
                    df = df.where(F.col(f"{a}__{key}") != F.col(f"{b}__{key}"))
        return self._with(df)

    def degree(self, var: str, edge: str, direction: str = "any", name: str = "degree") -> Bindings:
        """Edges of one label at a node: ``out``, ``in`` or both together; 0 without any."""
        t = self.graph.edges[edge]
        ends = {"out": [t.src], "in": [t.dst], "any": [t.src, t.dst]}[direction]
        rows = None
        for c in ends:
            part = t.df.select(F.col(c).alias(var))
            rows = part if rows is None else rows.unionAll(part)
        counts = rows.groupBy(var).agg(F.count(F.lit(1)).alias("_degree"))
        return self._with(self.df.join(counts, var, "left").withColumn(name, F.coalesce("_degree", F.lit(0))).drop("_degree"))

    def _matched(self, other: Bindings, value: Column) -> tuple[list[str], DataFrame]:
        shared = self._shared(other)
        return shared, other.df.select(*shared, value.alias("_value"))

    def collect_of(self, other: Bindings, value: Column, name: str) -> Bindings:
        """``COLLECT { ... }``: a value of all matches of a correlated pattern, sorted; an empty list where there is none."""
        shared, found = self._matched(other, value)
        lists = found.groupBy(*shared).agg(F.array_sort(F.collect_list("_value")).alias("_list"))
        kind = lists.schema["_list"].dataType
        return self._with(self.df.join(lists, shared, "left").withColumn(name, F.coalesce("_list", F.array().cast(kind))).drop("_list"))

    def value_of(self, other: Bindings, value: Column, name: str) -> Bindings:
        """``VALUE { ... }``: the value of the only match, null without one; more than one match is an error."""
        shared, found = self._matched(other, value)
        one = found.groupBy(*shared).agg(F.count(F.lit(1)).alias("_n"), F.first("_value").alias("_one"))
        checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("VALUE has more than one match")).cast(one.schema["_one"].dataType)).otherwise(F.col("_one"))
        return self._with(self.df.join(one, shared, "left").withColumn(name, checked).drop("_n", "_one"))

    def call(self, subquery: Callable[[Callable[[str], Column]], DataFrame], optional: bool = False) -> Bindings:
        """``CALL { ... }``: for each row the rows of a subquery, which gets the row's values by ``outer("n.p")``.

        Inside it aggregate with ``select``, which may hold values of the row that are bound later; ``groupBy`` may not.
        """
        found = subquery(lambda name: prop(name).outer())
        return self._with(self.df.lateralJoin(found, F.lit(True), "left") if optional else self.df.lateralJoin(found))

    def call_procedure(self, result: DataFrame, on: dict[str, str], yields: dict[str, str], optional: bool = False) -> Bindings:
        """``CALL procedure YIELD``: the rows of a procedure's result that belong to each row.

        ``on`` names the result's column for each variable, ``yields`` the new name of each column that is kept.
        """
        kept = result.select(*[F.col(c).alias(v) for v, c in on.items()], *[F.col(c).alias(name) for c, name in yields.items()])
        return self._with(self.df.join(kept, list(on), "left" if optional else "inner"))

    def next(self, columns: dict[str, Column]) -> Bindings:
        """``NEXT``: goes on with some columns as the only rows; a variable's key keeps its label, so it can be expanded again."""
        df = self.df.select(*[c.alias(name) for name, c in columns.items()])
        return Bindings(self.graph, df, {v: label for v, label in self.labels.items() if v in columns})

    # -- functions of variables --------------------------------------------------

    def id(self, var: str) -> Column:
        """The key of a node, or of an edge whose table has one."""
        return F.col(f"{var}__{self.graph.edges[self.edge_vars[var]].key}") if var in self.edge_vars else F.col(var)

    def element_id(self, var: str) -> Column:
        return self.id(var).cast("string")

    def type(self, edge_var: str) -> Column:
        return F.lit(self.edge_vars[edge_var])

    def start_node(self, edge_var: str) -> Column:
        return F.col(f"{edge_var}__{self.graph.edges[self.edge_vars[edge_var]].src}")

    def end_node(self, edge_var: str) -> Column:
        return F.col(f"{edge_var}__{self.graph.edges[self.edge_vars[edge_var]].dst}")

    def is_source_of(self, var: str, edge_var: str) -> Column:
        right = self.labels[var] == self.graph.edges[self.edge_vars[edge_var]].src_label
        return F.lit(right) & (F.col(var) == self.start_node(edge_var))

    def is_destination_of(self, var: str, edge_var: str) -> Column:
        right = self.labels[var] == self.graph.edges[self.edge_vars[edge_var]].dst_label
        return F.lit(right) & (F.col(var) == self.end_node(edge_var))

    def labels_of(self, var: str) -> Column:
        """The labels of a node, sorted; of an edge its label alone."""
        own = {self.edge_vars[var]} if var in self.edge_vars else {self.labels[var], *self.graph.nodes[self.labels[var]].also}
        return F.array(*[F.lit(x) for x in sorted(own)])

    def is_labeled(self, var: str, expression: Label) -> Column:
        return expression.test(self.labels_of(var))

    def property_exists(self, var: str, name: str) -> Column:
        """False for a property that the variable's table lacks."""
        return F.col(f"{var}__{name}").isNotNull() if f"{var}__{name}" in self.df.columns else F.lit(False)

    def properties(self, var: str) -> Column:
        """All properties of a variable as a struct."""
        names = [c for c in self.df.columns if c.startswith(f"{var}__")]
        return F.struct(*[F.col(c).alias(c[len(var) + 2 :]) for c in names])

    def property_names(self, var: str) -> Column:
        """The names of the properties that are not null, in the table's order."""
        names = [c for c in self.df.columns if c.startswith(f"{var}__")]
        return F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c[len(var) + 2 :])) for c in names]))

    keys = property_names

    def select(self, *columns: Column | str) -> DataFrame:
        return self.df.select(*[prop(c) if isinstance(c, str) else c for c in columns])

    def aggregate(self, keys: dict[str, Column], values: dict[str, Column]) -> DataFrame:
        """Grouped by the key columns; without keys one row."""
        keyed = self.df.groupBy(*[c.alias(k) for k, c in keys.items()])
        return keyed.agg(*[c.alias(k) for k, c in values.items()])
