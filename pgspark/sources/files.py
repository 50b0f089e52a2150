"""CSV, JSON-graph, N-Triples and time-series Parquet, all read and written by Spark."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgspark.functions.scalar import floor_to, int_divide
from pgspark.graph import Graph
from pgspark.operators.paths import bfs

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


# -- CSV -----------------------------------------------------------------------


def cell(value: Column) -> Column:
    """A cell by its own form: whole number, then number, then boolean, else text; as VARIANT."""
    whole, number, truth = value.try_cast("long"), value.try_cast("double"), F.lower(value)
    text = F.to_json(F.struct(value.alias("v")))
    as_json = F.when(whole.isNotNull() & value.rlike(r"^[+-]?[0-9]+$"), whole.cast("string")).when(number.isNotNull() & value.rlike(r"^[+-]?[0-9.]+([eE][+-]?[0-9]+)?$"), number.cast("string")).when(truth.isin("true", "false"), truth)
    return F.when(as_json.isNotNull(), F.try_parse_json(as_json)).otherwise(F.try_variant_get(F.try_parse_json(text), "$.v", "variant"))


def read_nodes_csv(spark: SparkSession, path: str, key: str, columns: dict[str, str] | None = None, parent: str | None = None, delimiter: str = ",") -> tuple[DataFrame, DataFrame | None]:
    """(nodes, containment edges): every cell typed by itself; ``parent`` names the column of a containing node."""
    raw = spark.read.csv(path, header=True, sep=delimiter)
    names = columns or {c: c for c in raw.columns}
    nodes = raw.select(F.col(key).alias("id"), *[cell(F.col(c)).alias(n) for c, n in names.items() if c not in (key, parent)])
    edges = raw.where(F.col(parent).isNotNull()).select(F.col(parent).alias("src"), F.col(key).alias("dst"), F.lit("contains").alias("label")) if parent else None
    return nodes, edges


def read_edges_csv(spark: SparkSession, path: str, src: str = "source_id", dst: str = "target_id", label: str = "label", delimiter: str = ",") -> DataFrame:
    raw = spark.read.csv(path, header=True, sep=delimiter)
    rest = [c for c in raw.columns if c not in (src, dst, label)]
    return raw.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(label).alias("label"), *[cell(F.col(c)).alias(c) for c in rest])


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.csv(path, header=True, sep=delimiter)


# -- JSON graph ------------------------------------------------------------------


def to_json_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value): one JSON object for each node (id, type, data) and edge (id, source, target, label)."""
    props = F.struct(*[c for c in nodes.columns if c not in ("id", "label")]) if len(nodes.columns) > 2 else F.struct(F.lit(None).cast("string").alias("none"))
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("id").cast("string").alias("id"), F.col("label").alias("type"), props.alias("data"))).alias("value"))
    e = edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.concat_ws("-", "src", "label", "dst").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), "label")).alias("value"))
    return n.unionAll(e)


def from_json_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``to_json_graph``; properties come back as a map of texts."""
    n = rows.where("kind = 'node'").select(F.from_json("value", "id string, type string, data map<string,string>").alias("j")).select("j.id", F.col("j.type").alias("label"), F.col("j.data").alias("props"))
    e = rows.where("kind = 'edge'").select(F.from_json("value", "source string, target string, label string").alias("j")).select(F.col("j.source").alias("src"), F.col("j.target").alias("dst"), "j.label")
    return n, e


# -- RDF -----------------------------------------------------------------------------


def to_triples(nodes: DataFrame, edges: DataFrame, base: str = "urn:graph:") -> DataFrame:
    """(s, p, o, literal): a type triple per label, one per property, one per edge.

    ``nodes`` is (id, labels, props map<string,string>), ``edges`` is (src, label, dst).
    """
    iri = lambda c: F.concat(F.lit(base + "node/"), c.cast("string"))
    types = nodes.select(iri(F.col("id")).alias("s"), F.lit(RDF_TYPE).alias("p"), F.explode("labels").alias("l")).select("s", "p", F.concat(F.lit(base + "type/"), "l").alias("o"), F.lit(False).alias("literal"))
    props = nodes.select(iri(F.col("id")).alias("s"), F.explode("props").alias("k", "v")).where("v IS NOT NULL").select("s", F.concat(F.lit(base + "prop/"), "k").alias("p"), F.col("v").alias("o"), F.lit(True).alias("literal"))
    links = edges.select(iri(F.col("src")).alias("s"), F.concat(F.lit(base + "rel/"), "label").alias("p"), iri(F.col("dst")).alias("o"), F.lit(False).alias("literal"))
    return types.unionAll(props).unionAll(links)


def write_ntriples(triples: DataFrame, path: str) -> None:
    o = triples["o"]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        o = F.replace(o, F.lit(a), F.lit(b))
    end = F.when(F.col("literal"), F.concat(F.lit('"'), o, F.lit('"'))).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    graph = F.when(F.col("graph").isNotNull(), F.concat(F.lit(" <"), "graph", F.lit(">"))).otherwise("") if "graph" in triples.columns else F.lit("")
    triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), end, graph, F.lit(" ."))).write.text(path)


#: Terms of Turtle: directives, IRIs, names with a prefix, blank nodes, texts, numbers, truth values and marks.
_TURTLE = r"""(?x) \s+ | \#[^\n]* | (?P<prefix>@?[Pp][Rr][Ee][Ff][Ii][Xx]\s+(?P<name>[\w.-]*):\s*<(?P<base>[^>]*)>\s*\.?)
 | <(?P<iri>[^>]*)> | (?P<blank>_:[\w.-]*\w) | (?:\"{3}(?P<long>.*?)\"{3} | \"(?P<text>(?:[^"\\]|\\.)*)\")(?:@[A-Za-z-]+|\^\^(?:<[^>]*>|[\w.-]*:[\w.-]*))?
 | (?P<number>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|true\b|false\b) | (?P<short>[\w.-]*:[\w.-]*[\w-]|[\w.-]+:) | (?P<a>a)(?=\s) | (?P<mark>[.;,])"""
_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}


def turtle_triples(text: str) -> list[tuple[str, str, str, bool]]:
    """(s, p, o, literal) of a Turtle text without collections and anonymous nodes."""
    prefixes, held, out, at = {}, [], [], 0
    pattern = re.compile(_TURTLE, re.S)
    while at < len(text):
        m = pattern.match(text, at)
        if m is None:
            raise ValueError(f"not Turtle: {text[at : at + 40]!r}")
        at = m.end()
        if m["prefix"]:
            prefixes[m["name"]] = m["base"]
        elif m["mark"]:
            out.append((held[0][0], held[1][0], *held[2]))
            held = {".": [], ";": held[:1], ",": held[:2]}[m["mark"]]
        elif m["short"]:
            name, _, rest = m["short"].partition(":")
            held.append((prefixes[name] + rest, False))
        elif m["a"]:
            held.append((RDF_TYPE, False))
        elif (value := m["long"] if m["long"] is not None else m["text"]) is not None:
            held.append((re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), value), True))
        elif m["number"]:
            held.append((m["number"], True))
        elif m["iri"] is not None or m["blank"]:
            held.append((m["blank"] or m["iri"], False))
    return out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, literal) of Turtle files; each file is read whole, as its prefixes hold to its end."""

    def run(batches):
        for b in batches:
            rows = [t for text in b["value"] for t in turtle_triples(text)]
            yield pd.DataFrame(rows, columns=["s", "p", "o", "literal"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "s string, p string, o string, literal boolean")


def write_turtle(triples: DataFrame, path: str) -> None:
    """Turtle, one statement a line: files can then be written in parallel and need no header."""
    write_ntriples(triples.select("s", "p", "o", "literal"), path)

def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, literal, graph) of N-Triples or N-Quads lines; comments and other lines are passed over."""
    term = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*+)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(?:<([^>]*)>\s*)?\.\s*$'
    got = lambda i: F.regexp_extract("value", term, i)
    rows = spark.read.text(path).where(F.col("value").rlike(term))
    literal = F.col("value").rlike(r'^\s*\S+\s+<[^>]*>\s+"')
    text = got(5)
    mark = "\x00"
    for a, b in (("\\\\", mark), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), (mark, "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return rows.select(F.regexp_replace(got(1), r"^<|>$", "").alias("s"), got(2).alias("p"), F.when(literal, text).otherwise(F.concat(got(3), got(4))).alias("o"), literal.alias("literal"), F.nullif(got(6), F.lit("")).alias("graph"))


def basic_pattern(triples: DataFrame, *patterns: tuple[str, str, str]) -> DataFrame:
    """Bindings of a basic graph pattern: terms that begin with ``?`` are variables, shared ones join."""
    out = None
    for pattern in patterns:
        df, seen = triples, {}
        for column, term in zip("spo", pattern):
            if not term.startswith("?"):
                df = df.where(F.col(column) == term)
            elif term in seen:
                df = df.where(F.col(column) == F.col(seen[term]))
            else:
                seen[term] = column
        df = df.select(*[F.col(c).alias(t[1:]) for t, c in seen.items()])
        if out is None:
            out = df
        else:
            shared = [c for c in out.columns if c in df.columns]
            if not shared:
                raise ValueError(f"{pattern} shares no variable with the patterns before it")
            out = out.join(df, shared)
    return out


def optional_pattern(bindings: DataFrame, found: DataFrame) -> DataFrame:
    """OPTIONAL: all bindings, with what ``found`` adds to them over the shared variables."""
    return bindings.join(found, [c for c in bindings.columns if c in found.columns], "left")


def union_patterns(*found: DataFrame) -> DataFrame:
    """UNION: the bindings of all patterns; variables that a pattern lacks are null."""
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


# -- changes of triples: the writes of SPARQL UPDATE as new versions of the table -------


def insert_triples(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """INSERT DATA: a triple is held once."""
    return triples.unionByName(rows).distinct()


def delete_triples(triples: DataFrame, rows: DataFrame) -> DataFrame:
    """DELETE DATA; ``triples.limit(0)`` is CLEAR."""
    return triples.join(rows, ["s", "p", "o", "literal"], "left_anti")


def filled(bindings: DataFrame, *templates: tuple[str, str, str, bool]) -> DataFrame:
    """The triples of templates (s, p, o, whether o is a literal) for all bindings; terms that begin with ``?`` are variables."""
    term = lambda t: F.col(t[1:]) if t.startswith("?") else F.lit(t)
    one = [F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o"), F.lit(literal).alias("literal")) for s, p, o, literal in templates]
    return bindings.select(F.explode(F.array(*one)).alias("t")).select("t.*").where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL").distinct()


def delete_insert_where(triples: DataFrame, bindings: DataFrame, gone: list[tuple] = (), new: list[tuple] = ()) -> DataFrame:
    """DELETE ... INSERT ... WHERE: both sides see the state before."""
    left = delete_triples(triples, filled(bindings, *gone)) if gone else triples
    return insert_triples(left, filled(bindings, *new)) if new else left


def arrow_streams(df: DataFrame) -> DataFrame:
    """(stream): the rows as Arrow IPC streams, one for each batch of a task, for readers outside Spark."""

    def run(batches):
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["stream"])

    return df.mapInArrow(run, "stream binary")


# -- time series -----------------------------------------------------------------------


def write_samples(samples: DataFrame, path: str) -> None:
    """By UTC day, sorted by series and time within files, so that row groups prune; zstd."""
    day = F.to_date(F.timestamp_seconds(int_divide(floor_to(F.col("timestamp"), 1_000_000_000), F.lit(1_000_000_000))))
    placed = samples.withColumn("day", day).repartition("day", F.pmod(F.xxhash64("entity_id", "property"), F.lit(16)))
    placed.sortWithinPartitions("day", "entity_id", "property", "timestamp").write.mode("append").partitionBy("day").option("compression", "zstd").parquet(path)


def read_samples(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Samples of [start, end]: other days are not opened."""
    day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t // 1_000_000_000)))
    return spark.read.parquet(path).where(F.col("day").between(day(start), day(end)) & F.col("timestamp").between(start, end)).drop("day")


def compact_samples(spark: SparkSession, path: str, out: str, keep_from: int | None = None) -> None:
    """Rewrite a folder of samples as few sorted files a day, without repeated rows and without days before ``keep_from``."""
    rows = spark.read.parquet(path)
    if keep_from is not None:
        day = F.to_date(F.timestamp_seconds(F.lit(keep_from // 1_000_000_000)))
        rows = rows.where((F.col("day") >= day) & (F.col("timestamp") >= keep_from))
    write_samples(rows.drop("day").dropDuplicates(["entity_id", "property", "timestamp"]), out)


# -- slices ---------------------------------------------------------------------------------


def slice_by_labels(graph: Graph, labels: list[str]) -> Graph:
    """The nodes of some labels and the edge tables between them."""
    return Graph({k: t for k, t in graph.nodes.items() if k in labels}, {k: t for k, t in graph.edges.items() if t.src_label in labels and t.dst_label in labels})


def slice_by_containment(root: DataFrame, contains: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their depth, edges between them) of all that ``root(start)`` contains, itself included."""
    inside = bfs(root, contains).groupBy("node").agg(F.min("depth").alias("_depth"))
    return inside, _between(edges, inside)


def _between(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("node").alias("_id"))
    kept = edges.join(ids, edges["src"] == ids["_id"], "left_semi")
    return kept.join(ids, kept["dst"] == ids["_id"], "left_semi")


def slice_by_traversal(root: DataFrame, edges: DataFrame, hops: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with their depth, edges between them) within ``hops`` of ``root(start)``."""
    near = bfs(root, edges, hops).groupBy("node").agg(F.min("depth").alias("_depth"))
    return near, _between(edges, near)
