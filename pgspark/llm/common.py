"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes with A-Z lower-cased, and the seed of shingle hashes.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SEED = 42
#: The span struct of the native scanners: code points, end exclusive.
SPAN = "struct<start:int,ord:int,end:int,kind:string,value:string>"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Set here only in a local session that names none (tests); a cluster without one is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        import tempfile

        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but runs the plan once only; a lost
    executor re-reads the files instead of recomputing the plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*written: DataFrame) -> None:
    """Remove the folders of materialised tables that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each component, by alternating star contraction.

    ``edges`` are (u, v) of any direction; nodes without edges are absent.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        # Large star: every larger neighbour of a node points at the smallest of its neighbourhood.
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node and its smaller neighbours point at the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pointed = large.join(least, "u")
        small = pointed.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        old, now = now, materialise(small, name)
        discard(old)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def unary_counts(bits: np.ndarray) -> np.ndarray:
    """The embedding with the counts 0, 1, 2 as 00, 01, 11: the Manhattan distance of two is the number of bits they differ in."""
    low = np.uint64(0x5555555555555555)
    return ((bits | bits >> np.uint64(1)) & low) | ((bits & bits >> np.uint64(1)) & low) << np.uint64(1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; a lambda would compute an outer expression for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Offsets are summed within runs of so many matches, and over whole runs, so that a text full of matches costs little more than its length.
RUN = 128


def placed(found: Column, gaps: Column, span) -> Column:
    """An array of ``span(start, end, match)`` of all matches.

    The pieces between the matches (``split``) and the matches themselves
    (``regexp_extract_all``) alternate, so their lengths add up to the offsets.
    """

    def lengths(a: Column) -> Column:
        pairs = F.arrays_zip(F.slice(a["g"], F.lit(1), F.size(a["m"])).alias("g"), a["m"].alias("m"))
        return F.struct(F.transform(pairs, lambda x: F.struct(F.length(x["g"]).alias("g"), F.length(x["m"]).alias("n"), x["m"].alias("v"))).alias("p"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x["g"] + x["n"])

    def runs(b: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(b["p"]) - 1, F.lit(0)), F.lit(RUN))
        sums = F.aggregate(starts, F.array(F.lit(0)), lambda acc, i: F.concat(acc, F.array(F.try_element_at(acc, F.lit(-1)) + total(F.slice(b["p"], i + 1, F.lit(RUN))))))
        return F.struct(b["p"].alias("p"), sums.alias("s"))

    def spans(c: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            within = i % RUN
            start = F.get(c["s"], ((i - within) / RUN).cast("int")) + total(F.slice(c["p"], i - within + 1, within)) + x["g"]
            return span(start, start + x["n"], x["v"])

        return F.transform(c["p"], one)

    return _let(F.struct(found.alias("m"), gaps.alias("g")), lambda a: _let(lengths(a), lambda b: _let(runs(b), spans)))


def native_spans(text: Column, pattern: str, kind: str, order: int, prefilter: Column | None = None) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` as an array of SPAN."""

    def span(start: Column, end: Column, value: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"))

    spans = placed(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1), span)
    if prefilter is None:
        return spans
    return F.when(prefilter, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in square brackets; spans are sorted.

    A span that begins before the end of an earlier one extends that replacement.
    """
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        piece = F.concat(F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
