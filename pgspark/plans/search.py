"""Vector, text and hybrid search, and retrieval over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pgspark.functions.vector import cosine_similarity
from pgspark.operators.paths import bfs
from pgspark.plans.rounds import materialise

K1, B, RRF = 1.2, 0.75, 60


def vector_search(df: DataFrame, key: str, vector: str, query: list[float], k: int) -> DataFrame:
    """(node_id, score): exact cosine top-k in one pass; rows of another dimension are passed over."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = df.where(F.size(vector) == len(query)).select(F.col(key).alias("node_id"), cosine_similarity(F.col(vector), q).alias("score"))
    return scored.orderBy(F.desc("score"), "node_id").limit(k)


def similar(df: DataFrame, key: str, vector: str, to, k: int) -> DataFrame:
    """(node_id, score): the nodes most similar to one, itself excluded."""
    probe = df.where(F.col(key) == to).select(F.col(vector).alias("_q")).limit(1)
    scored = df.where(F.col(key) != to).crossJoin(F.broadcast(probe)).where(F.size(vector) == F.size("_q"))  # one row
    return scored.select(F.col(key).alias("node_id"), cosine_similarity(F.col(vector), F.col("_q")).alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def scoped_vector_search(df: DataFrame, key: str, vector: str, query: list[float], k: int, root: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """``vector_search`` among the nodes within ``hops`` of ``root(start)``."""
    near = bfs(root, edges, hops).select(F.col("node").alias(key)).distinct()
    return vector_search(df.join(near, key, "left_semi"), key, vector, query, k)


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of at most 40 characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) <= 40)


def text_search(df: DataFrame, key: str, text: str, query: str, k: int) -> DataFrame:
    """(node_id, score): BM25 top-k over all rows.

    Term counts of the few query terms are taken per row without exploding the
    text and written to the shared folder, so the texts are read once for the
    statistics and the scores; only document frequencies and the mean length are
    aggregated.
    """
    terms = sorted(set(_query_terms(query)))
    if not terms:
        return df.select(F.col(key).alias("node_id"), F.lit(0.0).alias("score")).limit(0)
    words = df.select(F.col(key).alias("node_id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    counted = words.select("node_id", F.size("w").alias("n"), *[_count("w", t).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = materialise(counted, "text-counts")
    stats = counted.agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    joined = counted.where(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df_ = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("docs") - df_ + 0.5) / (df_ + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return joined.select("node_id", score.alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == term))


def _query_terms(query: str) -> list[str]:
    word, out = "", []
    for c in query.lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def fuse(*ranked: DataFrame, k: int) -> DataFrame:
    """(node_id, score): reciprocal rank fusion of top lists of (node_id, score); each list holds at most a few k rows."""
    parts = None
    for r in ranked:
        w = Window.orderBy(F.desc("score"), "node_id")  # over a top-k list
        one = r.withColumn("_r", F.row_number().over(w)).select("node_id", (1.0 / (RRF + F.col("_r"))).alias("s"))
        parts = one if parts is None else parts.unionAll(one)
    return parts.groupBy("node_id").agg(F.sum("s").alias("score")).orderBy(F.desc("score"), "node_id").limit(k)


def graph_retrieval(hits: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(node_id, score, source, depth): hits, and what lies within ``hops`` at score / (depth + 1); the best hit first."""
    reached = bfs(hits.select(F.col("node_id").alias("start")), edges, hops)
    spread = reached.join(hits.select(F.col("node_id").alias("start"), F.col("score").alias("s")), "start").select(F.col("node").alias("node_id"), (F.col("s") / (F.col("depth") + 1)).alias("score"), F.when(F.col("depth") == 0, "vector").otherwise("graph").alias("source"), "depth")
    best = F.max(F.struct(F.col("score"), (-F.col("depth")).alias("d"), "source")).alias("b")
    return spread.groupBy("node_id").agg(best).select("node_id", "b.score", "b.source", (-F.col("b.d")).alias("depth"))


def community_search(hits: DataFrame, communities: DataFrame) -> DataFrame:
    """(node_id, score, community_id, size) of vector hits; ``communities`` is (node_id, community_id)."""
    sizes = communities.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    return hits.join(communities, "node_id", "left").join(sizes, "community_id", "left").select("node_id", "score", "community_id", "size")


def community_members(hits: DataFrame, communities: DataFrame, labels: DataFrame) -> DataFrame:
    """(community_id, score, node_id, label): every member of the communities that hits lie in, with the best hit's score.

    A row for each member, so that a community of any size is no single value; ``labels`` is (node_id, label).
    """
    best = hits.join(communities, "node_id").groupBy("community_id").agg(F.max("score").alias("score"))
    return communities.join(best, "community_id").join(labels, "node_id", "left").select("community_id", "score", "node_id", "label")


def context(retrieved: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(nodes, context): the texts of the ``k`` best retrieved nodes, best first, one a line, with what led to them."""
    best = retrieved.orderBy(F.desc("score"), "node_id").limit(k).join(texts, "node_id", "left")
    line = F.concat(F.lit("["), "source", F.lit(" "), F.col("depth").cast("string"), F.lit("] "), F.coalesce("text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "node_id", line.alias("line"))))
    return best.agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("context"))


def with_path(hits: DataFrame, parents: DataFrame, names: DataFrame, hops: int) -> DataFrame:
    """(node_id, score, path): names from the outermost container down to the hit, joined by " > ".

    ``parents`` is (child, parent), one parent for each child; ``names`` is (id, name).
    """
    now = hits.join(names.select(F.col("id").alias("node_id"), F.col("name").alias("path")), "node_id", "left").select("node_id", "score", F.coalesce("path", F.lit("")).alias("path"), F.col("node_id").alias("_at"))
    for _ in range(hops):
        up = parents.join(names, parents["parent"] == names["id"]).select(F.col("child").alias("_at"), F.col("parent").alias("_up"), "name")
        step = now.join(up, "_at", "left")
        now = step.select("node_id", "score", F.when(F.col("_up").isNotNull(), F.concat("name", F.lit(" > "), "path")).otherwise(F.col("path")).alias("path"), F.coalesce("_up", F.lit(None)).alias("_at"))
    return now.drop("_at")
