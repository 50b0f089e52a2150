"""Inputs that every operator has to take, and brute-force pieces."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def docs(spark, texts, ids=None, lang="en"):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t in zip(ids, texts)], DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The table with columns named like things that operators compute."""
    from pyspark.sql import functions as F

    for name in ("blob_id", "spans", "path", "fp", "rep", "codes", "findings", "base", "ids", "kept", "_content", "n_words", "text_key", "component_id", "host", "rule", "_key"):
        df = df.withColumn(name, F.lit("x"))
    return df


def prose(n, seed, vocabulary=400):
    r = random.Random(seed)
    pool = [f"w{r.randrange(10**6)}" for _ in range(vocabulary)]
    return [r.choice(pool) for _ in range(n)]


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)
