"""The pipeline against a plain version of each stage, each on its own input."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from pgspark.llm import decontaminate, quality, secrets
from tests.llm.helpers import clashing, empty, sorted_rows
from tests.llm.test_near_pairs import brute_kept

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    first = stage["quality_rules"](spark, docs, DIR)
    kept = {r[0] for r in sorted_rows(quality.assess(docs).where("kept"), "doc_id")}
    rows = {r.doc_id: r for r in first.collect()}
    assert set(rows) == kept

    second = stage["near_duplicates"](spark, first, DIR)
    ids = sorted(rows)
    left = {r.doc_id: r for r in second.collect()}
    assert set(left) == brute_kept([rows[i].text for i in ids], ids)  # five words, similarity 0.8

    third = stage["benchmark_leaks"](spark, second, DIR)
    matcher = decontaminate.Matcher([(r.item_id, decontaminate.normal(r.text)) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()], decontaminate.RATE)
    clean = {i for i, r in left.items() if not matcher.find(r.text)}
    assert {r.doc_id for r in third.collect()} == clean

    fourth = stage["secret_scans"](spark, third, DIR)
    assert fourth.columns == docs.columns and fourth.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert {r.doc_id for r in fourth.collect()} == clean
    assert secrets.scan_documents(fourth).where("size(findings) > 0").count() == 0
    assert all(r.n_chars == len(r.text) for r in fourth.collect())

    last = stage["tokens"](spark, fourth, DIR).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in fourth.collect()}
    assert all(r.ids == t.encode(texts[r.doc_id], add_special_tokens=False).ids for r in last) and len(last) == len(clean)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()) == sorted(clean)


def test_odd_tables(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        assert docs.count() == 0
    # The last stage returns columns ``ids`` and ``decoded``, so a table with one of these would not be one of documents.
    docs = clashing(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).drop("ids")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() > 0


def test_nulls_repeats_and_long_texts(spark):
    """Null texts fail the quality rules; of repeated rows one stays; rows without id stay; long texts pass through whole."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    good = [r.text for r in quality.keep_good(table).limit(3).collect()]
    long = "\n".join(f"{good[k % 3]} {k}" for k in range(400))
    rows = [(1, good[0], None, None, None), (1, good[0], None, None, None), (None, good[1], "en", "s", 5), (2, None, "en", "s", None), (3, "", "en", "s", 0), (4, long, "en", "s", len(long))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        kept[name] = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=str)
    assert set(kept["quality_rules"]) <= {1, 4, None} and kept["near_duplicates"] == sorted(set(kept["quality_rules"]), key=str)
    assert kept["tokens"] == kept["secret_scans"] == kept["benchmark_leaks"]
