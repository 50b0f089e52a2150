"""Personal data, and the terms that give it away.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. Then
corpus co-occurrence estimates how much every term on the line of a protected
value tells about it. All counts are of whole lines: with ``n`` lines in the
corpus, ``PMI(t, e) = log2(n * n(e,t) / (n(e) * n(t)))`` and ``IC(e) = log2(n /
n(e))``, which PMI reaches when the term never appears without the value. The
share ``n(e,t) / n(t)`` is smoothed by ``s / (s + prior)``, where ``s`` counts the
different lines of the pair: copies of one line add nothing, and a value with one
or two lines counts as far as the corpus is large enough to tell. A term is
generalised when PMI is at least ``generalise_at`` of IC and removed when it is at
least ``remove_at``, in every document that holds the value. Only DataFrame
functions are used.

Defined results: a null text counts as empty; repeated rows each get their own
result; a row with null id gets base spans only; extra columns are ignored; an
empty table gives an empty result; ties in the spans order by kind as listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgspark.llm.common import SPAN, masked, materialise, native_spans, placed, span_list

#: The kinds in their listed order, and the kinds the method adds.
BASE_KINDS = ["email", "ip", "card", "phone"]
GENERAL, REMOVED = "term", "removed"
#: The base patterns, with possessive loops and run starts so that no text is scanned twice.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_OK = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: A term: a run of letters and digits with a letter in it, lower-cased.
TERM = r"(?<![\p{L}\p{N}])(?=[\p{N}]*+\p{L})[\p{L}\p{N}]++"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    d = _digits(s)
    n = F.length(d)

    def add(acc: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(v > 9, v - 9).otherwise(v)

    return n.between(12, 19) & (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0)


def base_spans(text: Column) -> Column:
    """Base spans of one text, sorted by start, then kind as listed."""
    number = text.rlike("[0-9]")
    parts = [
        native_spans(text, EMAIL, "email", 0, F.contains(text, F.lit("@"))),
        F.filter(native_spans(text, IP, "ip", 1, number), lambda s: s["value"].rlike(IP_OK)),
        F.filter(native_spans(text, CARD, "card", 2, text.rlike("[0-9](?:[ -]?[0-9]){11}")), lambda s: _luhn(s["value"])),
        F.filter(native_spans(text, PHONE, "phone", 3, F.contains(text, F.lit("+"))), lambda s: F.length(_digits(s["value"])).between(9, 15)),
    ]
    return F.array_sort(F.concat(*parts))


def _entity(s: Column) -> Column:
    return F.concat(s["kind"], F.lit("|"), F.lower(s["value"]))


def _terms(line: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(line), F.lit(TERM), F.lit(0)))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line"))


def base_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans, entities) of every row: one pass over the texts, no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).select("doc_id", "text", base_spans(F.col("text")).alias("spans"))
    return found.select("doc_id", F.xxhash64("text").alias("text_key"), "spans", F.array_distinct(F.transform("spans", _entity)).alias("entities"))


def value_lines(docs: DataFrame) -> DataFrame:
    """(entities, terms, context) of every line that holds a value; no base pattern crosses a line end."""
    lines = _lines(docs).where(F.col("line").rlike("[0-9@]"))
    found = lines.select("line", F.array_distinct(F.transform(base_spans(F.col("line")), _entity)).alias("entities")).where(F.size("entities") > 0)
    return found.select("entities", _terms(F.col("line")).alias("terms"), F.xxhash64("line").alias("context"))


def term_lines(docs: DataFrame) -> DataFrame:
    """(term, n_t): lines of the corpus that hold the term; the empty term counts all lines."""
    terms = _lines(docs).select(F.explode(F.concat(_terms(F.col("line")), F.array(F.lit("")))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def disclosures(docs: DataFrame, generalise_at: float = 0.8, remove_at: float = 0.95, prior: float = 2.0) -> DataFrame:
    """(entity, term, pmi, ic, action) of every pair at or above ``generalise_at``."""
    seen = materialise(value_lines(docs), "pii-lines").select(F.explode("entities").alias("entity"), "terms", "context")
    pairs = seen.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("k"))
    pairs = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("support"), F.sum("k").alias("n_et"))
    entities = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    counts = term_lines(docs)
    lines = counts.where(F.col("term") == "").select(F.col("n_t").alias("n"))
    joined = pairs.join(counts, "term").join(entities, "entity").crossJoin(F.broadcast(lines))  # one row
    ic = F.log2(F.col("n") / F.col("n_e"))
    share = F.col("n_et") / F.col("n_t") * F.col("support") / (F.col("support") + prior)
    pmi = F.log2(F.col("n") * share / F.col("n_e"))
    action = F.when(F.col("pmi") >= remove_at * F.col("ic"), REMOVED).otherwise(GENERAL)
    return joined.select("entity", "term", F.least(pmi, ic).alias("pmi"), ic.alias("ic")).where((F.col("ic") > 0) & (F.col("pmi") >= generalise_at * F.col("ic"))).withColumn("action", action)


def term_spans(docs: DataFrame, base: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(doc_id, text_key, more): where disclosing terms stand in documents that hold their entity.

    A document's own terms meet the disclosing ones by (entity, term), so a value
    that a third of all documents hold brings each of them only terms that it has.
    """
    holds = base.where("doc_id IS NOT NULL AND size(entities) > 0").select("doc_id", "text_key", "entities")
    texts = docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", F.xxhash64("text").alias("text_key"), "text")  # all rows with base spans have one
    held = materialise(texts.join(holds, ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"]), "pii-held")
    own = held.select("doc_id", "text_key", F.explode("entities").alias("entity"), _terms(F.col("text")).alias("terms")).select("doc_id", "text_key", "entity", F.explode("terms").alias("term"))
    of_doc = own.join(disclosing.select("entity", "term", "action"), ["entity", "term"]).groupBy("doc_id", "text_key", "term").agg(F.max("action").alias("action"))
    of_doc = of_doc.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list(F.struct("term", "action"))).alias("terms"))
    both = held.select("doc_id", "text_key", "text").join(of_doc, ["doc_id", "text_key"])
    # A longer term comes first in the alternation; terms are letters and digits, so nothing needs quoting.
    listed = F.array_join(F.transform(F.sort_array(F.transform("terms", lambda t: F.struct(-F.length(t["term"]), t["term"].alias("term")))), lambda t: t["term"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), listed, F.lit(r")(?![\p{L}\p{N}])"))
    both = both.withColumn("pattern", pattern).withColumn("found", F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).withColumn("gaps", F.split("text", F.col("pattern"), -1))
    action = F.map_from_entries("terms")

    def span(start: Column, end: Column, value: Column) -> Column:
        kind = F.coalesce(F.try_element_at(action, F.lower(value)), F.lit(GENERAL))
        return F.struct(start.alias("start"), F.lit(len(BASE_KINDS)).alias("ord"), end.alias("end"), kind.alias("kind"), value.alias("value"))

    return both.select("doc_id", "text_key", placed(F.col("found"), F.col("gaps"), span).alias("more"))


def find(docs: DataFrame, **thresholds: float) -> DataFrame:
    """(doc_id, text_key, base, spans): base spans and all spans of every row.

    ``base`` and the lines with values are written once to the shared folder, as
    more than one later step reads them.
    """
    docs = docs.select("doc_id", "text")
    base = materialise(base_table(docs), "pii-base")
    more = term_spans(docs, base, disclosures(docs, **thresholds))
    joined = base.select("doc_id", "text_key", F.col("spans").alias("base")).join(more, ["doc_id", "text_key"], "left")
    # Terms inside a base span are covered already.
    kept = F.filter(F.coalesce("more", F.array().cast(f"array<{SPAN}>")), lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return joined.select("doc_id", "text_key", "base", F.array_sort(F.concat("base", kept)).alias("spans"))


def sanitise(docs: DataFrame, **thresholds: float) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; removed terms are cut out."""
    found = find(docs, **thresholds).dropDuplicates(["doc_id", "text_key"])
    same = docs["doc_id"].eqNullSafe(found["doc_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["text_key"])
    new = F.replace(masked(docs["text"], found["spans"]), F.lit(f"[{REMOVED.upper()}]"), F.lit(""))
    return docs.join(found, same, "left").select(*[new.alias(c) if c == "text" else docs[c] for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's rows."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find(spark.read.parquet(f"{sf_dir}/documents.parquet")))
