"""URL filter: host and path rules, then logistic regression on hashed character n-grams.

Features of a url are the distinct 3- to 5-grams of its host and of its path,
each hashed with its field to one of ``DIMENSIONS`` slots. A small labelled table
trains Spark's LogisticRegression; the weights (a fixed number, whatever the
input) become a literal and every page is scored by DataFrame functions in one
pass without a shuffle. The labelled table is made by rule from lists of topics;
a fifth of its hosts is held out and measured in the tests. Topics that the lists
lack are told by the n-grams they share with those only.

Defined results: a null url or one without ``://`` has an empty host and path,
no n-grams and the verdict ``allow``; repeated rows get equal results; extra
columns are ignored; an empty table gives an empty result. Of rules that fit the
longest wins; the rules given are all different.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DIMENSIONS, SIZES, BLOCK_FROM = 1 << 13, (3, 4, 5), 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The labelled table is made by rule from these words: topics of hosts to block, topics of hosts to allow (some of which
#: hold or resemble words of the first list), words that go with either, and paths, which tell nothing by themselves.
BAD_TOPICS = "casino poker slots jackpot betting viagra cialis pills steroids porn xxx escort warez torrent keygen crack malware phishing botnet spamlinks linkfarm clickbait adserver popunder payday replica lottery getrich".split()
GOOD_TOPICS = (
    "news weather recipes garden museum library university history science physics chemistry astronomy gallery theatre orchestra poetry parliament courts council hospital medicine pharmacy therapist analyst nursing "
    "school college teachers kindergarten football sports cycling hiking travel railway harbour airport forest rivers mountain farming beekeeping geology mapping atlas census archive dictionary grammar software compiler "
    "database python linux hardware electronics carpentry pottery knitting painting photography film music radio essex sussex adventure advocate classics passage crackers keystone slotcar betterhomes pillow escorial torrential "
    "philately numismatics genealogy folklore cooking bakery vineyard cheese orchard housing planning transport energy climate ocean"
).split()
EITHER = "the my best top free online super daily world city home web net pro plus hub zone point world24 first local true great cheap win prize vip live royal shop club".split()
PATHS = ["/en/125", "/fr/831.html", "/de/44/", "/es/917?page=2", "/en/6402#top", "/articles/2023/index.html", "/", "/en/58?utm_source=feed"]
#: Of the hosts of a topic every fifth, from a place that moves with the topic, is held out of training.
HELD_OUT = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def slots(host: Column, path: Column) -> Column:
    """Distinct slots of the n-grams of a host and a path."""

    def grams(field: str, s: Column) -> list[Column]:
        # Host and path are bounded by marks, so that beginnings and ends are n-grams of their own.
        s = F.when(s != "", F.concat(F.lit("^"), s, F.lit("$"))).otherwise("")
        of = lambda n: F.transform(F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(F.lit(field), F.substring(s, i, F.lit(n))))
        return [of(n) for n in SIZES]

    return F.array_distinct(F.transform(F.concat(*grams("host", host), *grams("path", path)), lambda h: F.pmod(h, F.lit(DIMENSIONS)).cast("int")))


def labelled_rows(held_out: bool = False) -> list[tuple[str, float]]:
    """(url, label) of the labelled table, or of what is held out of it: every topic before or after every word of either kind."""
    rows = []
    for topics, label in ((BAD_TOPICS, 1.0), (GOOD_TOPICS, 0.0)):
        for i, topic in enumerate(topics):
            hosts = [f"{topic}.test", f"www.{topic}.test", f"blog.{topic}.test"]
            for j, word in enumerate(EITHER):
                first, last = (word, topic) if (i + j) % 2 else (topic, word)
                hosts.append(f"{'www.' if j % 4 == 0 else ''}{first}{'-' if j % 3 else ''}{last}.test")
            rows += [(f"https://{h}{PATHS[(i + k) % len(PATHS)]}", label) for k, h in enumerate(hosts) if ((i + k) % HELD_OUT == 0) == held_out]
    return rows


def labelled(spark: SparkSession) -> DataFrame:
    """(url, label): the training table, some 2,900 rows."""
    return spark.createDataFrame(labelled_rows(), "url string, label double").coalesce(1)


def train(table: DataFrame) -> tuple[list[float], float]:
    """Weights and intercept of a fit to a small table of (url, label)."""
    found = slots(*host_and_path(F.col("url"))).cast("array<string>")
    # The kinds count alike, however many hosts each has.
    weight = F.when(F.col("label") > 0, len(GOOD_TOPICS) / len(BAD_TOPICS)).otherwise(1.0)
    grams = table.select("label", weight.alias("weight"), found.alias("slots")).cache()
    counts = CountVectorizer(inputCol="slots", outputCol="features", vocabSize=DIMENSIONS, binary=True).fit(grams)
    model = LogisticRegression(regParam=0.005, maxIter=60, standardization=False, weightCol="weight").fit(counts.transform(grams))
    grams.unpersist()
    weights = [0.0] * DIMENSIONS
    for slot, w in zip(counts.vocabulary, model.coefficients.toArray()):
        weights[int(slot)] = float(w)
    return weights, float(model.intercept)


def score(host: Column, path: Column, weights: list[float], intercept: float) -> Column:
    """The probability that a url is to be blocked; null without n-grams."""
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    found = slots(host, path)
    total = F.aggregate(F.transform(found, lambda i: F.get(w, i)), F.lit(float(intercept)), lambda a, x: a + x)
    return F.when(F.size(found) > 0, 1 / (1 + F.exp(-total)))


def rule_of(host: Column, path: Column) -> Column:
    """The index into RULES of the longest rule that fits, as (length, index); null without one."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(i).alias("i"))) for i, (_, h, p) in enumerate(RULES)]
    return reduce(lambda a, b: F.greatest(a, b), fits)


def judge(pages: DataFrame, model: tuple[list[float], float] | None = None) -> DataFrame:
    """(page_id, host, path, rule, p_block, verdict) of every url."""
    weights, intercept = model or train(labelled(pages.sparkSession))
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("fit", rule_of(F.col("host"), F.col("path"))["i"]).withColumn("p_block", score(F.col("host"), F.col("path"), weights, intercept))
    rule = reduce(lambda c, i: c.when(F.col("fit") == i, F.lit(RULES[i][1] + RULES[i][2])), range(1, len(RULES)), F.when(F.col("fit") == 0, F.lit(RULES[0][1] + RULES[0][2])))
    said = reduce(lambda c, i: c.when(F.col("fit") == i, F.lit(RULES[i][0])), range(1, len(RULES)), F.when(F.col("fit") == 0, F.lit(RULES[0][0])))
    verdict = F.coalesce(said, F.when(F.col("p_block") >= BLOCK_FROM, F.lit("block")).otherwise("allow"))
    return ruled.select("page_id", "host", "path", rule.alias("rule"), "p_block", verdict.alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")
