"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger
holds one row for each (blob, rule version) that has been scanned; a scan takes
the pairs that the ledger lacks, and findings are joined back to all paths. Only
DataFrame functions are used.

Defined results: a null text is the empty blob; repeated rows and copies share a
blob and each gets its findings; an empty table gives empty results; extra
columns are ignored. A null path keeps its findings. A ledger that holds a pair
more than once counts as if it held it once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pgspark.llm.common import SPAN, masked, materialise, native_spans, shared_dir, span_list

#: The base kinds in their listed order.
BASE_KINDS = ["assign", "access", "hex"]
#: The base patterns. A match whose value is too short is dropped.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
ASSIGN_LONG = r"""^[A-Za-z_]++["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
#: Rules beyond the base, by kind: what a blob ledger is asked to find besides.
MORE_KINDS = {
    "private_key": r"-----BEGIN (?:[A-Z0-9]++ ){0,3}PRIVATE KEY-----",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "bearer": r"(?<![A-Za-z])Bearer\x20[A-Za-z0-9._~+/=-]{20,}+",
    "forge_token": r"(?<![A-Za-z0-9])(?:ghp|gho|ghs|glpat|xoxb|xoxp)[_-][A-Za-z0-9-]{16,}+",
}
#: Raise it whenever a pattern above changes: old ledger rows then no longer count as scanned.
RULE_VERSION = 1
LEDGER = f"blob_id string, rule_version int, findings array<{SPAN}>"


def _assign(text: Column) -> Column:
    quick = F.lower(text).rlike("passw|secret|token|api_?key")
    return F.filter(native_spans(text, ASSIGN, "assign", 0, quick), lambda s: s["value"].rlike(ASSIGN_LONG))


def findings_of(text: Column) -> Column:
    """All findings of one text, sorted by start, then kind as listed."""
    parts = [_assign(text), native_spans(text, ACCESS, "access", 1, F.contains(text, F.lit("AKIA"))), native_spans(text, HEX, "hex", 2, text.rlike(HEX))]
    for i, (kind, pattern) in enumerate(MORE_KINDS.items(), 3):
        parts.append(native_spans(text, pattern, kind, i, text.rlike(pattern)))
    return F.array_sort(F.concat(*parts))


def versions(docs: DataFrame, path: str = "doc_id", content: str = "text") -> DataFrame:
    """(path, blob_id, _content): every version content-addressed."""
    text = F.coalesce(F.col(content), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(text, 256).alias("blob_id"), text.alias("_content"))


def scan_unseen(seen_versions: DataFrame, ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """New ledger rows: one for each blob that the ledger lacks under this rule version.

    Copies meet by address before the scan, within each task first, so a blob
    held by a third of all paths is scanned once and no task gets its copies.
    """
    if ledger is not None:
        # Addresses alone say what is unseen; texts move only for those blobs.
        done = ledger.where(F.col("rule_version") == rule_version).select("blob_id")
        unseen = materialise(seen_versions.select("blob_id").distinct().join(done, "blob_id", "left_anti"), "unseen-blobs")
        seen_versions = seen_versions.join(unseen, "blob_id", "left_semi")
    blobs = seen_versions.groupBy("blob_id").agg(F.first("_content").alias("_content"))
    return blobs.select("blob_id", F.lit(rule_version).alias("rule_version"), findings_of(F.col("_content")).alias("findings"))


def findings_by_path(seen_versions: DataFrame, ledger: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
    """(path, blob_id, findings): ledger rows of one rule version at every path that holds the blob."""
    found = ledger.where((F.col("rule_version") == rule_version) & (F.size("findings") > 0)).groupBy("blob_id").agg(F.first("findings").alias("findings"))
    return seen_versions.select("path", "blob_id").join(found, "blob_id", "left").select("path", "blob_id", F.coalesce("findings", F.array().cast(f"array<{SPAN}>")).alias("findings"))


class BlobLedger:
    """The ledger as a folder of Parquet folders, one for each ``update``, which scans what is new.

    Two writers at a time do not touch each other's files; what both have scanned stands in both.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(LEDGER).parquet(f"{self.folder}/*")
        except Exception as e:  # an absent folder is an empty ledger
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LEDGER)

    def update(self, seen_versions: DataFrame, rule_version: int = RULE_VERSION) -> DataFrame:
        scan_unseen(seen_versions, self.read(), rule_version).write.parquet(f"{self.folder}/{uuid.uuid4().hex}")
        return self.read()


def scan_documents(docs: DataFrame, path: str = "doc_id", content: str = "text", ledger: DataFrame | None = None) -> DataFrame:
    """(path, blob_id, findings) of every row, scanning what ``ledger`` lacks."""
    seen = versions(docs, path, content)
    # The new rows are written: the ledger is a table, and Spark can split a skewed join between tables.
    fresh = materialise(scan_unseen(seen, ledger), "blob-ledger")
    return findings_by_path(seen, fresh if ledger is None else ledger.select("blob_id", "rule_version", "findings").union(fresh))


def redact(docs: DataFrame, content: str = "text") -> DataFrame:
    """``docs`` with every finding in ``content`` replaced by its kind; other columns stay."""
    text = F.coalesce(F.col(content), F.lit(""))
    seen = docs.select(F.sha2(text, 256).alias("blob_id"), text.alias("_content"))
    found = materialise(scan_unseen(seen).where(F.size("findings") > 0), "blob-ledger")
    own = docs[content]
    joined = docs.join(found, F.sha2(F.coalesce(own, F.lit("")), 256) == found["blob_id"], "left")
    new = F.when(found["findings"].isNotNull(), masked(own, found["findings"])).otherwise(own)
    return joined.select(*[new.alias(c) if c == content else docs[c] for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's rows."""
    base = F.filter("findings", lambda s: s["kind"].isin(BASE_KINDS))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("path").alias("doc_id"), *[count(k) for k in BASE_KINDS], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("findings")).alias("spans"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds over one ledger: the second finds every pair scanned and only joins findings back."""
    seen = versions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ledger = BlobLedger(spark, f"{shared_dir(spark).rstrip('/')}/op4-ledger-{uuid.uuid4().hex}")
    for _ in range(2):
        found = ledger.update(seen)
    return digest(findings_by_path(seen, found))
