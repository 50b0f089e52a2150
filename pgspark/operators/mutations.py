"""Mutations as new versions of a table: every function returns the table after the change.

Values are read from the state before the change, so several changes of one
statement see the same snapshot. ``VersionedTable`` publishes a version by
writing a new folder and then naming it; readers keep the version they opened.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Append; missing columns become null. No rows, no change."""
    return table.unionByName(rows, allowMissingColumns=True)


def merge(table: DataFrame, rows: DataFrame, keys: list[str], on_match: dict[str, Column] | None = None) -> DataFrame:
    """Insert the rows whose keys are absent; update matches with ``on_match``, which may use ``new_<column>``.

    ``rows`` hold each key once, else it is an error. Keys compare null-safely.
    """
    if not rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty():
        raise ValueError("a key stands in more than one of the rows to merge")
    new = rows.select(*[F.col(c).alias(f"new_{c}") for c in rows.columns], F.lit(True).alias("_hit"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"new_{k}"))
    joined = table.join(new, same, "left")
    changed = on_match or {}
    updated = joined.select(*[F.when(F.col("_hit"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in table.columns])
    marker = table.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    absent = F.lit(True)
    for i, k in enumerate(keys):
        absent = absent & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return updated.unionByName(rows.join(marker, absent, "left_anti"), allowMissingColumns=True)


def set_properties(table: DataFrame, where: Column, **values: Column) -> DataFrame:
    """Assign to the rows that satisfy ``where``; all values come from the old row."""
    return table.select(*[F.when(where, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns], *[F.when(where, v).alias(c) for c, v in values.items() if c not in table.columns])


def remove_properties(table: DataFrame, where: Column, *names: str) -> DataFrame:
    return set_properties(table, where, **{n: F.lit(None).cast(table.schema[n].dataType) for n in names})


def delete(table: DataFrame, key: str, gone: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Rows without those whose key is in ``gone``; an error if edges still touch them."""
    if edges is not None:
        ids = gone.select(F.col(key).alias("_id"))
        held = edges.select(F.explode(F.array("src", "dst")).alias("_id")).join(ids, "_id", "left_semi")
        if not held.isEmpty():
            raise ValueError("nodes with edges: use detach_delete")
    return table.join(gone.select(key), key, "left_anti")


def detach_delete(table: DataFrame, key: str, gone: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes and without every edge that touches them."""
    ids = gone.select(F.col(key).alias("_id"))
    left = edges.join(ids, edges["src"] == ids["_id"], "left_anti")
    return table.join(gone.select(key), key, "left_anti"), left.join(ids, left["dst"] == ids["_id"], "left_anti")


def changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): created, updated or deleted rows between two versions."""
    columns = [c for c in before.columns if c != key and c in after.columns]
    old = before.select(F.col(key), F.struct(*columns).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(F.col(key), F.struct(*columns).alias("_new"), F.lit(True).alias("_is"))
    kind = F.when(F.col("_was").isNull(), "created").when(F.col("_is").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return old.join(new, key, "full_outer").select(key, kind.alias("change")).where("change IS NOT NULL")


class VersionedTable:
    """A folder of versions; each is named by a file of its number, which only one writer can create."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _manifest(self) -> DataFrame:
        named = self.spark.read.text(f"{self.folder}/manifest").select("value", "_metadata.file_name")
        return named.select(F.col("file_name").cast("long").alias("version"), F.col("value").alias("path"))

    def read(self, version: int | None = None) -> DataFrame:
        rows = self._manifest() if version is None else self._manifest().where(F.col("version") == version)
        return self.spark.read.parquet(rows.orderBy(F.desc("version")).first()["path"])

    def commit(self, df: DataFrame) -> int:
        """Write a version, then name it; a writer that fails in between leaves the old version current."""
        path = f"{self.folder}/data-{uuid.uuid4().hex}"
        df.write.parquet(path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(f"{self.folder}/manifest")
        fs = folder.getFileSystem(self.spark._jsc.sc().hadoopConfiguration())
        fs.mkdirs(folder)
        while True:
            version = 1 + max([int(f.getPath().getName()) for f in fs.listStatus(folder)], default=0)
            try:
                out = fs.create(hadoop.Path(folder, str(version)), False)
            except Exception as e:  # another writer took this number
                if "already exists" not in str(e):
                    raise
                continue
            out.write(bytearray(path.encode()))
            out.close()
            return version
