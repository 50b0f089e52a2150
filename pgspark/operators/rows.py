"""Row operators whose semantics differ from Spark's defaults, and small row helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_by(df: DataFrame, *keys: tuple[str | Column, bool]) -> DataFrame:
    """Sort by (column, ascending): ascending puts nulls last, descending puts them first."""
    return df.orderBy(*_sort_keys(keys))


def _sort_keys(keys) -> list[Column]:
    columns = [(F.col(c) if isinstance(c, str) else c, up) for c, up in keys]
    return [c.asc_nulls_last() if up else c.desc_nulls_first() for c, up in columns]


def page(df: DataFrame, *keys: tuple[str | Column, bool], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Sorted rows after ``offset``, at most ``limit``: the offset always comes first."""
    out = df.orderBy(*_sort_keys(keys)).offset(offset)
    return out if limit is None else out.limit(limit)


def unwind(df: DataFrame, values: Column, name: str) -> DataFrame:
    """One row per list element; a null or empty list gives no row."""
    return df.withColumn(name, F.explode(values))


# -- set operations ------------------------------------------------------------


def _same(left: DataFrame, right: DataFrame) -> tuple[DataFrame, Column]:
    """The right side renamed, and the null-safe equality of all columns by position."""
    if len(left.columns) != len(right.columns):
        raise ValueError("both sides need the same number of columns")
    names = [f"_r{i}" for i in range(len(right.columns))]
    return right.toDF(*names), reduce(lambda a, b: a & b, [left[c].eqNullSafe(F.col(n)) for c, n in zip(left.columns, names)])


def union_all(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right)


def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def intersect_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.intersect(right)


def intersect_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row that the right side holds, with the left side's multiplicity."""
    renamed, same = _same(left, right)
    return left.join(renamed, same, "left_semi")


def except_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.subtract(right)


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row that the right side does not hold, with the left side's multiplicity."""
    renamed, same = _same(left, right)
    return left.join(renamed, same, "left_anti")


def otherwise(left: DataFrame, right: DataFrame) -> DataFrame:
    """The left rows, or the right ones if there are no left rows."""
    one = left.limit(1).select(F.lit(1).alias("_any"))  # at most one row
    return left.union(right.join(F.broadcast(one), F.lit(True), "left_anti"))


# -- aggregates over lists -------------------------------------------------------


def list_sum(values: Column) -> Column:
    """Sum of the non-null elements; null without any."""
    kept = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double")))


def list_avg(values: Column) -> Column:
    kept = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, list_sum(kept) / F.size(kept))


def list_min(values: Column) -> Column:
    return F.array_min(values)


def list_max(values: Column) -> Column:
    return F.array_max(values)


def list_count(values: Column) -> Column:
    return F.size(F.filter(values, lambda x: x.isNotNull())).cast("long")


def collect_sorted(value: Column, *by: Column) -> Column:
    """Aggregate: the values in the order of ``by``; nulls dropped; an empty list for none."""
    keyed = F.when(value.isNotNull(), F.struct(*[b.alias(f"k{i}") for i, b in enumerate(by)], value.alias("v")))
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda s: s["v"])
