"""Prefix sums and ranks over a whole table without gathering a group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import keep


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    """Equality of all named columns in which null equals null."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def running(df: DataFrame, value: str, within: list[str], order: list[Column], name: str = "before") -> DataFrame:
    """Adds ``name``: the sum of the long column ``value`` over the earlier rows of the same group.

    Rows are dealt by ranges of (group, order), so a hot group covers many tasks; each range is
    summed by itself and shifted by the sums of the ranges before it (one row per range and group).
    Pass narrow rows: they are written once. Rows that tie in ``order`` come in any order.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_last() for c in within] + order
    dealt = keep(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    names = ["_part", *within]
    sums = dealt.groupBy(*names).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.withColumn("_shift", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    here = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return (
        local.join(shift, same(local, shift, names))
        .select(*[local[c] for c in df.columns], (F.col("_here") + F.col("_shift")).alias(name))
    )


def numbered(df: DataFrame, order: str, key: str = "doc_id", name: str = "copy_no") -> DataFrame:
    """Tells rows of the same key apart by a number from 1, in the order of the column ``order``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)))
