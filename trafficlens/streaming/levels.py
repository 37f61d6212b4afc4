"""Tables that take one folder of changes per micro-batch and are merged level by level.

Batch ``b`` writes only its own changes. Whenever ``FAN ** k`` batches are complete, their folders
are merged into one of level ``k``, so that after ``n`` batches the table is read from at most
``FAN - 1`` folders per level, and a change is rewritten once per level. Which folders hold the
table follows from ``n`` alone, and ``n`` is published by an empty file after the batch's folders are whole.

A repeated batch finds the folders of its predecessor untouched and overwrites its own output: what a
batch has merged is removed at the end of the next batch that is run. A reader therefore keeps its folders for
at least one more batch. An empty batch writes an empty folder; a table without batches has no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import remove

FAN = 4

Merge = Callable[[DataFrame], DataFrame]


def folders(n: int, fan: int = FAN) -> list[tuple[int, int]]:
    """(level, first batch) of the folders that hold the first ``n`` batches, oldest first."""
    top = 0
    while fan ** (top + 1) <= n:
        top += 1
    out, first = [], 0
    for level in range(top, -1, -1):
        while first + fan**level <= n:
            out.append((level, first))
            first += fan**level
    return out


def _path(path: str, folder: tuple[int, int]) -> str:
    return f"{path}/level={folder[0]}/first={folder[1]}"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def batches(spark: SparkSession, path: str) -> int:
    """Number of complete batches of the table at ``path``."""
    at, fs = _files(spark, f"{path}/_complete")
    return max((int(f.getPath().getName()) for f in fs.listStatus(at)), default=0) if fs.exists(at) else 0


def read(spark: SparkSession, path: str, schema=None, n: int | None = None) -> DataFrame:
    """The changes of the first ``n`` batches (all complete ones), merged as far as their folders are.

    A table that may have no batches yet is read with its ``schema``.
    """
    held = folders(batches(spark, path) if n is None else n)
    if not held:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[_path(path, f) for f in held])


def append(changes: DataFrame, path: str, batch_id: int, merge: Merge) -> None:
    """Write the changes of a batch; ``merge`` reduces the rows of several batches and keeps their columns."""
    spark, n = changes.sparkSession, batch_id + 1
    before, after = folders(batch_id), folders(n)
    changes.write.mode("overwrite").parquet(_path(path, (0, batch_id)))
    new = after[-1]
    if new[0]:
        merged = [f for f in before if f not in after] + [(0, batch_id)]
        rows = spark.read.schema(changes.schema).parquet(*[_path(path, f) for f in merged])
        merge(rows).select(*changes.columns).write.mode("overwrite").parquet(_path(path, new))
    at, fs = _files(spark, f"{path}/_complete/{n}")
    fs.create(at, True).close()
    # of the last batch: what it merged, its own changes if they are merged, and the mark before its own
    if batch_id:
        for f in {*folders(batch_id - 1), (0, batch_id - 1)} - set(before):
            remove(spark, _path(path, f))
        remove(spark, f"{path}/_complete/{batch_id - 1}")


def newest(keys: list[str], by: str) -> Merge:
    """Keep the row with the greatest ``by`` of each key."""

    def merge(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), by).alias("_r")).select(*keys, "_r.*")

    return merge


def summed(keys: list[str]) -> Merge:
    """Add up all other columns of each key."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])

    return merge
