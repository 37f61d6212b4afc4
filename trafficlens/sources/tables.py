"""Table scans and appends.

Facts are Parquet folders partitioned by the day ``dt``; dimensions are plain folders.
No key, job or response table is broadcast by hint: they grow with the traffic, so the size
check of ``spark.sql.autoBroadcastJoinThreshold`` (and AQE at run time) decides.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import settings as S
from ..functions.times import as_datetime, ts_lit
from . import schemas

DAY = "dt"


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def load_usage(
    spark: SparkSession, path: str, from_: str | datetime | None = None, to: str | datetime | None = None
) -> DataFrame:
    """The usage fact, pruned to the day folders and row groups of ``[from_, to]``."""
    with_day = T.StructType([*schemas.USAGE.fields, T.StructField(DAY, T.DateType())])
    df = _scan(spark, path, with_day)
    if from_ is not None:
        df = df.filter((F.col(DAY) >= F.lit(as_datetime(from_).date())) & (F.col("created_at") >= ts_lit(from_)))
    if to is not None:
        df = df.filter((F.col(DAY) <= F.lit(as_datetime(to).date())) & (F.col("created_at") <= ts_lit(to)))
    return df.drop(DAY)


def append_usage(df: DataFrame, path: str) -> None:
    """Append usage rows into their day folders.

    The rebalance gathers a day in few tasks, so there are no files per day and input task, and
    splits a day that holds most of the rows into tasks of the advisory partition size.
    """
    rows = _shape(df, schemas.USAGE).withColumn(DAY, F.to_date("created_at"))
    rows.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def drop_days(spark: SparkSession, path: str, as_of: str | datetime, days: float = 30) -> list[str]:
    """Retention: remove the day folders that lie wholly before ``as_of`` less ``days``; their names.

    Works on folder names alone; rows of the day in which the limit falls stay (``usage.retain``).
    """
    limit = (as_datetime(as_of) - timedelta(days=days)).date().isoformat()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())
    gone = [n for n in found if n.startswith(f"{DAY}=") and n.removeprefix(f"{DAY}=") < limit]
    for name in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
    return gone


def _shape(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_days(spark: SparkSession, path: str, first: str, last: str) -> DataFrame:
    """Whole days of the usage fact, from their folders only; feeds a rollup of changed days."""
    with_day = T.StructType([*schemas.USAGE.fields, T.StructField(DAY, T.DateType())])
    return _scan(spark, path, with_day).filter(F.col(DAY).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).drop(DAY)


def load_keys(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.KEYS)


def load_responses(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.RESPONSES)


def load_entries(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.ENTRIES)


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, schemas.JOBS)


def stream_usage(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """The same fact as a file stream."""
    with_day = T.StructType([*schemas.USAGE.fields, T.StructField(DAY, T.DateType())])
    reader = spark.readStream.schema(with_day).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).drop(DAY)


def pricing_df(spark: SparkSession, prices: list[tuple] | None = None) -> DataFrame:
    """The price list as literal rows of the plan, so the planner knows its size and broadcasts it
    as long as it is small; a longer list is joined like any table."""
    rows = [f"(:p{i}, :m{i}, cast({a!r} as double), cast({b!r} as double))" for i, (_, _, a, b) in enumerate(prices or S.PRICES)]
    names = {f"{c}{i}": r[j] for i, r in enumerate(prices or S.PRICES) for j, c in enumerate("pm")}
    text = f"select * from values {', '.join(rows)} as t(provider, model, prompt_per_1k, completion_per_1k)"
    return spark.sql(text, args=names)
