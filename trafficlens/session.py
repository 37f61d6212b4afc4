"""Session building and the shared checkpoint folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths made in the open ``scratch`` blocks, per thread, the innermost last.
_open: dict[int, list[list[str]]] = {}


def build_session(master: str | None = None, app: str = "trafficlens", **conf: str) -> SparkSession:
    """A session with the settings every job here relies on (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    Where it is unset, a folder in the warehouse, which every executor reaches as well.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not current:
        current = sc.getCheckpointDir()
    if not current:
        current = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder; removed at the end of the ``scratch`` it is made in,
    or else with the rest of that folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    blocks = _open.get(threading.get_ident())
    if blocks:
        blocks[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever it is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept inside are removed at the end; write what is to stay before that."""
    blocks = _open.setdefault(threading.get_ident(), [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            remove(spark, path)


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, later steps read only the
    columns they need, and the planner knows the true size, so it broadcasts the table exactly
    where it is small enough.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
