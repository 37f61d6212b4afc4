"""Replay of the exact-match cache: first success fills, later ones hit until the TTL ends.

The fills of a hash form a chain: the next one is the first eligible request at or after the
previous fill plus the TTL. The requests of a hash are sorted once and the chain jumps from fill to
fill. A hot hash is never gathered: its chain is followed on many tasks by composed transfer
functions of its TTL-long cells (``chains``), however long it goes without a silence.
Hits are then read off by joining rows to the fills on (hash, TTL-long cell), which spreads a
hot hash over its cells; a cell has at most one fill.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import settings as S
from ..functions.times import millis
from ..session import keep
from .chains import jumps
from .timeline import CELL_MS, HOT_KEY_ROWS, asof_last, cell_of, hot_keys, runs


class _Chain:
    """Follows one hash after the other; remembers when the current one may fill again."""

    def __init__(self, ttl_ms: int):
        self.ttl, self.key, self.due = ttl_ms, None, None

    def fills(self, key, times: list, start: int, end: int) -> Iterator[int]:
        """Positions of the fills among the sorted ``times[start:end]`` of ``key``."""
        if key != self.key or self.due is None:
            self.key, self.due = key, times[start]
        i = start
        while times[end - 1] >= self.due:
            i = bisect_left(times, self.due, i, end)
            yield i
            self.due = times[i] + self.ttl


def _chain_rows(ttl_ms: int):
    """Fills among plain rows (key, ms, id) sorted by (key, ms, id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = _Chain(ttl_ms)
        for batch in batches:
            keys, times = batch.column("key").to_pylist(), batch.column("ms").to_pylist()
            picks = [i for s, e in runs(keys) for i in chain.fills(keys[s], times, s, e)]
            if picks:
                yield batch.take(pa.array(picks, type=pa.int64()))

    return run


def islands(rows: DataFrame, gap_ms: int) -> DataFrame:
    """(key, cell, island): stretches of a key that a silence of a TTL and its longest delay separates.

    After such a silence every answer has arrived and expired, so each island can be followed by
    itself. Only the ends of each cell are ranked. A silence inside a cell is left alone. Rows without
    ``delay`` are answered at once.
    """
    delay = F.col("delay") if "delay" in rows.columns else F.lit(0)
    ends = rows.groupBy("key", "cell").agg(F.min("ms").alias("first"), F.max("ms").alias("last"), F.max(delay).alias("delay"))
    order = Window.partitionBy("key").orderBy("cell")
    longest = F.greatest(F.max("delay").over(Window.partitionBy("key")), F.lit(0))
    new = (F.col("first") - F.lag("last").over(order) >= longest + F.lit(gap_ms)).cast("int")
    starts = ends.withColumn("new", F.coalesce(new, F.lit(0)))
    return starts.select("key", "cell", F.sum("new").over(order).alias("island"))


def fill_chain(
    candidates: DataFrame, ttl_seconds: int, key: str = "key", ms: str = "ms", id_: str = "id",
    cell_ms: int = CELL_MS, hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """The fills among requests that may fill: columns key, ms, id."""
    ttl_ms = ttl_seconds * 1000
    rows = candidates.select(F.col(key).alias("key"), F.col(ms).alias("ms"), F.col(id_).alias("id"))
    rows = rows.filter(F.col("key").isNotNull())
    out = f"key {rows.schema['key'].dataType.simpleString()}, ms bigint, id {rows.schema['id'].dataType.simpleString()}"
    hot = hot_keys(rows, "key", hot_rows)
    fills = (
        rows.join(hot, "key", "left_anti")
        .repartition("key")
        .sortWithinPartitions("key", "ms", "id")
        .mapInArrow(_chain_rows(ttl_ms), out)
    )
    if hot.isEmpty():
        return fills
    busy = keep(rows.join(hot, "key", "left_semi").groupBy("key", "ms").agg(F.min("id").alias("id")), "hot-times")
    return fills.unionByName(busy.join(jumps(busy, ttl_ms, cell_ms), ["key", "ms"]).select("key", "ms", "id"))


def hits_by_fills(
    rows: DataFrame, fills: DataFrame, ttl_seconds: int, key: str, ms: str = "_ms", id_: str = "id"
) -> DataFrame:
    """Add ``fill_id``/``fill_ms``: the live fill of the row's key before the row, by (ms, id).

    Fills of a key are at least a TTL apart, so only the fill of the row's own TTL-long cell and
    the one of the cell before can be alive.
    """
    ttl_ms = ttl_seconds * 1000
    both = (
        fills.withColumn("age", F.explode(F.array(F.lit(0), F.lit(1))))
        .groupBy(F.col("key").alias(key), (cell_of(F.col("ms"), ttl_ms) + F.col("age")).alias("_cell"))
        .agg(
            *[
                F.max(F.when(F.col("age") == a, F.col(c))).alias(f"{name}{a}")
                for a in (0, 1)
                for c, name in (("ms", "fms"), ("id", "fid"))
            ]
        )
    )
    joined = rows.withColumn("_cell", cell_of(F.col(ms), ttl_ms)).join(both, [key, "_cell"], "left")

    def seen(a: int):
        earlier = (F.col(f"fms{a}") < F.col(ms)) | ((F.col(f"fms{a}") == F.col(ms)) & (F.col(f"fid{a}") < F.col(id_)))
        return earlier & (F.col(ms) - F.col(f"fms{a}") < F.lit(ttl_ms))

    is_fill = F.coalesce((F.col("fms0") == F.col(ms)) & (F.col("fid0") == F.col(id_)), F.lit(False))

    def pick(c: str):
        return F.when(is_fill, F.lit(None)).when(seen(0), F.col(f"{c}0")).when(seen(1), F.col(f"{c}1"))

    return joined.select(
        *rows.columns, pick("fid").alias("fill_id"), pick("fms").alias("fill_ms"), is_fill.alias("is_fill")
    )


def replay_exact_cache(
    requests: DataFrame,
    ttl_seconds: int = S.CACHE_TTL_SECONDS,
    *,
    key: str = "request_hash",
    ts: str = "ts",
    id_: str = "id",
    fillable: str | None = None,
    earlier_fills: DataFrame | None = None,
    cell_ms: int = CELL_MS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Add ``cache_hit`` (none or exact), ``is_fill`` and the ``fill_id`` that answered.

    ``fillable`` names a boolean column: requests whose upstream call fails may hit but never
    fill. ``earlier_fills`` (key, ms, id) continues from a cache that is already filled.
    """
    rows = requests.withColumn("_ms", millis(F.col(ts)))
    can_fill = rows if fillable is None else rows.filter(F.col(fillable))
    candidates = can_fill.select(F.col(key).alias("key"), F.col("_ms").alias("ms"), F.col(id_).alias("id"))
    if earlier_fills is not None:
        candidates = candidates.unionByName(earlier_fills.select("key", "ms", "id"))
    fills = fill_chain(candidates, ttl_seconds, cell_ms=cell_ms, hot_rows=hot_rows)
    out = hits_by_fills(rows, fills, ttl_seconds, key, "_ms", id_)
    return out.select(
        *requests.columns,
        F.when(F.col("fill_id").isNotNull(), "exact").otherwise("none").alias("cache_hit"),
        "is_fill",
        "fill_id",
    )


def _delayed_sets(ttl_ms: int, packed: bool):
    """Times at which answers become visible, among requests sorted by (key, ms)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, visible, pending = None, None, []
        for batch in batches:
            keys, ms, delay = batch.column("key").to_pylist(), batch.column("ms"), batch.column("delay")
            if packed:
                keys = list(zip(keys, batch.column("island").to_pylist(), strict=True))
                ends = np.cumsum(ms.value_lengths().to_numpy()).tolist()
                stretches = zip(range(len(ends)), [0, *ends], ends)
                times, delays = ms.flatten().to_pylist(), delay.flatten().to_pylist()
            else:
                stretches = ((s, s, e) for s, e in runs(keys))
                times, delays = ms.to_pylist(), delay.to_pylist()
            rows, sets = [], []
            for row, start, end in stretches:
                if keys[row] != current:
                    current, visible, pending = keys[row], None, []
                i = start
                while i < end:
                    now = times[i]
                    while pending and pending[0] < now:
                        visible = heapq.heappop(pending)
                    if visible is not None and now - visible < ttl_ms:
                        # nothing changes until the entry expires or the next answer arrives
                        change = min(visible + ttl_ms, pending[0] + 1 if pending else visible + ttl_ms)
                        i = bisect_left(times, change, i + 1, end)
                        continue
                    rows.append(row)
                    sets.append(now + delays[i])
                    heapq.heappush(pending, now + delays[i])
                    i += 1
            if sets:
                key = batch.column("key").take(pa.array(rows, type=pa.int64()))
                yield pa.RecordBatch.from_arrays([key, pa.array(sets, type=pa.int64())], names=["key", "set_ms"])

    return run


def replay_exact_cache_delayed(
    requests: DataFrame,
    latency_ms: str,
    ttl_seconds: int = S.CACHE_TTL_SECONDS,
    *,
    key: str = "request_hash",
    ts: str = "ts",
    fillable: str | None = None,
    cell_ms: int = CELL_MS,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """The replay when an answer is set ``latency_ms`` after its request and visible from then on.

    Requests of the same millisecond do not see it yet. Until then equal requests all go upstream and each of them sets the entry anew. Adds
    ``cache_hit`` and ``is_fill``.
    """
    ttl_ms = ttl_seconds * 1000
    rows = requests.withColumn("_ms", millis(F.col(ts)))
    can_fill = rows if fillable is None else rows.filter(F.col(fillable))
    points = can_fill.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col("_ms").alias("ms"), F.col(latency_ms).cast("bigint").alias("delay")
    )
    out = f"key {points.schema['key'].dataType.simpleString()}, set_ms bigint"
    hot = hot_keys(points, "key", hot_rows)
    sets = (
        points.join(hot, "key", "left_anti")
        .repartition("key")
        .sortWithinPartitions("key", "ms", "delay")
        .mapInArrow(_delayed_sets(ttl_ms, False), out)
    )
    if not hot.isEmpty():
        # requests of one time and latency set the same entry
        busy = points.join(hot, "key", "left_semi").withColumn("cell", cell_of(F.col("ms"), cell_ms)).distinct()
        packed = (
            busy.groupBy("key", "cell")
            .agg(F.array_sort(F.collect_list(F.struct("ms", "delay"))).alias("p"))
            .join(islands(busy, ttl_ms), ["key", "cell"])
            .select("key", "island", "cell", F.col("p.ms").alias("ms"), F.col("p.delay").alias("delay"))
            .repartition("key", "island")
            .sortWithinPartitions("key", "island", "cell")
        )
        sets = sets.unionByName(packed.mapInArrow(_delayed_sets(ttl_ms, True), out))
    before = rows.withColumn("_before", F.col("_ms") - 1)
    found = asof_last(before, sets.withColumnRenamed("key", key), key, "_before", "set_ms", cell_ms)
    alive = F.coalesce(F.col("_ms") - F.col("set_ms") < F.lit(ttl_ms), F.lit(False))
    can = F.lit(True) if fillable is None else F.col(fillable)
    return found.select(
        *requests.columns, F.when(alive, "exact").otherwise("none").alias("cache_hit"), (~alive & can).alias("is_fill")
    )
