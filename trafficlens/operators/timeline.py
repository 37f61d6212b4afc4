"""Building blocks for order-dependent operators: cells, islands, as-of lookups, sliding counts.

A key may hold a third of all rows, so no operator here sorts the raw rows of one key in one
task. Time is cut into cells; rows are first reduced to one per (key, millisecond) or one per
(key, cell), with map-side combining, and only those reduced rows meet per key.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.times import millis
from ..session import keep

CELL_MS = 60_000
HOT_KEY_ROWS = 2_000_000  # a key with more rows than this is never sorted in one task


def cell_of(ms: Column, cell_ms: int) -> Column:
    return F.floor(ms / F.lit(cell_ms)).cast("bigint")


def runs(keys: list) -> Iterator[tuple[int, int]]:
    """Stretches of equal neighbours."""
    start = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[start]:
            yield start, i
            start = i


def hot_keys(rows: DataFrame, key: str, more_than: int = HOT_KEY_ROWS) -> DataFrame:
    """Keys with more rows than one task should sort; few by nature, at most rows / ``more_than``."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return keep(sizes.filter(F.col("_n") > more_than).select(key), "hot-keys")


def spans(points: DataFrame, key: str, ms: str, cell_ms: int, n: Column | None = None) -> DataFrame:
    """Per (key, cell): number of rows, first and last time. At most one row per key and cell."""
    return points.groupBy(key, cell_of(F.col(ms), cell_ms).alias("cell")).agg(
        F.sum(n if n is not None else F.lit(1)).alias("n"),
        F.min(ms).alias("first_ms"),
        F.max(ms).alias("last_ms"),
    )


def with_islands(cells: DataFrame, key: str, gap_ms: int, cut: Column | None = None) -> DataFrame:
    """Number the stretches of a key's cells that are at least ``gap_ms`` apart.

    Needs cells no longer than the gap, so that a gap can only lie between two cells. A cell for
    which ``cut`` holds begins a stretch as well.
    """
    w = Window.partitionBy(key).orderBy("cell")
    quiet = F.col("first_ms") - F.lag("last_ms").over(w) >= F.lit(gap_ms)
    if cut is not None:
        quiet = F.coalesce(quiet, F.lit(False)) | cut
    starts = F.when(quiet, 1).otherwise(0)
    return cells.withColumn("_starts", starts).withColumn("island", F.sum("_starts").over(w)).drop("_starts")


def limiter_islands(
    requests: DataFrame, gap_seconds: int, key: str = "api_key_id", ts: str = "ts", cell_ms: int = CELL_MS
) -> DataFrame:
    """Add ``island``: a new one starts wherever the key was silent for ``gap_seconds`` or more."""
    cell_ms = min(cell_ms, gap_seconds * 1000)
    rows = requests.withColumn("_ms", millis(F.col(ts))).withColumn("_cell", cell_of(F.col("_ms"), cell_ms))
    cells = with_islands(spans(rows, key, "_ms", cell_ms), key, gap_seconds * 1000)
    numbers = cells.select(key, F.col("cell").alias("_cell"), "island")
    return rows.join(numbers, [key, "_cell"], "left").select(*requests.columns, "island")


def sliding_counts(
    requests: DataFrame, seconds: int, key: str = "api_key_id", ts: str = "ts", out: str = "in_window",
    cell_ms: int = CELL_MS,
) -> DataFrame:
    """Add the number of the key's requests in ``(ts - seconds, ts]``, rejected ones included.

    Requests are first counted per (key, millisecond). The window is a whole number of cells long.
    The count at time t of cell c is the total of the cells before c that lie in the window, plus
    what cell c has seen up to t, minus what the cell dropping out had seen at the same offset. So
    each count appears twice, as an arrival in its own cell and as an expiry one window later, no
    task sees more than a cell of a key, and no window holds rows: they join their time's count.
    """
    span_ms = seconds * 1000
    while span_ms % cell_ms:
        cell_ms //= 2
    k = span_ms // cell_ms
    rows = requests.withColumn("_ms", millis(F.col(ts)))
    counts = rows.groupBy(F.col(key).alias("key"), F.col("_ms").alias("ms")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("cell", cell_of(F.col("ms"), cell_ms))
    moves = F.array(
        F.struct("cell", F.col("ms").alias("at"), F.col("n").alias("move"), F.lit(True).alias("own")),
        F.struct((F.col("cell") + k).alias("cell"), (F.col("ms") + span_ms).alias("at"), (-F.col("n")).alias("move"), F.lit(False).alias("own")),
    )
    inside = Window.partitionBy("key", "cell").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    running = counts.select("key", F.inline(moves)).withColumn("running", F.sum("move").over(inside)).filter("own")
    before = Window.partitionBy("key").orderBy("cell").rangeBetween(-k, -1)
    base = (
        counts.groupBy("key", "cell")
        .agg(F.sum("n").alias("n"))
        .select("key", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    totals = running.join(base, ["key", "cell"]).select(
        F.col("key").alias(key), F.col("at").alias("_ms"), (F.col("base") + F.col("running")).alias(out)
    )
    return rows.join(totals, [key, "_ms"]).select(*requests.columns, out)


def asof_last(
    left: DataFrame, right: DataFrame, key: str, ms: str, value: str, cell_ms: int = CELL_MS
) -> DataFrame:
    """Add to each left row the greatest ``value`` (a time) of the right rows of its key at or before it.

    The times of a key are looked up, not its rows: inside a cell a window over distinct times finds
    the value, what lies before the cell comes from one row per (key, cell), and the rows join the
    result of their time.
    """
    asked = left.select(key, F.col(ms).alias("_at")).filter(F.col("_at").isNotNull()).distinct().withColumn("_cell", cell_of(F.col("_at"), cell_ms))
    rrows = right.select(key, F.col(value).alias("_v")).distinct().withColumn("_cell", cell_of(F.col("_v"), cell_ms))
    both = asked.withColumns({"_v": F.lit(None).cast("bigint"), "_asked": F.lit(True)}).unionByName(
        rrows.select(key, F.col("_v").alias("_at"), "_cell", "_v", F.lit(False).alias("_asked"))
    )
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = both.groupBy(key, "_cell").agg(F.max("_v").alias("_vmax")).select(key, "_cell", F.max("_vmax").over(earlier).alias("_carry"))
    upto = Window.partitionBy(key, "_cell").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.max("_v").over(upto)).filter("_asked").drop("_v", "_asked")
    found = seen.join(carry, [key, "_cell"], "left").select(
        key, F.col("_at").alias(ms), F.greatest(F.col("_seen"), F.col("_carry")).alias(value)
    )
    return left.join(found, [key, ms], "left").select(*left.columns, value)


def asof_fill(
    requests: DataFrame, fills: DataFrame, ttl_seconds: int, key: str = "request_hash", ts: str = "ts",
    fill_ts: str = "fill_ts", cell_ms: int = CELL_MS,
) -> DataFrame:
    """Latest fill of the same key at or before each request, and whether it is still alive."""
    rows = requests.withColumn("_ms", millis(F.col(ts)))
    marks = fills.select(key, millis(F.col(fill_ts)).alias("fill_ms"))
    found = asof_last(rows, marks, key, "_ms", "fill_ms", cell_ms)
    alive = F.coalesce(F.col("_ms") - F.col("fill_ms") < F.lit(ttl_seconds * 1000), F.lit(False))
    return found.select(*requests.columns, "fill_ms", alive.alias("alive"))
