"""Replay of a sliding-window rate limiter with a short and a long window per key.

Only accepted requests take a slot, so whether one is accepted depends on all earlier decisions.
That chain is followed per key, but over compressed input:

1. rows are counted per key and stretch of the longest window, combined before the shuffle; where
   two neighbouring stretches stay within the lowest limit nothing can be rejected, and that is
   the end of it for most keys;
2. the others become one count per (key, millisecond), which are streamed per key in time order.
   A full window is skipped in one step to the moment it opens, so the work grows with the
   accepted requests, and memory holds just the accepted slots of one window;
3. a hot key is not sorted in one task: its counts are packed and sorted per cell on many tasks.
   Its stretches are independent (islands) and replayed on different tasks where it was silent for
   longer than both windows, and also where a short window's raw counts stay within its limit and
   the long limit cannot be reached before all earlier slots have left its window. An island whose
   raw counts never reach a limit is skipped. A key that is always over a limit stays one island;
4. the decisions go back to the rows by (key, millisecond), which spreads a hot key over all tasks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import settings as S
from ..functions.credentials import limit_of
from ..functions.times import millis
from ..session import keep
from .timeline import CELL_MS, HOT_KEY_ROWS, cell_of, runs, with_islands

OK, SHORT, LONG = 0, 1, 2
FEW_STRETCHES = 200_000  # busy stretches that are small enough to look up in place of a shuffle


class _Gate:
    """Accepted slots of one window."""

    def __init__(self, width_ms: int):
        self.width, self.slots, self.used = width_ms, deque(), 0

    def clear(self) -> None:
        self.slots.clear()
        self.used = 0

    def expire(self, now: int) -> None:
        while self.slots and self.slots[0][0] <= now - self.width:
            self.used -= self.slots.popleft()[1]

    def take(self, now: int, n: int) -> None:
        self.slots.append((now, n))
        self.used += n

    def opens(self) -> int:
        return self.slots[0][0] + self.width


def _replay_cell(ms, n, short: _Gate, long: _Gate, per_short: int, per_long: int):
    """Decide the counts of one cell: accepted per entry, and why the others were not."""
    accepted = np.zeros(len(ms), dtype=np.int64)
    reason = np.zeros(len(ms), dtype=np.int8)
    i, end = 0, len(ms)
    while i < end:
        now, asked = int(ms[i]), int(n[i])
        short.expire(now)
        long.expire(now)
        free = asked
        if per_short > 0:
            free = min(free, per_short - short.used)
        if per_long > 0:
            free = min(free, per_long - long.used)
        if free > 0:
            accepted[i] = free
            short.take(now, free)
            long.take(now, free)
        if free >= asked:
            i += 1
            continue
        full = short if per_short > 0 and short.used >= per_short else long
        code = SHORT if full is short else LONG
        # nothing is accepted before the full window opens, and the reason stays the same
        j = max(i + 1, int(np.searchsorted(ms, full.opens(), side="left")))
        reason[i:j] = code
        i = j
    return accepted, reason


def _replay(short_ms: int, long_ms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long, current = _Gate(short_ms), _Gate(long_ms), None
        for batch in batches:
            keys, islands = batch.column("key"), batch.column("island").to_pylist()
            names = keys.to_pylist()
            lim_s, lim_l = batch.column("per_short").to_pylist(), batch.column("per_long").to_pylist()
            ends = np.cumsum(batch.column("ms").value_lengths().to_numpy())
            ms = batch.column("ms").flatten().to_numpy()
            n = batch.column("n").flatten().to_numpy()
            taken = batch.column("taken").flatten().to_numpy()
            acc, why, start = [], [], 0
            for row, end in enumerate(ends):
                if (names[row], islands[row]) != current:
                    current = (names[row], islands[row])
                    short.clear()
                    long.clear()
                a, r = _replay_cell(ms[start:end], n[start:end], short, long, lim_s[row], lim_l[row])
                acc.append(a)
                why.append(r)
                start = end
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))

            def lists(values, kind):
                return pa.ListArray.from_arrays(offsets, pa.array(values, type=kind))

            if not len(ends):
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    keys,
                    pa.array(lim_s, type=pa.int32()),
                    pa.array(lim_l, type=pa.int32()),
                    lists(ms, pa.int64()),
                    # what earlier slots took is not there for the requests of this replay
                    lists(np.concatenate(acc) - taken, pa.int64()),
                    lists(np.concatenate(why), pa.int8()),
                ],
                names=["key", "per_short", "per_long", "ms", "accepted", "reason"],
            )

    return run


def _replay_counts(short_ms: int, long_ms: int):
    """The same over plain counts (key, ms, n, taken, limits) sorted by (key, ms); rejections only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short, long, current = _Gate(short_ms), _Gate(long_ms), None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column("key").to_pylist()
            cols = [batch.column(c).to_numpy() for c in ("ms", "n", "taken", "per_short", "per_long")]
            ms, n, taken, lim_s, lim_l = cols
            acc, why = [], []
            for start, end in runs(names):
                if names[start] != current:
                    current = names[start]
                    short.clear()
                    long.clear()
                a, r = _replay_cell(ms[start:end], n[start:end], short, long, int(lim_s[start]), int(lim_l[start]))
                acc.append(a)
                why.append(r)
            accepted, reason = np.concatenate(acc) - taken, np.concatenate(why)
            hit = np.flatnonzero(reason)
            if len(hit):
                kept = batch.select(["key", "per_short", "per_long", "ms"]).take(pa.array(hit))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(accepted[hit], type=pa.int64()), pa.array(reason[hit], type=pa.int8())],
                    names=["key", "per_short", "per_long", "ms", "accepted", "reason"],
                )

    return run


def key_limits(keys: DataFrame, per_short: int = S.PER_MINUTE, per_long: int = S.PER_DAY) -> DataFrame:
    """Limits per key: its JSON overrides or the defaults."""
    o = F.col("rate_limit_overrides")
    return keys.select(
        F.col("id").alias("api_key_id"),
        limit_of(o, "per_minute", per_short).alias("per_short"),
        limit_of(o, "per_day", per_long).alias("per_long"),
    )


def _busy_stretches(
    points: DataFrame, key: str, limits: DataFrame | None, per_short: int, per_long: int
) -> DataFrame:
    """Stretches (as long as the longest window) per key that may hold a rejection, with the limits.

    No window reaches further back than the stretch before its own. Where two neighbouring
    stretches together hold no more rows than the lowest limit, everything is accepted. A
    stretch is also kept for the one after it, whose windows reach into it.
    """
    sizes = points.groupBy("key", "big").agg(F.sum("n").alias("n"))
    if limits is not None:
        sizes = sizes.join(limits.select(F.col(key).alias("key"), "per_short", "per_long"), "key", "left")
    else:
        sizes = sizes.withColumns({c: F.lit(None).cast("int") for c in ("per_short", "per_long")})
    sizes = sizes.withColumns(
        {
            "per_short": F.coalesce("per_short", F.lit(per_short)).cast("int"),
            "per_long": F.coalesce("per_long", F.lit(per_long)).cast("int"),
        }
    )
    lowest = F.least(*[F.when(F.col(c) > 0, F.col(c)) for c in ("per_short", "per_long")])
    by_big = Window.partitionBy("key").orderBy("big")
    full = F.coalesce(F.sum("n").over(by_big.rangeBetween(-1, 0)) > lowest, F.lit(False))
    kept = F.max("full").over(by_big.rangeBetween(0, 1))
    return sizes.withColumn("full", full).withColumn("kept", kept).filter("kept").select(
        "key", "big", "per_short", "per_long", F.col("n").alias("rows")
    )


def _packed_islands(counts: DataFrame, short_ms: int, long_ms: int, cell_ms: int) -> DataFrame:
    """Counts of hot keys as one row per (key, island, cell), without islands that need no replay."""
    # the filter spells out what the join below implies, so that both uses of the counts share one shuffle
    counts = counts.withColumn("cell", cell_of(F.col("ms"), cell_ms)).filter("key is not null and cell is not null")
    cells = counts.groupBy("key", "cell", "per_short", "per_long").agg(
        F.sum("n").alias("n"), F.sum("taken").alias("taken"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )
    by_cell = Window.partitionBy("key").orderBy("cell")

    def within(n, width_ms: int):
        """No window ending in this cell holds more than this."""
        return F.sum(n).over(by_cell.rangeBetween(-(-(-width_ms // cell_ms)), 0))

    def all_of(flag: str, width_ms: int):
        """Does it hold for this cell and all that begin within ``width_ms``?"""
        return F.min(flag).over(by_cell.rangeBetween(0, -(-width_ms // cell_ms) - 1))

    # a cell no longer than the short window never accepts more than the short limit
    capped = (F.col("per_short") > 0) & F.lit(cell_ms <= short_ms)
    cells = cells.withColumn("most", F.when(capped, F.greatest(F.least("n", "per_short"), "taken")).otherwise(F.col("n")))
    cells = cells.withColumns(
        {
            "calm_short": (F.col("per_short") <= 0) | (within("n", short_ms) <= F.col("per_short")),
            "calm_long": (F.col("per_long") <= 0) | (within("most", long_ms) <= F.col("per_long")),
        }
    )
    # Where a whole short window is calm, all its requests are accepted whatever came before, and where the
    # long window stays calm until all earlier slots have left it, they do not matter: a new start.
    cut = all_of("calm_short", short_ms) & all_of("calm_long", long_ms + cell_ms)
    cells = cells.withColumns({"tight": ~(F.col("calm_short") & F.col("calm_long")), "cut": cut})
    cells = with_islands(cells, "key", max(short_ms, long_ms), F.col("cut"))
    tight_islands = F.max("tight").over(Window.partitionBy("key", "island"))
    todo = cells.withColumn("tight", tight_islands).filter("tight").select("key", "cell", "island")
    return (
        counts.join(todo, ["key", "cell"])
        .groupBy("key", "island", "cell", "per_short", "per_long")
        # at most one entry per millisecond of the cell
        .agg(F.array_sort(F.collect_list(F.struct("ms", "n", "taken"))).alias("points"))
        .select("key", "island", "cell", "per_short", "per_long", *[F.col(f"points.{c}").alias(c) for c in ("ms", "n", "taken")])
        .repartition("key", "island")
        .sortWithinPartitions("key", "island", "cell")
    )


def _unit(seconds: int) -> str:
    return {S.MINUTE_SECONDS: "minute", S.DAY_SECONDS: "day"}.get(seconds, f"{seconds}s")


def replay_rate_limit(
    requests: DataFrame,
    limits: DataFrame | None = None,
    *,
    key: str = "api_key_id",
    ts: str = "ts",
    id_: str = "id",
    short_seconds: int = S.MINUTE_SECONDS,
    long_seconds: int = S.DAY_SECONDS,
    per_short: int = S.PER_MINUTE,
    per_long: int = S.PER_DAY,
    earlier_slots: DataFrame | None = None,
    cell_ms: int = CELL_MS,
    hot_rows: int = HOT_KEY_ROWS,
    few_stretches: int = FEW_STRETCHES,
) -> DataFrame:
    """Add ``decision`` (ok, short or long), ``retry_after`` seconds and ``detail`` to each request.

    ``limits`` holds ``per_short`` and ``per_long`` per key; a limit of 0 or less is off. Requests
    of one key are taken by (millisecond, id). The key must not be null. ``earlier_slots`` (key,
    ms, n) are slots taken before these requests; taken slots alone always fit again, so they
    simply lead the replay.
    """
    short_ms, long_ms = short_seconds * 1000, long_seconds * 1000
    cell_ms = min(cell_ms, max(short_ms, long_ms))
    rows = requests.withColumn("_ms", millis(F.col(ts)))
    points = rows.select(F.col(key).alias("key"), F.col("_ms").alias("ms"), F.lit(1).alias("n"))
    taken = F.lit(0)
    if earlier_slots is not None:
        slots = earlier_slots.select("key", "ms", "n", F.col("n").alias("taken"))
        points, taken = points.withColumn("taken", taken).unionByName(slots), F.col("taken")
    points = points.withColumn("big", cell_of(F.col("ms"), max(short_ms, long_ms)))

    # Usually few: kept as a table, so that its true size decides whether the rows need a shuffle.
    busy = keep(_busy_stretches(points, key, limits, per_short, per_long), "busy")
    counts = (
        points.join(busy.drop("rows"), ["key", "big"])
        .filter("key is not null")
        .groupBy("key", "ms", "per_short", "per_long")
        .agg(F.sum("n").alias("n"), *([] if earlier_slots is None else [F.sum("taken").alias("taken")]))
    )
    hot = keep(busy.groupBy("key").agg(F.sum("rows").alias("rows")).filter(F.col("rows") > hot_rows).select("key"), "hot-keys")
    entry = ["key", "per_short", "per_long", "ms", "n"]
    key_type = requests.schema[key].dataType.simpleString()
    out = f"key {key_type}, per_short int, per_long int, "
    decided = (
        counts.join(hot, "key", "left_anti")
        .select(*entry, taken.cast("bigint").alias("taken"))
        .repartition("key")
        .sortWithinPartitions("key", "ms")
        .mapInArrow(_replay_counts(short_ms, long_ms), out + "ms bigint, accepted bigint, reason tinyint")
    )
    if not hot.isEmpty():
        packed = _packed_islands(
            counts.join(hot, "key", "left_semi").select(*entry, taken.cast("bigint").alias("taken")),
            short_ms, long_ms, cell_ms,
        )
        replayed = packed.mapInArrow(
            _replay(short_ms, long_ms), out + "ms array<bigint>, accepted array<bigint>, reason array<tinyint>"
        )
        decided = decided.unionByName(
            replayed.select("key", "per_short", "per_long", F.inline(F.arrays_zip("ms", "accepted", "reason")))
            .filter(F.col("reason") != OK)
        )

    rejected = decided.select(
        F.col("key").alias(key), F.col("ms").alias("_ms"), "reason", "accepted",
        F.when(F.col("reason") == SHORT, F.col("per_short")).otherwise(F.col("per_long")).alias("_limit"),
    )
    # Where only some requests of a millisecond were accepted, these are the ones with the lowest ids.
    # The rank needs the same shuffle and sort as the join.
    rank = F.row_number().over(Window.partitionBy(key, "_ms").orderBy(id_))
    turned_away = F.col("reason").isNotNull() & (F.col("_rank") > F.col("accepted"))
    is_short = F.col("reason") == SHORT
    unit = F.when(is_short, _unit(short_seconds)).otherwise(_unit(long_seconds))
    decision = [
        F.when(~turned_away, "ok").when(is_short, "short").otherwise("long").alias("decision"),
        F.when(turned_away, F.when(is_short, short_seconds).otherwise(long_seconds)).alias("retry_after"),
        F.when(
            turned_away, F.concat(F.lit("rate limit exceeded: "), F.col("_limit").cast("string"), F.lit("/"), unit)
        ).alias("detail"),
    ]

    def decide(part: DataFrame) -> DataFrame:
        return part.withColumn("_rank", rank).join(rejected, [key, "_ms"], "left").select(*requests.columns, *decision)

    if busy.count() > few_stretches:
        return decide(rows)
    # Few stretches are looked up where the rows are; rows outside of them need no shuffle at all.
    rows = rows.withColumn("_big", cell_of(F.col("_ms"), max(short_ms, long_ms)))
    where = busy.select(F.col("key").alias(key), F.col("big").alias("_big"))
    quiet = rows.join(where, [key, "_big"], "left_anti").select(
        *requests.columns, F.lit("ok").alias("decision"), F.lit(None).cast("int").alias("retry_after"),
        F.lit(None).cast("string").alias("detail"),
    )
    return quiet.unionByName(decide(rows.join(where, [key, "_big"], "left_semi")))
