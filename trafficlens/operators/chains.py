"""Chains of jumps over the times of a hot key, followed without gathering the key in one task.

A chain starts at the first time of its key and goes on to the first time at least ``step_ms`` after the
last one. Time is cut into cells of one step, and only cells that hold a time are numbered. A cell holds
one jump at most, so the chain is in one *state* when it leaves a cell: the time it took there, or
``FREE``. From the state of a cell follows that of the next cell, and the times of a cell with what
follows from each form its transfer function: one row per state, never one array per cell.

* Transfer functions are composed by doubling: level j tells, for every 2**j-th cell, the state
  2**j cells on. Each level is an equi-join of half the rows of the last one, so all of them
  together cost about twice the first, and a hot key spreads over all tasks by (cell, state).
* The states are read off from the top: a level gives the states half way between those known.

Where many states lead to the same one, the rows of a join key are many on one side and one on the
other; adaptive execution splits such partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import keep
from .timeline import CELL_MS, cell_of

FREE = -(1 << 62)


def numbered_cells(points: DataFrame, step_ms: int) -> DataFrame:
    """(key, cell, no, first, next_cell, next_first): the cells with times, numbered from 0 per key."""
    cells = points.groupBy("key", cell_of(F.col("ms"), step_ms).alias("cell")).agg(F.min("ms").alias("first"))
    by = Window.partitionBy("key").orderBy("cell")
    return cells.select(
        "key", "cell", (F.row_number().over(by) - 1).alias("no"), "first",
        F.lead("cell").over(by).alias("next_cell"), F.lead("first").over(by).alias("next_first"),
    )


def first_after(points: DataFrame, step_ms: int, cell_ms: int = CELL_MS) -> DataFrame:
    """(key, ms, after): for each time the first one of its key at least ``step_ms`` later, or null.

    A window never holds more than ``cell_ms`` milliseconds of a key; what lies beyond them comes
    from one row per (key, window).
    """
    events = points.select("key", F.col("ms").alias("at"), F.col("ms").alias("event"), F.lit(None).cast("bigint").alias("ms"))
    asked = points.select("key", (F.col("ms") + step_ms).alias("at"), F.lit(None).cast("bigint").alias("event"), "ms")
    both = events.unionByName(asked).withColumn("part", cell_of(F.col("at"), cell_ms))
    later = Window.partitionBy("key").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = both.groupBy("key", "part").agg(F.min("event").alias("event"))
    beyond = beyond.select("key", "part", F.min("event").over(later).alias("beyond"))
    # from the end of the window on, as a frame that starts anywhere else would be summed anew per row
    here = Window.partitionBy("key", "part").orderBy(F.col("at").desc()).rangeBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("here", F.min("event").over(here)).filter("ms IS NOT NULL")
    return seen.join(beyond, ["key", "part"]).select("key", "ms", F.coalesce("here", "beyond").alias("after"))


def transfer(points: DataFrame, cells: DataFrame, step_ms: int, cell_ms: int = CELL_MS) -> DataFrame:
    """(key, no, state, next): what the state of a cell becomes in the next one."""
    more = cells.filter("next_cell IS NOT NULL")
    after = first_after(points, step_ms, cell_ms).withColumn("cell", cell_of(F.col("ms"), step_ms))
    held = F.when(cell_of(F.col("after"), step_ms) == F.col("next_cell"), F.col("after")).otherwise(FREE)
    # a chain that has been silent for a whole cell takes the first time there is
    following = F.when(F.col("next_cell") > F.col("cell") + 1, F.col("next_first")).otherwise(held)
    taken = after.join(more, ["key", "cell"]).select("key", "no", F.col("ms").alias("state"), following.alias("next"))
    free = more.select("key", "no", F.lit(FREE).alias("state"), F.col("next_first").alias("next"))
    return taken.unionByName(free)


def doubled(f: DataFrame, width: int) -> DataFrame:
    """The transfer functions over 2 * ``width`` cells, from those over ``width`` cells."""
    left = f.filter(F.col("no") % (2 * width) == 0)
    right = f.filter(F.col("no") % (2 * width) == width).select(
        F.col("key").alias("r_key"), (F.col("no") - width).alias("r_no"), F.col("state").alias("r_state"), F.col("next").alias("r_next")
    )
    same = (F.col("key") == F.col("r_key")) & (F.col("no") == F.col("r_no")) & (F.col("next") == F.col("r_state"))
    return left.join(right, same).select("key", "no", "state", F.col("r_next").alias("next"))


def jumps(points: DataFrame, step_ms: int, cell_ms: int = CELL_MS) -> DataFrame:
    """The times (key, ms) of the chain of each key, among its distinct times (key, ms)."""
    points = keep(points.select("key", "ms"), "chain-times")
    cells = keep(numbered_cells(points, step_ms), "chain-cells")
    last = cells.agg(F.max("no")).first()[0]
    levels, width = [], 1
    while last is not None and width <= last:
        f = transfer(points, cells, step_ms, cell_ms) if width == 1 else doubled(levels[-1], width // 2)
        levels.append(keep(f, "chain-level"))
        width *= 2
    states = cells.filter("no = 0").select("key", "no", F.col("first").alias("state"))
    for f in reversed(levels):
        width //= 2
        onward = states.join(f, ["key", "no", "state"]).select("key", (F.col("no") + width).alias("no"), F.col("next").alias("state"))
        states = keep(states.unionByName(onward), "chain-states")
    return states.filter(F.col("state") != FREE).select("key", F.col("state").alias("ms"))
