"""Nearest neighbours by cosine distance, within a group (the model).

Nothing here emits pairs of a group. Entries lie in a ball tree: a cell of more than ``LEAF`` blocks is split
around pivots of its own, level by level, so no task and no node grows with the data. A query goes
down only where a vector within the wanted distance can lie (the bisector and the ball bound, which
lose nothing), and every (cell, block of entries, block of queries) is one bounded matrix product
that returns at most one row per query (or its few record holders over time).

Frames have the columns ``grp``, ``id`` (bigint), ``ms`` (bigint, time) and ``vec``; the order of
two items is (ms, id). Distances are rounded to 9 decimals before they are compared.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .. import settings as S
from ..session import keep

BLOCK = 4096  # rows per side of one matrix product
LEAF = 8  # a cell of more blocks than this is split
FAN = 64  # pivots of a node of the tree, at most
STRIP = 128  # queries of one product in single precision
WIDE = 2048  # and entries
DIGITS = 9
FOUND = "qid bigint, dist double, ms bigint, id bigint"


def max_distance(threshold: float) -> float:
    """The greatest distance that still is a hit."""
    return round(1.0 - threshold, DIGITS)


def to_matrix(column) -> np.ndarray:
    """Vectors of an Arrow list column as unit rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 1))
    if pc.count_distinct(pc.list_value_length(column), mode="all").as_py() > 1:
        raise ValueError("vectors of different length in one group")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1.0)


def slack(dims: int) -> float:
    """How far a product of unit vectors in single precision is from the exact one, at most (rounding included)."""
    return 1e-6 + 1.2e-7 * dims


def _bands(queries: np.ndarray, entries: np.ndarray, max_dist: float):
    """(order of the queries, order of the entries, steps): a step (at, to, lo, hi) names the queries from ``at`` to ``to``
    and the entries from ``lo`` to ``hi`` of these orders, and no other entry is within the distance of its queries.

    Two rows differ in their angles to a third direction by no more than the angle between them, so both sides are
    ordered by their angles to the sum of the queries. A zero vector is at distance 1 of all.
    """
    starts = np.arange(0, len(queries), STRIP)
    ends = np.minimum(starts + STRIP, len(queries))
    towards = queries.sum(axis=0)
    length = np.linalg.norm(towards)
    if max_dist < 0.5 and length > 0:
        turned = [np.arccos(np.clip(m @ (towards / length), -1.0, 1.0)) for m in (queries, entries)]
        if not any(np.isnan(t).any() for t in turned):
            rows, others = (np.argsort(t, kind="stable") for t in turned)
            mine, theirs = turned[0][rows], turned[1][others]
            # a distance counts as it is rounded
            reach = math.acos(min(1.0, 1.0 - max_dist - 2 * 10.0**-DIGITS)) + 1e-6
            lo = np.searchsorted(theirs, mine[starts] - reach, side="left")
            hi = np.searchsorted(theirs, mine[ends - 1] + reach, side="right")
            return rows, others, np.stack([starts, ends, lo, hi], axis=1)[lo < hi].tolist()
    whole = np.stack([starts, ends, np.zeros_like(starts), np.full_like(starts, len(entries))], axis=1)
    return np.arange(len(queries)), np.arange(len(entries)), whole.tolist()


def near_pairs(queries: np.ndarray, entries: np.ndarray, max_dist: float):
    """(i, j, dist) of all rows within the distance, by steps of queries; within a step in row order.

    Only rows whose angles to a common direction are near enough meet. A product in single precision names every pair
    that can be near; only these are computed in double precision, or the whole step where they are many.
    """
    if not len(queries) or not len(entries):
        return
    rows, others, steps = _bands(queries, entries, max_dist)
    q32, e32 = queries[rows].astype(np.float32), entries[others].astype(np.float32)
    least = np.float32(1.0 - max_dist - slack(queries.shape[1]))
    # the same memory for every product
    product, large = np.empty(STRIP * WIDE, np.float32), np.empty(STRIP * WIDE, bool)
    for at, to, lo, hi in steps:
        found = []
        for a in range(lo, hi, WIDE):
            b = min(a + WIDE, hi)
            size = (to - at) * (b - a)
            np.matmul(q32[at:to], e32[a:b].T, out=product[:size].reshape(to - at, b - a))
            # places in the flat product: finding them in two dimensions takes longer than the product
            flat = np.flatnonzero(np.greater_equal(product[:size], least, out=large[:size]))
            if not len(flat):
                continue
            i, j = rows[at + flat // (b - a)], others[a + flat % (b - a)]
            if 16 * len(flat) > size:
                dots = (queries[rows[at:to]] @ entries[others[a:b]].T).ravel()[flat]
            else:
                parts = [slice(x, x + 8192) for x in range(0, len(i), 8192)]
                dots = np.concatenate([np.einsum("nk,nk->n", queries[i[x]], entries[j[x]]) for x in parts])
            dist = np.round(1.0 - dots, DIGITS) + 0.0
            near = np.flatnonzero(dist <= max_dist)
            found.append((i[near], j[near], dist[near]))
        if found:
            i, j, dist = (np.concatenate(c) for c in zip(*found, strict=True))
            turn = np.argsort(i * len(entries) + j, kind="stable")
            yield i[turn], j[turn], dist[turn]


# pivots and cells ----------------------------------------------------------------------------


def sample_pivots(items: DataFrame, n: int) -> np.ndarray:
    """``n`` vectors picked by a hash of their id: the same ones on every run."""
    rows = items.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(n).collect()
    return _as_pivots([r.vec for r in rows])


def _as_pivots(vectors: list) -> np.ndarray:
    """The distinct unit vectors among them."""
    if not vectors:
        return np.zeros((0, 1))
    m = np.unique(np.array(vectors, dtype=np.float64), axis=0)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m[length[:, 0] > 0] / length[length > 0][:, None]


def cells_within(q: np.ndarray, pivots: np.ndarray, radius: float) -> np.ndarray:
    """Boolean (query, cell): may the cell hold a vector within Euclidean ``radius`` of the query?

    A vector of cell p lies on p's side of the bisector between p and the query's own pivot, and
    the query's distance to that bisector is a lower bound of its distance to the vector.
    """
    sq = np.maximum(2.0 - 2.0 * (q @ pivots.T), 0.0)
    own = sq.argmin(axis=1)
    between = np.sqrt(np.maximum(2.0 - 2.0 * (pivots[own] @ pivots.T), 0.0))
    bound = (sq - sq[np.arange(len(q)), own][:, None]) / np.maximum(2.0 * between, 1e-12)
    reach = bound <= radius + 1e-6
    reach[np.arange(len(q)), own] = True
    return reach


def _place(pivots: np.ndarray, pick):
    def run(batches):
        for batch in batches:
            cells = [np.flatnonzero(r).astype(np.int64) for r in pick(to_matrix(batch.column("vec")), pivots)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cells, type=pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"]
            )

    return run


def _with_cells(df: DataFrame, pivots: np.ndarray | None, pick) -> DataFrame:
    """Add ``cell``; a row that reaches several cells is repeated."""
    if pivots is None or len(pivots) < 2:
        return df.withColumn("cell", F.lit(0).cast("bigint"))
    fields = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    placed = df.mapInArrow(_place(pivots, pick), f"{fields}, cells array<bigint>")
    return placed.withColumn("cell", F.explode("cells")).drop("cells")


def nearest_cell(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.zeros((len(m), len(pivots)), dtype=bool)
    out[np.arange(len(m)), (m @ pivots.T).argmax(axis=1)] = True
    return out


def probe_cells(n: int):
    """The ``n`` cells whose pivots are nearest."""

    def pick(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        out = np.zeros((len(m), len(pivots)), dtype=bool)
        k = min(n, len(pivots))
        nearest = np.argpartition(-(m @ pivots.T), k - 1, axis=1)[:, :k]
        np.put_along_axis(out, nearest, True, axis=1)
        return out

    return pick


def reachable_cells(max_dist: float):
    radius = math.sqrt(2.0 * max_dist)
    return lambda m, pivots: cells_within(m, pivots, radius)


def place_entries(entries: DataFrame, pivots: np.ndarray | None) -> DataFrame:
    return _with_cells(entries, pivots, nearest_cell)


def place_queries(queries: DataFrame, pivots: np.ndarray | None, pick) -> DataFrame:
    return _with_cells(queries, pivots, pick)


# the tree ------------------------------------------------------------------------------------


class Flat:
    """Cells around given pivots, or one cell per group without any."""

    def __init__(self, entries: DataFrame, pivots: np.ndarray | None):
        self.pivots, self.entries = pivots, place_entries(entries, pivots)

    def place(self, queries: DataFrame, max_dist: float) -> DataFrame:
        return place_queries(queries, self.pivots, reachable_cells(max_dist))


def _below(pick):
    """Send the rows of a node to its children: ``pick`` (rows, pivots, radii) says to which."""

    def run(rows: pa.Table, node: pa.Table) -> pa.Table:
        names = rows.schema.names
        if not rows.num_rows or not node.num_rows:
            children, dist = [], np.zeros(0)
            rows = rows.slice(0, 0)
        else:
            pivots = _as_pivots(node["pivots"][0].as_py())
            m = to_matrix(rows["vec"])
            own = np.sqrt(np.maximum(2.0 - 2.0 * (m @ pivots.T), 0.0))
            reach = pick(m, pivots, own, node["radii"][0].as_py())
            base = node["cell"][0].as_py() * FAN + 1
            children = [base + np.flatnonzero(r) for r in reach]
            dist = np.where(reach, own, 0.0).max(axis=1)
        return pa.table(
            [*rows.columns, pa.array(children, pa.list_(pa.int64())), pa.array(dist, pa.float64())], names=[*names, "children", "dist"]
        )

    return run


def _to_nearest(m, pivots, own, radii) -> np.ndarray:
    return nearest_cell(m, pivots)


def _to_reachable(max_dist: float):
    radius = math.sqrt(2.0 * max_dist)

    def pick(m, pivots, own, radii) -> np.ndarray:
        # a child without entries has the radius -inf
        return cells_within(m, pivots, radius) & (own - np.array(radii[: len(pivots)])[None, :] <= radius + 1e-6)

    return pick


class Tree:
    """Entries in cells of at most ``LEAF`` blocks, and the nodes that lead there.

    A node's pivots are picked by hash from its own entries (``FAN`` at most), and its entries go to
    the nearest one. The nodes of a level are a table; rows meet the node they are in by a cogroup in
    pieces of a block, so nothing is collected. Cells of equal vectors cannot be split and stay whole.
    """

    def __init__(self, entries: DataFrame, block: int = BLOCK):
        self.block, self.levels = block, []
        current = entries.withColumn("cell", F.lit(0).cast("bigint"))
        full = current.groupBy("grp", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF * block)
        if not full.isEmpty():
            current, full = keep(current, "tree-entries"), keep(full, "tree-cells")
        # each row is written once per level it goes down; what stays behind is done
        done = None
        while not full.isEmpty():
            left = current.join(full.select("grp", "cell"), ["grp", "cell"], "left_anti").select(*current.columns)
            done = left if done is None else done.unionByName(left)
            current, full = self._split(current, full)
        self.entries = current if done is None else done.unionByName(current)

    def _split(self, entries: DataFrame, full: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Split the cells named: their entries in the children, and the children that are still too large."""
        key, turn = ["grp", "cell"], len(self.levels)
        wanted = F.least(F.lit(FAN), F.ceil(2 * F.col("n") / self.block)).cast("int")
        hashed = entries.join(full.withColumn("wanted", wanted), key).withColumn("_h", F.xxhash64("id", F.lit(turn)))
        drawn = hashed.filter(F.pmod("_h", F.col("n")) < 8 * F.col("wanted"))
        rank = F.row_number().over(Window.partitionBy(*key).orderBy("_h", "id"))
        drawn = drawn.withColumn("_r", rank).filter("_r <= wanted")
        # drawn by hash and sorted where they are used, so they are the same each time
        pivots = drawn.groupBy(*key).agg(F.collect_list("vec").alias("pivots"))
        nodes = pivots.withColumn("radii", F.array().cast("array<double>"))
        columns = [c for c in entries.columns if c != "cell"]
        moved = self._down(entries, nodes, full.select(*key, "n"), _to_nearest)
        moved = keep(moved.select(*columns, "cell", F.col("children")[0].alias("child"), "dist"), "tree-moved")
        children = moved.groupBy(*key, "child").agg(F.max("dist").alias("radius"), F.count("*").alias("n"))
        radii = children.groupBy(*key).agg(
            F.map_from_entries(F.collect_list(F.struct((F.col("child") - F.col("cell") * FAN - 1).cast("int"), "radius"))).alias("of")
        )
        each = F.transform(F.sequence(F.lit(0), F.lit(FAN - 1)), lambda i: F.coalesce(F.try_element_at("of", i), F.lit(float("-inf"))))
        self.levels.append(keep(pivots.join(radii, key).select(*key, "pivots", each.alias("radii")), "tree-nodes"))
        larger = children.join(full.select(*key, F.col("n").alias("before")), key)
        again = larger.filter((F.col("n") > LEAF * self.block) & (F.col("n") < F.col("before")))
        return moved.select(*columns, F.col("child").alias("cell")), keep(again.select("grp", F.col("child").alias("cell"), "n"), "tree-cells")

    def _down(self, rows: DataFrame, nodes: DataFrame, sizes: DataFrame, pick) -> DataFrame:
        """Rows of the nodes named, with the ``children`` they go to."""
        key = ["grp", "cell"]
        pieces = F.ceil(F.col("n") / self.block).cast("int")
        dealt = rows.join(sizes, key).withColumn("piece", F.pmod(F.xxhash64("id"), pieces).cast("int")).select(*rows.columns, "piece")
        spread = nodes.join(sizes, key).withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1)))
        # new names for the columns, as both sides may stem from the same frame
        spread = spread.select(*[F.col(c).alias(c) for c in [*key, "piece", "pivots", "radii"]])
        schema = ", ".join(f"`{n}` {t}" for n, t in dealt.dtypes) + ", children array<bigint>, dist double"
        by = [*key, "piece"]
        return dealt.groupBy(*by).cogroup(spread.groupBy(*by)).applyInArrow(_below(pick), schema)

    def place(self, queries: DataFrame, max_dist: float) -> DataFrame:
        """Queries with the cells that can hold a vector within the distance; one row per cell.

        ``queries`` are read more than once, so they should be a written table.
        """
        current, key = queries.withColumn("cell", F.lit(0).cast("bigint")), ["grp", "cell"]
        if not self.levels:
            return current
        done = None
        for nodes in self.levels:
            here = nodes.select(*key)
            left = current.join(here, key, "left_anti").select(*current.columns)
            done = left if done is None else done.unionByName(left)
            inside = current.join(here, key).select(*current.columns)
            sizes = inside.groupBy(*key).agg(F.count("*").alias("n"))
            moved = self._down(inside, nodes, sizes, _to_reachable(max_dist)).withColumn("cell", F.explode("children"))
            current = keep(moved.select(*current.columns), "tree-queries")
        return done.unionByName(current)


def placed_for(entries: DataFrame, pivots, block: int) -> Tree | Flat:
    return Tree(entries, block) if isinstance(pivots, str) else Flat(entries, pivots)


# blocked search ------------------------------------------------------------------------------


def _search(max_dist: float, earlier: bool, records: bool):
    def run(q: pa.Table, e: pa.Table) -> pa.Table:
        out = {"qid": [], "dist": [], "ms": [], "id": []}
        if q.num_rows and e.num_rows:
            e = e.sort_by([("ms", "ascending"), ("id", "ascending")])
            em, ei = e["ms"].to_numpy(), e["id"].to_numpy()
            qm, qi = q["ms"].to_numpy(), q["id"].to_numpy()
            for i, j, dist in near_pairs(to_matrix(q["vec"]), to_matrix(e["vec"]), max_dist):
                if earlier:
                    ok = (em[j] < qm[i]) | ((em[j] == qm[i]) & (ei[j] < qi[i]))
                    i, j, dist = i[ok], j[ok], dist[ok]
                # entries are in time order, so the first of equals is the earliest
                if records:
                    kept = _records(i, dist)
                else:
                    best = np.lexsort((j, dist, i))
                    kept = best[np.flatnonzero(np.diff(i[best], prepend=-1))]
                for c, v in (("qid", qi[i[kept]]), ("dist", dist[kept]), ("ms", em[j[kept]]), ("id", ei[j[kept]])):
                    out[c].append(v)
        types = {"qid": pa.int64(), "dist": pa.float64(), "ms": pa.int64(), "id": pa.int64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], types[c]) for c, v in out.items()})

    return run


def _records(i: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """Places of the rows whose distance is below all before them of the same ``i``, which ascends."""
    rank = np.unique(dist, return_inverse=True)[1].astype(np.int64)
    # each i has whole numbers of its own, below those of all i before it
    turn = rank - i.astype(np.int64) * (len(i) + 1)
    least = np.minimum.accumulate(turn)
    return np.flatnonzero(np.concatenate(([True], turn[1:] < least[:-1]))[: len(i)])


def by_blocks(queries: DataFrame, entries: DataFrame, compare, schema: str, block: int = BLOCK) -> DataFrame:
    """``compare`` (queries, entries) over every block of queries and of entries of each cell."""
    key = ["grp", "cell"]
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    sizes = (
        queries.groupBy(*key).agg(F.count("*").alias("nq"))
        .join(entries.groupBy(*key).agg(F.count("*").alias("ne")), key)
        .select(*key, blocks("nq").alias("qbs"), blocks("ne").alias("ebs"))
    )
    spread = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = ["qb", "eb"]
    q = queries.join(sizes, key).withColumn("qb", spread("qbs")).withColumn("eb", all_of("ebs")).select(*queries.columns, *at)
    e = entries.join(sizes, key).withColumn("eb", spread("ebs")).withColumn("qb", all_of("qbs"))
    # new names for the columns, as both sides may stem from the same frame
    e = e.select(*[F.col(c).alias(c) for c in [*entries.columns, *at]])
    return q.groupBy(*key, *at).cogroup(e.groupBy(*key, *at)).applyInArrow(compare, schema)


def packed(df: DataFrame, block: int) -> DataFrame:
    """(grp, data): the rows of each cell in blocks, a block being one row that holds them as an Arrow stream."""
    key = ["grp", "cell"]
    sizes = df.groupBy(*key).agg(F.ceil(F.count("*") / F.lit(block)).alias("_blocks"))
    dealt = df.join(sizes, key).withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks"))).drop("_blocks")

    def pack(rows: pa.Table) -> pa.Table:
        return pa.table({"grp": rows["grp"].slice(0, 1), "data": pa.array([_stream(rows)], pa.binary())})

    return dealt.groupBy(*key, "_block").applyInArrow(pack, f"grp {df.schema['grp'].dataType.simpleString()}, data binary")


def _may_reach(queries: np.ndarray, entries: np.ndarray, max_dist: float) -> np.ndarray:
    """Which queries can have an entry within the distance, by the ball around the entries."""
    centre = entries.mean(axis=0)
    radius = np.linalg.norm(entries - centre, axis=1).max()
    # a zero vector is at distance 1 of all, whatever its place
    return (np.linalg.norm(queries - centre, axis=1) <= radius + math.sqrt(2.0 * max_dist) + 1e-6) | (max_dist >= 0.5)


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpacked(data) -> pa.Table:
    """The rows of a block."""
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def _halved(m: np.ndarray, rows: np.ndarray, most: int) -> list[np.ndarray]:
    """The rows in parts of at most ``most``, cut in halves along the direction in which they are spread the most."""
    if len(rows) <= most:
        return [rows]
    some = m[rows[:: max(1, len(rows) // 2048)]]
    some = some - some.mean(axis=0)
    towards = np.ones(m.shape[1])
    for _ in range(8):
        towards = some.T @ (some @ towards)
        towards /= np.linalg.norm(towards) or 1.0
    order = rows[np.argsort(m[rows] @ towards, kind="stable")]
    half = len(order) // 2
    return _halved(m, order[:half], most) + _halved(m, order[half:], most)


def block_rows(table: pa.Table, block: int, first: int = 0) -> pa.Table:
    """Rows of one group as blocks (no, grp, n, lo, hi, data) of rows that lie near each other, numbered from ``first``.

    ``lo`` and ``hi`` are the first and the last time, null where a row has none.
    """
    whole = [np.arange(table.num_rows)]
    parts = [table.take(pa.array(p)) for p in (_halved(to_matrix(table["vec"]), whole[0], block) if table.num_rows > block else whole)]
    ends = [pc.min_max(p["ms"], skip_nulls=False).as_py() for p in parts]
    return pa.table({
        "no": pa.array(range(first, first + len(parts)), pa.int64()),
        "grp": pa.array([p["grp"][0].as_py() for p in parts], table.schema.field("grp").type),
        "n": pa.array([p.num_rows for p in parts], pa.int64()),
        "lo": pa.array([e["min"] for e in ends], pa.int64()), "hi": pa.array([e["max"] for e in ends], pa.int64()),
        "data": pa.array([_stream(p) for p in parts], pa.binary()),
    })


def block_schema(df: DataFrame) -> str:
    return f"no bigint, grp {df.schema['grp'].dataType.simpleString()}, n bigint, lo bigint, hi bigint, data binary"


def in_time(df: DataFrame, block: int, together: int = 1) -> DataFrame:
    """The rows (grp, id, ms, vec and others) as blocks of a group in the order of (ms, id), which ``no`` ascends in.

    Rows are dealt by ranges of (grp, ms, id), so no task holds a group, however many rows have one time. With
    ``together`` blocks as many are cut anew from the rows of their time, so that each holds rows that lie near each other.
    """
    order = [F.col(c).asc_nulls_last() for c in ("grp", "ms", "id")]
    parts = max(1, -(-df.count() // (16 * block)))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        first, made, held, name = TaskContext.get().partitionId() << 32, 0, [], None

        def flush():
            nonlocal made, held
            out = block_rows(pa.Table.from_batches(held), block, first + made)
            made, held = made + out.num_rows, []
            return out.to_batches(max_chunksize=1)

        for batch in batches:
            codes = batch.column("grp").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for at, to in zip(edges[:-1], edges[1:], strict=True):
                if held and name != batch.column("grp")[at].as_py():
                    yield from flush()
                name = batch.column("grp")[at].as_py()
                while at < to:
                    piece = batch.slice(at, min(to - at, together * block - sum(b.num_rows for b in held)))
                    held.append(piece)
                    at += piece.num_rows
                    if sum(b.num_rows for b in held) == together * block:
                        yield from flush()
        if held:
            yield from flush()

    return dealt.mapInArrow(run, block_schema(df))


def met(queries: DataFrame, entries: DataFrame, compare, schema: str, ordered: bool = False) -> DataFrame:
    """``compare`` over the pairs (block of queries, block of entries) of a group that a task is given.

    ``compare`` maps an iterator of (number of a block of queries, its Arrow stream, number of a block of entries, its
    Arrow stream) to Arrow tables; a block comes many times, with the same number. Both frames are written blocks. They meet in a join without an equality, which reads blocks again
    instead of shuffling copies. With ``ordered`` only entries that begin before the end of the queries count.
    """
    n = 2 * queries.sparkSession.sparkContext.defaultParallelism
    many, others = queries.count(), entries.count()
    # the entries are dealt to all tasks, the queries to as many as it takes; no task reads more than 32 blocks of each
    right = max(min(n, others), -(-others // 32), 1)
    left = max(min(many, -(-n // right)), -(-many // 32), 1)
    q = queries.select("no", F.col("data").alias("q"), F.xxhash64("grp").alias("_qg"), F.col("hi").alias("_qhi")).repartition(left)
    e = entries.select(F.monotonically_increasing_id().alias("eno"), F.col("data").alias("e"), F.xxhash64("grp").alias("_eg"), F.col("lo").alias("_elo")).repartition(right)
    same = F.col("_qg").bitwiseXOR(F.col("_eg")) == 0
    in_order = F.coalesce(F.col("_elo") <= F.col("_qhi"), F.lit(True)) if ordered else F.lit(True)
    pairs = q.join(e, same & in_order).select("no", "q", "eno", "e")

    def run(batches):
        each = ((no.as_py(), a, eno.as_py(), b) for batch in batches for no, a, eno, b in zip(*batch.columns, strict=True))
        for table in compare(each):
            yield from table.to_batches(max_chunksize=100_000)

    return pairs.mapInArrow(run, schema)


def crossed(queries: DataFrame, entries: DataFrame, compare, schema: str, max_dist: float, block: int = BLOCK) -> DataFrame:
    """``compare`` (queries, entries) over every block of queries and every block of entries of a group.

    Rows are shuffled once, into blocks. Blocks meet in a join without an equality, which reads them again
    instead of shuffling a copy for every block on the other side. ``queries`` need no cells.
    """
    n = 2 * queries.sparkSession.sparkContext.defaultParallelism
    if "cell" not in queries.columns:
        queries = queries.withColumn("cell", F.lit(0).cast("bigint"))
    q = keep(packed(queries, block).select("grp", F.col("data").alias("q"), F.xxhash64("grp").alias("_qg")), "query-blocks")
    e = keep(packed(entries, block).select(F.col("data").alias("e"), F.xxhash64("grp").alias("_eg")), "entry-blocks")
    met = q.repartition(n).join(e.repartition(n), F.col("_qg").bitwiseXOR(F.col("_eg")) == 0).select("q", "e")

    def run(batches):
        for batch in batches:
            for a, b in zip(batch.column("q"), batch.column("e"), strict=True):
                mine, theirs = unpacked(a), unpacked(b)
                if mine["grp"][0].as_py() != theirs["grp"][0].as_py():
                    continue
                mine = mine.filter(pa.array(_may_reach(to_matrix(mine["vec"]), to_matrix(theirs["vec"]), max_dist)))
                if mine.num_rows:
                    yield from compare(mine, theirs).to_batches(max_chunksize=100_000)

    return met.mapInArrow(run, schema)


def blocked_search(
    queries: DataFrame, entries: DataFrame, max_dist: float, earlier: bool = False, records: bool = False, block: int = BLOCK
) -> DataFrame:
    """Matches of placed queries (grp, cell, id, ms, vec) among placed entries: qid, dist, ms, id.

    One row per query: its nearest entry within ``max_dist``, the earliest among equals. With
    ``earlier`` only entries before the query count. With ``records`` a query gets one row for
    every entry, in time order, that is nearer than all before it.
    """
    columns = ["grp", "cell", "id", "ms", "vec"]
    found = by_blocks(
        queries.select(*columns), entries.select(*columns), _search(max_dist, earlier, records), FOUND, block
    )
    return _merged(found, records)


def _merged(found: DataFrame, records: bool) -> DataFrame:
    """One row per query, or its record holders, of what the blocks found."""
    if records:
        return merge_records(found)
    best = found.groupBy("qid").agg(F.min(F.struct("dist", "ms", "id")).alias("b"))
    return best.select("qid", "b.dist", "b.ms", "b.id")


def merge_records(found: DataFrame) -> DataFrame:
    """Record holders over all blocks: rows nearer than every earlier row of the query."""
    before = Window.partitionBy("qid").orderBy("ms", "id").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("_min", F.min("dist").over(before)).filter(
        F.col("_min").isNull() | (F.col("dist") < F.col("_min"))
    ).drop("_min")


def nearest(
    queries: DataFrame, entries: DataFrame, max_dist: float, earlier: bool = False, records: bool = False,
    pivots: np.ndarray | str | None = "auto", block: int = BLOCK,
) -> DataFrame:
    """Exact search: entries in a tree (or around the pivots given), then block by block."""
    tree, columns = placed_for(entries, pivots, block), ["grp", "id", "ms", "vec"]
    compare = _search(max_dist, earlier, records)
    return _merged(crossed(queries.select(*columns), tree.entries.select(*columns, "cell"), compare, FOUND, max_dist, block), records)


def records_among(queries: DataFrame, entries: DataFrame, max_dist: float, small: int, block: int = BLOCK) -> DataFrame:
    """For each query (grp, id, ms, vec) every entry, in time order, that is nearer than all before it: qid, dist, ms, id.

    Here ``ms`` of a query is the last time it is asked: entries made after it may be left out. Both are written
    tables. Groups of at most ``small`` rows on each side are searched in one task each, all others by blocks.
    """
    columns = ["grp", "id", "ms", "vec"]
    queries, entries = queries.select(*columns), entries.select(*columns)
    sizes = queries.select("grp", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(entries.select("grp", F.lit(0).alias("a"), F.lit(1).alias("b")))
    big = keep(sizes.groupBy("grp").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter((F.col("a") > small) | (F.col("b") > small)).select("grp"), "big-groups")
    little = lambda df: df.join(big, "grp", "left_anti").groupBy("grp")
    found = little(queries).cogroup(little(entries)).applyInArrow(_search(max_dist, False, True), FOUND)
    if big.isEmpty():
        return found
    q, e = (keep(df.join(big, "grp", "left_semi").select(*columns), "of-big-groups") for df in (queries, entries))
    q, e = keep(in_time(q, block), "query-blocks"), keep(in_time(e, block, together=4), "entry-blocks")
    return merge_records(found.unionByName(met(q, e, _records_met(max_dist), FOUND, ordered=True)))


def _records_met(max_dist: float):
    """Record holders of the blocks of queries among the blocks of entries that a task is given."""

    def run(pairs):
        held, read = {}, {}
        for no, a, eno, b in pairs:
            if no not in held:
                mine = unpacked(a)
                held[no] = [mine["grp"][0].as_py(), mine["id"].to_numpy(), to_matrix(mine["vec"]), None]
            if eno not in read:
                if len(read) == 64:
                    read.clear()
                theirs = unpacked(b).sort_by([("ms", "ascending"), ("id", "ascending")])
                read[eno] = theirs["grp"][0].as_py(), to_matrix(theirs["vec"]), theirs["ms"].to_numpy(), theirs["id"].to_numpy()
            (grp, _, m, known), (group, e, em, ei) = held[no], read[eno]
            if group != grp:
                continue
            reached = np.flatnonzero(_may_reach(m, e, max_dist))
            found = [] if known is None else [known]
            for i, j, dist in near_pairs(m[reached], e, max_dist):
                kept = _records(i, dist)
                found.append((reached[i[kept]], em[j[kept]], ei[j[kept]], dist[kept]))
            if len(found) > (known is not None):
                i, ms, ids, dist = (np.concatenate(c) for c in zip(*found, strict=True))
                turn = np.lexsort((ids, ms, i))
                kept = turn[_records(i[turn], dist[turn])]
                held[no][3] = (i[kept], ms[kept], ids[kept], dist[kept])
        for _, qi, _, known in held.values():
            if known is not None:
                i, ms, ids, dist = known
                yield pa.table({"qid": qi[i], "dist": dist, "ms": ms, "id": ids})

    return run


# lookups -------------------------------------------------------------------------------------


def _distinct_vectors(df: DataFrame) -> DataFrame:
    """One item per distinct (grp, vec), the earliest: copies would only repeat its distances.

    Vectors are told apart by 128 bits of hashes (_v1, _v2), so they are no grouping keys.
    """
    first = _keyed(df).groupBy("grp", "_v1", "_v2").agg(F.min(F.struct("ms", "id")).alias("o"), F.first("vec").alias("vec"))
    return first.select("grp", "_v1", "_v2", "vec", F.col("o.ms").alias("ms"), F.col("o.id").alias("id"))


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_v1": F.xxhash64("vec"), "_v2": F.xxhash64(F.lit(1), "vec")})


def semantic_lookup(
    queries: DataFrame, entries: DataFrame, threshold: float = S.SEMANTIC_THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """For each query (grp, id, ms, vec) the nearest entry of its group, if near enough.

    Adds ``entry_id`` and ``dist``, null on a miss. Identical vectors are searched once.
    """
    return _lookup(queries, entries, lambda q, e: nearest(q, e, max_distance(threshold), block=block))


def _lookup(queries: DataFrame, entries: DataFrame, search) -> DataFrame:
    distinct, flat = _distinct_vectors(queries), ["grp", "vec", "ms", "id"]
    found = search(distinct.select(*flat), _distinct_vectors(entries).select(*flat)).select(
        F.col("qid").alias("_rep"), F.col("id").alias("entry_id"), "dist"
    )
    hits = distinct.select("grp", "_v1", "_v2", F.col("id").alias("_rep")).join(found, "_rep").drop("_rep")
    return _keyed(queries).join(hits, ["grp", "_v1", "_v2"], "left").drop("_v1", "_v2")


def train_lists(entries: DataFrame, lists: int = S.VECTOR_LISTS, seed: int = 7) -> np.ndarray:
    """Centres of inverted lists: k-means over all distinct unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from ..functions.vectors import unit

    distinct = entries.select(unit(F.col("vec")).alias("vec")).filter("vec is not null").distinct()
    points = distinct.select(array_to_vector("vec").alias("features")).cache()
    model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine").fit(points)
    points.unpersist()
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def semantic_lookup_ivf(
    queries: DataFrame, entries: DataFrame, threshold: float = S.SEMANTIC_THRESHOLD, lists: int = S.VECTOR_LISTS,
    nprobe: int = 10, centres: np.ndarray | None = None, block: int = BLOCK,
) -> DataFrame:
    """Approximate lookup: only the ``nprobe`` lists nearest to the query are searched."""
    centres = train_lists(entries, lists) if centres is None else centres

    def search(q: DataFrame, e: DataFrame) -> DataFrame:
        return blocked_search(
            place_queries(q, centres, probe_cells(nprobe)), place_entries(e, centres), max_distance(threshold), block=block
        )

    return _lookup(queries, entries, search)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate lookup also finds with the same distance."""
    a = approx.select("id", F.col("dist").alias("a"))
    e = exact.filter(F.col("dist").isNotNull()).select("id", F.col("dist").alias("e"))
    same = F.coalesce(F.abs(F.col("a") - F.col("e")) < 1e-6, F.lit(False))
    return e.join(a, "id", "left").agg(
        F.count("*").alias("exact_hits"), F.count_if(same).alias("found"),
        F.round(F.coalesce(F.count_if(same) / F.nullif(F.count("*"), F.lit(0)), F.lit(1.0)), 6).alias("recall"),
    )
