"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

* Vectors are projected on ``PROJECTIONS`` Gaussian (2-stable) directions, so that the projected
  squared distance over the true one follows a chi-square law with as many degrees of freedom.
* The upper levels of a kd-tree over the projections and the length, which is kept as it is, deal
  the whole table to at most ``REGIONS`` regions. Its cuts are the medians of at most ``SAMPLE`` vectors; every
  vector is dealt, and each region's bounds cover all of its vectors. A region of more than
  ``SHARD`` vectors is cut by hash into shards, and in a shard the tree goes on down to leaves.
* For a region or a leaf the query is scaled to M, the largest length in it. A vector x whose inner product
  with the query of length one is above s then has |Mq - x|^2 < 2M^2 - 2Ms, so with t the ``SURE``
  quantile of the chi-square law its projection lies within t(2M^2 - 2Ms) with probability
  ``SURE``. Solved for s, the projected distance gives the score that it can hold, M - distance^2 / 2Mt.
* Two passes: a query is searched in the region that can hold the best score, which gives it a k-th
  best one; then it goes only to the regions that can hold that much. In a shard leaves are
  verified by their true inner products from the highest such score on, and a query stops when its
  k-th best score is above that of the next leaf.

Vectors are shuffled four times, whatever the size of the table: to tell rows that repeat, to find equal vectors, and once
a pass; a shard is copied in a pass only for each ``BLOCK`` queries that reach it, its tree is built
once for these. Where regions do not tell the vectors apart, as with nearly orthogonal ones, most queries reach most regions.

Equal vectors are one point of the tree that keeps its smallest ids. Scores are sums in double
precision over the original components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; vectors of other lengths are searched among themselves; rows that repeat an id are one
candidate with its best score; an id never finds itself; equal scores are ordered by the smaller id;
a table without usable vectors or queries gives no rows. Only the id and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import keep

PROJECTIONS = 8
SURE = 0.99
LEAF = 32
SHARD = 8192
BLOCK = 8192
SAMPLE = 32768
REGIONS = 4096
#: Leaves that a query verifies between two stopping tests.
LEAVES = 4


def chi_square(x: np.ndarray, degrees: int = PROJECTIONS) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = np.minimum(x / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, degrees // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(sure: float, degrees: int = PROJECTIONS) -> float:
    """The value that ``chi_square`` takes to ``sure``, by halving; infinite for 1."""
    lo, hi = 0.0, 1000.0
    if sure >= 1:
        return np.inf
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if chi_square(np.array([mid]), degrees)[0] >= sure else (mid, hi)
    return hi


def directions(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(20140901).standard_normal((dim, m))


def points_of(x: np.ndarray) -> np.ndarray:
    """The projections of vectors, and their lengths as the last column."""
    return np.hstack([x @ directions(x.shape[1]), np.linalg.norm(x, axis=1)[:, None]])


def held(at: np.ndarray, norm: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray, sure: float) -> np.ndarray:
    """The score that each box (rows of low and high, with the largest length top) can hold for each query.

    ``at`` are the projections of the queries scaled to length one.
    """
    gap = np.zeros((len(at), len(top)))
    for d in range(at.shape[1]):
        place = at[:, d, None] * top
        gap += np.maximum(np.maximum(low[:, d] - place, place - high[:, d]), 0) ** 2
    return (top - gap / (2 * top * quantile(sure))) * norm[:, None]


class Regions:
    """The upper levels of a kd-tree: a complete binary tree of cuts, and the bounds of its regions."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.cut = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
        inside = [sample]
        for node in range(len(self.axis)):
            p = inside[node]
            if len(p):
                d = self.axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
                self.cut[node] = np.median(p[:, d])
            above = p[:, self.axis[node]] > self.cut[node]
            inside += [p[~above], p[above]]
        self.number = self.low = self.high = self.top = None

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), self.axis[node]] > self.cut[node])
        return node - ((1 << self.depth) - 1)

    def bounded(self, rows: list) -> None:
        """``rows``: (region, lows, highs, largest length) of the regions that hold vectors."""
        self.number = np.array([r[0] for r in rows])
        self.low, self.high = (np.array([r[i] for r in rows], float).reshape(len(rows), -1) for i in (1, 2))
        self.top = np.array([r[3] for r in rows], float)

    def held(self, q: np.ndarray, sure: float) -> np.ndarray:
        points = points_of(q)
        return held(points[:, :-1] / points[:, -1:], points[:, -1], self.low, self.high, self.top, sure)


class Shard:
    """Distinct vectors with their smallest ids, and the leaves of a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, leaf: int = LEAF):
        order = np.lexsort((ids, *x.T[::-1]))
        ids, x = ids[order], x[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.x = np.ascontiguousarray(x[first], float)
        # the first k + 1 ids of each vector: one more, as a query may have to leave out its own
        unique = [np.unique(g)[: k + 1] for g in np.split(ids, first[1:])]
        self.ids = np.full((len(first), k + 1), -1, np.int64)
        self.known = np.array([len(u) for u in unique])
        for i, u in enumerate(unique):
            self.ids[i, : len(u)] = u
        self.plane = directions(x.shape[1])
        self.points = points_of(self.x)
        length = self.points[:, -1]
        self.leaves = self._split(np.arange(len(first)), leaf)
        self.low = np.stack([self.points[i, :-1].min(axis=0) for i in self.leaves])
        self.high = np.stack([self.points[i, :-1].max(axis=0) for i in self.leaves])
        self.top = np.array([length[i].max() for i in self.leaves])
        width = max(map(len, self.leaves))
        self.member = np.stack([np.resize(i, width) for i in self.leaves])  # short leaves repeat members

    def _split(self, index: np.ndarray, leaf: int) -> list[np.ndarray]:
        """Halve along the widest side until the leaves are small; ties are cut by place."""
        todo, out = [index], []
        while todo:
            i = todo.pop()
            if len(i) <= leaf:
                out.append(i)
                continue
            p = self.points[i]
            i = i[np.argsort(p[:, np.argmax(p.max(axis=0) - p.min(axis=0))], kind="stable")]
            todo += [i[: len(i) // 2], i[len(i) // 2 :]]
        return out

    def search(self, q: np.ndarray, k: int, sure: float = SURE, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(vectors, scores) of the k + 1 best distinct vectors of each query, and pairs verified.

        Scores below ``floor`` need not be found.
        """
        n, keep_ = len(q), min(k + 1, len(self.x))
        floor = np.full(n, -np.inf) if floor is None else floor
        norm = np.linalg.norm(q, axis=1)
        bound = held((q / norm[:, None]) @ self.plane, norm, self.low, self.high, self.top, sure)
        turn = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, turn, axis=1)
        best = np.full((n, keep_), -1)
        score = np.full((n, keep_), -np.inf)
        alive, verified = np.arange(n), 0
        for step in range(0, len(self.leaves), LEAVES):
            alive = alive[bound[alive, step] >= np.maximum(score[alive, -1], floor[alive])]
            if not len(alive):
                break
            for part in np.array_split(alive, -(-len(alive) // 256)):
                member = self.member[turn[part, step : step + LEAVES]].reshape(len(part), -1)
                s = np.einsum("nmd,nd->nm", self.x[member], q[part])
                verified += s.size
                # members that a short leaf repeats count once
                order = np.argsort(member, axis=1, kind="stable")
                member, s = np.take_along_axis(member, order, 1), np.take_along_axis(s, order, 1)
                s[:, 1:][member[:, 1:] == member[:, :-1]] = -np.inf
                all_i = np.hstack([best[part], member])
                all_s = np.hstack([score[part], s])
                pick = np.argpartition(-all_s, keep_ - 1, axis=1)[:, :keep_]
                pick = np.take_along_axis(pick, np.argsort(-np.take_along_axis(all_s, pick, 1), axis=1, kind="stable"), 1)
                best[part], score[part] = np.take_along_axis(all_i, pick, 1), np.take_along_axis(all_s, pick, 1)
        # the scores that are returned are summed in one way, so equal pairs have equal scores
        return best, np.where(best >= 0, (self.x[best] * q[:, None, :]).sum(axis=2), -np.inf), verified


def _vectors(table: pa.Table) -> np.ndarray:
    column = table.column("vector")
    flat = pa.concat_arrays(column.chunks).flatten() if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(float)


def _search(k: int, sure: float):
    def search(key, table, asked):
        out = {"query_id": [], "vec_id": [], "score": []}
        if table.num_rows and asked.num_rows:
            shard = Shard(table.column("id").to_numpy(), _vectors(table), k)
            ids, q, least = asked.column("id").to_numpy(), _vectors(asked), asked.column("least").to_numpy()
            best, score, _ = shard.search(q, k, sure, least)
            for i in range(len(ids)):
                got = best[i][np.isfinite(score[i])]
                found = shard.ids[got].ravel()
                scores = np.repeat(score[i][: len(got)], shard.ids.shape[1])
                good = np.flatnonzero((found >= 0) & (found != ids[i]) & (scores >= least[i]))
                good = good[np.lexsort((found[good], -scores[good]))][:k]
                out["query_id"].append(np.full(len(good), ids[i]))
                out["vec_id"].append(found[good])
                out["score"].append(scores[good])
        types = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], types[c]) for c, v in out.items()})

    return search


POINTS = [f"p{i}" for i in range(PROJECTIONS)] + ["length"]


def _batch_vectors(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, dimension, vectors) for each dimension of a batch."""
    column, dim = batch.column("vector"), batch.column("dim").to_numpy()
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        yield at, int(d), flat.reshape(len(at), int(d)).astype(float)


def with_points(rows: DataFrame) -> DataFrame:
    """Adds the projections p0, p1, ... and the length."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            points = np.zeros((batch.num_rows, len(POINTS)))
            for at, _, x in _batch_vectors(batch):
                points[at] = points_of(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c) for c in points.T]], names=[*batch.schema.names, *POINTS]
            )

    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(batches, f"{fields}, " + ", ".join(f"{c} double" for c in POINTS))


def fitted(placed: DataFrame, sizes: dict[int, int], shard: int, sample: int) -> dict[int, Regions]:
    """The regions of each dimension, their cuts fitted on at most ``sample`` vectors of it."""
    out = {}
    for dim, n in sizes.items():
        depth = min(max(-(-n // shard) - 1, 0).bit_length(), REGIONS.bit_length() - 1)
        points = np.zeros((0, len(POINTS)))
        if depth:
            rows = placed.filter(F.col("dim") == dim).select(*POINTS).orderBy(F.xxhash64("v1"), "v1").limit(sample).collect()
            points = np.array([tuple(r) for r in rows], float)
        out[dim] = Regions(points, depth)
    return out


def with_regions(placed: DataFrame, regions: dict[int, Regions]) -> DataFrame:
    """Adds ``region``, in place of the projections."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dim, points = batch.column("dim").to_numpy(), np.stack([batch.column(c).to_numpy() for c in POINTS], axis=1)
            region = np.zeros(batch.num_rows, np.int64)
            for d in np.unique(dim):
                region[dim == d] = regions[int(d)].of(points[dim == d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=[*batch.schema.names, "region"])

    fields = ", ".join(f"`{n}` {t}" for n, t in placed.dtypes)
    return placed.mapInArrow(batches, f"{fields}, region bigint")


def sent(asked: DataFrame, regions: dict[int, Regions], sure: float, first: bool) -> DataFrame:
    """Queries with the regions they are searched in: the best one, or all others that can hold ``least``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            least, out = batch.column("least").to_numpy(), [[]] * batch.num_rows
            for at, dim, q in _batch_vectors(batch):
                of = regions[dim]
                for lo in range(0, len(at), 512):
                    part = at[lo : lo + 512]
                    score = of.held(q[lo : lo + 512], sure)
                    best = score.argmax(axis=1)
                    if first:
                        wanted = [[b] for b in best]
                    else:
                        reach = score >= least[part][:, None]
                        reach[np.arange(len(part)), best] = False
                        wanted = [np.flatnonzero(r) for r in reach]
                    for i, w in zip(part.tolist(), wanted, strict=True):
                        out[i] = of.number[w].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], names=[*batch.schema.names, "regions"])

    fields = ", ".join(f"`{n}` {t}" for n, t in asked.dtypes)
    found = asked.mapInArrow(batches, f"{fields}, regions array<bigint>")
    return found.select(*asked.columns, F.explode("regions").alias("region"))


def searched(vectors: DataFrame, asked: DataFrame, sizes: DataFrame, k: int, sure: float, shard: int) -> DataFrame:
    """(query_id, vec_id, score): queries meet the shards of their regions, a block of queries a time."""
    at = ["dim", "region"]
    asks = asked.groupBy(*at).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    plan = sizes.select(*at, F.ceil(F.col("n") / shard).cast("int").alias("shards")).join(asks, at)
    deal = lambda n: F.pmod(F.xxhash64("id", "v1"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.join(plan, at).withColumn("shard", deal("shards")).withColumn("block", each("blocks"))
    right = asked.join(plan, at).withColumn("block", deal("blocks")).withColumn("shard", each("shards"))
    keys = [*at, "shard", "block"]
    left = left.select(*[F.col(c).alias(c) for c in [*keys, "id", "vector"]])
    right = right.select(*[F.col(c).alias(c) for c in [*keys, "id", "vector", "least"]])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k, sure), "query_id bigint, vec_id bigint, score double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def usable(vector: Column) -> Column:
    """Is the vector complete, finite and not zero?"""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, sure: float = SURE,
    shard: int = SHARD, sample: int = SAMPLE,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest inner product for each query.

    ``queries`` is a condition on the id that names the query rows. With ``sure`` = 1 the search is exact.
    """
    kind = dict(vectors.dtypes)[vector_col]
    vector = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))
    rows = rows.withColumns({"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit(1), "vector")})
    rows = rows.dropDuplicates(["dim", "v1", "v2", "id"]).withColumn("asked", queries)
    # of equal vectors the k + 1 smallest ids: one more, as a query may have to leave out its own
    equal = F.row_number().over(Window.partitionBy("dim", "v1", "v2").orderBy("id"))
    candidates = rows.withColumn("_n", equal).filter(F.col("_n") <= k + 1).drop("_n", "asked", "v2")
    placed = keep(with_points(candidates), "projected")
    asked = keep(rows.filter("asked").select("id", "dim", "v1", "vector", F.lit(float("-inf")).alias("least")), "queries")
    sizes = {r["dim"]: r["n"] for r in placed.join(asked.select("dim").distinct(), "dim").groupBy("dim").agg(F.count("*").alias("n")).collect()}
    regions = fitted(placed, sizes, shard, sample)
    dealt = keep(with_regions(placed.filter(F.col("dim").isin(list(sizes))), regions), "regions")
    bounds = dealt.groupBy("dim", "region").agg(
        F.array(*[F.min(c) for c in POINTS[:-1]]).alias("low"), F.array(*[F.max(c) for c in POINTS[:-1]]).alias("high"),
        F.max("length").alias("top"), F.count("*").alias("n"),
    )
    # at most REGIONS rows for each dimension
    bounds = keep(bounds, "bounds")
    known = bounds.collect()
    for dim, of in regions.items():
        of.bounded([(r["region"], r["low"], r["high"], r["top"]) for r in known if r["dim"] == dim])
    slim = dealt.select("id", "dim", "v1", "vector", "region")
    first = keep(searched(slim, sent(asked, regions, sure, True), bounds, k, sure, shard), "first_pass")
    least = best_of(first, k).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
    again = asked.drop("least").join(least, "id", "left").withColumn("least", F.coalesce("score", F.lit(float("-inf")))).drop("score")
    second = searched(slim, keep(sent(again, regions, sure, False), "second_pass"), bounds, k, sure, shard)
    ranked = best_of(first.unionByName(second), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(expected, found): how many of the exact results, by (query, vector), were found."""
    pairs = found.select("query_id", "vec_id", F.lit(1).alias("hit"))
    return exact.join(pairs, ["query_id", "vec_id"], "left").agg(F.count("*").alias("expected"), F.count("hit").alias("found"))
