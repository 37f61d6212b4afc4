"""Replay of the semantic cache and of all layers together.

A request is a hit iff an earlier fill of its model lies within the wanted distance, otherwise it
goes upstream and, if that succeeds, becomes a fill that never expires. So the fills are the
greedy independent set of the prompts in time order. Copies of a prompt cannot fill twice, so only
the first fillable request per (model, prompt) can; those items decide everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .. import settings as S
from ..functions.times import millis
from ..session import keep
from . import similarity as sim
from .exact_cache import replay_exact_cache
from .ratelimit import replay_rate_limit

SMALL_GROUP = 8192  # a group of at most this many distinct prompts is decided in one task
FIRST_BATCH = 1024  # undecided prompts of a group that are examined in the first round, in whole blocks
MOST_EXAMINED = 1 << 16  # items of a group that one task decides in a round


def _bits(mask: np.ndarray, n: int) -> np.ndarray:
    """Masks as rows of ``n`` booleans."""
    return (mask[:, None] >> np.arange(n)[None, :]) & 1 > 0


def _masks(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(np.int64) << np.arange(bits.shape[1])[None, :]).sum(axis=1)


def _any_near(part: np.ndarray, m: np.ndarray, single: np.ndarray, fills: np.ndarray, dist: float) -> np.ndarray:
    """Which rows of ``part`` have a fill (a row of ``m``; ``single`` holds it in single precision) within the distance.

    The greatest product in single precision tells, but for the rows where it is too close to the distance.
    """
    near = np.zeros(len(part), bool)
    if len(fills):
        most, slack = (part.astype(np.float32) @ single[fills].T).max(axis=1), sim.slack(m.shape[1])
        near = most > 1.0 - dist + slack
        doubt = np.flatnonzero(~near & ~(most < 1.0 - dist - slack))
        if len(doubt):
            near[doubt] = (np.round(1.0 - part[doubt] @ m[fills].T, sim.DIGITS) <= dist).any(axis=1)
    return near


def _greedy(dists: float | list[float]):
    """Fills among one small group: each item is compared with the fills so far, in time order.

    Bit t of ``mask`` tells that the item is a fill for the distance t; one product serves all. Items with
    ``open`` are decided only for the distances whose bits it has.
    """
    dists = dists if isinstance(dists, list) else [dists]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ms", "ascending"), ("id", "ascending")])
        m = sim.to_matrix(table["vec"])
        open_ = _bits(table["open"].to_numpy(), len(dists)) if "open" in table.column_names else np.ones((len(m), len(dists)), bool)
        single, fills, bits = m.astype(np.float32), [], []
        for at in range(0, len(m), 256):
            part = m[at : at + 256]
            free = open_[at : at + 256].copy()
            if fills:
                of = np.array(bits)
                for t, d in enumerate(dists):
                    free[:, t] = ~_any_near(part, m, single, np.array(fills)[of[:, t]], d)
            inside = np.round(1.0 - part @ part.T, sim.DIGITS)
            for i in np.flatnonzero(free.any(axis=1)):
                mine = free[i].copy()
                if mine.any():
                    fills.append(at + int(i))
                    bits.append(mine)
                    for t in np.flatnonzero(mine):
                        free[i + 1 :, t] &= ~(inside[i, i + 1 :] <= dists[t])
        mask = _masks(np.array(bits).reshape(-1, len(dists)))
        return table.take(pa.array(fills, type=pa.int64())).append_column("mask", pa.array(mask, pa.int64()))

    return run


def _before(q: pa.Table, e: pa.Table):
    """(entries in time order, their times and ids), and which of them come before each query."""
    e = e.sort_by([("ms", "ascending"), ("id", "ascending")])
    em, ei = e["ms"].to_numpy(), e["id"].to_numpy()

    def before(ms: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return (em[None, :] < ms[:, None]) | ((em[None, :] == ms[:, None]) & (ei[None, :] < ids[:, None]))

    return e, em, ei, before


def _answer(m: np.ndarray, mask: np.ndarray, fills: np.ndarray, theirs: np.ndarray, dists: list[float]) -> None:
    """Add to ``mask`` the distances for which a row of ``m`` has a near one among the fills, all of them earlier.

    Rows that are answered for all distances are left out.
    """
    left = np.flatnonzero(mask != (1 << len(dists)) - 1)
    left = left[sim._may_reach(m[left], fills, max(dists))] if len(left) else left
    bits = _bits(theirs, len(dists))
    for i, j, apart in sim.near_pairs(m[left], fills, max(dists)):
        for t, d in enumerate(dists):
            mask[left[i[(apart <= d) & bits[j, t]]]] |= 1 << t


def _answered(dists: list[float]):
    """(grp, no, mask): for the blocks of items that a task is given, the distances for which each row has a near fill."""

    def run(pairs):
        held, read = {}, {}
        for no, a, eno, b in pairs:
            if no not in held:
                rows = sim.unpacked(a)
                held[no] = rows["grp"].slice(0, 1), sim.to_matrix(rows["vec"]), np.zeros(rows.num_rows, np.int64)
            if eno not in read:
                if len(read) == 64:
                    read.clear()
                fills = sim.unpacked(b)
                read[eno] = fills["grp"][0].as_py(), sim.to_matrix(fills["vec"]), fills["mask"].to_numpy()
            (grp, m, mask), (group, *fills) = held[no], read[eno]
            if group == grp[0].as_py():
                _answer(m, mask, *fills, dists)
        for no, (grp, _, mask) in held.items():
            if mask.any():
                found = mask.astype(np.min_scalar_type((1 << len(dists)) - 1)).tobytes()
                yield pa.table({"grp": grp, "no": pa.array([no], pa.int64()), "mask": pa.array([found], pa.binary())})

    return run


def _first_fills(dists: list[float]):
    """(qid, t, ms, id): for each distance the earliest fill that is near enough."""

    def run(q: pa.Table, e: pa.Table) -> pa.Table:
        out = {"qid": [], "t": [], "ms": [], "id": []}
        if q.num_rows and e.num_rows:
            e, em, ei, _ = _before(q, e)
            entries, queries = sim.to_matrix(e["vec"]), sim.to_matrix(q["vec"])
            qi, bits = q["id"].to_numpy(), _bits(e["mask"].to_numpy(), len(dists))
            step = max(1, 2_000_000 // len(em))
            for at in range(0, len(qi), step):
                apart = np.round(1.0 - queries[at : at + step] @ entries.T, sim.DIGITS)
                for t, d in enumerate(dists):
                    near = (apart <= d) & bits[:, t][None, :]
                    some = np.flatnonzero(near.any(axis=1))
                    j = near[some].argmax(axis=1)
                    for c, v in (("qid", qi[at + some]), ("t", np.full(len(some), t)), ("ms", em[j]), ("id", ei[j])):
                        out[c].append(v)
        return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in out.items()})

    return run


def _decided(dists: list[float], block: int):
    """Fills among the blocks of one group's round, in blocks; ``found`` holds what earlier rounds answer of them."""
    greedy, of = _greedy(dists), np.min_scalar_type((1 << len(dists)) - 1)

    def run(examined: pa.Table, found: pa.Table) -> pa.Table:
        answered, made = {}, []
        for no, mask in zip(found["no"].to_pylist(), found["mask"], strict=True):
            answered[no] = answered.get(no, 0) | np.frombuffer(mask.as_buffer(), of).astype(np.int64)
        examined = examined.sort_by("no")
        for no, data in zip(examined["no"].to_pylist(), examined["data"], strict=True):
            rows = sim.unpacked(data)
            m, mask = sim.to_matrix(rows["vec"]), np.zeros(rows.num_rows, np.int64) | answered.get(no, 0)
            for fills, theirs, _ in made:
                _answer(m, mask, fills, theirs, dists)
            open_ = ((1 << len(dists)) - 1) & ~mask
            some = np.flatnonzero(open_)
            if len(some):
                new = greedy(rows.take(pa.array(some)).append_column("open", pa.array(open_[some], pa.int64()))).drop_columns(["open"])
                made.append((sim.to_matrix(new["vec"]), new["mask"].to_numpy(), new))
        if not made:
            return examined.slice(0, 0)
        return sim.block_rows(pa.concat_tables([new for _, _, new in made]), block)

    return run


def _earliest(blocks: DataFrame, end: int) -> DataFrame:
    """The blocks with fewer than ``end`` items of their group before them."""
    return blocks.filter(F.col("before") < end)


def _fills_in_rounds(items: DataFrame, dists: list[float], block: int, first_batch: int) -> DataFrame:
    """Fills of groups of any size, as blocks, in rounds over all groups at once.

    Items are written once, in blocks by time. A round takes the next blocks of each group, compares them with all
    fills so far, many tasks at a time, and decides what is left of them in one task a group, block by block.
    So each item meets each earlier fill once, and nothing is written but the items, once more for their round, and the
    fills. The batch grows each round up to what one task takes; many items at one time make no difference.
    """
    blocks = keep(sim.in_time(keep(items, "of-big-groups"), block), "item-blocks")
    earlier = Window.partitionBy("grp").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    order = keep(blocks.select("no", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "order")
    last = order.agg(F.max("before")).head()[0]
    schema = sim.block_schema(blocks)
    answer = f"grp {blocks.schema['grp'].dataType.simpleString()}, no bigint, mask binary"
    fills, start, batch = None, 0, first_batch
    while last is not None and start <= last:
        named = _earliest(order.filter(F.col("before") >= start), start + batch).select("no")
        examined = keep(blocks.join(named, "no", "left_semi").select(*blocks.columns), "examined")
        known = examined.select("grp", "no", F.col("data").alias("mask")).limit(0) if fills is None else sim.met(examined, fills, _answered(dists), answer)
        new = keep(examined.groupBy("grp").cogroup(known.groupBy("grp")).applyInArrow(_decided(dists, block), schema), "fills")
        fills = new if fills is None else fills.unionByName(new)
        start, batch = start + batch, min(8 * batch, MOST_EXAMINED)
    return blocks.limit(0) if fills is None else fills


def semantic_fill_masks(
    items: DataFrame, dists: list[float], small: int = SMALL_GROUP, block: int = sim.BLOCK,
    first_batch: int = FIRST_BATCH, pivots="auto", most_pairs: int | None = None,
) -> DataFrame:
    """The fills among items (grp, id, ms, vec), in (ms, id) order per group; bit t of ``mask``: for distance t.

    Groups whose checked size fits one task are decided there; all others in rounds. These use no tree and write
    no pairs, so ``pivots`` and ``most_pairs`` steer nothing and stay for callers that name them.
    """
    items = items.select("grp", "id", "ms", "vec")
    sizes = items.groupBy("grp").agg(F.count("*").alias("_n"))
    big_names = sizes.filter(F.col("_n") > small).select("grp")
    small_names = sizes.filter(F.col("_n") <= small).select("grp")
    little = items.join(small_names, "grp").select(*items.columns)
    schema = ", ".join(f"{n} {t}" for n, t in items.dtypes) + ", mask bigint"
    fills = little.groupBy("grp").applyInArrow(_greedy(dists), schema)
    if big_names.isEmpty():
        return fills
    big = items.join(big_names, "grp").select(*items.columns)
    rows = lambda batches: (r for b in batches for data in b.column("data") for r in sim.unpacked(data).to_batches())
    return fills.unionByName(_fills_in_rounds(big, dists, block, first_batch).select("data").mapInArrow(rows, schema))


def semantic_fills(items: DataFrame, max_dist: float, **options) -> DataFrame:
    """The fills for one distance."""
    return semantic_fill_masks(items, [max_dist], **options).drop("mask")


def _fill_candidates(requests: DataFrame, prompts: DataFrame, model: str, prompt: str, ts: str, id_: str, can_fill) -> DataFrame:
    """(grp, prompt, vec, first, last, fill): the first and the first fillable request of each prompt with a vector,
    and the last time it is asked."""
    at = F.struct(millis(F.col(ts)).alias("ms"), F.col(id_).alias("id"))
    firsts = requests.filter(F.col(prompt).isNotNull()).groupBy(F.col(model).alias("grp"), F.col(prompt).alias("prompt")).agg(
        F.min(F.when(can_fill, at)).alias("fill"), F.min(at).alias("first"), F.max(at["ms"]).alias("last")
    )
    vectors = prompts.select(F.col(model).alias("grp"), F.col(prompt).alias("prompt"), "vec")
    return firsts.join(vectors, ["grp", "prompt"])


def _may_fill(items: DataFrame) -> DataFrame:
    return items.filter(F.col("fill").isNotNull()).select("grp", F.col("fill.id").alias("id"), F.col("fill.ms").alias("ms"), "vec")


def replay_semantic(
    requests: DataFrame,
    prompts: DataFrame,
    threshold: float = S.SEMANTIC_THRESHOLD,
    *,
    model: str = "model",
    prompt: str = "prompt",
    ts: str = "ts",
    id_: str = "id",
    fillable: str | None = None,
    small: int = SMALL_GROUP,
    block: int = sim.BLOCK,
    first_batch: int = FIRST_BATCH,
    pivots="auto",
) -> DataFrame:
    """Add ``cache_hit`` (none or semantic), ``is_fill``, ``fill_id`` and ``dist`` to each request.

    ``prompts`` holds one ``vec`` per (model, prompt). A hit names the nearest fill made before
    the request. Requests without a prompt, or whose prompt has no vector, skip this cache. ``pivots`` steers
    nothing any more.
    """
    max_dist = sim.max_distance(threshold)
    rows = requests.withColumn("_ms", millis(F.col(ts)))
    can_fill = F.lit(True) if fillable is None else F.col(fillable)
    # one row per distinct (model, prompt): used three times below, so it is kept
    items = keep(_fill_candidates(requests, prompts, model, prompt, ts, id_, can_fill))
    fills = keep(semantic_fills(_may_fill(items), max_dist, small=small, block=block, first_batch=first_batch, pivots=pivots))
    # a fill has no near one before it and is at distance 0 of its own prompt, so only the others are searched for;
    # a vector without a direction is at no such distance
    directed = F.exists("vec", lambda x: F.abs(x) > 1e-150) & ~F.exists("vec", lambda x: F.abs(x) > 1e150)
    own = fills.filter(directed).select("grp", F.struct("ms", "id").alias("fill"), F.xxhash64("vec").alias("_v"))
    marked = items.withColumn("_v", F.xxhash64("vec"))
    key = ["grp", "fill", "_v"]
    found = marked.select(*key, F.col("first.id").alias("qid")).join(own, key).select(
        "qid", F.lit(0.0).alias("dist"), F.col("fill.ms").alias("ms"), F.col("fill.id").alias("id")
    )
    asked = keep(marked.join(own, key, "left_anti").select("grp", F.col("first.id").alias("id"), F.col("last").alias("ms"), "vec"), "asked")
    found = found.unionByName(sim.records_among(asked, fills, max_dist, small, block))
    # the record holders of a prompt: few, because each must be nearer than all before it
    stairs = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("ms", "id", "dist"))).alias("_stairs"))
    known = items.select(
        F.col("grp").alias(model), F.col("prompt").alias(prompt), F.col("first.id").alias("qid")
    ).join(stairs, "qid").drop("qid")
    joined = rows.join(known, [model, prompt], "left")
    before = F.filter(
        "_stairs", lambda s: (s["ms"] < F.col("_ms")) | ((s["ms"] == F.col("_ms")) & (s["id"] < F.col(id_)))
    )
    hit = F.try_element_at(before, F.lit(-1))
    is_fill = F.exists("_stairs", lambda s: (s["id"] == F.col(id_)) & (s["dist"] == 0)) & hit.isNull() & can_fill
    return joined.select(
        *requests.columns,
        F.when(hit.isNotNull(), "semantic").otherwise("none").alias("cache_hit"),
        F.coalesce(is_fill, F.lit(False)).alias("is_fill"),
        hit["id"].alias("fill_id"),
        hit["dist"].alias("dist"),
    )


def replay_funnel(
    requests: DataFrame,
    prompts: DataFrame | None,
    *,
    limits: DataFrame | None = None,
    threshold: float = S.SEMANTIC_THRESHOLD,
    ttl_seconds: int = S.CACHE_TTL_SECONDS,
    fillable: str | None = None,
    limiter: dict | None = None,
    **search,
) -> DataFrame:
    """Attribute each request to a layer: rate_limited, exact, semantic or none.

    ``requests``: id, api_key_id, ts, model, prompt, request_hash. Adds ``layer`` and ``fill_id``
    (the request whose answer was reused). ``prompts=None`` switches the semantic cache off.

    Fills of the semantic cache never expire and a repeated hash is at distance 0 of its fill, so
    a hash is filled at most once: a request that is no fill is an exact hit while the fill of its
    own hash lives, and a semantic hit otherwise. Requests without prompt use the exact cache alone.
    """
    # read by every step below; what it takes to derive the rows is done once
    requests = keep(requests, "requests")
    columns = requests.columns
    slim = ["id", "api_key_id", "ts", "model", "prompt", "request_hash"] + ([fillable] if fillable else [])
    gated = keep(replay_rate_limit(requests.select(*slim), limits, **(limiter or {})))
    admitted = gated.filter(F.col("decision") == "ok").select(*slim)
    if prompts is None:
        plain, labelled = admitted, None
    else:
        prompts = keep(prompts.select("model", "prompt", "vec"), "prompts")
        has_vector = prompts.select("model", "prompt")
        known = admitted.filter(F.col("prompt").isNotNull())
        plain = admitted.join(has_vector, ["model", "prompt"], "left_anti").select(*slim)
        seen = keep(replay_semantic(known.join(has_vector, ["model", "prompt"], "left_semi").select(*slim), prompts,
                                   threshold, fillable=fillable, **search))
        fills = seen.filter("is_fill").select(
            "request_hash", F.col("id").alias("_own_id"), millis(F.col("ts")).alias("_own_ms")
        )
        at = millis(F.col("ts"))
        earlier = (F.col("_own_ms") < at) | ((F.col("_own_ms") == at) & (F.col("_own_id") < F.col("id")))
        exact = F.coalesce(earlier & (at - F.col("_own_ms") < F.lit(ttl_seconds * 1000)), F.lit(False))
        labelled = seen.join(fills, "request_hash", "left").select(
            "id",
            F.when(exact, "exact").otherwise(F.col("cache_hit")).alias("layer"),
            F.when(exact, F.col("_own_id")).otherwise(F.col("fill_id")).alias("fill_id"),
        )
    alone = replay_exact_cache(plain, ttl_seconds, fillable=fillable).select(
        "id", F.col("cache_hit").alias("layer"), "fill_id"
    )
    limited = gated.filter(F.col("decision") != "ok").select(
        "id", F.lit("rate_limited").alias("layer"), F.lit(None).cast("bigint").alias("fill_id")
    )
    layers = alone.unionByName(limited) if labelled is None else alone.unionByName(limited).unionByName(labelled)
    return requests.join(layers, "id").select(*columns, "layer", "fill_id")


def threshold_sweep(
    requests: DataFrame, prompts: DataFrame, thresholds: list[float], **columns
) -> DataFrame:
    """Upper bound of the hits per threshold, from one search.

    A request can only hit if an earlier request of its model lies within the distance; the
    nearest earlier one is found once, for the lowest threshold, and counted for all.
    """
    rows = requests.withColumn("_ms", millis(F.col("ts")))
    first = F.min(F.struct(F.col("_ms").alias("ms"), F.col("id").alias("id")))
    items = rows.groupBy(F.col("model").alias("grp"), "prompt").agg(first.alias("o"), F.count("*").alias("n"))
    items = keep(items.join(prompts.select(F.col("model").alias("grp"), "prompt", "vec"), ["grp", "prompt"]))
    points = items.select("grp", F.col("o.id").alias("id"), F.col("o.ms").alias("ms"), "vec")
    found = sim.nearest(points, points, sim.max_distance(min(thresholds)), earlier=True)
    counted = items.select(F.col("o.id").alias("qid"), "n").join(found.select("qid", "dist"), "qid", "left")
    levels = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(sim.max_distance(t)).alias("m")) for t in thresholds])
    first_hits = F.when(F.coalesce(F.col("dist") <= F.col("l.m"), F.lit(False)), 1).otherwise(0)
    # all but the first request of a prompt have a copy before them
    return (
        counted.withColumn("l", F.explode(levels))
        .groupBy(F.col("l.threshold").alias("threshold"))
        .agg(F.sum("n").alias("requests"), F.sum(F.col("n") - 1 + first_hits).alias("possible_hits"))
    )


def threshold_sweep_exact(
    requests: DataFrame, prompts: DataFrame, thresholds: list[float], *, model: str = "model", prompt: str = "prompt",
    ts: str = "ts", id_: str = "id", fillable: str | None = None, block: int = sim.BLOCK, pivots="auto", **options,
) -> DataFrame:
    """Hits per threshold, all of them from one replay (at most 60 thresholds).

    The fills are found once, with a bit for each threshold that they are a fill for; one search at
    the loosest distance gives each prompt its earliest fill per threshold, and all its requests
    after that one are hits.
    """
    dists = [sim.max_distance(t) for t in thresholds]
    if not 0 < len(dists) <= 60:
        raise ValueError("1 to 60 thresholds")
    can_fill = F.lit(True) if fillable is None else F.col(fillable)
    items = keep(_fill_candidates(requests, prompts, model, prompt, ts, id_, can_fill), "sweep-items")
    fills = keep(semantic_fill_masks(_may_fill(items), dists, block=block, pivots=pivots, **options), "sweep-fills")
    asked = items.select("grp", F.col("first.id").alias("id"), F.col("first.ms").alias("ms"), "vec")
    tree = sim.placed_for(fills, pivots, block)
    found = sim.by_blocks(tree.place(asked, max(dists)), tree.entries, _first_fills(dists), "qid bigint, t bigint, ms bigint, id bigint", block)
    earliest = [F.min(F.when(F.col("t") == t, F.struct("ms", "id"))).alias(f"_first{t}") for t in range(len(dists))]
    firsts = found.groupBy("qid").agg(*earliest)
    known = items.select(F.col("grp").alias(model), F.col("prompt").alias(prompt), F.col("first.id").alias("qid")).join(firsts, "qid").drop("qid")
    joined = requests.withColumn("_at", F.struct(millis(F.col(ts)).alias("ms"), F.col(id_).alias("id"))).join(known, [model, prompt], "left")
    hits = joined.agg(F.count("*").alias("requests"), *[F.count_if(F.col(f"_first{t}") < F.col("_at")).alias(f"hits{t}") for t in range(len(dists))])
    levels = [F.struct(F.lit(float(v)).alias("threshold"), "requests", F.col(f"hits{t}").alias("hits")) for t, v in enumerate(thresholds)]
    return hits.select(F.inline(F.array(*levels)))


def semantic_collisions(replayed: DataFrame, context: list[str], id_: str = "id") -> DataFrame:
    """Semantic hits whose context differs from that of the request they were answered from.

    The lookup compares only the model and the last user turn; ``context`` names the columns
    (hash, system prompt, sampling) it ignores.
    """
    hits = replayed.filter(F.col("cache_hit") == "semantic")
    theirs = replayed.filter("is_fill").select(
        F.col(id_).alias("fill_id"), *[F.col(c).alias(f"fill_{c}") for c in context]
    )
    joined = hits.join(theirs, "fill_id")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"fill_{c}")), F.lit(c)) for c in context]
    return joined.withColumn("differing", F.concat_ws(",", *differs)).filter(F.col("differing") != "")
