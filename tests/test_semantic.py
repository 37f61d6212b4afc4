"""Vector search and semantic replays against brute force."""

import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from trafficlens.operators import embedding, semantic_cache as sc, similarity as sim

T0 = datetime(2024, 1, 1)
BASE = int((T0 - datetime(1970, 1, 1)).total_seconds() * 1000)


def clustered(seed, n, dim=12, groups=("a", "b"), spread=0.15, centres=9):
    """Vectors around a few centres; one centre holds a third of them."""
    rng = np.random.default_rng(seed)
    c = np.random.default_rng(0).normal(size=(centres, dim))
    pick = np.where(rng.random(n) < 0.34, 0, rng.integers(0, centres, n))
    vec = (c[pick] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    dup = rng.integers(0, n, n // 6)
    vec[dup] = vec[rng.integers(0, n, len(dup))]
    grp = [groups[0] if rng.random() < 0.6 else groups[1] for _ in range(n)]
    return [(grp[i], i, int(rng.integers(0, n // 2)), vec[i].tolist()) for i in range(n)]


def items(spark, rows):
    return spark.createDataFrame(rows, "grp string, id bigint, ms bigint, vec array<float>")


def unit(v):
    v = np.asarray(np.asarray(v, dtype=np.float32), dtype=np.float64)
    return v / (np.linalg.norm(v) or 1.0)


def distances(q, e):
    return np.round(1 - np.array([unit(x[3]) for x in q]) @ np.array([unit(x[3]) for x in e]).T, 9) + 0.0


def brute_nearest(q, e, max_dist, earlier):
    d, out = distances(q, e), {}
    for i, (g, qid, ms, _) in enumerate(q):
        best = None
        for j, (g2, eid, ms2, _) in enumerate(e):
            if g2 != g or d[i, j] > max_dist or (earlier and (ms2, eid) >= (ms, qid)):
                continue
            best = min(best or (9, 0, 0), (d[i, j], ms2, eid))
        if best:
            out[qid] = (round(best[0], 6), best[2])
    return out


def result(df):
    return {r.qid: (round(r.dist, 6), r.id) for r in df.collect()}


@pytest.mark.parametrize("earlier", [False, True])
@pytest.mark.parametrize("block", [4096, 16])
def test_nearest_equals_brute_force(spark, earlier, block):
    e, q = clustered(1, 220), clustered(2, 150)
    pivots = sim.sample_pivots(items(spark, e), 20)
    want = brute_nearest(q, e, 0.08, earlier)
    assert want
    for p in (None, pivots):
        got = sim.nearest(items(spark, q), items(spark, e), 0.08, earlier=earlier, pivots=p, block=block)
        assert result(got) == want


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.001, 0.6), st.integers(2, 12))
def test_cells_lose_nothing(seed, max_dist, k):
    rng = np.random.default_rng(seed)
    norm = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    p, e, q = (norm(rng.normal(size=(n, 5))) for n in (k, 60, 40))
    cell = (e @ p.T).argmax(axis=1)
    reach = sim.cells_within(q, p, np.sqrt(2 * max_dist))
    near = 1 - q @ e.T <= max_dist
    for i, j in zip(*np.nonzero(near)):
        assert reach[i, cell[j]]


@pytest.mark.parametrize(("earlier", "max_dist"), [(False, 0.08), (True, 1.1)])
def test_tree_equals_brute_force(spark, monkeypatch, earlier, max_dist):
    monkeypatch.setattr(sim, "FAN", 8)
    monkeypatch.setattr(sim, "LEAF", 4)
    e, q = clustered(1, 400, centres=30), clustered(2, 150, centres=30)
    e += [("a", 1000 + i, i, [0.0] * 12) for i in range(3)] + [("a", 2000 + i, i, e[0][3]) for i in range(100)]
    q += [("a", 3000, 500, [0.0] * 12)]
    got = sim.nearest(items(spark, q), items(spark, e), max_dist, earlier=earlier, block=8)
    assert result(got) == brute_nearest(q, e, max_dist, earlier)
    tree = sim.Tree(items(spark, e), 8)
    assert len(tree.levels) > 1 and tree.entries.count() == len(e)
    sizes = {(r["grp"], r["cell"]): r["count"] for r in tree.entries.groupBy("grp", "cell").count().collect()}
    # only the cell of equal vectors is larger
    assert sorted(sizes.values())[-2] <= 32


def test_copies_of_a_query_do_not_grow_with_the_entries(spark):
    copies, rng = [], np.random.default_rng(6)
    for n in (500, 8000):
        # more clusters as there are more entries, so that a query has as many neighbours
        centre = rng.normal(size=(n // 25, 12))
        near = lambda m: (centre[rng.integers(0, len(centre), m)] + 0.01 * rng.normal(size=(m, 12))).tolist()  # noqa: B023, E731
        tree = sim.Tree(items(spark, [("a", i, i, v) for i, v in enumerate(near(n))]), 8)
        copies.append(tree.place(items(spark, [("a", i, i, v) for i, v in enumerate(near(200))]), 0.005).count() / 200)
    assert copies[1] <= 1.5 * copies[0] + 1


def test_records_are_the_nearest_so_far(spark):
    e, q = clustered(4, 200, groups=("a", "a")), clustered(5, 60, groups=("a", "a"))
    got = {}
    for r in sim.nearest(items(spark, q), items(spark, e), 0.2, records=True, pivots=None, block=16).collect():
        got.setdefault(r.qid, []).append((r.ms, r.id, round(r.dist, 6)))
    d = distances(q, e)
    for i, (_, qid, _, _) in enumerate(q):
        best, want = 9.0, []
        for j in sorted(range(len(e)), key=lambda j: (e[j][2], e[j][1])):
            if d[i, j] <= 0.2 and d[i, j] < best:
                best = d[i, j]
                want.append((e[j][2], e[j][1], round(best, 6)))
        assert sorted(got.get(qid, [])) == want


def test_lookup_misses_and_edge(spark):
    e = items(spark, [("m", 1, 0, [1.0, 0.0]), ("m", 2, 0, [1.0, 0.0]), ("n", 3, 0, [0.0, 1.0])])
    # cos = 0.6, so the distance is exactly the greatest one of threshold 0.6
    q = items(spark, [("m", 10, 0, [0.6, 0.8]), ("m", 11, 0, [0.0, 1.0]), ("x", 12, 0, [1.0, 0.0]), ("m", 13, 0, [0.6, 0.8])])
    got = {r.id: (r.entry_id, r.dist) for r in sim.semantic_lookup(q, e, 0.6).collect()}
    assert got[10][0] == 1 and abs(got[10][1] - 0.4) < 1e-6 and got[13] == got[10]
    assert got[11] == (None, None) and got[12] == (None, None)
    strict = {r.id: r.entry_id for r in sim.semantic_lookup(q, e, 0.61).collect()}
    assert strict[10] is None


def test_ivf_recall(spark):
    e, q = clustered(6, 400, centres=30, spread=0.05), clustered(7, 200, centres=30, spread=0.05)
    e = e + [(g, 1000 + i, 0, v) for g, i, _, v in q[:100]]
    exact = sim.semantic_lookup(items(spark, q), items(spark, e), 0.9)
    approx = sim.semantic_lookup_ivf(items(spark, q), items(spark, e), 0.9, lists=20, nprobe=5)
    r = sim.recall(approx, exact).head()
    assert r.exact_hits >= 100 and r.recall >= 0.9


def brute_semantic(rows, vec, max_dist):
    """rows: (id, model, prompt, ms, fillable); vec: prompt -> vector. Sequential replay."""
    u = {p: unit(v) for p, v in vec.items()}
    fills, out = {}, {}
    for i, model, prompt, ms, fillable in sorted(rows, key=lambda r: (r[3], r[0])):
        if prompt is None or prompt not in u:
            out[i] = ("none", False, None)
            continue
        best = None
        for p, fid in fills.get(model, []):
            d = round(1 - float(u[prompt] @ u[p]), 9) + 0.0
            if d <= max_dist and (best is None or d < best[0]):
                best = (d, fid)
        if best:
            out[i] = ("semantic", False, best[1])
        else:
            out[i] = ("none", fillable, None)
            if fillable:
                fills.setdefault(model, []).append((prompt, i))
    return out


def requests(seed, n=700, prompts=120):
    r = random.Random(seed)
    vec = {f"p{i}": v for i, (_, _, _, v) in enumerate(clustered(seed, prompts, spread=0.2))}
    rows = []
    for i in range(n):
        p = "p0" if r.random() < 0.33 else f"p{r.randrange(prompts)}"
        p = None if r.random() < 0.05 else "unknown" if r.random() < 0.02 else p
        rows.append((i, r.choice("ab"), p, r.randrange(n), r.random() > 0.25))
    return rows, vec


def request_frame(spark, rows):
    data = [(i, m, p, T0 + timedelta(milliseconds=ms), f) for i, m, p, ms, f in rows]
    return spark.createDataFrame(data, "id bigint, model string, prompt string, ts timestamp_ntz, fillable boolean")


def prompt_frame(spark, vec):
    return spark.createDataFrame([(m, p, v) for p, v in vec.items() for m in "ab"], "model string, prompt string, vec array<float>")


@pytest.mark.parametrize("options", [{}, {"small": 0, "first_batch": 5, "block": 32}, {"small": 0, "first_batch": 8, "pivots": "some"}])
def test_replay_semantic_equals_loop(spark, options):
    rows, vec = requests(11)
    prompts = prompt_frame(spark, vec)
    if options.get("pivots") == "some":
        options = {**options, "pivots": np.array([unit(v) for v in list(vec.values())[:7]])}
    got = sc.replay_semantic(request_frame(spark, rows), prompts, 0.95, fillable="fillable", **options)
    want = brute_semantic(rows, vec, 0.05)
    assert {r.id: (r.cache_hit, r.is_fill, r.fill_id) for r in got.collect()} == want
    assert {w[0] for w in want.values()} == {"none", "semantic"}


@pytest.mark.parametrize("shape", ["chain", "clique", "mixed"])
@pytest.mark.parametrize("most_pairs", [10**6, 8])
def test_pieces_of_any_shape_end_in_few_rounds(spark, monkeypatch, shape, most_pairs):
    n = 1000 if most_pairs > 8 else 20
    angle = np.arange(n) * 0.005 if shape == "chain" else np.random.default_rng(1).random(n) * (0.004 if shape == "clique" else 3.0)
    rows = [("a", i, i, [float(np.cos(x)), float(np.sin(x))]) for i, x in enumerate(angle)]
    rounds, earliest = [], sc._earliest
    monkeypatch.setattr(sc, "_earliest", lambda df, batch: rounds.append(batch) or earliest(df, batch))
    max_dist = round(1 - np.cos(0.0051), 9)
    got = sc.semantic_fill_masks(items(spark, rows), [max_dist, 4 * max_dist], small=0, block=256, most_pairs=most_pairs)
    u = [unit(r[3]) for r in rows]
    want = {}
    for t, d in enumerate((max_dist, 4 * max_dist)):
        fills = []
        for i in range(n):
            if not any(round(1 - float(u[i] @ u[j]), 9) <= d for j in fills):
                fills.append(i)
                want[i] = want.get(i, 0) | 1 << t
    assert {r["id"]: r["mask"] for r in got.collect()} == want
    assert most_pairs == 8 or len(rounds) <= 3


def test_rounds_write_no_pairs(spark, monkeypatch):
    """What the rounds write grows with the items, not with their pairs, of which a crowd has n * n / 2."""
    n, written, kept = 1500, [], sc.keep
    rows = [("a", i, i, [1.0, 0.0001 * (i % 97) + 0.00001 * (i // 97)]) for i in range(n)]
    monkeypatch.setattr(sc, "keep", lambda df, *name: (out := kept(df, *name), written.append(out.count()))[0])
    got = sc.semantic_fill_masks(items(spark, rows), [0.01], small=0, block=256)
    assert [r["id"] for r in got.collect()] == [0]
    assert sum(written) <= 10 * n


@pytest.mark.parametrize("options", [{}, {"small": 0, "first_batch": 8, "block": 32}])
def test_sweep_equals_a_replay_for_each_threshold(spark, options):
    rows, vec = requests(12)
    thresholds = [0.99, 0.8, 0.97, 0.9, 0.95, 0.85]
    got = sc.threshold_sweep_exact(request_frame(spark, rows), prompt_frame(spark, vec), thresholds, fillable="fillable", **options)
    want = {}
    for t in thresholds:
        replay = brute_semantic(rows, vec, sim.max_distance(t))
        want[t] = (len(rows), sum(x[0] == "semantic" for x in replay.values()))
    assert {r["threshold"]: (r["requests"], r["hits"]) for r in got.collect()} == want


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 100_000), st.integers(1, 700), st.floats(0.01, 0.9))
def test_greedy_equals_loop(seed, n, max_dist):
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    vec = rng.normal(size=(n, 4)).astype(np.float32)
    table = pa.table(
        {"grp": ["g"] * n, "id": list(range(n)), "ms": rng.integers(0, n, n).tolist(), "vec": [v.tolist() for v in vec]},
        schema=pa.schema([("grp", pa.string()), ("id", pa.int64()), ("ms", pa.int64()), ("vec", pa.list_(pa.float32()))]),
    )
    got = sc._greedy(max_dist)(table)["id"].to_pylist()
    m = sim.to_matrix(table["vec"])
    fills = []
    for i in sorted(range(n), key=lambda i: (table["ms"][i].as_py(), i)):
        if not any(round(1 - float(m[i] @ m[j]), 9) <= max_dist for j in fills):
            fills.append(i)
    # distances next to the limit may round differently in the two products
    close = np.abs(1 - m @ m.T - max_dist).min() < 1e-8
    assert close or got == fills


def brute_funnel(rows, vec, max_dist, ttl, limit):
    """Rate limit, exact cache, semantic cache, upstream: one request after the other."""
    u = {p: unit(v) for p, v in vec.items()}
    slots, exact, fills, out = {}, {}, {}, {}
    for i, key, model, prompt, h, ms, fillable in sorted(rows, key=lambda r: (r[5], r[0])):
        taken = slots.setdefault(key, [])
        if sum(1 for t in taken if t > ms - 60_000) >= limit:
            out[i] = ("rate_limited", None)
            continue
        taken.append(ms)
        if h in exact and ms - exact[h][0] < ttl:
            out[i] = ("exact", exact[h][1])
            continue
        best = None
        if prompt in u:
            for p, fid in fills.get(model, []):
                d = round(1 - float(u[prompt] @ u[p]), 9) + 0.0
                if d <= max_dist and (best is None or d < best[0]):
                    best = (d, fid)
        if best:
            out[i] = ("semantic", best[1])
            continue
        out[i] = ("none", None)
        if fillable:
            exact[h] = (ms, i)
            if prompt in u:
                fills.setdefault(model, []).append((prompt, i))
    return out


@pytest.mark.parametrize("semantic", [True, False])
def test_funnel_equals_loop(spark, semantic):
    base, vec = requests(21, n=900)
    r = random.Random(5)
    rows = []
    for i, model, prompt, _, fillable in base:
        rows.append((i, r.randrange(6), model, prompt, f"{model}|{prompt}|{r.randrange(2)}", r.randrange(600_000), fillable))
    data = [(i, k, m, p, h, T0 + timedelta(milliseconds=ms), f) for i, k, m, p, h, ms, f in rows]
    df = spark.createDataFrame(
        data, "id bigint, api_key_id bigint, model string, prompt string, request_hash string, ts timestamp_ntz, fillable boolean"
    )
    got = sc.replay_funnel(
        df, prompt_frame(spark, vec) if semantic else None, threshold=0.95, ttl_seconds=60, fillable="fillable",
        limiter={"per_short": 12, "per_long": 10_000},
    )
    want = brute_funnel(rows, vec if semantic else {}, 0.05, 60_000, 12)
    assert {x.id: (x.layer, x.fill_id) for x in got.collect()} == want
    layers = {"rate_limited", "exact", "none"} | ({"semantic"} if semantic else set())
    assert {w[0] for w in want.values()} == layers


def test_collisions(spark):
    rows = [(1, "none", True, None, "x", None), (2, "semantic", False, 1, "x", None), (3, "semantic", False, 1, "x", 0.5)]
    df = spark.createDataFrame(
        rows, "id bigint, cache_hit string, is_fill boolean, fill_id bigint, system string, temperature double"
    )
    got = sc.semantic_collisions(df, ["system", "temperature"]).collect()
    assert [(r.id, r.differing) for r in got] == [(3, "temperature")]


def test_jobs_fail_whole(spark):
    def build():
        inner = embedding.hashed_terms(8)()

        def embed(texts, model):
            if any("boom" in t for t in texts):
                raise ValueError("boom in batch")
            return inner(texts, model)

        return embed

    jobs = spark.createDataFrame([(1, "openai", "m"), (2, "gemini", "m"), (3, "gemini", "m")], "job_id bigint, provider string, model string")
    rows = [(1, i, f"text {i}") for i in range(70)] + [(2, i, "boom" if i == 50 else "fine") for i in range(70)]
    inputs = spark.createDataFrame(rows, "job_id bigint, pos int, text string")
    results, vectors = embedding.run_embedding_jobs(jobs, inputs, build)
    got = {r.job_id: (r.status, r["count"], r.dimensions, r.error) for r in results.collect()}
    assert got == {
        1: ("succeeded", 70, 8, None), 2: ("failed", None, None, "boom in batch"), 3: ("succeeded", 0, 0, None),
    }
    assert {(r.job_id, r.pos) for r in vectors.collect()} == {(1, i) for i in range(70)}


def test_embedder_is_deterministic_and_unit():
    embed = embedding.hashed_terms(32)()
    a, b = embed(["Ein Wort, noch ein Wort", ""], None), embed(["ein wort, NOCH ein Wort", ""], "m")
    assert np.allclose(a, b) and abs(np.linalg.norm(a[0]) - 1) < 1e-6 and not a[1].any()


def test_funnel_derives_its_requests_once(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i, i % 3, T0 + timedelta(seconds=i % 7), "m", f"p{i % 5}", f"h{i % 5}") for i in range(60)]
    schema = "id bigint, api_key_id bigint, ts timestamp_ntz, model string, prompt string, request_hash string"
    given = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    vec = spark.createDataFrame([("m", f"p{i}", [1.0, float(i)]) for i in range(5)], "model string, prompt string, vec array<float>")
    assert len(sc.replay_funnel(given, vec, limiter={"per_short": 12, "per_long": 10_000}).collect()) == 60
    assert read.value == 60


@pytest.mark.parametrize("max_dist", [0.2, 0.03, 1.4])
def test_near_pairs_are_those_of_double_precision(max_dist):
    rng = np.random.default_rng(4)
    q, e = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rng.normal(size=(n, 6)) for n in (700, 900)))
    # pairs at the distance, and nearer and farther by less than single precision tells
    for k, off in enumerate([0.0, 4e-10, 6e-10, 3e-9, -3e-9, 1e-7, -1e-7]):
        cos = 1.0 - max_dist - off
        e[k] = cos * q[k] + np.sqrt(1 - cos**2) * np.linalg.qr(np.column_stack([q[k], q[k + 300]]))[0][:, 1]
    e[50], q[60] = 0.0, np.nan
    want = np.round(1.0 - q @ e.T, 9)
    got = list(sim.near_pairs(q, e, max_dist))
    i, j, dist = (np.concatenate(x) for x in zip(*got, strict=True))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(want <= max_dist)), strict=True))
    assert np.abs(dist - want[i, j]).max() <= 1.1e-9
    some = np.array([0, 60, *range(100, 140)])
    m = np.concatenate([e, q[some]])
    near = sc._any_near(q, m, m.astype(np.float32), np.arange(900), max_dist)
    assert (near == (want <= max_dist).any(axis=1)).all()


def test_records_are_below_all_before():
    rng = np.random.default_rng(8)
    i = np.sort(rng.integers(0, 40, 500))
    dist = np.round(rng.random(500), 1)
    want = [k for k in range(500) if all(dist[k] < dist[n] for n in range(k) if i[n] == i[k])]
    assert sim._records(i, dist).tolist() == want
    assert sim._records(i[:0], dist[:0]).tolist() == []


def test_rounds_write_an_item_as_often_whatever_their_number(spark, monkeypatch):
    """An item is written for its block, its round and as a fill, however many rounds come before its own."""
    n, written, kept = 600, [], sc.keep
    monkeypatch.setattr(sc, "MOST_EXAMINED", 64)
    count = lambda df: df.selectExpr("sum(n)").head()[0] or 0 if "n" in df.columns else df.count()
    monkeypatch.setattr(sc, "keep", lambda df, *name: (out := kept(df, *name), written.append(count(out)))[0])
    rng = np.random.default_rng(3)
    rows = [("a", i, i // 150, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 12)))]
    got = sc.semantic_fill_masks(items(spark, rows), [0.001], small=0, block=32, first_batch=64)
    assert got.count() == n
    assert sum(written) <= 6 * n


def test_only_prompts_without_a_fill_are_searched(spark, monkeypatch):
    rows, vec = requests(13)
    asked, search = [], sim.records_among
    monkeypatch.setattr(sim, "records_among", lambda q, *rest: asked.append(q.count()) or search(q, *rest))
    got = sc.replay_semantic(request_frame(spark, rows), prompt_frame(spark, vec), 0.95, fillable="fillable", small=0, block=16)
    want = brute_semantic(rows, vec, 0.05)
    assert {r.id: (r.cache_hit, r.is_fill, r.fill_id) for r in got.collect()} == want
    known = {(m, p) for _, m, p, _, _ in rows if p in vec}
    assert asked == [len(known) - sum(w[1] for w in want.values())]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.floats(0.0, 0.7), st.floats(0.0, 1.0))
def test_bands_lose_nothing(seed, max_dist, spread):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=6)
    q, e = (sim.to_matrix(_list_column(centre + spread * rng.normal(size=(n, 6)))) for n in (150, 170))
    e[:3], q[:3], q[3] = q[5:8], 0.0, -q[4]
    rows, others, steps = sim._bands(q, e, max_dist)
    met = np.zeros((len(q), len(e)), bool)
    for at, to, lo, hi in steps:
        met[np.ix_(rows[at:to], others[lo:hi])] = True
    assert met[np.round(1 - q @ e.T, 9) <= max_dist].all()


def _list_column(m):
    import pyarrow as pa

    return pa.array(m.tolist(), pa.list_(pa.float64()))


def test_bands_spare_rows_at_other_angles():
    angle = np.linspace(0, 1.5, 4000)
    m = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    products = sum((to - at) * (hi - lo) for at, to, lo, hi in sim._bands(m, m, 0.001)[2])
    # a pair is near up to 0.045 of 1.5, on either side of the common direction
    assert products < 0.25 * 4000 * 4000


def test_words_are_those_of_a_split():
    import pyarrow as pa

    r = random.Random(3)
    texts = ["", " ", "a", "a ", " a", "x\ty\r\n\fz", "b\x0bc d", "日本 語", "", "\x00 e"]
    texts += ["".join(r.choice(" \t\n\r\faÄé日\x0b") for _ in range(r.randrange(12))) for _ in range(300)]
    for part in (texts, texts[:1], [], ["", " "]):
        # a slice, so the offsets do not begin at 0
        column = pa.array(["x y", *part], pa.large_string()).slice(1)
        rows, words = embedding._words(column)
        want = [(i, w) for i, t in enumerate(part) for w in re.split(r"[ \t\n\r\f]+", t) if w]
        assert list(zip(rows.tolist(), words.to_pylist(), strict=True)) == want


def test_embedding_of_a_column_keeps_nulls_and_calls(spark):
    def build():
        def embed(texts, model):
            assert len(texts) <= 3
            return np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

        return embed

    texts = ["ab", None, "", "abcd", None, "x", "yz", "abc", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    got = rows.withColumn("vec", embedding.embed_udf(build, batch=3)("text")).collect()
    assert {x.id: x.vec for x in got} == {i: None if t is None else [float(len(t)), 1.0] for i, t in enumerate(texts)}
    none = rows.filter("text IS NULL").withColumn("vec", embedding.embed_udf(build, batch=3)("text")).collect()
    assert [x.vec for x in none] == [None] * 3
