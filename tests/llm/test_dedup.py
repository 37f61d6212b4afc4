import random

import numpy as np
import pyarrow as pa
import pytest
from brute import near_groups, groups, sha, struck_bytes, struck_words

from trafficlens.llm import blocks, near_dedup, suffix_dedup, window_dedup


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """Blocks and segments of a few documents, so that every exchange has several."""
    dealt = blocks.dealt
    monkeypatch.setattr(blocks, "PER_SEGMENT", 2)
    monkeypatch.setattr(blocks, "dealt", lambda docs: dealt(docs, 16000))


def sorted_rows(pairs):
    return sorted(pairs, key=repr)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("window", [35, 4])
def test_words(request, table, window):
    df = request.getfixturevalue(table)
    given = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    expected = [(d, n, g, sha(k), k) for (d, _), (n, g, k) in zip(given, struck_words([t for _, t in given], window), strict=True)]
    found = window_dedup.strike_repeats(df, window, texts=True)
    assert sorted_rows(map(tuple, found.collect())) == sorted_rows(expected)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize(("length", "gram", "crowd"), [(200, 64, 512), (24, 8, 512), (24, 8, 1)])
def test_bytes(request, monkeypatch, table, length, gram, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    monkeypatch.setattr(suffix_dedup, "STEP", 1000)
    df = request.getfixturevalue(table)
    given = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    expected = [(d, n, g, s, sha(k), k) for (d, _), (n, g, s, k) in zip(given, struck_bytes([t for _, t in given], length), strict=True)]
    found = [(*r[:5], bytes(r[5])) for r in suffix_dedup.remove_repeats(df, length, gram, texts=True).collect()]
    assert sorted_rows(found) == sorted_rows(expected)


@pytest.mark.parametrize("segments", [32, 115])
def test_anchors_spread_over_segments(segments):
    r = random.Random(12)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 6) + str(r.randint(0, 999)) for _ in range(400)) for _ in range(300)]
    block = suffix_dedup.Block(pa.table({"doc_id": range(len(texts)), "text": texts}), 200, 64)
    count = np.bincount(blocks.segment_of(block.keys[0], segments), minlength=segments)
    assert len(block.keys[0]) > 5000 and count.min() > 0 and count.max() <= 3 * count.mean()


@pytest.mark.parametrize("collide", [False, True])
def test_suffix_order(monkeypatch, collide):
    """The hashed mergesort orders like bytes do, also when every hash collides."""
    r = random.Random(2)
    words = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) for _ in range(400)]
    group = np.sort([r.randint(0, 20) for _ in words])
    text = np.frombuffer(b"".join(words) + b"\0", np.uint8)
    size = np.array([len(w) for w in words])
    if collide:
        monkeypatch.setattr(suffix_dedup, "prefix_hash", lambda data, base: np.zeros(len(data) + 1, np.uint64))
    s = suffix_dedup.Suffixes(text, np.cumsum(size) - size, size, group)
    assert [(group[i], words[i]) for i in s.order] == sorted((g, w) for g, w in zip(group, words, strict=True))


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("chunk", [512, 2])
def test_near(request, monkeypatch, table, chunk):
    monkeypatch.setattr(near_dedup, "CHUNK", chunk)
    df = request.getfixturevalue(table)
    given = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    sets, group = near_groups([t for _, t in given])
    expected = []
    for i, (doc_id, _) in enumerate(given):
        ids = [given[j][0] for j in group[i] if given[j][0] is not None]
        expected.append((doc_id, len(sets[i]), min(ids, default=None)))
    found = near_dedup.near_duplicates(df)
    assert sorted_rows((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == sorted_rows(expected)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_one_of_each(request, table):
    df = request.getfixturevalue(table)
    left = near_dedup.keep_one(df)
    assert left.schema == df.schema or [f.name for f in left.schema] == df.columns
    kept = [r["text"] for r in left.collect()]
    given = [r["text"] for r in df.collect()]
    sets, group = near_groups(given)
    words = {frozenset(g) for i, g in group.items() if sets[i]}
    assert len(kept) == len(words) + sum(not s for s in sets)
    _, after = near_groups(kept)
    assert all(len(g) == 1 for g in after.values())


def test_open_buckets_find_a_bridge(spark, monkeypatch):
    """Two texts that resemble a third but not each other are one group, whoever leads."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    versions = []
    for k in range(40):
        words = list(base)
        for i in range(k):
            words[5 + 9 * i] = f"x{i}"
        versions.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(versions)), "doc_id long, text string")
    _, group = near_groups(versions)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert found == {i: min(g) for i, g in group.items()}


def test_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)]
    name = lambda i: b"%04d" % i
    df = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in links], "a binary, b binary")
    found = {bytes(x["node"]): bytes(x["root"]) for x in near_dedup.components(df).collect()}
    nodes = {name(x) for pair in links if pair[0] != pair[1] for x in pair}
    group = groups(nodes, [(name(a), name(b)) for a, b in links])
    assert found == {n: min(group[n]) for n in nodes}


def test_components_after_more_links(spark):
    r = random.Random(8)
    name = lambda i: b"%04d" % i
    frame = lambda links: spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in links], "a binary, b binary")
    first = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(80)]
    more = [(r.randint(0, 260), r.randint(0, 260)) for _ in range(40)]
    comps = near_dedup.components(frame(first))
    found = {bytes(x["node"]): bytes(x["root"]) for x in near_dedup.joined_components(comps, frame(more)).collect()}
    links = [(a, b) for a, b in first + more if a != b]
    group = groups({name(x) for pair in links for x in pair}, [(name(a), name(b)) for a, b in links])
    assert found == {n: min(g) for n, g in group.items()}


def test_links_that_leaders_miss(spark):
    """Pairs of versions resemble each other more than their common base, so their links come last."""
    r = random.Random(21)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
    versions = [" ".join(base)]
    for k in range(12):
        words = list(base)
        for i in r.sample(range(300), 6):
            words[i] = f"x{k}-{i}"
        versions.append(" ".join(words))
        words[r.randint(0, 299)] = f"y{k}"
        versions.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(versions)), "doc_id long, text string")
    _, group = near_groups(versions)
    assert 3 < len({min(g) for g in group.values()}) < len(versions)
    found = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert found == {i: min(g) for i, g in group.items()}


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_drop_hardly_a_link(percent):
    """The exact chance that a pair at the threshold has too few equal minima for the exact test."""
    from math import ceil, comb

    n, p = near_dedup.HASHES, percent / 100
    need = ceil(n * near_dedup._likely(p))
    assert sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(need)) < 1e-9


def test_sets_go_only_to_members_with_a_possible_pair(spark, monkeypatch):
    """Members of an open bucket whose signatures leave no pair possible are not sent with their sets."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 32, (4, near_dedup.HASHES), np.uint32)
    sig[1] = sig[0]
    sig[:, :4] = sig[0, :4]
    sets = [np.sort(rng.integers(0, 1 << 62, 50).astype(np.uint64)) for _ in range(4)]
    sets[1] = sets[0]
    names = [b"n%d" % i for i in range(4)]
    members = spark.createDataFrame([(7, 0, n, 4) for n in names], "bucket bigint, band int, node binary, members bigint")
    classes = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(names, sig, strict=True)], "node binary, signature binary")
    full = spark.createDataFrame([(n, s.tobytes()) for n, s in zip(names, sets, strict=True)], "node binary, shingles binary")
    written, keep = {}, near_dedup.keep
    monkeypatch.setattr(near_dedup, "keep", lambda df, name="kept": written.setdefault(name, keep(df, name)))
    links = near_dedup.open_links(members, members.limit(0).selectExpr("node", "node AS root"), classes, full, 85)
    assert {frozenset((bytes(r.a), bytes(r.b))) for r in links.collect()} == {frozenset(names[:2])}
    assert {bytes(r.node) for r in written["possible"].collect()} == set(names[:2])
