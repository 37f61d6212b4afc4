"""Mixing, language, quality, fingerprints, neighbours, packing and secrets on small tables."""

import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, base_spans, copies, plain, redacted, sha, targets
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trafficlens.llm import catalog, fingerprint, language, mixing, neighbours, packing, quality, secrets_scan

TABLES = ["docs", "odd", "empty"]


def ordered(rows):
    return sorted(rows, key=repr)


def source_rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


# mixing


@pytest.mark.parametrize("table", TABLES)
def test_shares(request, table):
    df = request.getfixturevalue(table)
    given_ = source_rows(df)
    size = [len(WORD.findall(t or "")) for _, t, _ in given_]
    by = {}
    for (_, _, s), n in zip(given_, size, strict=True):
        by[s] = by.get(s, 0) + n
    target = targets(by) if by else {}
    expected = [
        (d, n, by[s], round(target[s], 6), c * n) for (d, _, s), n, c in zip(given_, size, copies(given_), strict=True)
    ]
    found = mixing.shares(df).select("doc_id", "size", "source_size", F.round("target", 6), "taken")
    assert ordered(map(tuple, found.collect())) == ordered(expected)
    assert all(t <= 2 * n for _, n, _, _, t in expected)


@pytest.mark.parametrize("table", TABLES)
def test_mix_repeats_whole_rows(request, table):
    df = request.getfixturevalue(table)
    given_ = source_rows(df)
    expected = [r for r, c in zip(given_, copies(given_), strict=True) for _ in range(c)]
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    assert ordered(source_rows(mixed)) == ordered(expected)


# language and quality


def test_language_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = catalog.op3_language(spark, "/root/testdata/sf0.01").join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert 0.25 < len(held) / len(found) < 0.42
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert all(0 <= r["score"] <= 1 for r in found)


@pytest.mark.parametrize("table", TABLES)
def test_language_odd_rows(request, table):
    df = request.getfixturevalue(table)
    found = language.identify(df).collect()
    assert len(found) == df.count()
    for r, t in [(r, t) for r in found for d, t in [(r["doc_id"], None)] if d in (0, 3, 6)]:
        assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    known = language.keep_known(df)
    assert known.columns == df.columns
    assert all(any(map(str.isalpha, r["text"] or "")) for r in known.collect())


def test_language_rejects_what_is_far_away(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(df)
    far = spark.createDataFrame([("丠丱 仧 仾 " * 30,), ("zzzqqq xkx wwjj " * 30,), (df.first()["text"],)], "text string")
    assert [r["rejected"] for r in language.predict(far, model).collect()] == [True, True, False]
    assert language.keep_known(df).count() >= 0.99 * df.count()


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. ",
    "Watu wote wamezaliwa huru, hadhi na haki zao ni sawa. Wote wamejaliwa akili na dhamiri, hivyo yapasa watendeane kindugu. ",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem. ",
]


@pytest.mark.parametrize("size", [400, 4000])
def test_language_rejects_foreign_latin_text_and_gibberish(spark, size):
    import base64
    import string

    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(df)
    r = random.Random(7)
    far = [(t * size)[:size] for t in FOREIGN]
    far += ["".join(r.choice(string.ascii_lowercase + " ") for _ in range(size)) for _ in range(3)]
    far += [base64.b64encode(r.randbytes(size)).decode()[:size] for _ in range(3)]
    found = language.predict(spark.createDataFrame([(t,) for t in far], "text string"), model).collect()
    assert [t["text"][:30] for t in found if not t["rejected"]] == []


def test_language_spares_short_clean_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(df.filter("doc_id % 2 = 0"))
    words = [r["text"].split() for r in df.filter("doc_id % 2 = 1").collect() if r["text"]]
    short = [(" ".join(w[len(w) // 2 :][:n]),) for w in words for n in (3, 8, 20, 60)]
    short = [t for t in short if any(map(str.isalpha, t[0]))]
    found = language.predict(spark.createDataFrame(short, "text string"), model)
    assert found.filter("rejected").count() <= 0.01 * len(short)


def test_sample_counts_copies_once(spark):
    rows = spark.range(20_000).selectExpr("concat('text ', id % 20) AS text", "'aa' AS lang")
    rows = rows.union(spark.range(300).selectExpr("concat('other ', id)", "'bb'"))
    found = [tuple(r) for r in language.sample_by_label(rows, "lang", 10).collect()]
    assert len(set(found)) == len(found)
    assert sorted(lang for _, lang in found) == ["aa"] * 10 + ["bb"] * 10
    everything = [tuple(r) for r in language.sample_by_label(rows, "lang", 400).collect()]
    assert len(set(everything)) == len(everything) == 320


def test_gram_counts_of_long_texts(monkeypatch):
    text = ("abc déf, xyz " * 500).encode()
    data = np.frombuffer(text, np.uint8)
    whole = language.gram_counts(data, np.array([0, len(data)]))
    monkeypatch.setattr(language, "STEP", 300)
    import pyarrow as pa

    (_, _, parts), = language.count_batches(pa.array([text.decode()]))
    assert abs(parts.sum() - whole.sum()) <= 2 * len(data) / 300 + 2  # a blank run may lie on a border


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = catalog.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r["quality"] == r["predicted"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)


@pytest.mark.parametrize("labelled", [0, 1, 2])
def test_quality_odd_rows(spark, odd, empty, labelled):
    values = [(0, 1, 0), (27, 0, 0), (30, 1, 0), (33, None, 0), (None, 1, 1)]
    labels = spark.createDataFrame([v for v in values if labelled == 2 or (labelled and v[1] == 1)], "doc_id long, quality int, toxic int")
    found = quality.quality_scores(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.quality_scores(empty, labels).count() == 0
    if not labelled:
        assert {r["score"] for r in found} == {0.5}


def test_factorisation_identity():
    """The linear-time score is the sum over all pairs of features."""
    r = np.random.default_rng(1)
    dim, data = quality.BUCKETS + quality.STATISTICS, np.frombuffer(b"Some words, and SOME more words!\n42", np.uint8)
    model = quality.Model(0.3, r.normal(size=dim), r.normal(size=(dim, 3)), np.zeros(quality.STATISTICS), np.ones(quality.STATISTICS))
    row, bucket, value, statistics = quality.features(data, np.array([0, len(data)]))
    x = np.zeros(dim)
    np.add.at(x, bucket, value)
    assert len(set(bucket)) == len(bucket)
    x[quality.BUCKETS :] = np.clip(statistics[0], -4, 4)
    on = np.flatnonzero(x)
    pairs = sum(model.factor[i] @ model.factor[j] * x[i] * x[j] for a, i in enumerate(on) for j in on[:a])
    assert np.isclose(model.margin(row, bucket, value, statistics)[0], 0.3 + model.weight @ x + pairs)


# fingerprints


@pytest.mark.parametrize("table", TABLES)
def test_fingerprints(request, table):
    df = request.getfixturevalue(table)
    given_ = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    found = fingerprint.fingerprints(df).collect()
    assert len(found) == len(given_)
    by_text = {}
    expected = {}
    ranked = sorted({d for d, _ in given_ if d is not None}, reverse=True)
    unique = len({d for d, _ in given_}) == len(given_)
    text = dict(given_)
    for i, d in enumerate(ranked):
        t, following = text[d], text[ranked[(i + 1) % len(ranked)]]
        expected[d] = (len(t), sha(t[: len(t) - len(t) // 2] + following[: len(t) // 2]))
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if unique:
            assert (r["n_chars"], r["edited_sha256"]) == expected[r["doc_id"]]
            assert by_text.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
    assert len(set(by_text.values())) == len(by_text)


def test_fingerprint_algebra(spark):
    parts = ["First line.", "second;", "thï, rd?", "4.", "x" * 3000 + "!"]
    df = spark.createDataFrame([("".join(parts), "".join(parts[::-1]), parts[1], "".join(parts[:1] + parts[2:]), "")], "t string, r string, p string, rest string, none string")
    v = {c: fingerprint.vector(fingerprint.hashes(F.col(c))) for c in df.columns}
    row = df.select(
        (v["t"] == v["r"]).alias("order"),
        (fingerprint.minus(v["t"], v["p"]) == v["rest"]).alias("deleted"),
        (fingerprint.plus(v["rest"], v["p"]) == v["t"]).alias("inserted"),
        (fingerprint.minus(v["p"], v["p"]) == v["none"]).alias("zero"),
        (v["t"] == v["rest"]).alias("other"),
        fingerprint.written(v["t"]).alias("text"),
    ).first()
    assert (row["order"], row["deleted"], row["inserted"], row["zero"], row["other"]) == (True, True, True, True, False)
    assert re.fullmatch("[0-9a-f]{592}", row["text"])


def test_fingerprint_likeness(spark):
    found = catalog.op6_fingerprint(spark, "/root/testdata/sf0.01").collect()
    edited, following = (sum(r[c] for r in found) / len(found) for c in ("near_edited", "near_next"))
    assert edited > 0.3 > 0.15 > following


def test_fingerprint_plan_is_native(spark):
    plan = catalog.op6_fingerprint(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapIn", plan)


# neighbours


def brute_nearest(rows, k):
    out = {}
    for a, x in rows:
        if a % 20 == 0:
            scores = sorted((-float((np.float64(x) * np.float64(y)).sum()), b) for b, y in rows if b != a and len(x) == len(y))
            out[a] = [b for _, b in scores[:k]]
    return out


@pytest.mark.parametrize(("shard", "block"), [(8192, 1024), (150, 4)])
def test_recall(spark, monkeypatch, shard, block):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    expected = brute_nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], 20)
    found = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found.keys() == expected.keys() and all(len(x) == 20 for x in found.values())
    assert sum(len(set(found[q]) & set(expected[q])) for q in expected) >= 0.9 * 20 * len(expected)


def test_search_of_a_large_shard_prunes_and_recalls():
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 32)) * 3
    x = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 32)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shard = neighbours.Shard(np.arange(4000), x, 10)
    best, score, verified = shard.search(x[:200], 10)
    exact = x[:200] @ shard.x.T
    top = np.argsort(-exact, axis=1)[:, :10]
    recall = np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(top, best, strict=True)])
    assert recall >= 0.9 and verified < 0.7 * 200 * 4000


@pytest.mark.parametrize("case", ["even", "uneven", "outlier", "two lengths", "long queries"])
@pytest.mark.parametrize("dim", [32, 64])
def test_recall_whatever_the_lengths(case, dim):
    r = np.random.default_rng(11)
    x = r.normal(size=(60, dim))[r.integers(0, 60, 4000)] + r.normal(size=(4000, dim)) * 0.7
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:200].copy()
    if case == "uneven":
        x *= np.exp(r.normal(size=(4000, 1)) * 0.5)
    if case == "outlier":
        x[300] *= 30
    if case == "two lengths":
        x[r.random(4000) < 0.5] *= 5
    if case == "long queries":
        q *= 10
    best, score, _ = neighbours.Shard(np.arange(4000), x, 20).search(q, 20)
    exact = np.sort(q @ x.T, axis=1)[:, ::-1][:, :20]
    assert (score[:, :20] >= exact[:, -1:] - 1e-9).mean() >= 0.98


def test_odd_vectors(spark):
    x = [1.0, 2.0, 0.5]
    rows = [(i, x) for i in range(0, 70)] + [(0, x), (100, None), (101, []), (102, [0.0, 0.0, 0.0]), (103, [1.0, None, 2.0])]
    rows += [(120, [float("nan"), 1.0, 1.0]), (140, [float("inf"), 1.0, 1.0]), (None, x), (160, [1.0, 1.0]), (161, [-1.0, 3.0])]
    df = spark.createDataFrame([(a, b, 1, "e") for a, b in rows], "vec_id long, embedding array<float>, id int, score string")
    found = {}
    for r in neighbours.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == {0, 20, 40, 60, 160}
    assert found[160] == [(1, 161, 2.0)]
    for q in (0, 20, 40, 60):
        assert found[q] == [(i + 1, v, 5.25) for i, v in enumerate([v for v in range(22) if v != q][:20])]
    assert neighbours.nearest(df.limit(0), F.col("id") % 20 == 0).count() == 0



def clustered_vectors(n, dim=32, clusters=60):
    r = np.random.default_rng(17)
    centre = r.normal(size=(clusters, dim))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    return centre[r.integers(0, clusters, n)] + 0.01 * r.normal(size=(n, dim))


@pytest.mark.parametrize("kind", ["clustered", "long one", "spread"])
def test_regions_over_the_table_find_the_nearest(spark, kind):
    x = np.random.default_rng(3).normal(size=(3000, 32)) if kind == "spread" else clustered_vectors(3000)
    if kind == "long one":
        x[7] *= 30
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, F.col("id") % 20 == 0, shard=200, sample=500).collect()}
    score = x[::20] @ x.T
    score[np.arange(len(score)), np.arange(0, 3000, 20)] = -np.inf
    want = {(20 * i, int(j)) for i, s in enumerate(score) for j in np.argsort(-s)[:20]}
    assert len(found) == len(want) and len(found & want) >= 0.97 * len(want)
    exact = {(r["query_id"], r["vec_id"]) for r in neighbours.nearest(df, F.col("id") % 20 == 0, sure=1.0, shard=200).collect()}
    assert exact == want


def test_most_regions_are_skipped_where_vectors_cluster(spark):
    x = clustered_vectors(8000)
    points = neighbours.points_of(x)
    regions = neighbours.Regions(points[::4], 6)
    of = regions.of(points)
    assert set(range(64)) >= set(of.tolist()) and np.bincount(of, minlength=64).max() <= 4 * 8000 / 64
    number = np.unique(of)
    regions.bounded([(r, points[of == r, :-1].min(axis=0), points[of == r, :-1].max(axis=0), points[of == r, -1].max()) for r in number])
    least = np.sort(x[:200] @ x.T, axis=1)[:, -21]
    assert (regions.held(x[:200], neighbours.SURE) >= least[:, None]).mean() < 0.2
    rows = [(i, 32, i, v.tolist(), float(s)) for i, (v, s) in enumerate(zip(x[:200], least, strict=True))]
    asked = spark.createDataFrame(rows, "id long, dim int, v1 long, vector array<double>, least double")
    first = neighbours.sent(asked, {32: regions}, neighbours.SURE, True).count()
    second = neighbours.sent(asked, {32: regions}, neighbours.SURE, False).count()
    assert first == 200 and second < 0.2 * 200 * len(number)


def test_a_vector_that_most_rows_hold_is_searched_once(spark):
    x = clustered_vectors(300).tolist()
    x[0] = [2 * v for v in x[0]]
    rows = [(i, x[0] if i % 2 else x[i]) for i in range(300)] + [(1, x[0])] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(df, F.col("id") % 20 == 0, k=3).collect()
    assert len(found) == 15 * 3
    same = [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 0]
    assert same == [1, 3, 5]


def test_chi_square():
    x = np.random.default_rng(0).chisquare(8, 200_000)
    for t in (1.0, 4.0, 7.3, 15.0):
        assert abs(neighbours.chi_square(np.array([t]))[0] - (x <= t).mean()) < 0.005


# packing


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("length", [2048, 64])
def test_packing_round_trip(request, table, length):
    df = request.getfixturevalue(table)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary())
    ids = {}
    for r in df.collect():
        x = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        ids.setdefault(r["doc_id"], []).append(x)
    found = packing.pack(df, length=length).collect()
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    expected = {}
    for d, lists in ids.items():
        for x in lists:
            for a in range(0, len(x), length):
                part = x[a : a + length]
                expected.setdefault(d, []).append((a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(x)))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in expected.items()}
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length


def test_padding_is_small(spark):
    found = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    total, sequences = found.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    assert sequences * packing.LENGTH <= 1.02 * total


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=25))
def test_shortest_pack_first(histogram):
    packs = packing.shortest_pack_first(histogram, 40)
    placed = {}
    for pattern, n in packs:
        assert n > 0 and sum(pattern) <= 40
        for size in pattern:
            placed[size] = placed.get(size, 0) + n
    assert placed == histogram


def test_word_cache_changes_no_id():
    encoder = packing.Encoder(packing.vocabulary())
    r = random.Random(1)
    odd = ["Don't, we'll;'s a,'s", "É,é. … a…,b!!x's", "<|ENDOFTEXT|> a<|endoftext|>b <|x", "a\x1cb\x85c\xa0d İIſ Kk Σ ΑΣ a̸≮", "", "x_y-z/1.2,3a4 [q]{r}~^`"]
    odd += ["".join(r.choice("abÉB'.,!<|é \n\t1_́…") for _ in range(40)) for _ in range(800)]
    expected = encoder.whole(odd)
    found = list(encoder(pa.array(odd)))
    assert len(found) == len(expected) and all(np.array_equal(x, y) for x, y in zip(found, expected, strict=True))


# secrets


@pytest.mark.parametrize("table", TABLES)
def test_secrets(request, table):
    df = request.getfixturevalue(table)
    expected = []
    for r in df.collect():
        spans = base_spans(r["text"])
        kinds = [k for *_, k in spans]
        expected.append((r["doc_id"], *(kinds.count(k) for k in secrets_scan.BASE), sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))))
    found = secrets_scan.secret_spans(df)
    assert ordered(map(tuple, found.drop("spans").collect())) == ordered(expected)
    left = secrets_scan.redact(df)
    assert left.columns == df.columns
    want = [(a, redacted(t), b, c, n if redacted(t) == t else len(redacted(t))) for a, t, b, c, n in plain(df)]
    assert ordered(plain(left)) == ordered(want)


def test_dropped_matches_use_up_their_text(spark):
    texts = ["token: secret: abcdefghij", "PASSWD='12345678'", "api-key=abcdefgh", "apikey : \"abcdefgh\"", "0123456789abcdef" * 2 + "g", "ſecret=abcdefgh", "AKIA" + "A" * 11]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets_scan.secret_spans(df).collect()}
    assert found == {i: ",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t)) for i, t in enumerate(texts)}


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([p for _, p, _, _ in secrets_scan.RULES] + [r"a(b|cd)?e{2,3}fgh|xyz[0-9]w", r"(abc|de)+f\d?ghi", r"x.?yzab*cde"]), st.data())
def test_trigram_queries_lose_nothing(pattern, data):
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=False))
    assert holds(secrets_scan.trigram_query(pattern), text)


def test_trigram_queries_are_mandatory_where_they_can_be():
    queries = {k: secrets_scan.trigram_query(p) for k, p, _, _ in secrets_scan.RULES}
    assert [k for k, q in queries.items() if q is True] == ["hex"]
    assert not holds(queries["assign"], "nothing to see") and holds(queries["assign"], "my API_Key=1")
