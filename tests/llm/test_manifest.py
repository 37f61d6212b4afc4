"""Decontamination, fill-in-the-middle and the Merkle manifest next to plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import contaminated, fill_middle as cut, longest, merkle as trees, plain, sha
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from trafficlens.llm import catalog, decontaminate, fill_middle, merkle

TABLES = ["docs", "odd", "empty"]


def ordered(rows):
    return sorted(rows, key=repr)


@pytest.fixture(scope="session")
def items(rows):
    """Passages of the documents, short items, items without words, repeated and nameless ones."""
    words = rows[12][1].split()
    out = [("a", " ".join(words[25:60])), ("b", " ".join(words[40:48])), ("10", "ONE two, three FOUR"), ("9", "three four"), ("c", "no such thing here at all")]
    out += [("d", None), ("e", " .,! "), ("b", " ".join(words[40:48])), ("b", " ".join(words[30:52])), (None, " ".join(words[28:45])), (None, "one")]
    out += [("long", rows[11][1]), ("x", "x" * 900), ("é", "über stra")]
    return out


@pytest.fixture(scope="session")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))


# decontamination


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize(("window", "shard", "part"), [(10, 4 << 20, 8 << 20), (10, 2000, 300), (3, 500, 8 << 20)])
def test_hits(request, monkeypatch, benchmark, items, table, window, shard, part):
    monkeypatch.setattr(decontaminate, "CHAIN", 2)
    df = request.getfixturevalue(table)
    given_rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    expected = [
        (d, n, len(hit), sorted(names), without)
        for (d, _), (n, hit, names, without) in zip(given_rows, contaminated([t for _, t in given_rows], items, window), strict=True)
    ]
    found = decontaminate.hits(df, benchmark, window, shard_bytes=shard, part_bytes=part)
    assert ordered((r["doc_id"], r["n_words"], r["n"], r["items"], r["nameless"]) for r in found.withColumn("n", decontaminate.n_hit(F.col("spans"))).collect()) == ordered(expected)


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize(("shard", "part"), [(4 << 20, 8 << 20), (2000, 300)])
def test_contaminated_documents_go(request, benchmark, items, table, shard, part):
    df = request.getfixturevalue(table)
    left = decontaminate.remove_contaminated(df, benchmark, shard_bytes=shard, part_bytes=part)
    assert left.schema == df.schema
    rows_ = df.collect()
    marks = contaminated([r["text"] for r in rows_], items)
    assert ordered(map(tuple, left.collect())) == ordered(tuple(r) for r, (_, hit, _, _) in zip(rows_, marks, strict=True) if not hit)


def test_empty_benchmark_leaves_all_clean(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_contaminated(docs, none).count() == docs.count()
    assert decontaminate.hits(docs, none).filter("size(spans) > 0 OR size(items) > 0").isEmpty()


@pytest.mark.parametrize(("shard", "part"), [(4 << 20, 8 << 20), (3000, 300)])
def test_longest_matches(docs, rows, benchmark, items, shard, part):
    texts = [r[1] for r in rows]
    named = {(None if k is None else k, t) for k, t in items}
    expected = {}
    for item in named:
        for (name, j), (n, places) in longest(texts, [item], 4).items():
            expected[name, item[1], j] = (n, {(rows[d][0], p) for d, p in places})
    found = decontaminate.longest_matches(docs, benchmark, 4, shard_bytes=shard, part_bytes=part).collect()
    assert len(found) == len(expected)
    pool = {}
    for (name, _, j), (n, places) in expected.items():
        pool.setdefault((name, j, n), []).append(places)
    for r in found:
        options = pool[r["item_id"], r["item_word"], r["length"]]
        assert any((r["doc_id"], r["doc_word"]) in places for places in options)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), max_size=8), st.integers(1, 20))
def test_suffix_array_orders_to_its_depth(texts, depth):
    word = np.array([w for t in texts for w in [*(x + 1 for x in t), 0]], np.uint64)
    got = decontaminate.suffix_array(word, depth)
    assert sorted(got.tolist()) == list(range(len(word)))
    ends = np.flatnonzero(word == 0)

    def suffix(i):
        return word[i : ends[np.searchsorted(ends, i)]].tolist()[:depth]

    assert [suffix(i) for i in got] == sorted(map(suffix, range(len(word))))


def test_a_word_that_only_hashes_alike_is_no_hit(monkeypatch):
    items_ = decontaminate.Items(["a"], ["red green blue"], 3)
    plain_hash = decontaminate.hashes_of

    def colliding(words, lane=0):
        out = plain_hash(words, lane).copy()
        for i, (a, b) in enumerate(zip(words.begin, words.end, strict=True)):
            if words.data[a:b].tobytes() == b"gr33n":
                out[i] = items_.word[1]
        return out

    monkeypatch.setattr(decontaminate, "hashes_of", colliding)
    words = decontaminate.words_of(pa.array(["red gr33n blue", "so red green blue gr33n"]))
    mask, doc, _, _ = decontaminate.Shard(words, items_.lane, items_.longest).hits(items_)
    assert mask.tolist() == [False] * 3 + [False, True, True, True, False] and doc.tolist() == [1]


def test_a_text_of_several_megabytes(spark):
    r = random.Random(3)
    words = [f"w{r.randint(0, 10**5)}" for _ in range(700_000)]
    items_ = [(1, " ".join(words[500_000:500_030]))]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "short")], "doc_id long, text string")
    found = decontaminate.hits(df, spark.createDataFrame(items_, "item_id long, text string"), shard_bytes=1 << 20).orderBy("doc_id").collect()
    assert [(x["n_words"], [tuple(s) for s in x["spans"]], x["items"]) for x in found] == [(700_000, [(500_000, 500_030)], ["1"]), (1, [], [])]


# fill-in-the-middle


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("piece", [fill_middle.PIECE, 7])
def test_forms(spark, request, monkeypatch, table, piece):
    df = request.getfixturevalue(table)
    marked = df.limit(1).select(F.lit(4).cast("long").alias("doc_id"), F.lit("a <P> b").alias("text"))
    df = df.select("doc_id", "text").union(marked)
    found = fill_middle.transform(df, piece=piece)
    expected = [(r["doc_id"], *cut(r["doc_id"], r["text"])) for r in df.collect()]
    assert ordered(map(tuple, found.collect())) == ordered(expected)
    back = found.select("doc_id", fill_middle.restore(F.col("output"), F.col("form")).alias("text")).collect()
    assert ordered(map(tuple, back)) == ordered((r["doc_id"], r["text"] or "") for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab\né<>PSM𝄞"), max_size=30), st.integers(0, 2**32 - 1), st.integers(0, 2**32 - 1), st.integers(1, 9))
def test_pieces_cut_like_one_match(text, first, second, piece):
    whole, pieces = fill_middle.Units(), fill_middle.Units(piece=piece)
    assert whole.cuts(text, first, second) == pieces.cuts(text, first, second)


def test_units_may_be_words_or_lines():
    units = fill_middle.Units(r"\s*\S+\s*")
    n, (a, i), (b, j) = units.cuts("one two  three four", 1, 3)
    assert (n, a, i, b, j) == (4, 1, 4, 3, 15)
    assert fill_middle.Units("a").cuts("aab", 0, 1) is None
    assert fill_middle.transformed("aab", "1", 1, fill_middle.Units("a"), 0, 0)[:2] == (0, "plain")


def test_very_long_text(spark):
    text = "é\n𝄞x" * 400_000
    for key in range(12):
        found = fill_middle.transformed(text, str(key), 1, fill_middle.Units(), 10, 20)
        assert found == cut(key, text)


# Merkle manifest


@pytest.mark.parametrize("table", TABLES)
def test_manifest(spark, request, tmp_path, table):
    df = request.getfixturevalue(table)
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalog.op13_merkle(spark, str(tmp_path)).collect()
    expected = [(r[0], leaf, top, root, sha(proof), folded, folded == root) for r, leaf, top, root, proof, folded in trees(plain(df))]
    assert ordered(map(tuple, found)) == ordered(expected)


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [257, 1, 33], [2] * 40, [5000, 3]])
def test_tree_shapes(spark, sizes):
    rows_ = [(i, f"Text {i}", None, f"s{k:03d}", i) for i, k in enumerate(k for k, n in enumerate(sizes) for _ in range(n))]
    df = spark.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long")
    found = merkle.proofs(df, merkle.tampered())
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("proof"), merkle.fold(F.coalesce("claim", "leaf"), F.col("path")).alias("folded"))
    expected = [(r[0], *rest) for r, *rest in trees(rows_)]
    assert ordered(map(tuple, found.collect())) == ordered(expected)
    assert len({x[3] for x in expected}) == 1


def test_any_changed_field_is_noticed(spark, docs):
    for column, value in (("lang", F.lit("zz")), ("n_chars", F.lit(-1)), ("text", F.concat(F.coalesce("text", F.lit("")), F.lit(".")))):
        claim = merkle.digest(*[value if c == column else F.col(c) for c in merkle.FIELDS])
        found = merkle.proofs(docs, claim)
        assert found.filter(merkle.fold(F.col("claim"), F.col("path")) == F.col("root")).isEmpty()
        assert found.filter(merkle.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
