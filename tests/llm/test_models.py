"""Classifiers next to plain versions of them, from the same fitted model."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from brute import WORD
from pyspark.sql import functions as F

from trafficlens.llm import language, quality
from trafficlens.llm.words import mixed


def grams(text):
    """Counts of one to three bytes of letters; a run of all else is one blank, which alone counts for nothing."""
    low = re.sub("[À-ÖØ-Þ]", lambda m: m[0].lower(), text).encode()
    low = re.sub(rb"[^a-z\x80-\xff]+", b" ", bytes(c + 32 if 65 <= c <= 90 else c for c in low))
    return Counter(low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1) if low[i : i + n] != b" ")


def plain_language(text, model):
    """(lang_pred, score, rejected) by comparing with one centroid after the other."""
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0, True
    x = np.zeros(language.BUCKETS)
    for gram, n in grams(text).items():
        code = np.array([int.from_bytes(gram, "big") | len(gram) << 40], np.uint64)
        x[int(mixed(code)[0]) % language.BUCKETS] += n
    kind = int(2 * math.log2(max(np.count_nonzero(x), 1)))
    x = np.log1p(x) * model.idf
    x /= max(math.sqrt(sum(v * v for v in x)), 1e-12)
    cosines = [float(sum(a * b for a, b in zip(x, c, strict=True) if a)) for c in model.centroids]
    best = max(range(len(cosines)), key=lambda i: (cosines[i], -i))
    return model.languages[model.language[best]], min(max(cosines[best], 0), 1), cosines[best] < model.least[kind]


def test_language_is_the_nearest_centroid(spark, docs, sf):
    given = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(given.unionByName(docs.select("doc_id", "text", "lang")))
    table = docs.select("doc_id", "text").unionByName(given.select("doc_id", "text").limit(60))
    for r in language.predict(table, model).collect():
        lang, score, rejected = plain_language(r["text"], model)
        assert abs(r["score"] - score) < 1e-4
        assert (r["lang_pred"], r["rejected"]) == (lang, rejected) or abs(score - model.least).min() < 1e-4


def test_language_learns_from_every_text(spark):
    """One centroid a language is the unit mean of all its texts, and their lowest hundredth sets the limits."""
    r = random.Random(3)
    texts = [("".join(r.choice("abcdefgh ") for _ in range(60)), ("aa", "bb")[i % 2]) for i in range(1300)]
    texts += [("".join(r.choice("opqrstuv ") for _ in range(60)), "aa") for _ in range(300)] + [("a " * 900 + "xyz", "bb")]
    model = language.fit(spark.createDataFrame(texts, "text string, lang string").repartition(5), k=1)
    counts = np.vstack([c for _, _, c in language.count_batches(pa.array([t for t, _ in texts]))])
    assert np.array_equal(language.unpacked(language.packed(counts)), counts)
    assert np.allclose(model.idf, np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))) + 1, atol=1e-5)
    x = language.vectors(counts, model.idf)
    assert np.allclose(language.unpacked(language.packed(counts), model.idf), x, atol=1e-6)
    for i, lang in enumerate(model.languages):
        mean = x[[v == lang for _, v in texts]].sum(axis=0)
        assert np.allclose(model.centroids[i], mean / np.linalg.norm(mean), atol=1e-5)
    kinds, near = language.length_class(counts[:1600]), (x[:1600] @ model.centroids.T).max(axis=1)
    kind = np.bincount(kinds).argmax()
    parts = [s for t, _ in texts for s in language.stretches(language.window(t.encode()))]
    for _, _, c in language.count_batches(pa.array(parts, pa.binary())):
        kinds = np.append(kinds, language.length_class(c))
        near = np.append(near, (language.vectors(c, model.idf) @ model.centroids.T).max(axis=1))
    assert abs(model.least[kind] - language.SLACK * np.quantile(near[kinds == kind], language.LOW)) < 1e-3


def test_language_of_a_text_does_not_depend_on_its_neighbours():
    texts = ["one sentence.", "  another one", "¿qué?", "", "42 birds ", " 7 more", None, "straße"]
    alone = np.vstack([language.gram_counts(*language.as_bytes(pa.array([t], pa.string()))) for t in texts])
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        order = list(order)
        together = language.gram_counts(*language.as_bytes(pa.array([texts[i] for i in order], pa.string())))
        assert np.array_equal(together, alone[order])


def statistics(text):
    """The structure of a text, counted in plain Python."""
    data, words = text.encode(), [w.encode() for w in WORD.findall(text)]
    n, m = max(len(data), 1), max(len(words), 1)
    capital, digit, stop = set(range(65, 91)), set(range(48, 58)), {46, 44}
    mark = set(range(33, 127)) - capital - digit - set(range(97, 123))
    lengths = [len(w) for w in words]
    mean = sum(lengths) / m
    marked = [w for w in words if w[-1] in mark - stop]
    share = lambda some: sum(c in some for c in data) / n
    return [
        math.log1p(len(data)), math.log1p(len(words)), share(capital), share(digit), share(mark - stop), 10 * share(stop),
        10 * share({10}), share(set(range(128, 256))), mean, math.sqrt(max(sum(x * x for x in lengths) / m - mean**2, 0)),
        len(marked) / m, sum(len(w) == 1 for w in marked) / m, sum(len(w) > 1 and w[0] in capital and w[1] in capital for w in words) / m,
    ]


def test_quality_is_the_plain_score(spark, docs):
    """Statistics, words and score of each text by itself; the machine's pairs are summed one by one."""
    r = np.random.default_rng(3)
    dim = quality.BUCKETS + quality.STATISTICS
    model = quality.Model(
        -0.2, r.normal(size=dim) / 9, r.normal(size=(dim, 2)) / 9, r.normal(size=quality.STATISTICS), r.uniform(0.5, 2, quality.STATISTICS)
    )
    for row in quality.score(docs.select("doc_id", "text"), model).collect():
        text = row["text"] or ""
        data = np.frombuffer(text.encode(), np.uint8)
        _, bucket, value, found = quality.features(data, np.array([0, len(data)]))
        words = Counter(w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(text))
        norm = math.sqrt(sum(math.log1p(n) ** 2 for n in words.values()))
        assert np.allclose(sorted(value), sorted(math.log1p(n) / norm for n in words.values()))
        assert np.allclose(found[0], [*statistics(text), len(words) / max(sum(words.values()), 1)])
        x = np.zeros((len(bucket) + quality.STATISTICS, 3))
        where = [*bucket, *range(quality.BUCKETS, dim)]
        for i, v in enumerate([*value, *np.clip((found[0] - model.mean) / model.spread, -4, 4)]):
            x[i] = [model.weight[where[i]] * v, *(model.factor[where[i]] * v)]
        margin, before = model.bias, np.zeros(2)
        for linear, *factor in x:
            margin += linear + before @ np.array(factor)
            before += factor
        assert abs(row["score"] - 1 / (1 + math.exp(-min(max(margin, -30), 30)))) < 1e-6


def test_an_id_of_several_texts_is_learnt_the_same_way(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    other = docs.withColumn("text", F.concat(F.reverse("text"), F.lit(" x"))).unionByName(docs.withColumn("text", F.lit(None).cast("string")))
    both = docs.unionByName(other)
    found = [
        sorted(tuple(r)[::2] for r in quality.quality_scores(df, labels).select("doc_id", "held_out", "score").collect())
        for df in (both.repartition(7), both.orderBy(F.desc("doc_id"), "text").coalesce(2))
    ]
    assert len(found[0]) == 600 and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(*found, strict=True))
