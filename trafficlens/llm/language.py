"""Language identification by the nearest centroid.

A text is the TF-IDF vector of its hashed byte n-grams (one to three bytes; letters in lower case,
bytes of longer characters as they are, everything else a blank), with unit length. Document
frequencies come from all training texts. The centroids are spherical k-means clusters within each
language, fitted on all labelled texts: their n-gram counts are written once, and each round of k-means is
a pass over them. A text gets the language of the centroid with the largest cosine.
It is rejected when it has no letters or is too far from every centroid for its length: its cosine
is below ``SLACK`` times the lowest hundredth of the training texts' cosines in its class of length (counted
in steps of 1/``LEVELS``). Length
is the number of different n-grams, so that a text that repeats a word counts as short; a class
spans a factor of sqrt(2). All training texts and stretches of 8 to 2,048 bytes of them fill the
classes; a class of fewer than ``FEW`` takes the limit of the class below, the shortest have none.
Training rows that repeat count as often as they come.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and rejected; rows with
a null language or text are no training rows; without training rows every text is ``und``. Rows
that repeat are predicted each by itself; equal cosines go to the first centroid in the order of the languages;
very long texts are counted whole, in stretches; an empty table gives no rows. Only doc_id, text and (to learn) lang are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..session import keep
from .words import as_bytes, mixed, runs

BUCKETS = 1 << 12
LONGEST = 3
CLUSTERS = 4
SLACK = 0.6
LOW = 0.01
LEVELS = 10_000
FEW = 50
STRETCHES = [1 << k for k in range(3, 12)]
#: Labels that a table may have; more is an error, as each has centroids.
MOST_LABELS = 1000
STEP = 1 << 20
UNKNOWN = "und"
#: Sums over tasks are of whole multiples of this, so their order does not matter.
UNIT = 2.0**-30


def _letters() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


LETTERS = _letters()


def _folded(data: np.ndarray) -> np.ndarray:
    """Bytes for n-grams; capitals of Latin-1 become small too (C3 80..9E -> C3 A0..BE)."""
    out = LETTERS[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    out[after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]] += 0x20
    return out


def gram_counts(data: np.ndarray, at: np.ndarray, begin_before: int | None = None) -> np.ndarray:
    """Texts x buckets: how often each hashed n-gram occurs; a run of blanks counts as one."""
    n = len(at) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    low = _folded(data)
    kept = np.ones(len(low), bool)
    kept[1:] = (low[1:] != 32) | (low[:-1] != 32)
    kept[at[:-1][at[:-1] < len(low)]] = True  # whatever the text before ends with
    if begin_before is not None:
        begin_before = int(np.count_nonzero(kept[:begin_before]))
    text = np.repeat(np.arange(n), np.diff(at))[kept]
    low = low[kept].astype(np.uint32)
    code = low
    for size in range(1, LONGEST + 1):
        if size > 1:
            code = code[:-1] << 8 | low[size - 1 :]
        if not len(code):
            break
        first = text[: len(code)]
        inside = first == text[size - 1 :] if size > 1 else low != 32
        inside = np.flatnonzero(inside[:begin_before])
        bucket = mixed(code[inside].astype(np.uint64) | np.uint64(size << 40)) % np.uint64(BUCKETS)
        at_ = first[inside] * BUCKETS + bucket.astype(np.int64)
        out += np.bincount(at_, minlength=n * BUCKETS).reshape(n, BUCKETS)
    return out


def count_batches(column) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, last, counts) over the texts of a column, about a megabyte at a time."""
    data, at = as_bytes(column)
    for lo, hi in runs(at, STEP):
        for i in range(lo, hi, 128):
            j = min(hi, i + 128)
            size = int(at[j] - at[i])
            if size <= 4 * STEP or j > i + 1:
                yield i, j, gram_counts(data[at[i] : at[j]], at[i : j + 1] - at[i])
                continue
            counts = np.zeros((1, BUCKETS), np.float32)  # one very long text, in overlapping stretches
            for a in range(0, size, STEP):
                part = data[at[i] + a : min(at[j], at[i] + a + STEP + LONGEST - 1)]
                counts += gram_counts(part, np.array([0, len(part)]), STEP)
            yield i, j, counts


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF vectors; a zero vector stays zero."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def length_class(counts: np.ndarray) -> np.ndarray:
    """Half octaves of the number of different n-grams."""
    return (2 * np.log2(np.maximum(np.count_nonzero(counts, axis=1), 1))).astype(int)


CLASSES = int(length_class(np.ones((1, BUCKETS)))[0]) + 1


def window(text: bytes) -> bytes:
    """The part of a text that its stretches are cut from, at a place that depends on the text."""
    a = zlib.crc32(text) % max(len(text) - STRETCHES[-1] + 1, 1)
    return text[a : a + STRETCHES[-1]]


def stretches(text: bytes) -> list[bytes]:
    """A stretch of each size that is shorter than the text."""
    places = [(n, zlib.crc32(text, n) % (len(text) - n + 1)) for n in STRETCHES if n < len(text)]
    return [text[a : a + n] for n, a in places]


def limits(found: np.ndarray) -> np.ndarray:
    """The least cosine of each class of length that is not rejected; ``found`` counts class x level."""
    out = np.zeros(CLASSES)
    for c in range(CLASSES):
        n = int(found[c].sum())
        low = np.searchsorted(np.cumsum(found[c]), int(LOW * (n - 1)), side="right") if n >= FEW else 0
        out[c] = SLACK * low / LEVELS if n >= FEW else out[max(c - 1, 0)]
    return out


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # clusters x buckets
    language: np.ndarray  # number of each centroid's language
    least: np.ndarray  # cosine below which a text is rejected, by class of length


def packed(counts: np.ndarray) -> list[bytes]:
    """Each row of counts as a bitmap of its buckets and their counts, a byte each where all are below 256."""
    bits = np.packbits(counts > 0, axis=1)
    out = []
    for row, mask in zip(counts, bits, strict=True):
        n = row[row > 0]
        out.append(mask.tobytes() + n.astype(np.uint8 if n.max(initial=0) < 256 else np.uint32).tobytes())
    return out


def unpacked(values: list[bytes], idf: np.ndarray | None = None) -> np.ndarray:
    """The counts again, texts x buckets; with ``idf`` their unit TF-IDF vectors."""
    size = BUCKETS // 8
    there = np.unpackbits(np.frombuffer(b"".join(v[:size] for v in values), np.uint8)).reshape(-1, BUCKETS).view(bool)
    each = np.count_nonzero(there, axis=1)
    found = [np.frombuffer(v, np.uint8 if len(v) - size == n else np.uint32, offset=size) for v, n in zip(values, each.tolist(), strict=True)]
    out = np.zeros(there.shape, np.float32)
    if not found:
        return out
    n = np.concatenate(found).astype(np.float32)
    if idf is not None:
        text, bucket = np.divmod(np.flatnonzero(there), BUCKETS)
        n = np.log1p(n) * idf[bucket]
        n /= np.maximum(np.sqrt(np.bincount(text, n * n, len(values))), 1e-12).astype(np.float32)[text]
    out[there] = n
    return out


def counted(rows: DataFrame) -> DataFrame:
    """(lang, counts) of (text, lang) rows, written once."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, counts in count_batches(batch.column("text")):
                columns = [batch.column("lang").slice(i, j - i), pa.array(packed(counts), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "counts"])

    return keep(rows.select("text", "lang").mapInArrow(run, "lang string, counts binary"), "gram-counts")


def count_parts(batch: pa.RecordBatch, idf: np.ndarray | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """(languages, counts or vectors) of a batch of ``counted``, few texts at a time."""
    for i in range(0, batch.num_rows, 128):
        part = batch.slice(i, 128)
        yield part.column("lang").to_pylist(), unpacked(part.column("counts").to_pylist(), idf)


def document_frequency(table: DataFrame) -> tuple[int, np.ndarray]:
    """(texts, texts that hold each bucket) over all rows; each task sends one row per bucket."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in it:
            for langs, counts in count_parts(batch):
                total[0] += len(langs)
                total[1:] += (counts > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(total)], names=["bucket", "n"])

    sums = table.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n"))
    total = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in sums.collect():
        total[bucket] = n
    return int(total[0]), total[1:]


def sample_by_label(rows: DataFrame, label: str, most: int) -> DataFrame:
    """At most ``most`` different rows of each label: those with the smallest hashes of the whole row.

    Copies count once. Only hashes are ranked: a first cut leaves about twice as many, so that no
    task ranks a whole label. A task then sends each row that was picked once.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    different = keep(hashed.select(label, "_hash").distinct(), "sample_hashes")
    counts = different.groupBy(label).count().limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return rows
    part = F.create_map(*[F.lit(x) for value, n in counts for x in (value, min(1.0, (2 * most + 50) / n))])
    near = different.filter(F.pmod("_hash", F.lit(1 << 30)) < part[F.col(label)] * float(1 << 30))
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.pmod("_hash", F.lit(1 << 30)), "_hash"))
    picked = np.array([h for (h,) in near.withColumn("_place", place).filter(F.col("_place") <= most).select("_hash").collect()], np.int64)

    def once(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = picked
        for batch in it:
            hashes = batch.column("_hash").to_numpy()
            at = np.flatnonzero(np.isin(hashes, left))
            at = at[np.unique(hashes[at], return_index=True)[1]]
            left = np.setdiff1d(left, hashes[at])
            yield batch.take(pa.array(at))

    return hashed.mapInArrow(once, hashed.schema).dropDuplicates(["_hash"]).select(*rows.columns)


def own_cosines(x: np.ndarray, langs: np.ndarray, centres: np.ndarray, language: np.ndarray) -> np.ndarray:
    """Cosines with the centroids of each text's own language; -2 for the others."""
    return np.where(langs[:, None] == language[None, :], x @ centres.T, -2.0)


def means(table: DataFrame, idf: np.ndarray, number: dict[str, int], centres: np.ndarray | None, language: np.ndarray) -> dict[int, np.ndarray]:
    """The unit mean of the texts next to each centroid; without centroids, of each language."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in it:
            for names, x in count_parts(batch, idf):
                own = np.array([number[v] for v in names])
                if centres is not None:
                    own = np.argmax(own_cosines(x, own, centres, language), axis=1)
                present = np.unique(own)
                for c, total in zip(present.tolist(), (own == present[:, None]).astype(np.float32) @ x, strict=True):
                    sums[c] = sums.get(c, 0) + total.astype(np.float64)
        data = [np.rint(v / UNIT).astype(np.int64).tobytes() for v in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(data, pa.binary())], names=["cluster", "total"])

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS, np.int64)
        for v in part["total"]:
            total += np.frombuffer(v.as_py(), np.int64)
        return pa.table({"cluster": part["cluster"].slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "cluster bigint, total binary"
    found = {c: np.frombuffer(bytes(v), np.int64) * UNIT for c, v in table.mapInArrow(run, schema).groupBy("cluster").applyInArrow(add, schema).collect()}
    return {c: (m / np.linalg.norm(m)).astype(np.float32) for c, m in found.items() if m.any()}


def farthest(table: DataFrame, idf: np.ndarray, number: dict[str, int], centres: np.ndarray, language: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(language, vector) of the text of each language that is farthest from the centroids, if it is not one of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[float, bytes]] = {}
        for batch in it:
            for names, x in count_parts(batch, idf):
                langs = np.array([number[v] for v in names])
                near = own_cosines(x, langs, centres, language).max(axis=1)
                near[~x.any(axis=1)] = 2.0
                for c in np.unique(langs).tolist():
                    mine = np.flatnonzero(langs == c)
                    i = mine[np.argmin(near[mine])]
                    least[c] = min(least.get(c, (2.0, b"")), (float(near[i]), x[i].astype(np.float32).tobytes()))
        columns = [pa.array(list(least), pa.int64()), pa.array([n for n, _ in least.values()]), pa.array([v for _, v in least.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays([columns[0], columns[1].cast(pa.float64()), columns[2]], names=["lang", "near", "x"])

    found = table.mapInArrow(run, "lang bigint, near double, x binary").groupBy("lang").agg(F.min(F.struct("near", "x")).alias("m"))
    return sorted(((c, np.frombuffer(bytes(m["x"]), np.float32)) for c, m in found.collect() if m["near"] < 1 - 1e-6), key=lambda v: v[0])


def clusters(table: DataFrame, idf: np.ndarray, number: dict[str, int], k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means within each language over all its texts: (centroids, the number of each one's language).

    Starts from the mean, then from the vectors that are farthest away.
    """
    start = sorted(means(table, idf, number, None, np.zeros(0, int)).items())
    if not start:
        return np.zeros((0, BUCKETS), np.float32), np.zeros(0, int)
    for _ in range(k - 1):
        more = farthest(table, idf, number, np.stack([v for _, v in start]), np.array([c for c, _ in start]))
        if not more:
            break
        start += more
    start.sort(key=lambda v: v[0])
    centres, language = np.stack([v for _, v in start]), np.array([c for c, _ in start])
    for _ in range(rounds):
        before = centres.copy()
        for c, m in means(table, idf, number, before, language).items():
            centres[c] = m
        if np.array_equal(centres, before):
            break
    return centres, language


def cosine_counts(rows: DataFrame, column: str, take, idf: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Class of length x level of the cosine with the nearest centroid: how many of the texts that ``take`` gives."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * (LEVELS + 1), np.int64)
        for batch in it:
            for counts in take(batch):
                near = (vectors(counts, idf) @ centres.T).max(axis=1)
                place = length_class(counts) * (LEVELS + 1) + np.clip(near * LEVELS, 0, LEVELS).astype(int)
                np.add.at(total, place[near > 0], 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "n"])

    out = np.zeros(CLASSES * (LEVELS + 1), np.int64)
    for place, n in rows.select(column, *[c for c in ("lang",) if c != column]).mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n")).collect():
        out[place] = n
    return out.reshape(CLASSES, -1)


def whole_counts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, counts in count_parts(batch):
        yield counts


def stretch_counts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    texts = batch.column("text").cast(pa.binary())
    for i in range(0, len(texts), 512):
        parts = [s for t in texts.slice(i, 512).to_pylist() for s in stretches(window(t))]
        for _, _, counts in count_batches(pa.array(parts, pa.binary())):
            yield counts


def fit(rows: DataFrame, k: int = CLUSTERS) -> Model:
    """Learn from all (text, lang) rows; nulls are left out."""
    rows = rows.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    table = counted(rows)
    languages = sorted(lang for lang, in table.select("lang").distinct().limit(MOST_LABELS + 1).collect())
    if len(languages) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    n, found = document_frequency(table)
    idf = (np.log((1 + n) / (1 + found)) + 1).astype(np.float32)
    centres, language = clusters(table, idf, {v: i for i, v in enumerate(languages)}, k)
    if not len(centres):
        return Model([], idf, centres, language, np.zeros(CLASSES))
    seen = cosine_counts(table, "counts", whole_counts, idf, centres) + cosine_counts(rows, "text", stretch_counts, idf, centres)
    return Model(languages, idf, centres, language, limits(seen))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (the cosine, 0 to 1) and rejected to rows that have a text."""
    names = np.array([*model.languages, UNKNOWN], object)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n = batch.num_rows
            best, score, least = np.full(n, len(names) - 1), np.zeros(n), np.zeros(n)
            if len(model.centroids):
                letters = np.array([any(map(str.isalpha, t or "")) for t in batch.column("text").to_pylist()], bool)
                for i, j, counts in count_batches(batch.column("text")):
                    cosine = vectors(counts, model.idf) @ model.centroids.T
                    top = np.argmax(cosine, axis=1)
                    score[i:j] = np.clip(cosine[np.arange(j - i), top], 0, 1)
                    best[i:j] = model.language[top]
                    least[i:j] = model.least[length_class(counts)]
                best[~letters], score[~letters] = len(names) - 1, 0
            rejected = (best == len(names) - 1) | (score < least)
            found = [pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "lang_pred", "score", "rejected"])

    added = T._parse_datatype_string("lang_pred string, score double, rejected boolean")
    return rows.mapInArrow(batches, T.StructType([*rows.schema.fields, *added.fields]))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def identify(docs: DataFrame, fold: int = 1, folds: int = 3) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected): learns from the other folds, predicts all."""
    held = remainder(F.col("doc_id"), folds) == fold
    model = fit(docs.filter(~held))
    found = predict(docs.select("doc_id", held.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that language identification does not reject, learning from all labels."""
    found = predict(docs.select(F.struct(*docs.columns).alias("_row"), "text"), fit(docs))
    return found.filter(~F.col("rejected")).select("_row.*")
