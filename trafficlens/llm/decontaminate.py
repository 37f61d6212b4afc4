"""Benchmark decontamination by suffix arrays of the training text.

Documents are taken in shards of a few MB inside each task. A shard's words become 64-bit hashes, and
its suffixes are sorted by prefix doubling (only suffixes that still tie are sorted again, up to
the length of the longest benchmark item). Every suffix of every benchmark item is then searched by
binary search, all at once: first among the first words, then word by word within the interval of
the suffixes that agree so far. This gives each test suffix its longest verbatim match in the shard
and all places of its windows. The best of all shards is the longest match in the training data.

A window is ``window`` consecutive words of an item; a shorter item is one window. Words covered by
an occurrence are hit. The bytes of hit words are compared with those of the item's words; should
a hash have collided, that word is taken out and the shard is searched again.

No text is shuffled. The benchmark goes to the tasks in parts of at most about ``PART_BYTES`` of
different texts, one after the other, so a large one is never broadcast whole.

Defined cases: a null text has no words, an item without words has no window; a text is searched
whole, and one longer than ``SHARD_BYTES`` is a shard of its own; matches never cross documents or
items; rows that share an item_id are one item, null being an id too that is counted but has no
name; of equally long matches each shard offers one, and the least (document id, word) of these is named;
rows of documents that repeat are handled one by one; an empty benchmark leaves all clean, an empty
table gives no rows. Of other columns nothing is read, so their names may clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import keep
from .words import U, Words, as_bytes, runs

WINDOW = 10
SHARD_BYTES = 4 << 20
PART_BYTES = 8 << 20
#: Parts that documents pass through before what was found is written.
CHAIN = 4
#: Letters in lower case, digits and bytes from 128 on make words; all else becomes a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[48:58] = np.arange(48, 58)
FOLD[65:91] = np.arange(97, 123)
FOLD[97:123] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def words_of(column) -> Words:
    data, at = as_bytes(column)
    return Words(FOLD[data], at)


def hashes_of(words: Words, lane: int = 0) -> np.ndarray:
    """The hash of each word, never 0."""
    return np.maximum(words.hash(lane), U(1))


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers begin[i] .. begin[i] + size[i] - 1, one stretch after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Items:
    """A part of the benchmark: the words of its items, one after the other, and their suffixes."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        words = words_of(pa.array(texts, pa.string()))
        self.ids, self.window = ids, window
        self.size = np.asarray(words.per_text, np.int64)
        self.item = np.asarray(words.text, np.int64)
        self.number = np.arange(len(words)) - words.first[self.item]
        self.left = self.size[self.item] - self.number  # words from here to the end of the item
        #: words of the window that begins here, 0 if none does
        self.need = np.where(self.left >= window, window, np.where((self.number == 0) & (self.left > 0), self.left, 0))
        for lane in (0, 1):
            self.lane, self.word = lane, hashes_of(words, lane)
            self.vocabulary, first, self.entry = np.unique(self.word, return_index=True, return_inverse=True)
            size = words.end - words.begin
            self.spell_size = size[first]
            self.spell = words.data[stretches(words.begin[first], self.spell_size)]
            if self.same_bytes(words, np.arange(len(words)), self.entry).all():
                return
        raise ValueError("two words of the benchmark have equal hashes")

    def same_bytes(self, words: Words, which: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Is each of the words ``which`` spelled like the vocabulary's ``entry``?"""
        size = words.end[which] - words.begin[which]
        same = size == self.spell_size[entry]
        w, e = which[same], entry[same]
        start = np.cumsum(self.spell_size) - self.spell_size
        differs = words.data[stretches(words.begin[w], size[same])] != self.spell[stretches(start[e], size[same])]
        total = np.concatenate(([0], np.cumsum(differs)))
        end = np.cumsum(size[same])
        same[np.flatnonzero(same)[total[end] > total[end - size[same]]]] = False
        return same

    @property
    def longest(self) -> int:
        return int(self.size.max(initial=1))


def suffix_array(word: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first ``depth`` words at least; a 0 ends a suffix."""
    n = len(word)
    order = np.argsort(word, kind="stable")
    new = np.ones(n, bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (word[order[1:]] == 0)
    rank = np.zeros(n + 1, np.int64)  # place of the first suffix that ties; the place after the last ranks lowest
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[n] = -1
    ties = np.ones(n + 1, bool)
    ties[:n] = new
    place = np.flatnonzero(~(ties[:-1] & ties[1:]))  # places whose suffix ties with a neighbour
    width = 1
    while width < depth and len(place):
        s = order[place]
        key = rank[s] * (n + 2) + rank[np.minimum(s + width, n)] + 1
        turn = np.argsort(key, kind="stable")
        s, key = s[turn], key[turn]
        new = np.ones(len(place) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        order[place] = s
        rank[s] = place[np.maximum.accumulate(np.where(new[:-1], np.arange(len(place)), 0))]
        place = place[~(new[:-1] & new[1:])]
        width *= 2
    return order


class Shard:
    """The suffix array of a run of documents."""

    def __init__(self, words: Words, lane: int, depth: int):
        self.words, self.texts = words, len(words.at) - 1
        #: place of each word among words and ends of documents
        self.place = np.arange(len(words)) + words.text
        self.word = np.zeros(len(words) + self.texts, U)
        self.word[self.place] = hashes_of(words, lane)
        self.depth = depth
        self.array = suffix_array(self.word, depth)

    def without(self, bad: np.ndarray) -> None:
        """Take words out (places): a word of this shard that only hashes like one of the items."""
        self.word[bad] = 0
        self.array = suffix_array(self.word, self.depth)

    def _narrow(self, lo: np.ndarray, hi: np.ndarray, d: int, target: np.ndarray, after: bool) -> np.ndarray:
        """The first place of [lo, hi) whose suffix has at word ``d`` not less (or more) than the target."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) >> 1
            there, t = self.word[self.array[mid] + d], target[open_]
            low = (there <= t) if after else (there < t)
            lo[open_] = np.where(low, mid + 1, lo[open_])
            hi[open_] = np.where(low, hi[open_], mid)
        return lo

    def search(self, items: Items):
        """For each test suffix: the length of its longest match, an interval of suffixes that have
        it, and the interval of those that begin with its window (empty if none)."""
        first = self.word[self.array]
        left, right = (np.searchsorted(first, items.vocabulary, side)[items.entry] for side in ("left", "right"))
        lo, hi = left.astype(np.int64), right.astype(np.int64)
        length = (lo < hi).astype(np.int64)
        window = np.zeros((2, len(lo)), np.int64)
        alive = np.flatnonzero(lo < hi)
        d = 1
        while len(alive):
            done = alive[items.need[alive] == d]
            window[:, done] = lo[done], hi[done]
            alive = alive[items.left[alive] > d]
            target = items.word[alive + d]
            a = self._narrow(lo[alive], hi[alive], d, target, False)
            b = self._narrow(a, hi[alive], d, target, True)
            found = a < b
            alive = alive[found]
            lo[alive], hi[alive] = a[found], b[found]
            d += 1
            length[alive] = d
        return length, lo, hi, window[0], window[1]

    def windows(self, items: Items):
        """(places, words, first test suffix) of the occurrences of windows, each different window once."""
        _, _, _, lo, hi = self.search(items)
        j = np.flatnonzero(lo < hi)
        if not len(j):
            return j, j, j, []
        # equal windows have equal intervals
        _, once, group = np.unique(np.stack([lo[j], items.need[j]]), axis=1, return_index=True, return_inverse=True)
        group = group.ravel()
        count = hi[j[once]] - lo[j[once]]
        place = self.array[stretches(lo[j[once]], count)]
        which = np.repeat(np.arange(len(once)), count)
        of = [np.unique(items.item[j[g]]) for g in np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])]
        return place, np.repeat(items.need[j[once]], count), which, of

    def hits(self, items: Items):
        """Hit words (a mask), and the occurrences (document, different window) with the windows' items."""
        while True:
            place, need, which, of = self.windows(items)
            edge = np.zeros(len(self.word) + 1, np.int64)
            np.add.at(edge, place, 1)
            np.add.at(edge, place + need, -1)
            hit = np.flatnonzero(np.cumsum(edge)[self.place] > 0)
            entry = np.searchsorted(items.vocabulary, self.word[self.place[hit]])
            wrong = hit[~items.same_bytes(self.words, hit, entry)]
            if not len(wrong):
                mask = np.zeros(len(self.words), bool)
                mask[hit] = True
                text = np.searchsorted(self.place, place)
                return mask, self.words.text[text], which, of
            self.without(self.place[wrong])


def parts_of(benchmark: DataFrame, window: int, part_bytes: int, id_col: str, text_col: str) -> Iterator[tuple[Items, bool]]:
    """The different texts of the benchmark in parts of bounded size, one at a time, and whether it is the last."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, math.ceil(total / part_bytes))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    for p in range(parts):
        found = rows.filter(part == p).orderBy("id", "text").collect()
        yield Items([r["id"] for r in found], [r["text"] for r in found], window), p == parts - 1


def _item_names(items: Items, doc: np.ndarray, which: np.ndarray, of: list[np.ndarray]) -> dict[int, tuple[list[str], bool]]:
    """document -> (ids of the items that occur in it, whether one without an id does)."""
    out, known = {}, {}
    if not len(doc):
        return out
    pairs = np.unique(np.stack([doc, which]), axis=1)
    for d, w in zip(*(np.split(x, np.flatnonzero(np.diff(pairs[0])) + 1) for x in pairs), strict=True):
        key = w.tobytes()
        if key not in known:
            ids = {items.ids[i] for k in w.tolist() for i in of[k].tolist()}
            known[key] = (sorted(i for i in ids if i is not None), None in ids)
        out[int(d[0])] = known[key]
    return out


def _shards(batch: pa.RecordBatch, text: str, items: Items, shard_bytes: int) -> Iterator[tuple[int, int, Shard]]:
    data, at = as_bytes(batch.column(text))
    for i, j in runs(at, shard_bytes):
        words = Words(FOLD[data[at[i] : at[j]]], at[i : j + 1] - at[i])
        yield i, j, Shard(words, items.lane, items.longest)


def _spans(mask: np.ndarray, words: Words, earlier: list) -> list[list[dict[str, int]]]:
    """The maximal runs of hit words of each document, joined with those found before."""
    for d, spans in enumerate(earlier):
        for s in spans:
            mask[words.first[d] + s["start"] : words.first[d] + s["end"]] = True
    first, last = mask.copy(), mask.copy()
    same = words.text[1:] == words.text[:-1]
    first[1:] &= ~(mask[:-1] & same)
    last[:-1] &= ~(mask[1:] & same)
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out: list[list[dict[str, int]]] = [[] for _ in earlier]
    for b, e, d in zip(begin.tolist(), end.tolist(), words.text[begin].tolist(), strict=True):
        start = int(words.first[d])
        out[d].append({"start": b - start, "end": e - start})
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _marked(rows: DataFrame, items: Items, shard_bytes: int, last: bool) -> DataFrame:
    """Adds what one part of the benchmark hits; the last part leaves out the text."""
    names = [c for c in rows.columns if not (last and c == "text")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, shard in _shards(batch, "text", items, shard_bytes):
                part = batch.slice(i, j - i)
                mask, doc, which, of = shard.hits(items)
                found = _item_names(items, doc, which, of)
                ids, nameless = part.column("items").to_pylist(), part.column("nameless").to_pylist()
                for d, (more, without) in found.items():
                    ids[d] = sorted({*ids[d], *more})
                    nameless[d] |= without
                spans = _spans(mask, shard.words, part.column("spans").to_pylist())
                out = {
                    "id": part.column("id"),
                    "text": part.column("text"),
                    "n_words": pa.array(shard.words.per_text, pa.int64()),
                    "spans": pa.array(spans, SPANS),
                    "items": pa.array(ids, pa.list_(pa.string())),
                    "nameless": pa.array(nameless, pa.bool_()),
                }
                yield pa.RecordBatch.from_arrays([out[c] for c in names], names=names)

    return rows.mapInArrow(batches, rows.select(*names).schema)


def hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", item_id: str = "item_id",
    text_col: str = "text", shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(the id, n_words, spans of hit words, items, nameless) of every document.

    ``items`` are the ids, as sorted strings, of the items of which a window occurs; ``nameless``
    tells that items without an id do.
    """
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"), F.array().cast("array<string>").alias("items"),
        F.lit(False).alias("nameless"),
    )
    for k, (items, last) in enumerate(parts_of(benchmark, window, part_bytes, item_id, text_col)):
        rows = _marked(keep(rows, "marked") if k and k % CHAIN == 0 else rows, items, shard_bytes, last)
    return rows.select(F.col("id").alias(id_col), "n_words", "spans", "items", "nameless")


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, id_col: str = "doc_id", item_id: str = "item_id",
    text_col: str = "text", shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(item_id as a string, item_word, length, the document's id, doc_word): the longest verbatim match of
    every suffix of the benchmark (from its word ``item_word`` on) that has one of ``least`` words or more.

    The match is one occurrence; equal texts of an item are one.
    """
    kind = dict(docs.dtypes)[id_col]
    out = f"item_id string, item string, item_word bigint, length bigint, id {kind}, doc_word bigint"

    def searched(items: Items) -> DataFrame:
        names = [hashlib.md5(f"{i}:{k}".encode()).hexdigest() for k, i in enumerate(items.ids)]

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for i, _, shard in _shards(batch, "text", items, shard_bytes):
                    shard.hits(items)  # takes out words that only hash alike
                    length, lo, _, _, _ = shard.search(items)
                    j = np.flatnonzero(length >= least)
                    at = np.searchsorted(shard.place, shard.array[lo[j]])
                    doc = shard.words.text[at]
                    columns = [
                        pa.array([items.ids[k] for k in items.item[j]], pa.string()),
                        pa.array([names[k] for k in items.item[j]], pa.string()),
                        pa.array(items.number[j], pa.int64()),
                        pa.array(length[j], pa.int64()),
                        batch.column("id").take(pa.array(doc + i)),
                        pa.array(at - shard.words.first[doc], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["item_id", "item", "item_word", "length", "id", "doc_word"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, out)

    best = F.min_by(F.struct("id", "doc_word"), F.struct(-F.col("length"), F.col("id").isNull(), "id", "doc_word")).alias("place")
    found = None
    for items, _ in parts_of(benchmark, least, part_bytes, item_id, text_col):
        # one row for each suffix: combined in the tasks before the shuffle
        part = searched(items).groupBy("item_id", "item", "item_word").agg(F.max("length").alias("length"), best)
        found = part if found is None else found.unionByName(part)
    return found.select("item_id", "item_word", "length", F.col("place.id").alias(id_col), F.col("place.doc_word").alias("doc_word"))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, item_id: str = "item_id", text_col: str = "text",
    shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""

    def clean(items: Items):
        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for i, j, shard in _shards(batch, text_col, items, shard_bytes):
                    mask, *_ = shard.hits(items)
                    dirty = np.bincount(shard.words.text[mask], minlength=j - i) > 0
                    yield batch.slice(i, j - i).filter(pa.array(~dirty))

        return batches

    left = docs
    for k, (items, _) in enumerate(parts_of(benchmark, window, part_bytes, item_id, text_col)):
        left = (keep(left, "clean") if k and k % CHAIN == 0 else left).mapInArrow(clean(items), docs.schema)
    return left
