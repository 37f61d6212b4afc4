"""Packing token sequences shortest-pack-first over the length histogram.

A document (its ids and the end id) is cut at multiples of the sequence length; what remains is a
piece of fewer tokens. The histogram of piece lengths has at most one entry per token of a
sequence, so it is packed on the driver: lengths are placed longest first, each into the open
packs that are shortest, as many at a time as there are, updating the counts of the patterns.
Patterns are then joined back to the pieces by rank: the r-th piece of a length takes the r-th
place that the patterns hold for that length, which is two binary searches in a table whose size
depends on the sequence length alone. Ranks are found without gathering a length in one task.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each by itself;
very long texts are encoded whole and give many pieces;
an empty table gives no pieces. Only doc_id and text are read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import keep
from .ranks import running
from .words import Words, as_bytes, runs

LENGTH = 2048
KNOWN = 1_000_000
STEP = 1 << 21


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


MARKS = np.zeros(256, bool)
MARKS[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True


def _after_letter(data: np.ndarray) -> np.ndarray:
    """Where a mark (no apostrophe) follows an ASCII letter: a pre-token begins there in any case."""
    out = np.zeros(len(data), bool)
    out[1:] = MARKS[data[1:]] & (data[:-1] >= 97) & (data[:-1] <= 122)
    return out


class Encoder:
    """Texts -> ids, for a vocabulary that drops white space, folds case and never joins letters
    with marks: a text's ids are those of its words in a row.

    Each distinct word is encoded once while it is remembered, by its 64-bit hash; the table of
    words is a few arrays, dropped when it holds ``KNOWN`` words. Texts that could hold a special
    token go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self._forget()

    def _forget(self) -> None:
        self.key, self.start, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Words of letters are one pre-token each, so they are encoded in one go."""
        row = [i for i, w in enumerate(words) if w.isalpha()]
        found = self.tokenizer.encode(" ".join(words[i] for i in row), add_special_tokens=False)
        ids, word = np.array(found.ids, "<u4"), np.array(found.word_ids, np.int64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        if len(first) != len(row):
            row, first, ids = [], first[:0], ids[:0]
        rest = sorted(set(range(len(words))) - set(row))
        others = self.whole([words[i] for i in rest])
        order = np.array(row + rest, np.int64)
        size = np.concatenate([np.diff(np.append(first, len(ids))), [len(x) for x in others]]).astype(np.int64)
        start = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, ids, *others])
        key = np.concatenate([self.key, keys[order]])
        sort = np.argsort(key, kind="stable")
        self.key = key[sort]
        self.start, self.size = np.concatenate([self.start, start])[sort], np.concatenate([self.size, size])[sort]

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        data, at = as_bytes(column)
        words = Words(data, at, lower=True, cuts=_after_letter)
        keys, first, back = np.unique(words.hash(), return_index=True, return_inverse=True)
        place = np.searchsorted(self.key, keys)
        new = np.flatnonzero(np.append(self.key, 0)[place] != keys) if len(self.key) else np.arange(len(keys))
        if len(self.key) + len(new) > KNOWN and len(self.key):
            self._forget()
            new = np.arange(len(keys))
        if len(new):
            raw, pick = words.data, first[new]
            begin, end = words.begin[pick].tolist(), words.end[pick].tolist()
            self._learn(keys[new], [raw[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)])
        place = np.searchsorted(self.key, keys)[back] if len(keys) else back
        size = self.size[place]
        end = np.cumsum(size)
        ids = self.ids[np.repeat(self.start[place] - (end - size), size) + np.arange(end[-1] if len(end) else 0)]
        edge = np.concatenate(([0], end))[words.first]
        out = np.split(ids, edge[1:-1]) if len(at) > 2 else [ids] * (len(at) - 1)
        special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <|
        for i in np.unique(np.searchsorted(at, special, side="right") - 1).tolist():
            out[i] = self.whole([column[i].as_py() or ""])[0]
        return out


@cache
def _encoder(path: str) -> Encoder:
    """One per worker, so tasks that follow one another share what it has learnt."""
    return Encoder(path)


def pieces(docs: DataFrame, path: str | None = None, end_id: int = 1, length: int = LENGTH, words: bool = True) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens."""
    path = path or vocabulary()
    kind = dict(docs.dtypes)["doc_id"]
    tail = np.array([end_id], "<u4").tobytes()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in it:
            _, at = as_bytes(batch.column("text"))
            for lo, hi in runs(at, STEP):
                part = batch.slice(lo, hi - lo)
                column = part.column("text")
                row, out = [], []
                for i, ids in enumerate(encoder(column) if words else encoder.whole([t or "" for t in column.to_pylist()])):
                    raw = ids.tobytes() + tail
                    n = len(raw) // 4
                    for a in range(0, n, length):
                        b = min(n, a + length)
                        row.append(i)
                        out.append((a, b - a, zlib.crc32(raw[4 * a : 4 * b]), n))
                columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), *columns],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


def shortest_pack_first(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a pack, number of such packs)] for ``histogram`` (piece length -> pieces).

    Lengths are placed from the longest to the shortest. The open packs are kept by the tokens
    they hold; pieces go to the shortest packs first, all packs of one pattern at a time, and to
    new packs when none has room.
    """
    open_packs: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    done: dict[tuple[int, ...], int] = defaultdict(int)
    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left > 0:
            held = min((h for h, p in open_packs.items() if p), default=length)
            if held + size > length:
                pattern, n, into = (), left, size
            else:
                pattern = next(iter(open_packs[held]))
                n, into = min(left, open_packs[held][pattern]), held + size
                open_packs[held][pattern] -= n
                if not open_packs[held][pattern]:
                    del open_packs[held][pattern]
            grown = (*pattern, size)
            (done if into == length else open_packs[into])[grown] += n
            left -= n
    for packs in open_packs.values():
        for pattern, n in packs.items():
            done[pattern] += n
    return sorted(done.items(), reverse=True)


def places(packs: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """The ranks that each pattern takes of each length: sorted keys, first sequence, offset.

    A run of places covers the ranks from ``rank`` on of ``length``; place r is in sequence
    ``sequence + r - rank`` at ``offset``.
    """
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, n in packs:
        at = 0
        for size in pattern:
            rows.append((size, taken[size], sequence, at))
            taken[size] += n
            at += size
        sequence += n
    rows.sort()
    table = np.array(rows or [(0, 0, 0, 0)], np.int64)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T.copy(), strict=True))


def _place(table: dict[str, np.ndarray]):
    key = table["length"] << 48 | table["rank"]

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(key, length << 48 | rank, side="right") - 1
            found = [pa.array(x) for x in (table["sequence"][k] + rank - table["rank"][k], table["offset"][k])]
            kept = [batch.column(c) for c in batch.schema.names if c != "rank"]
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, *found], names=[*names, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, length: int = LENGTH, words: bool = True) -> DataFrame:
    """One row per piece: the columns of ``pieces`` with sequence_id and offset."""
    cut = keep(pieces(docs, path, end_id, length, words), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    order = [F.xxhash64("doc_id", "start").asc(), F.col("doc_id").asc(), F.col("start").asc(), F.col("ids_crc32").asc()]
    ranked = running(cut.withColumn("one", F.lit(1).cast("bigint")), "one", ["length"], order, "rank").drop("one")
    kinds = ", ".join(f"{c} {t}" for c, t in ranked.dtypes if c != "rank")
    return ranked.mapInArrow(_place(places(shortest_pack_first(histogram, length))), f"{kinds}, sequence_id bigint, offset bigint")
