"""Removal of repeated word windows, found by a count-min sketch and confirmed exactly.

Pass 1: every block of documents builds its part of a count-min sketch of its windows (``ROWS``
hash rows; a part is the sorted list of the cells it touches, so it is as small as the block).
The parts are merged by ranges of cells; a block learns which of its cells hold two or more. As
counts are only ever overestimated, a window that occurs twice always has two or more in all rows.
Pass 2: only those windows are grouped exactly, by 96 bits of two independent polynomials, and
each block learns which are repeated. Pass 3 strikes the words that repeated windows cover.
The sketch has a fixed number of cells per byte of text, so its error is the same at every size.

Defined cases: a null text has no words; a document with fewer words than a window keeps them all;
repeated rows are documents of their own, so their windows count as repeated; an empty table gives
no rows. Windows never cross documents. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from . import blocks as B
from .words import Words, as_bytes

WINDOW = 35
ROWS = 2
#: Cells of a row per byte of all texts: about three per window.
CELLS_PER_BYTE = 0.5
SKETCH, MARKS, WANTED, CANDIDATES, FOUND = range(5)


class Block:
    """The windows of a block: two hashes each."""

    def __init__(self, table: pa.Table, n: int):
        self.ids = table.column("doc_id")
        self.words = Words(*as_bytes(table.column("text")))
        self.starts = self.words.windows(n)
        self.hash = [self.words.window_hash(self.starts, n, lane) for lane in (0, 1)]

    def cells(self, row: int, width: int) -> np.ndarray:
        return self.hash[row] % B.U(width)


def _sketch(n: int, width: int, segments: int):
    """Distinct cells of each row, with a mark on those that the block touches more than once."""

    def send(key, table):
        block, rows = Block(table, n), []
        for r in range(ROWS):
            cells, count = np.unique(block.cells(r, width), return_counts=True)
            of = (cells * B.U(segments) // B.U(width)).astype(np.int64)
            for s, part in B.cuts(of, segments):
                rows.append((r * segments + s, key[0].as_py(), SKETCH, B.packed(sorted=cells[part], more=count[part] > 1)))
        return B.messages(rows)

    return send


def _merge(key, table):
    """Sum the parts of a range of cells: which cells hold two or more, for each block."""
    parts = B.read(table, SKETCH)
    zero = [np.zeros(len(p["sorted"]), np.uint8) for _, _, p in parts]
    found = B.repeated([(p["sorted"], z, p["more"]) for (_, _, p), z in zip(parts, zero, strict=True)])
    return B.messages([(s, b, MARKS, B.packed(bits=x)) for (s, b, _), x in zip(parts, found, strict=True)])


def _wanted(n: int, width: int, segments: int):
    """The windows that the sketch estimates to be repeated, and their keys for the exact count."""

    def send(key, table, marks):
        if not table.num_rows:
            return B.messages([])
        block, b = Block(table, n), key[0].as_py()
        likely = np.ones(len(block.starts), bool)
        replies = B.read(marks, MARKS)
        for r in range(ROWS):
            own = [m["bits"] for s, _, m in replies if s // segments == r]
            cells, entry = np.unique(block.cells(r, width), return_inverse=True)
            likely &= np.concatenate(own)[entry] if len(cells) else False
        keys, entry = np.unique(block.hash[0], return_inverse=True)
        flag = np.zeros(len(keys), bool)
        flag[entry[likely]] = True
        rows = [(-1 - b, b, CANDIDATES, B.packed(bits=flag))]
        first, second, count, _ = _entries(block, flag[entry])
        for s, part in B.cuts(B.segment_of(first, segments), segments):
            data = B.packed(sorted=first[part], second=second[part], more=count[part] > 1)
            rows.append((s, b, WANTED, data))
        return B.messages(rows)

    return send


def _entries(block: Block, likely: np.ndarray):
    return B.distinct(block.hash[0][likely], (block.hash[1][likely] >> B.U(32)).astype(np.uint32))


def _count(key, table):
    """Group the wanted windows of a segment exactly; what a block noted for itself passes through."""
    noted = table.filter(pa.compute.equal(table.column("kind"), CANDIDATES))
    parts = B.read(table, WANTED)
    found = B.repeated([(p["sorted"], p["second"], p["more"]) for _, _, p in parts])
    rows = B.messages([(s, b, FOUND, B.packed(bits=x)) for (s, b, _), x in zip(parts, found, strict=True)])
    return pa.concat_tables([noted.select(rows.schema.names).cast(rows.schema), rows])


def covered(words: Words, starts: np.ndarray, n: int) -> np.ndarray:
    """Words that a window from one of ``starts`` covers."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_texts(words: Words, gone: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    data, at = words.data.copy(), words.at
    mask = np.zeros(len(data) + 1, np.int8)
    mask[words.begin[~gone]] += 1
    mask[words.end[~gone]] -= 1
    keep = np.cumsum(mask[:-1]) > 0
    after = words.end[~gone]
    inside = after < np.append(at[1:], 0)[words.text[~gone]]
    data[after[inside]] = 32  # the space that ends a kept word
    keep[after[inside]] = True
    total = np.concatenate(([0], np.cumsum(keep)))[at]
    left = data[keep].tobytes()
    return [left[a:b].rstrip(b" ") for a, b in zip(total[:-1].tolist(), total[1:].tolist(), strict=True)]


def _strike(n: int, text_out: bool, id_type: pa.DataType):
    def strike(key, table, replies):
        if table.num_rows:
            block = Block(table, n)
            keys, entry = np.unique(block.hash[0], return_inverse=True)
            flag = np.concatenate([m["bits"] for _, _, m in B.read(replies, CANDIDATES)])
            likely = flag[entry] if len(keys) else np.zeros(0, bool)
            _, _, _, at = _entries(block, likely)
            found = [m["bits"] for _, _, m in B.read(replies, FOUND)]
            twice = np.concatenate(found)[at] if found else np.zeros(0, bool)
            words = block.words
            gone = covered(words, block.starts[likely][twice], n)
            texts = kept_texts(words, gone)
            out = {
                "doc_id": block.ids,
                "n_words": pa.array(words.per_text, pa.int64()),
                "n_removed": pa.array(np.bincount(words.text, gone, minlength=len(texts)).astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
        else:
            texts = []
            out = {"doc_id": pa.array([], id_type), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_sha256": pa.array([], pa.string())}
        if text_out:
            out["text"] = pa.array([t.decode() for t in texts], pa.string())
        return pa.table(out)

    return strike


def strike_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document, with ``texts`` also what is left."""
    rows, _, segments, total = B.dealt(docs)
    width = max(1 << 16, int(total * CELLS_PER_BYTE))
    by_block = rows.groupBy("block")
    parts = by_block.applyInArrow(_sketch(window, width, segments), B.MESSAGE)
    marks = parts.repartition(segments, "segment").groupBy("segment").applyInArrow(_merge, B.MESSAGE)
    wanted = by_block.cogroup(marks.groupBy("block")).applyInArrow(_wanted(window, width, segments), B.MESSAGE)
    found = wanted.repartition(segments, "segment").groupBy("segment").applyInArrow(_count, B.MESSAGE)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string" + ", text string" * texts
    from pyspark.sql.pandas.types import to_arrow_type

    strike = _strike(window, texts, to_arrow_type(docs.schema["doc_id"].dataType))
    return by_block.cogroup(found.groupBy("block")).applyInArrow(strike, schema)
