"""An exchange between blocks of documents and segments of a key space.

Documents are dealt into blocks by hash, once; every round reads that same shuffle. In a round
each block sends each of its distinct keys once, with a mark if it has the key more than once, as
sorted and compressed arrays: one row per segment of the key space. A segment merges what the
blocks sent, and answers each block in the order of its keys. So a key, passage or copy that a
third of all documents hold costs one entry per block, no matter how often it occurs, no task
holds more than a block or a segment, and no text leaves its block.

The row order inside a block does not matter: everything that is sent is sorted by value.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

U = np.uint64
#: Bytes of text in a block of an input of FULL_FROM to GROW_FROM bytes. Small inputs get smaller
#: blocks, for enough tasks; large ones blocks that grow with the square root of the input, so that
#: the messages between blocks and segments stay far fewer than the keys.
BLOCK_BYTES = 4 << 20
FULL_FROM, GROW_FROM = 1 << 30, 1 << 34
#: Blocks to a segment, and how many segments there are at most, times the root of the blocks.
PER_SEGMENT = 2
SEGMENTS_TIMES = 16
MESSAGE = "segment int, block int, kind int, data binary"


def dealt(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int, int, int]:
    """(rows of block, doc_id, text; blocks; segments; bytes of all texts)."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    total = docs.agg(F.sum(size + 64)).first()[0] or 0
    scale = max(0.25, min(1.0, math.sqrt(total / FULL_FROM))) * max(1.0, math.sqrt(total / GROW_FROM))
    blocks = max(1, math.ceil(total / (block_bytes * scale)))
    segments = max(1, min(blocks, 32), min(blocks // PER_SEGMENT, int(SEGMENTS_TIMES * math.sqrt(blocks))))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")
    rows = docs.select(block.alias("block"), "doc_id", "text").repartition(blocks, "block")
    return rows, blocks, segments, total


def _planes(x: np.ndarray) -> bytes:
    """The bytes of equal weight together, as the upper ones are mostly alike."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(raw: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(dtype).ravel()


def packed(**arrays: np.ndarray) -> bytes:
    """Compress arrays; an array named ``sorted`` is stored by its differences."""
    out = []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        if name == "sorted":
            x = np.diff(x, prepend=x.dtype.type(0))
        if x.dtype == bool:
            out.append((name, "bits", len(x), np.packbits(x).tobytes()))
        else:
            out.append((name, x.dtype.str, len(x), _planes(x) if len(x) else b""))
    return zstandard.compress(pickle.dumps(out, 5), 1)


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    out = {}
    for name, kind, n, raw in pickle.loads(zstandard.decompress(data)):
        if kind == "bits":
            out[name] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        else:
            out[name] = _from_planes(raw, np.dtype(kind)) if n else np.zeros(0, np.dtype(kind))
        if name == "sorted":
            out[name] = np.cumsum(out[name], dtype=out[name].dtype)
    return out


def segment_of(key: np.ndarray, segments: int) -> np.ndarray:
    """Segment of a uniform 64-bit key; rises with the key."""
    return ((key >> U(32)) * U(segments) >> U(32)).astype(np.int64)


def cuts(segment: np.ndarray, segments: int) -> Iterator[tuple[int, slice]]:
    """(segment, its stretch) for rising segment numbers."""
    edge = np.searchsorted(segment, np.arange(segments + 1))
    for s in range(segments):
        if edge[s] < edge[s + 1]:
            yield s, slice(int(edge[s]), int(edge[s + 1]))


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    types = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["segment", "block", "kind", "data"])


def read(table: pa.Table, kind: int) -> list[tuple[int, int, dict[str, np.ndarray]]]:
    """(segment, block, arrays) of the messages of a kind, by segment, then block."""
    rows = [
        (s, b, d)
        for s, b, k, d in zip(*(table.column(c).to_pylist() for c in ("segment", "block", "kind", "data")), strict=True)
        if k == kind
    ]
    return [(s, b, unpacked(d)) for s, b, d in sorted(rows, key=lambda r: r[:2])]


def distinct(key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, second) in order: keys, seconds, counts, and the entry of each row."""
    order = np.argsort(key, kind="stable")
    k, s = key[order], second[order]
    if len(k) and ((k[1:] == k[:-1]) & (s[1:] != s[:-1])).any():
        order = np.lexsort((second, key))
        k, s = key[order], second[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    entry = np.empty(len(k), np.int64)
    entry[order] = np.cumsum(new) - 1
    return k[at], s[at], np.diff(np.append(at, len(k))), entry


def repeated(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For the (keys, seconds, more than once) of each block: which of its entries occur twice or more."""
    if not entries:
        return []
    key, second, more = (np.concatenate(x) for x in zip(*entries, strict=True))
    _, _, _, entry = distinct(key, second)
    total = np.bincount(entry, 1.0 + more) if len(entry) else np.zeros(0)
    return np.split(total[entry] > 1, np.cumsum([len(e[0]) for e in entries])[:-1])
