"""Removal of repeated byte strings by a hash-compared suffix sort.

Every ``LENGTH``-byte string is represented by its anchors: those of its ``GRAM``-byte grams whose
hash is least among the grams in it. Equal strings have equal anchors at equal places, so two
strings can only be equal if an anchor of theirs is. What surrounds an anchor, up to the farthest
string that it can represent, is its context.

1. Blocks of documents send the distinct (anchor, context) hashes they hold; segments of the
   anchors tell which contexts occur twice (all of them is repeated) and which anchors stand in
   several contexts.
2. Those contexts are sent once each, and the suffixes that begin at the anchors, as well as the
   reversed text before them, are put in order by a mergesort. It compares two suffixes by the
   length of their common extension, which a binary search finds from prefix polynomial hashes;
   the order is verified byte by byte and, should a hash have collided, made again from the
   bytes. From the common extensions of neighbours follows which strings around an anchor occur
   in another context. Anchors with more than ``CROWD`` contexts are not sorted by one task:
   their strings are counted one by one, spread by their hashes, which gives the same.
3. Blocks remove the bytes that repeated strings cover.

Defined cases: a null text is empty; a text shorter than ``LENGTH`` keeps all bytes; repeated rows
are documents of their own, so they remove each other; an empty table gives no rows. Matches never
cross documents. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks as B
from .words import BASES, U, as_bytes, mixed, powers, prefix_hash, stretch_hash

LENGTH = 200
GRAM = 64
CROWD = 512
STEP = 1 << 19
ANCHORS, STATES, CONTEXTS, STRINGS, NOTED, EXTENTS, TWICE = range(7)
#: What a segment tells about an (anchor, context).
REPEATED, SORT, SENDER, CROWDED = 1, 2, 4, 8


def sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Least (or largest) of every n neighbours, by doubling."""
    best, width = np.minimum if least else np.maximum, 1
    while width < n:
        step = min(width, n - width)
        x = best(x[: len(x) - step], x[step:])
        width += step
    return x


class Block:
    """The anchors of a block: position, text, hash of the gram, hash and bounds of the context."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.ids = table.column("doc_id")
        self.data, self.at = as_bytes(table.column("text"))
        self.spread = length - gram  # how far a string can begin before its anchor
        found = [self._stretch(lo, length, gram) for lo in range(0, len(self.data), STEP)]
        self.place, index = np.unique(np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]), return_index=True)
        self.anchor, self.context = (
            np.concatenate([f[k] for f in found] or [np.zeros(0, U)])[index] for k in (1, 2)
        )
        text = np.searchsorted(self.at, self.place, side="right") - 1
        self.first = np.maximum(self.place - self.spread, self.at[text])
        self.last = np.minimum(self.place + length, self.at[text + 1])
        self.keys = B.distinct(self.anchor, self.context)

    def _stretch(self, lo: int, length: int, gram: int):
        """Anchors of the strings that begin in [lo, lo + STEP)."""
        n, spread = len(self.data), self.spread
        hi = min(n, lo + STEP)
        a, b = max(0, lo - spread), min(n, hi + spread + length)
        part = self.data[a:b]
        prefix = prefix_hash(part, BASES[0])
        begin = np.arange(lo - a, max(lo - a, min(b - a - gram, hi + spread - a) + 1))
        hashes = mixed(stretch_hash(prefix, begin, begin + gram, BASES[0]))
        small = np.maximum((hashes >> U(32)).astype(np.uint32), np.uint32(1))
        if len(small) <= spread:
            return np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        low = sliding(small, spread + 1, True)
        start = np.arange(lo, lo + len(low))
        end_of = self.at[np.searchsorted(self.at, start, side="right")] if len(self.at) > 1 else start
        low[start + length > end_of] = 0
        edge = np.zeros(spread, np.uint32)
        top = sliding(np.concatenate([edge, low, edge]), spread + 1, False)
        hit = np.flatnonzero(small == top[: len(small)])
        place = hit + lo
        text = np.searchsorted(self.at, place, side="right") - 1
        first = np.maximum(place - spread, self.at[text])
        last = np.minimum(place + length, self.at[text + 1])
        around = stretch_hash(prefix_hash(part, BASES[1]), first - a, last - a, BASES[1])
        around = mixed(around + (place - first).astype(U) * U(0xC2B2AE3D27D4EB4F) + (last - place).astype(U) * U(0x165667B19E3779F9))
        # an anchor's hash is the least of many, so its upper bits say little; mixed, it deals evenly to segments
        return place, mixed(hashes[hit]), around


def _anchors(length: int, gram: int, segments: int):
    def send(key, table):
        anchor, context, count, _ = Block(table, length, gram).keys
        rows = [
            (s, key[0].as_py(), ANCHORS, B.packed(sorted=anchor[part], context=context[part], more=count[part] > 1))
            for s, part in B.cuts(B.segment_of(anchor, segments), segments)
        ]
        return B.messages(rows)

    return send


def _states(key, table):
    parts = B.read(table, ANCHORS)
    if not parts:
        return B.messages([])
    anchor, context, more = (np.concatenate([p[k] for _, _, p in parts]) for k in ("sorted", "context", "more"))
    a, _, _, entry = B.distinct(anchor, context)
    total = np.bincount(entry, 1.0 + more)
    _, group, contexts = np.unique(a, return_inverse=True, return_counts=True)
    contexts = contexts[group]
    state = (total > 1) * REPEATED + (contexts > 1) * SORT + (contexts > CROWD) * CROWDED
    each = state[entry].astype(np.uint8)
    each[np.unique(entry, return_index=True)[1]] |= SENDER
    split = np.split(each, np.cumsum([len(p["sorted"]) for _, _, p in parts])[:-1])
    return B.messages([(s, b, STATES, B.packed(state=x)) for (s, b, _), x in zip(parts, split, strict=True)])


def _to_sort(state: np.ndarray) -> np.ndarray:
    return (state & SORT > 0) & (state & SENDER > 0) & (state & CROWDED == 0)


def _strings(block: Block, state: np.ndarray, example: np.ndarray, length: int):
    """Of crowded anchors: the strings of the contexts sent, once each: (start, key, second, repeated)."""
    e = np.flatnonzero((state & SENDER > 0) & (state & CROWDED > 0))
    before = np.arange(block.spread + 1)
    start = block.place[example[e]][:, None] - before
    inside = (start >= block.first[example[e]][:, None]) & (start + length <= block.last[example[e]][:, None])
    row, col = np.nonzero(inside)
    # a string may hold several anchors, so it is in several contexts
    start, at = np.unique(start[row, col], return_inverse=True)
    known = np.bincount(at, state[e[row]] & REPEATED > 0, minlength=len(start)) > 0
    out = []
    for base in BASES:
        h = np.zeros(len(start), U)
        for lo in range(0, len(start), STEP):
            s = start[lo : lo + STEP]
            a = s.min() if len(s) else 0
            prefix = prefix_hash(block.data[a : s.max() + length], base)
            h[lo : lo + STEP] = mixed(stretch_hash(prefix, s - a, s - a + length, base))
        out.append(h)
    return start, out[0], (out[1] >> U(32)).astype(np.uint32), known


def _contexts(length: int, gram: int, segments: int):
    def send(key, table, replies):
        if not table.num_rows:
            return B.messages([])
        b, block = key[0].as_py(), Block(table, length, gram)
        anchor, context, _, entry = block.keys
        state = np.concatenate([m["state"] for _, _, m in B.read(replies, STATES)] or [np.zeros(0, np.uint8)])
        rows = [(-1 - b, b, NOTED, B.packed(state=state))]
        example = np.unique(entry, return_index=True)[1]
        e = np.flatnonzero(_to_sort(state))
        for s, part in B.cuts(B.segment_of(anchor[e], segments), segments):
            x = example[e[part]]
            first, last, place = block.first[x], block.last[x], block.place[x]
            text = np.concatenate([block.data[i:j] for i, j in zip(first.tolist(), last.tolist(), strict=True)])
            data = B.packed(
                sorted=anchor[e[part]], before=(place - first).astype(np.uint16), after=(last - place).astype(np.uint16),
                text=text,
            )
            rows.append((s, b, CONTEXTS, data))
        _, first, second, known = _strings(block, state, example, length)
        keys, seconds, count, at = B.distinct(first, second)
        more = (np.bincount(at, 1.0 + known, minlength=len(keys)) > 1) if len(keys) else np.zeros(0, bool)
        for s, part in B.cuts(B.segment_of(keys, segments), segments):
            rows.append((s, b, STRINGS, B.packed(sorted=keys[part], second=seconds[part], more=more[part])))
        return B.messages(rows)

    return send


class Suffixes:
    """Strings of one text buffer, in groups, put in order by a mergesort on hashed extensions."""

    def __init__(self, text: np.ndarray, start: np.ndarray, size: np.ndarray, group: np.ndarray):
        """``group`` must rise; strings are compared within their group."""
        self.text, self.start, self.size, self.group = text, start, size, group
        self.prefix, self.power = prefix_hash(text, BASES[0]), powers(BASES[0], len(text) + 1)
        self.order = self._sorted()
        self.common = self._neighbours()
        if not self._verified():
            self.order = np.array(
                sorted(range(len(start)), key=lambda i: (group[i], text[start[i] : start[i] + size[i]].tobytes(), i)), np.int64
            )
            self.common = self._neighbours(exact=True)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common beginning, by binary search over equal hashes."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.size[x], self.size[y])
        sx, sy = self.start[x], self.start[y]
        px, py, wx, wy = self.prefix[sx], self.prefix[sy], self.power[sx], self.power[sy]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            same = (self.prefix[sx + mid] - px) * wx == (self.prefix[sy + mid] - py) * wy
            lo = np.where(same, mid, lo)
            hi = np.where(same, hi, mid - 1)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Is string x before string y (or equal, where asked)?"""
        n = self.extension(x, y)
        end_x, end_y = n == self.size[x], n == self.size[y]
        last = len(self.text) - 1
        smaller = self.text[np.minimum(self.start[x] + n, last)] < self.text[np.minimum(self.start[y] + n, last)]
        return np.where(end_x, ~end_y | or_equal, ~end_y & smaller)

    def _sorted(self) -> np.ndarray:
        n = len(self.start)
        order = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = self.group[1:] != self.group[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, n))
        base, members = np.repeat(first, size), np.repeat(size, size)
        width = 1
        while len(size) and width < size.max():
            at = np.flatnonzero(members > width)  # places of groups that are not one run yet
            local = at - base[at]
            run = local // width
            end = base[at] + members[at]
            other = run ^ 1
            lo = np.minimum(base[at] + other * width, end)
            hi = np.minimum(lo + width, end)
            begin, item, right = lo.copy(), order[at], (run & 1).astype(bool)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                # of equal strings those of the left run come first
                before = self.less(order[mid], item[open_], right[open_])
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            pair = base[at] + (run >> 1) * 2 * width
            target = pair + (local - run * width) + (lo - begin)
            order[target] = item
            width *= 2
        return order

    def _neighbours(self, exact: bool = False) -> np.ndarray:
        """Common beginning of each string with the one before it in order; -1 at a group's first."""
        x, y = self.order[:-1], self.order[1:]
        out = np.full(len(self.order), -1, np.int64)
        same = np.flatnonzero(self.group[x] == self.group[y])
        out[same + 1] = self._by_bytes(x[same], y[same]) if exact else self.extension(x[same], y[same])
        return out

    def _by_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.minimum(self.size[x], self.size[y])
        n, going, last = np.zeros(len(x), np.int64), np.ones(len(x), bool), len(self.text) - 1
        for k in range(int(most.max(initial=0))):
            going &= (k < most) & (self.text[np.minimum(self.start[x] + k, last)] == self.text[np.minimum(self.start[y] + k, last)])
            if not going.any():
                break
            n += going
        return n

    def _verified(self) -> bool:
        """Are all neighbours in order, with extensions that the bytes confirm?"""
        same = np.flatnonzero(self.common >= 0)
        x, y = self.order[same - 1], self.order[same]
        n = self._by_bytes(x, y)
        last = len(self.text) - 1
        ends = n == self.size[x]
        rises = self.text[np.minimum(self.start[x] + n, last)] < self.text[np.minimum(self.start[y] + n, last)]
        return bool(((n == self.common[same]) & (ends | ((n < self.size[y]) & rises))).all())

    def classes(self, depth: int) -> np.ndarray:
        """Equal numbers for strings of a group that agree in their first ``depth`` bytes."""
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.cumsum(self.common < depth)
        return out


def _whole_groups(anchor: np.ndarray, size: np.ndarray) -> list[slice]:
    """Stretches of whole groups of equal anchors with about STEP bytes of contexts each."""
    end = np.append(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1, len(anchor))
    total = np.cumsum(size)[end - 1]
    out, i, done = [], 0, 0
    while i < len(end):
        j = max(i + 1, int(np.searchsorted(total, done + STEP, side="right")))
        out.append(slice(int(end[i - 1]) if i else 0, int(end[j - 1])))
        i, done = j, int(total[j - 1])
    return out


def extents(anchor, before, after, text, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context (by anchor): the least and largest distance before its anchor at which a
    string that another context holds too begins; (1, 0) if there is none."""
    n, spread = len(anchor), length - gram
    size = before.astype(np.int64) + after
    place = np.cumsum(size) - size + before
    _, group = np.unique(anchor, return_inverse=True)
    right = Suffixes(text, place, after.astype(np.int64), group)
    left = Suffixes(text[::-1].copy(), len(text) - place, before.astype(np.int64), group)
    least, most = np.full(n, 255, np.int64), np.full(n, -1, np.int64)
    for j in range(spread + 1):
        fits = np.flatnonzero((before >= j) & (after >= length - j))
        if len(fits) < 2:
            continue
        pair = right.classes(length - j)[fits] * (n + 1) + left.classes(j)[fits]
        _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
        hit = fits[count[back] > 1]
        least[hit] = np.minimum(least[hit], j)
        most[hit] = j
    none = most < 0
    return np.where(none, 1, least).astype(np.uint8), np.where(none, 0, most).astype(np.uint8)


def _sort(length: int, gram: int):
    def answer(key, table):
        noted = table.filter(pc.equal(table.column("kind"), NOTED))
        rows = []
        if parts := B.read(table, CONTEXTS):
            names = ("sorted", "before", "after")
            anchor, before, after = (np.concatenate([p[k] for _, _, p in parts]) for k in names)
            of = np.repeat(np.arange(len(parts)), [len(p["sorted"]) for _, _, p in parts])
            size = before.astype(np.int64) + after
            begin = np.cumsum(size) - size
            text = np.concatenate([p["text"] for _, _, p in parts])
            order = np.argsort(anchor, kind="stable")
            least, most = np.zeros(len(order), np.uint8), np.zeros(len(order), np.uint8)
            for some in _whole_groups(anchor[order], size[order]):
                o = order[some]
                joined = np.concatenate([text[a : a + s] for a, s in zip(begin[o].tolist(), size[o].tolist(), strict=True)])
                least[o], most[o] = extents(anchor[o], before[o], after[o], joined, length, gram)
            for i, (s, b, _) in enumerate(parts):
                rows.append((s, b, EXTENTS, B.packed(least=least[of == i], most=most[of == i])))
        parts = B.read(table, STRINGS)
        found = B.repeated([(p["sorted"], p["second"], p["more"]) for _, _, p in parts])
        rows += [(s, b, TWICE, B.packed(bits=x)) for (s, b, _), x in zip(parts, found, strict=True)]
        out = B.messages(rows)
        return pa.concat_tables([noted.select(out.schema.names).cast(out.schema), out])

    return answer


def _removed(block: Block, replies: pa.Table, length: int) -> np.ndarray:
    """Which bytes of the block a repeated string covers."""
    cover = np.zeros(len(block.data) + 1, np.int64)
    _, _, _, entry = block.keys
    state = np.concatenate([m["state"] for _, _, m in B.read(replies, NOTED)] or [np.zeros(0, np.uint8)])
    if not len(entry):
        return cover[:-1] > 0
    whole = np.flatnonzero(state[entry] & REPEATED)
    np.add.at(cover, block.first[whole], 1)
    np.add.at(cover, block.last[whole], -1)
    example = np.unique(entry, return_index=True)[1]
    e = np.flatnonzero(_to_sort(state))
    if len(e):
        found = B.read(replies, EXTENTS)
        least, most = (np.concatenate([m[k] for _, _, m in found]).astype(np.int64) for k in ("least", "most"))
        hit = least <= most
        place = block.place[example[e[hit]]]
        np.add.at(cover, place - most[hit], 1)
        np.add.at(cover, place - least[hit] + length, -1)
    start, first, second, _ = _strings(block, state, example, length)
    if len(start):
        _, _, _, at = B.distinct(first, second)
        hit = np.concatenate([m["bits"] for _, _, m in B.read(replies, TWICE)])[at]
        np.add.at(cover, start[hit], 1)
        np.add.at(cover, start[hit] + length, -1)
    return np.cumsum(cover[:-1]) > 0


def _cut(length: int, gram: int, text_out: bool, id_type: pa.DataType):
    def cut(key, table, replies):
        block = Block(table, length, gram)
        gone = _removed(block, replies, length)
        at = block.at
        total = np.concatenate(([0], np.cumsum(gone)))[at]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        starts = at[:-1][np.diff(at) > 0]
        first[starts] = gone[starts]
        spans = np.concatenate(([0], np.cumsum(first)))[at]
        kept = at - total
        left = block.data[~gone].tobytes()
        texts = [left[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
        out = {
            "doc_id": block.ids if table.num_rows else pa.array([], id_type),
            "n_bytes": pa.array(np.diff(at).astype(np.int64)),
            "n_removed": pa.array(np.diff(total).astype(np.int64)),
            "n_spans": pa.array(np.diff(spans).astype(np.int64)),
            "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
        }
        if text_out:
            out["kept"] = pa.array(texts, pa.binary())
        return pa.table(out)

    return cut


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), with ``texts`` also the bytes that stay."""
    if not 8 <= gram <= length <= 255 + gram or length - gram > 254:
        raise ValueError("gram must be at least 8 and length - gram between 0 and 254")
    rows, _, segments, _ = B.dealt(docs)
    by_block = rows.groupBy("block")
    anchors = by_block.applyInArrow(_anchors(length, gram, segments), B.MESSAGE)
    states = anchors.repartition(segments, "segment").groupBy("segment").applyInArrow(_states, B.MESSAGE)
    sent = by_block.cogroup(states.groupBy("block")).applyInArrow(_contexts(length, gram, segments), B.MESSAGE)
    answers = sent.repartition(segments, "segment").groupBy("segment").applyInArrow(_sort(length, gram), B.MESSAGE)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
    cut = _cut(length, gram, texts, to_arrow_type(docs.schema["doc_id"].dataType))
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(cut, schema)
