"""Fill-in-the-middle: texts cut in three parts and put in another order for training.

A text is a sequence of units (by default code points). One ``fullmatch`` of ``(unit)*`` keeps
every repetition of the group, so ``ends(1)`` is the end of each unit: its length is the number n of
units, and both cuts are read off it. A text of more than ``PIECE`` characters is matched in
consecutive pieces of at most that many units, as each captured repetition takes about 120 bytes;
only the two pieces that hold the cuts are matched again.

Where a text is cut and which form it takes follows from SHA-256 of seed and id alone, so reruns
and recomputed tasks agree. ``restore`` rebuilds the exact text from output and form.

Defined cases: a null text is empty, and an empty text is plain; a null id counts as the empty
string; a text that holds one of the marks, or that is not a sequence of units, is plain; rows that
repeat give the same output again; very long texts are cut whole, piece by piece, in bounded
memory; an empty table gives no rows. Rows are handled one by one, so there are no ties. Only the
id and the text are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .words import runs

P, S, M = "<P>", "<S>", "<M>"
PIECE = 1 << 16
STEP = 1 << 22


class Units:
    """The units of texts, by the captures of one repeated group."""

    def __init__(self, unit: str = ".", piece: int = PIECE):
        self.whole = regex.compile(f"({unit})*", regex.DOTALL)
        self.some = regex.compile(f"({unit}){{1,{piece}}}+", regex.DOTALL)
        self.piece = piece

    def cuts(self, text: str, first: int, second: int) -> tuple[int, tuple[int, int], tuple[int, int]] | None:
        """n, and the unit counts and offsets of both cuts, at ``first`` and ``second`` modulo n + 1."""
        if len(text) <= self.piece:
            found = self.whole.fullmatch(text)
            if found is None:
                return None
            ends = [0, *found.ends(1)]
            n = len(ends) - 1
            a, b = sorted((first % (n + 1), second % (n + 1)))
            return n, (a, ends[a]), (b, ends[b])
        starts, before = [0], [0]  # of each piece: its offset, and the units before it
        while starts[-1] < len(text):
            found = self.some.match(text, starts[-1])
            if found is None or found.end() == starts[-1]:
                return None
            starts.append(found.end())
            before.append(before[-1] + len(found.ends(1)))
        n = before[-1]
        a, b = sorted((first % (n + 1), second % (n + 1)))
        return n, (a, self._offset(text, starts, before, a)), (b, self._offset(text, starts, before, b))

    def _offset(self, text: str, starts: list[int], before: list[int], units: int) -> int:
        i = int(np.searchsorted(before, units))  # the first piece that ends at or after the cut
        if before[i] == units:
            return starts[i]
        return self.some.match(text, starts[i - 1]).ends(1)[units - before[i - 1] - 1]


def transformed(text: str, key: str, seed: int, units: Units, plain: int, spm: int):
    """(n, form, units before the first cut, units between the cuts, output)."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    found = units.cuts(text, h[0], h[1])
    n = 0 if found is None else found[0]
    if not n or any(mark in text for mark in (P, S, M)) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    _, (a, i), (b, j) = found
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{S}{suffix}{P}{prefix}{M}{middle}"
    return n, "psm", a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}"


def transform(
    docs: DataFrame, seed: int = 1, unit: str = ".", plain: int = 10, spm: int = 20,
    id_col: str = "doc_id", text_col: str = "text", piece: int = PIECE,
) -> DataFrame:
    """(the id, n, form, prefix_units, middle_units, output) of every document.

    ``plain`` percent keep their order; of the others ``spm`` percent begin with the suffix.
    ``unit`` is a pattern without groups; units are taken from left to right without stepping back.
    """
    kind = dict(docs.dtypes)[id_col]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(unit, piece)
        names = ["n", "form", "prefix_units", "middle_units", "output"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in it:
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for i, j in runs(np.concatenate(([0], np.cumsum(size, dtype=np.int64))), STEP):
                part = batch.slice(i, j - i)
                rows = [
                    transformed(text or "", key or "", seed, units, plain, spm)
                    for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True)
                ]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    schema = f"id {kind}, n bigint, form string, prefix_units bigint, middle_units bigint, output string"
    return rows.mapInArrow(batches, schema).withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The exact text, rebuilt from output and form."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        a, b = F.instr(output, second), F.instr(output, M)
        own = F.lit(len(first) + 1)
        return F.substr(output, own, a - own), F.substr(output, a + len(second), b - a - len(second)), F.substr(output, b + len(M))

    prefix, suffix, middle = parts(P, S)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(S, P)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
