"""Secret scans through a trigram inverted index.

Every rule is a regular expression from which a Boolean query over three-byte strings is derived:
a text can only match where the query holds. Each Arrow batch of documents is one index segment:
the postings (trigram -> documents) of the trigrams that the rules ask for are built in one pass
over the bytes, the queries are answered by intersecting and uniting postings, and only the
candidates are verified with the expression. A rule without mandatory trigrams (``hex``) scans
every document. ASCII letters are folded in the index, so one query serves both cases.

Defined cases: a null or empty text has no spans; spans are code points, end exclusive; spans of
different kinds may overlap. Repeated rows are scanned each by itself; very long
texts are scanned whole; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre, _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .words import LOWER, as_bytes

#: kind, expression, the group whose length counts, the least length. The first three are the base
#: kinds: matches that are too short are dropped after matching, as they still use up their text.
RULES = [
    ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of 32 and more among the runs of [0-9a-f]+
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 0),
]
BASE = ("assign", "access", "hex")

# A query is True (every text), a trigram, or ("and" | "or", queries).


def _all_of(parts):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any_of(parts):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    return _any_of([_all_of([s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(op, arg, most: int) -> set[str] | None:
    """All strings of a node in lower case, or None if there are too many."""
    if op is sre.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if op is sre.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is sre.LITERAL and x < 128:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] < 128 and x[1] - x[0] < most:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= most else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3], most)[0]
    if op is sre.BRANCH:
        parts = [_sequence(b, most)[0] for b in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] != sre.MAXREPEAT and arg[1] <= 4:
        one = _sequence(arg[2], most)[0]
        if one is None:
            return None
        out, now = set(), {""}
        for n in range(arg[1] + 1):
            out |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in one}
            if len(now) > most:
                return None
        return out
    return {""} if op is sre.AT else None


def _sequence(nodes, most: int) -> tuple[set[str] | None, object]:
    """(all strings or None, query) of nodes in a row."""
    exact, whole, parts = {""}, True, []
    for op, arg in nodes:
        strings = _strings(op, arg, most)
        longer = None if strings is None else {a + b for a in exact for b in strings}
        if longer is not None and len(longer) <= most:
            exact = longer
            continue
        parts.append(_of_strings(exact))
        whole = False
        if strings is None:
            exact = {""}
            if op is sre.SUBPATTERN:
                parts.append(_sequence(arg[3], most)[1])
            elif op is sre.BRANCH:
                parts.append(_any_of([_sequence(b, most)[1] for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                inner = _sequence(arg[2], most)
                parts.append(_of_strings({s * arg[0] for s in inner[0]}) if inner[0] and arg[0] <= 4 else inner[1])
        else:
            # carry on from the last two letters, so trigrams across the border count
            exact = {s[-2:] for s in strings}
    parts.append(_of_strings(exact))
    return (exact if whole else None), _all_of(parts)


def trigram_query(pattern: str, most: int = 64):
    """The Boolean trigram query of an expression; True where nothing is mandatory."""
    return _sequence(_parser.parse(pattern), most)[1]


def trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _code(t: str) -> int:
    a, b, c = t.encode()
    return a << 16 | b << 8 | c


def code_table(codes: list[int]) -> np.ndarray:
    """Number from 1 of each wanted trigram, by its code; 0 for all others."""
    table = np.zeros(1 << 24, np.uint16)
    table[codes] = np.arange(1, len(codes) + 1)
    return table


class Segment:
    """The inverted index of a batch of texts, for the trigrams of ``table``."""

    def __init__(self, data: np.ndarray, at: np.ndarray, table: np.ndarray, n_codes: int, step: int = 1 << 20):
        self.table = table
        self.postings = np.zeros((n_codes + 1, len(at) - 1), bool)
        for lo in range(0, max(0, len(data) - 2), step):
            low = LOWER[data[lo : lo + step + 2]].astype(np.uint32)
            number = table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            hit = np.flatnonzero(number)
            text = np.searchsorted(at, hit + lo, side="right") - 1
            inside = hit + lo + 3 <= at[text + 1]
            self.postings[number[hit[inside]], text[inside]] = True

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.ones(self.postings.shape[1], bool)
        if isinstance(query, str):
            return self.postings[self.table[_code(query)]]
        parts = [self.candidates(q) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def _scan(rules) -> callable:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = [(kind, re.compile(p), trigram_query(p), group, least) for kind, p, group, least in rules]
        codes = sorted({_code(t) for *_, query, _, _ in plan for t in trigrams(query)})
        table = code_table(codes)
        for batch in it:
            column = batch.column("text")
            segment = Segment(*as_bytes(column), table, len(codes))
            spans: dict[int, list] = {}
            for n, (kind, expression, query, group, least) in enumerate(plan):
                for i in np.flatnonzero(segment.candidates(query)):
                    text = column[int(i)].as_py()
                    for m in expression.finditer(text or ""):
                        if m.end(group) - m.start(group) >= least:
                            spans.setdefault(int(i), []).append((m.start(), n, m.end(), kind))
            found = [
                [{"kind": k, "start": a, "end": b} for a, _, b, k in sorted(spans.get(i, ()))] for i in range(len(column))
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, SPAN_TYPE)], names=[*batch.schema.names, "spans"]
            )

    return batches


SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, rules=None) -> DataFrame:
    """(doc_id, text, spans): the spans of each whole text by start, then rule order."""
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scan(rules or RULES), f"doc_id {kind}, text string, spans {SPAN}")


def joined(spans, kinds=None):
    """kind:start:end of the spans, comma-joined."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, and all spans."""
    spans = F.col("spans")

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return find_secrets(docs).select(
        "doc_id", *map(count, BASE), F.sha2(joined(spans, BASE), 256).alias("base_sha256"), joined(spans).alias("spans")
    )


def _redact(rules, mark: str) -> callable:
    scan = _scan(rules)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(it):
            names, columns = batch.schema.names[:-1], list(batch.columns[:-1])
            texts = columns[names.index("text")].to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if not spans:
                    continue
                out, at = [], 0
                for s in spans:
                    if s["start"] >= at:
                        out += [texts[i][at : s["start"]], mark]
                    at = max(at, s["end"])
                texts[i] = "".join(out) + texts[i][at:]
            columns[names.index("text")] = pa.array(texts, batch.column("text").type)
            yield pa.RecordBatch.from_arrays([*columns, batch.column("spans")], names=[*names, "spans"])

    return batches


def redact(docs: DataFrame, rules=None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark`` (overlapping spans by one); n_chars follows.

    No document is dropped; texts without spans stay as they are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    schema = T.StructType([*rows.schema.fields, T.StructField("spans", T._parse_datatype_string(SPAN))])
    done = rows.mapInArrow(_redact(rules or RULES, mark), schema)
    changed = F.size("spans") > 0
    out = []
    for c in docs.columns:
        old = F.col("_row").getField(c)
        new = {"text": F.col("text"), "n_chars": F.char_length("text")}.get(c)
        kind = docs.schema[c].dataType
        out.append(old.alias(c) if new is None else F.when(changed, new.cast(kind)).otherwise(old).alias(c))
    return done.select(*out)


