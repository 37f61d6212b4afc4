"""Plain Python versions of the corpus operators for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def struck_words(texts, n=35):
    """[(n_words, n_removed, kept)]"""
    words = [WORD.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def struck_bytes(texts, n=200):
    """[(n_bytes, n_removed, n_spans, kept)]"""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        gone = [False] * (len(b) + 1)
        reach = 0
        for i in range(len(b)):
            if i + n <= len(b) and count[b[i : i + n]] > 1:
                reach = i + n
            gone[i] = i < reach
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        out.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=False) if not g)))
    return out


def shingles(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w else []))


def groups(nodes, links):
    """node -> its component (the members)."""
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[top(a)] = top(b)
    out = defaultdict(set)
    for n in nodes:
        out[top(n)].add(n)
    return {n: out[top(n)] for n in nodes}


def near_groups(texts, percent=85):
    """Row numbers -> the row numbers of their group."""
    sets = [shingles(t) for t in texts]
    links = [
        (i, j)
        for i in range(len(sets))
        for j in range(i)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    return sets, groups(range(len(sets)), links)


ASSIGN = re.compile(
    r"""((?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
OTHERS = [
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"gh[opsur]_[A-Za-z0-9]{36,}",
    r"xox[abprs]-[A-Za-z0-9-]{10,}",
    r"AIza[A-Za-z0-9_-]{35}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+",
]


def base_spans(text):
    """[(start, order, end, kind)] of the base kinds."""
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def redacted(text, mark="[SECRET]"):
    if text is None:
        return None
    spans = sorted([(a, b) for a, _, b, _ in base_spans(text)] + [m.span() for p in OTHERS for m in re.finditer(p, text)])
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + mark
        at = max(at, b)
    return out + text[at:]


def targets(sizes: dict, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0) -> dict:
    """source -> target, by raising the level until none is above its top."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = sum(weight[s] for s in order if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / rest if rest else 0.0
        above = {s for s in order if s not in full and weight[s] * level >= most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in order}
        full |= above


def copies(rows) -> list[int]:
    """How often the mix takes each (doc_id, text, source) row."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    by = defaultdict(int)
    for (_, _, s), n in zip(rows, size, strict=True):
        by[s] += n
    target, out = targets(dict(by)), [0] * len(rows)
    for s in by:
        rate = round(target[s] / by[s] * 10**9) if by[s] else 0
        at = int(hashlib.md5(("mix" + (s or "")).encode()).hexdigest()[:8], 16) % 10**9
        mine = [i for i, r in enumerate(rows) if r[2] == s]
        key = lambda i: (size[i], hashlib.md5(("" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest(), rows[i][0] or 0)
        for i in sorted(mine, key=key):
            out[i] = (at + rate) // 10**9 - at // 10**9
            at += rate
    return out


def plain(df) -> list[tuple]:
    """The five columns of documents, with repeats."""
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(texts, items, n=10):
    """[(n_words, hit word numbers, names of the items that occur, is one without a name among them)]"""
    windows = defaultdict(set)
    for name, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        for i in range(max(len(w) - n + 1, 1) if w else 0):
            windows[tuple(w[i : i + n])].add(name)
    out = []
    for text in texts:
        w, hit, names = TERM.findall((text or "").translate(LOWER)), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                found = windows.get(tuple(w[i : i + k]))
                if found:
                    hit.update(range(i, i + k))
                    names |= found
        out.append((len(w), hit, names - {None}, None in names))
    return out


def longest(texts, items, least):
    """(item, word) -> (length, the (document number, word) of all longest matches)."""
    words = [TERM.findall((t or "").translate(LOWER)) for t in texts]
    out = {}
    for name, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        for j in range(len(w) - least + 1):
            best, places = 0, set()
            for d, x in enumerate(words):
                for p in range(len(x)):
                    k = 0
                    while j + k < len(w) and p + k < len(x) and w[j + k] == x[p + k]:
                        k += 1
                    if k > best:
                        best, places = k, set()
                    if k == best:
                        places.add((d, p))
            if best >= least:
                out[name, j] = (best, places)
    return out


def fill_middle(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def merkle(rows, fanout=16):
    """[(row, leaf, subroot, root, proof, folded root)] for rows (doc_id, text, lang, source, n_chars)."""
    import zlib

    def climb(digests):
        """The levels of a tree, from the leaves to the top."""
        out = [digests]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + fanout])) for i in range(0, len(out[-1]), fanout)])
        return out

    def siblings(tree, i):
        """[(before, after)] level by level."""
        out = []
        for level in tree[:-1]:
            run = i // fanout * fanout
            out.append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
            i //= fanout
        return out

    def fields(doc_id, text, lang, source, n_chars):
        return leaf((doc_id, source, lang, n_chars, text))

    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, fields(*r)))
    trees = {s: climb([fields(*r) for r in by[s]]) for s in order}
    upper = climb([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = siblings(trees[s], i) + siblings(upper, k)
            wrong = r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            at = fields(r[0], r[1].translate(LOWER), *r[2:]) if wrong else fields(*r)
            for a, b in path:
                at = sha(a + at + b)
            out.append((r, fields(*r), trees[s][-1][0], upper[-1][0], "".join(a + b for a, b in path), at))
    return out
