"""Near-duplicate groups: universal hash minima, banding, verification, connected components.

A document's set is its distinct five-word shingles (ASCII letters in lower case). Documents with
equal sets form one class; everything below works on classes, so copies cost nothing.

* The signature is the minimum of each of ``HASHES`` universal hashes over the set; ``BANDS`` bands
  of it are the keys of buckets. At similarity 0.85 a pair shares no bucket once in 10**9.
* Pairs are tested in two steps, so that no bucket ever emits its pairs: every class with the
  leaders of its buckets (a leader is the member that shares the most buckets, which in a group of
  near copies is the one most others resemble); then, in buckets that still hold several
  components, the members outside the largest component with all others, chunk by chunk, by signatures
  and then, for members with a possible pair, by sets, where a task emits a link only between what it has not joined yet. A pair is tested in the first band
  that it shares only. This loses no link.
* A pair is tested by its signatures first (``DOUBT`` standard deviations below the threshold
  drop it) and then exactly on the full sets.
* Components of the confirmed links come from alternating large-star and small-star steps, each
  written to the shared folder.

Defined cases: a null text or one without words has an empty set, is linked with nothing and is
kept; with fewer words than a shingle the whole sequence is the only one; rows that repeat are one
class. A null doc_id is never the smallest unless its group has no other; an empty table gives no rows. Only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import keep
from .words import U, Words, as_bytes, mixed, runs

SHINGLE = 5
HASHES = 112
BANDS = 28
DOUBT = 7.0
STEP = 1 << 20
#: Members of a bucket that are compared in one piece of work.
CHUNK = 512
#: Rows of a class from which on they are joined with their group in SALTS parts.
MANY, SALTS = 256, 64


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(0, 1 << 63, n, np.uint64) << U(1) | U(1)
    return a, rng.integers(0, 1 << 63, n, np.uint64)


def shingle_sets(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in order, one text after the other, and offsets."""
    words = Words(data, at, lower=True)
    starts = words.windows(n)
    hashes = words.window_hash(starts, n)
    edge = np.searchsorted(starts, words.first)
    sets = []
    for i, (a, b) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)):
        if a < b:
            sets.append(np.unique(hashes[a:b]))
        elif words.per_text[i]:
            whole = words.hash()[words.first[i] : words.first[i + 1]]
            sets.append(mixed(np.array([int.from_bytes(xxhash.xxh3_64_digest(whole.tobytes()), "little")], U)))
        else:
            sets.append(hashes[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([*sets, hashes[:0]]), np.concatenate(([0], np.cumsum(sizes)))


def signatures(sets: np.ndarray, at: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Minima of the universal hashes (a*x + b) >> 32 over each non-empty set."""
    a, b = _multipliers(hashes)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((len(at) - 1, hashes), np.uint32)
    if len(full):
        for i in range(hashes):
            out[full, i] = np.minimum.reduceat((sets * a[i] + b[i]) >> U(32), at[full])
    return out


def profiles(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, n_shingles, node, signature): the class (a hash of the set) and its minima."""
    kind = dict(docs.dtypes)["doc_id"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, at = as_bytes(batch.column("text"))
            for i, j in runs(at, STEP):
                sets, edge = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
                size = np.diff(edge)
                empty = size == 0
                nodes = [xxhash.xxh3_128_digest(sets[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                minima = [s.tobytes() for s in signatures(sets, edge)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i),
                        batch.column("row_key").slice(i, j - i),
                        pa.array(size),
                        pa.array([None if e else x for e, x in zip(empty, nodes, strict=True)], pa.binary()),
                        pa.array([None if e else x for e, x in zip(empty, minima, strict=True)], pa.binary()),
                    ],
                    names=["doc_id", "row_key", "n_shingles", "node", "signature"],
                )

    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    return rows.mapInArrow(batches, f"doc_id {kind}, row_key bigint, n_shingles bigint, node binary, signature binary")


def bucket_members(classes: DataFrame) -> DataFrame:
    """(bucket, band, node, members) of the buckets that hold two classes or more."""
    width = 4 * HASHES // BANDS
    bands = classes.select("node", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "signature")
    bands = bands.select("band", F.expr(f"xxhash64(band, substring(signature, band * {width} + 1, {width}))").alias("bucket"), "node")
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    return bands.join(sizes, "bucket").select("bucket", "band", "node", "members")


def leader_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every class of a bucket with the bucket's leader."""
    shared = members.groupBy("node").agg(F.sum("members").alias("shared"))
    ranked = members.join(shared, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("shared", "node")).alias("top"))
    pairs = members.join(leaders, "bucket").select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    return pairs.filter("a <> b").distinct()


def _likely(threshold: float) -> float:
    return threshold - DOUBT * (threshold * (1 - threshold) / HASHES) ** 0.5


def with_estimates(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, estimate) of the pairs whose signatures leave the threshold possible."""
    sig = classes.select("node", "signature")
    a, b = (sig.withColumnsRenamed({"node": x, "signature": f"sig_{x}"}) for x in "ab")
    least = _likely(threshold)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            share = (x == y).mean(axis=1)
            kept = pa.array(np.flatnonzero(share >= least))
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").take(kept), batch.column("b").take(kept), pa.array(share).take(kept)], names=["a", "b", "estimate"]
            )

    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b")
    return joined.mapInArrow(batches, "a binary, b binary, estimate double")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of the classes named: one document of each is read again."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, at = as_bytes(batch.column("text"))
            for i, j in runs(at, STEP):
                sets, edge = shingle_sets(data[at[i] : at[j]], at[i : j + 1] - at[i], shingle)
                blobs = [sets[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node").slice(i, j - i), pa.array(blobs, pa.binary())], names=["node", "shingles"]
                )

    rows = classes.join(nodes, "node").select("node", "row_key")
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text")
    # a row that repeats would give the same set again; one of them is enough
    number = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    one = texts.join(rows, "row_key").withColumn("number", number).filter("number = 1")
    return one.select("node", "text").mapInArrow(batches, "node binary, shingles binary")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets?"""
    if len(x) < len(y):
        x, y = y, x
    if 100 * len(y) < percent * len(x):
        return False
    at = np.searchsorted(x, y)
    both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with 100 * intersection >= percent * union of their full sets."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            both = zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)
            good = pa.array([i for i, (x, y) in enumerate(both) if linked(np.frombuffer(x, U), np.frombuffer(y, U), percent)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(good) for c in ("a", "b")], names=["a", "b"])

    a, b = (sets.withColumnsRenamed({"node": x, "shingles": f"set_{x}"}) for x in "ab")
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(batches, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the least node that is reachable, for all nodes of the links (a, b).

    Alternates large-star and small-star until the links are stars.
    """
    edges = keep(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")

    def stars(e: DataFrame) -> bool:
        """Has every node that is the larger end of a link just that one link?"""
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(e.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        return ends.filter("up > 1 OR (up = 1 AND down > 0)").isEmpty()

    while not stars(edges):
        # large-star: the larger neighbours of a node move to its least neighbour or itself
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = keep(large, "large_star")
        # small-star: the smaller neighbours of a node, and the node, move to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = keep(moved.select("e.*").filter("a <> b").distinct(), "small_star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: only the components that these touch are joined anew."""
    a, b = (comps.withColumnsRenamed({"node": x, "root": f"root_{x}"}) for x in "ab")
    roots = links.join(a, "a", "left").join(b, "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")
    )
    moved = keep(components(roots), "joined").select(F.col("node").alias("root"), F.col("root").alias("top"))
    old = comps.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = moved.join(comps, moved["root"] == comps["node"], "left_anti")
    return old.union(new.select(F.col("root").alias("node"), F.col("top").alias("root")))


def _placed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members with their component, of the buckets that hold several components."""
    found = members.join(comps, "node", "left").withColumn("comp", F.coalesce("root", "node"))
    sides = found.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    return found.join(sides.select("bucket"), "bucket").select("bucket", "band", "node", "comp")


def _blobs(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def _cell(table: pa.Table, least: float):
    """The members of a pair of chunks: node, component number, minor, and for a minor member the others of
    another component that its signature leaves possible, the likeliest first."""
    node, band = table.column("node").to_pylist(), table.column("band")[0].as_py()
    comp = np.unique(np.array(table.column("comp").to_pylist(), object), return_inverse=True)[1]
    sig = np.stack(_blobs(table.column("signature"), np.uint32))
    minor = np.array(table.column("minor").to_pylist(), bool)
    rest = np.flatnonzero(~minor)

    def others(x: int) -> np.ndarray:
        other = rest[comp[rest] != comp[x]]
        same = sig[other] == sig[x]
        share = same.mean(axis=1)
        shared = same.reshape(len(other), BANDS, HASHES // BANDS).all(axis=2)
        near = np.flatnonzero((share >= least) & (shared.argmax(axis=1) == band))
        return other[near[np.argsort(-share[near], kind="stable")]]

    return node, comp, minor, others


def _possible(least: float):
    """The members of a pair of chunks that are in a pair which signatures leave possible, without their signatures."""

    def mark(key, table):
        _, _, minor, others = _cell(table, least)
        some = np.zeros(len(minor), bool)
        for x in np.flatnonzero(minor):
            near = others(x)
            some[near] = True
            some[x] = len(near) > 0
        return table.drop_columns(["signature"]).filter(pa.array(some))

    return mark


def _compare(percent: int, least: float):
    """Links between the members of a pair of chunks that join components, one for each join."""

    def compare(key, table):
        node, comp, minor, others = _cell(table, least)
        sets, a, b = _blobs(table.column("shingles"), U), [], []
        for x in np.flatnonzero(minor):
            for y in others(x):
                if comp[y] != comp[x] and linked(sets[x], sets[y], percent):
                    comp[comp == comp[y]] = comp[x]
                    a.append(node[x])
                    b.append(node[y])
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return compare


def open_links(members: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that join components: in buckets with several of them, members outside the
    largest one are compared with all others.

    Members are dealt into chunks of bounded size, and each pair of chunks is one piece of work. The first
    pass holds signatures alone and names the members that are in a pair they leave possible; only these are
    sent with their sets, to the second, which emits no more links than it has members.
    """
    placed = keep(_placed(members, comps), "open_buckets")
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("total"))
    chunk = F.floor(F.col("total") / CHUNK).cast("int") + 1
    few = F.floor((F.col("total") - F.col("top.n")) / CHUNK).cast("int") + 1
    marked = placed.join(largest, "bucket").select(
        "bucket", "band", "node", "comp", (F.col("comp") != F.col("top.comp")).alias("minor"),
        F.pmod(F.xxhash64("node"), chunk).cast("int").alias("any_no"),
        F.pmod(F.xxhash64("node"), few).cast("int").alias("minor_no"),
        chunk.alias("chunks"), few.alias("minors"),
    )
    numbers = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_any = F.transform(numbers("minors"), lambda i: F.struct(i.alias("i"), F.col("any_no").alias("j"), F.lit(False).alias("minor")))
    as_minor = F.transform(numbers("chunks"), lambda j: F.struct(F.col("minor_no").alias("i"), j.alias("j"), F.lit(True).alias("minor")))
    places = F.when(F.col("minor"), F.concat(as_any, as_minor)).otherwise(as_any)
    names, least = ["bucket", "i", "j", "minor", "band", "node", "comp"], _likely(percent / 100)
    signed = marked.join(classes.select("node", "signature"), "node").withColumn("at", F.explode(places))
    cells = signed.select("bucket", "at.i", "at.j", "at.minor", "band", "node", "comp", "signature")
    fields = ", ".join(f"{n} {t}" for n, t in cells.select(*names).dtypes)
    possible = keep(cells.groupBy("bucket", "i", "j").applyInArrow(_possible(least), fields), "possible")
    full = possible.join(classes.select("node", "signature"), "node").join(sets, "node").select(*names, "signature", "shingles")
    return full.groupBy("bucket", "i", "j").applyInArrow(_compare(percent, least), "a binary, b binary")


def near_duplicates(docs: DataFrame, percent: int = 85, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, row_key, n_shingles, root, component_id) of every row; root names the group, null for an empty set."""
    found = keep(profiles(docs, shingle), "profiles")
    own = found.filter("node IS NOT NULL").groupBy("node")
    classes = keep(
        own.agg(
            F.first("signature").alias("signature"), F.min("row_key").alias("row_key"), F.min("doc_id").alias("least_id"), F.count("*").alias("rows")
        ),
        "classes",
    )
    members = keep(bucket_members(classes), "members")
    sets = keep(full_sets(docs, classes, members.select("node").distinct(), shingle), "sets")
    likely = with_estimates(leader_pairs(members), classes, percent / 100)
    comps = keep(components(confirmed(likely, sets, percent)), "components")
    links = keep(open_links(members, comps, classes, sets, percent), "links")
    if not links.isEmpty():
        comps = keep(joined_components(comps, links), "components")
    ids = comps.join(classes.select("node", "least_id"), "node")
    smallest = ids.groupBy("root").agg(F.min("least_id").alias("linked_id"))
    linked = comps.join(smallest, "root").select("node", "root", "linked_id")
    labels = classes.select("node", "least_id", "rows").join(linked, "node", "left").select(
        "node", "rows", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("linked_id")).alias("component_id")
    )
    return labelled(found, labels)


def labelled(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row with the root and component of its class.

    Classes of many rows are few; they are joined first, on the class and a part of its rows, so that no
    task gets all copies of a text. Rows without a class are joined with nothing.
    """
    columns = ["doc_id", "row_key", "n_shingles", "root", "component_id"]
    many = keep(labels.filter(F.col("rows") >= MANY).drop("rows"), "large_classes")
    part = F.pmod("row_key", F.lit(SALTS)).cast("int")
    spread = many.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    first = found.filter("node IS NOT NULL").withColumn("part", part).join(spread, ["node", "part"], "left")
    copies = first.filter("root IS NOT NULL").select(*columns)
    others = first.filter("root IS NULL").drop("part", "root", "component_id").join(labels.filter(F.col("rows") < MANY).drop("rows"), "node")
    empty = found.filter("node IS NULL").select("doc_id", "row_key", "n_shingles", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("component_id"))
    return copies.unionByName(others.select(*columns)).unionByName(empty)


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of each group (the least doc_id, then the least row key) and all rows without words."""
    found = keep(near_duplicates(docs, percent), "near_duplicates")
    one = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("one"))
    chosen = one.select(F.col("one.row_key").alias("row_key"), F.lit(1).alias("most"))
    alone = found.filter("root IS NULL").select("row_key", F.lit(None).cast("int").alias("most")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.xxhash64("doc_id", "text").alias("row_key"))
    number = F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))
    kept = rows.withColumn("copy", number).join(chosen.union(alone), "row_key")
    return kept.filter("most IS NULL OR copy <= most").select("_row.*")
