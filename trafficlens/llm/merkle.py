"""A Merkle manifest of a dataset, with proofs, by nested-interval labels.

Every row is a leaf: SHA-256 of its fields, each with its length before it. The leaves of a group
are ranked, and a node is labelled with the interval [lo, hi) of leaf ranks that it covers. While a
group has several nodes, each run of ``FANOUT`` neighbours becomes one node, so a node of level k
lies in the bucket lo div FANOUT**k. The top nodes of the groups are the leaves of one more tree.

* Parents are found by grouping on (tree, bucket): a group holds at most ``FANOUT`` nodes however
  large its tree is, so a hot source covers as many tasks as it needs.
* From the top down, each node joins the parent whose bucket it lies in and whose interval contains
  its own. Its siblings are the parent's interval without its own: those that end at or before its
  lo, and those that begin at or after its hi. A node's path is its siblings level by level, up to
  the root; a leaf gets it from one join, as its parent brings the rest.
* ``fold`` recomputes the root from a digest and a path.

Defined cases: null fields are written ``-`` and differ from empty ones; rows without a group are a
group of their own, first in order; null ids come first in their group; rows that tie in the id are
ordered by their digest, and rows that are equal are leaves of their own, in any order, with the
same digests; a group of one row has that leaf as its top node, and a table of one group that
group's top node as its root; very long texts are hashed whole; an empty table gives no rows. Only
the named columns are read, others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import keep
from .ranks import running

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds the label [lo, hi) of each leaf: its rank in its tree."""
    one = rows.withColumn("one", F.lit(1).cast("bigint"))
    return running(one, "one", ["tree"], order, "lo").withColumn("hi", F.col("lo") + 1).drop("one")


def parents(nodes: DataFrame, span: int) -> DataFrame:
    """The nodes (tree, lo, hi, digest, children) that cover ``span`` leaf ranks each.

    The only node of a tree stays as it is; a last run of one node becomes a new node.
    """
    bucket = F.floor(F.col("lo") / span).alias("bucket")
    held = F.array_sort(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children")
    runs = nodes.groupBy("tree", bucket).agg(held)
    alone = (F.col("bucket") == 0) & (F.size("children") == 1)
    return runs.select(
        "tree",
        F.col("children")[0]["lo"].alias("lo"),
        F.element_at("children", -1)["hi"].alias("hi"),
        F.when(alone, F.col("children")[0]["digest"]).otherwise(F.sha2(F.array_join("children.digest", ""), 256)).alias("digest"),
        "children",
        alone.alias("alone"),
    )


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The nodes above the leaves, level by level; in the last one each tree has one node."""
    sizes = leaves.groupBy("tree").agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    out, nodes, span = [], leaves.select("tree", "lo", "hi", "digest"), 1
    while span < largest:
        span *= fanout
        out.append(keep(parents(nodes, span), "merkle_level"))
        nodes = out[-1]
    return out


def attach(nodes: DataFrame, above: DataFrame, span: int) -> DataFrame:
    """Adds path and what else ``above`` carries: each node joins the parent that contains it."""
    p = above.select(
        F.col("tree").alias("p_tree"), F.floor(F.col("lo") / span).alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
        F.col("children").alias("p_children"), F.col("alone").alias("p_alone"), F.col("path").alias("p_path"), "top", "root",
    )
    inside = (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi"))
    joined = nodes.join(p, F.col("tree").eqNullSafe(F.col("p_tree")) & (F.floor(F.col("lo") / span) == F.col("p_bucket")) & inside)
    digests = lambda keep_: F.array_join(F.transform(F.filter("p_children", keep_), lambda c: c["digest"]), "")
    before = digests(lambda c: c["hi"] <= F.col("lo"))
    after = digests(lambda c: c["lo"] >= F.col("hi"))
    here = F.array(F.struct(before.alias("before"), after.alias("after")))
    return joined.select(
        *[nodes[c] for c in nodes.columns], F.when(F.col("p_alone"), F.col("p_path")).otherwise(F.concat(here, F.col("p_path"))).alias("path"), "top", "root"
    )


def descend(leaves: DataFrame, above: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Leaves with path, top and root: ``tops`` (tree, path, top, root) are carried down the levels."""
    bring = tops.select(F.col("tree").alias("t_tree"), "path", "top", "root")
    first = above[-1] if above else leaves
    found = first.join(bring, F.col("tree").eqNullSafe(F.col("t_tree"))).drop("t_tree")
    for level in range(len(above) - 1, -1, -1):
        found = attach(above[level - 1] if level else leaves, found, fanout ** (level + 1))
    return found


PATH = "array<struct<before:string,after:string>>"


def manifest(rows: DataFrame, order: list[Column], fanout: int = FANOUT) -> DataFrame:
    """Every leaf with its path, the top node of its group and the root.

    ``rows`` hold tree (the group), digest and what is to be carried along; they are written once.
    """
    # the serial spreads rows that are equal over several ranges
    serial = rows.withColumn("serial", F.monotonically_increasing_id())
    leaves = keep(ranked(serial, [*order, F.col("digest"), F.col("serial")]).drop("serial"), "merkle_leaves")
    above = levels(leaves, fanout)
    tops = (above[-1] if above else leaves).select(F.col("tree").alias("group"), "digest")
    ordered = ranked(tops.withColumn("tree", F.lit(0)), [F.col("group").asc_nulls_first()])
    upper = levels(ordered, fanout)
    root = (upper[-1] if upper else ordered).select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"), F.col("digest").alias("root"))
    found = descend(ordered, upper, root, fanout)
    groups = keep(found.select(F.col("group").alias("tree"), "path", F.col("digest").alias("top"), "root"), "merkle_groups")
    return descend(leaves, above, groups, fanout)


def siblings(path: Column) -> Column:
    """The digests of a path, level by level and left to right, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, leaf, lambda acc, p: F.sha2(F.concat(p["before"], acc, p["after"]), 256))


def proofs(docs: DataFrame, claims: Column | None = None, fields=FIELDS, group: str = "source", order: str = "doc_id", fanout: int = FANOUT) -> DataFrame:
    """(order column, leaf, subroot, root, path, claim) of every row.

    ``claims`` is a digest to be checked in place of the leaf's own (null: its own).
    """
    claim = F.lit(None).cast("string") if claims is None else claims
    rows = docs.select(
        F.col(group).cast("string").alias("tree"), F.col(order).alias("key"), digest(*[F.col(f) for f in fields]).alias("digest"), claim.alias("claim")
    )
    found = manifest(rows, [F.col("key").asc_nulls_first()], fanout)
    return found.select(F.col("key").alias(order), F.col("digest").alias("leaf"), F.col("top").alias("subroot"), "root", "path", "claim")


def tampered(fields=FIELDS, every: int = 5) -> Column:
    """The leaf with the text's A-Z in lower case, for ids whose unsigned crc32 ``every`` divides; else null."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    values = [F.translate(f, upper, upper.lower()) if f == "text" else F.col(f) for f in fields]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % every == 0, digest(*values))
