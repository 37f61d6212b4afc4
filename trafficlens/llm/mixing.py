"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / size of the source`` times. The expected copies
are summed along the source, one random offset is added, and a copy is emitted at each integer
that is crossed. A source is walked by document size, so the error of its words stays below its
largest document. Sums are exact (billionths of a copy as bigint), so reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows
that repeat are sampled each by itself; an empty table gives an empty mix; very long texts are counted whole; a source without words
has target 0 and no copies. Only the named columns are read, others pass through ``mix``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import keep
from .ranks import numbered, running, same

WORD = r"[^\x20\x09-\x0D]+"
UNIT = 1_000_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0
) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes, dealt by repeating ``weights``.

    No target exceeds ``most`` times its source; what is cut off is dealt again by weight among
    the others until nothing is above. Each round is one sum over the sources, on the executors.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("bigint").alias("one"))
    ranked = running(by, "one", [], [F.col("source").asc_nulls_last()], "place")
    which = F.array(*[F.lit(float(w)) for w in weights])
    at = (F.col("place") % len(weights) + 1).cast("int")
    table = keep(
        ranked.select("source", "source_size", F.element_at(which, at).alias("weight"), (most * F.col("source_size")).alias("top")),
        "sources",
    )
    level = 0.0
    total = table.agg(F.sum("source_size")).first()[0] or 0
    while total:
        full = F.col("weight") * F.lit(level) >= F.col("top")
        cut, rest = table.agg(
            F.sum(F.when(full, F.col("top")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        new = (share * total - cut) / rest if rest else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("weight") * F.lit(level), F.col("top"))
    return table.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str) -> Column:
    """The random offset of a source, in billionths."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("bigint") % UNIT


def systematic(sized: DataFrame, targets: DataFrame, seed: str = "mix") -> DataFrame:
    """Adds source_size, target, copies and taken to rows of (doc_id, size, source, ...)."""
    rate = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * UNIT)).otherwise(0)
    joined = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).select(
        *[sized[c] for c in sized.columns], "source_size", "target", rate.cast("bigint").alias("expected")
    )
    order = [F.col("size").asc(), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).asc(), F.col("doc_id").asc()]
    if "copy_no" in sized.columns:
        order.append(F.col("copy_no").asc())
    summed = running(joined, "expected", ["source"], order)
    shift = F.col("before") + offset(F.col("source"), seed)
    crossed = F.expr(f"(_shift + expected) div {UNIT} - _shift div {UNIT}")
    return (
        summed.withColumn("_shift", shift)
        .withColumn("copies", crossed)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("_shift", "before", "expected")
    )


def shares(docs: DataFrame, **how) -> DataFrame:
    """One row per document: how often the mix takes it, and its words taken."""
    sized = keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sized")
    return systematic(sized, source_targets(sized, **how))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves, a row per copy, with the columns of ``docs``.

    Rows are found again by (doc_id, number among the rows of that id), so ids may repeat.
    """
    whole = F.xxhash64(*docs.columns).alias("_all")
    sized = numbered(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), whole), "_all")
    sized = keep(sized.drop("_all"), "sized")
    chosen = systematic(sized, source_targets(sized, **how)).filter("copies > 0").select("doc_id", "copy_no", "copies")
    rows = numbered(docs.select("doc_id", F.struct(*docs.columns).alias("_row"), whole), "_all")
    return (
        rows.join(chosen, same(rows, chosen, ["doc_id", "copy_no"]))
        .select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("_row.*")
    )
