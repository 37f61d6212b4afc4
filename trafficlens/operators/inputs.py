"""Inputs of embedding calls: one text or a list of texts per request."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import settings as S
from ..functions.numbers import chunk_no
from ..sources.documents import parsed_once


def read_inputs(df: DataFrame, col: str = "input") -> DataFrame:
    """The JSON ``input`` (a string or a list of strings) as ``texts array<string>``; null if neither.

    A list that holds anything but strings is none.
    """
    parsed = parsed_once(df, col, "_input")
    v = F.col("_input")
    # the type of a whole list would be merged from all its items, so it is asked of items and of the rest only
    items = F.try_variant_get(v, "$", "array<variant>")
    is_text = lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))
    texts = F.when(
        items.isNotNull(), F.when(F.forall(items, is_text), F.transform(items, lambda x: F.try_variant_get(x, "$", "string")))
    ).when(is_text(v), F.array(F.try_variant_get(v, "$", "string")))
    return parsed.withColumn("texts", texts).drop("_input")


def explode_inputs(
    df: DataFrame, max_inputs: int | None = S.MAX_SYNC_INPUTS, chunk: int = S.CHUNK_SIZES["gemini"], col: str = "input"
) -> tuple[DataFrame, DataFrame]:
    """Accepted texts with position and chunk number, and the rejected requests with the reason."""
    parsed = read_inputs(df, col)
    n = F.size("texts")
    too_many = F.lit(False) if max_inputs is None else n > F.lit(max_inputs)
    problem = F.when(F.col("texts").isNull(), "malformed").when(n == 0, "input empty").when(too_many, "too many inputs")
    tagged = parsed.withColumn("problem", problem)
    others = [c for c in df.columns if c != col]
    rows = tagged.filter(F.col("problem").isNull()).select(*others, F.posexplode("texts").alias("pos", "text"))
    return rows.withColumn("chunk", chunk_no(F.col("pos"), chunk)), tagged.filter(
        F.col("problem").isNotNull()
    ).select(*others, "problem")
