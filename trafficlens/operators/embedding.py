"""Embedding of texts by a pluggable embedder, and batch embedding jobs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from .. import settings as S
from ..session import scratch_path

# A factory builds the embedder once per task; the embedder maps (texts, model) to vectors.
Embedder = Callable[[list[str], str | None], np.ndarray]
EmbedderFactory = Callable[[], Embedder]

_SPACE = np.isin(np.arange(256), [ord(c) for c in " \t\n\r\f"])


def _words(texts: pa.LargeStringArray) -> tuple[np.ndarray, pa.LargeStringArray]:
    """All words of the texts and the number of the text that each is from."""
    if not len(texts):
        return np.zeros(0, np.int64), pa.array([], pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    # a text begins a word even where the one before it ends without a space
    begins = ends[:-1][ends[:-1] < ends[1:]]
    starts[begins] = inside[begins]
    at = np.flatnonzero(starts)
    kept = np.cumsum(inside, dtype=np.int64)
    offsets = np.append(kept[at] - 1, kept[-1:])
    offsets = offsets if len(at) else np.zeros(1, np.int64)
    words = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return np.searchsorted(ends, at, side="right") - 1, words


def hashed_terms(dim: int = S.EMBEDDING_DIM) -> EmbedderFactory:
    """The default embedder: counts of lower-cased words hashed into ``dim`` places, unit length.

    Local and deterministic. A text without words has no direction and gets a zero vector.
    """

    def build() -> Embedder:
        places: dict[str, int] = {}

        def place(word: str) -> int:
            return int.from_bytes(hashlib.md5(word.encode("utf-8")).digest()[:4], "big") % dim

        def embed(texts: list[str], model: str | None) -> np.ndarray:
            rows, words = _words(pc.utf8_lower(pa.array(texts, type=pa.large_string())))
            words = words.dictionary_encode()
            names = words.dictionary.to_numpy(zero_copy_only=False)
            if len(places) > 500_000:
                places.clear()
            found = [*map(places.get, names)]
            new = [k for k, p in enumerate(found) if p is None]
            for k in new:
                found[k] = places[names[k]] = place(names[k])
            at = np.array(found, dtype=np.int64)
            where = at[words.indices.to_numpy()] if len(at) else np.zeros(0, dtype=np.int64)
            out = np.bincount(rows * dim + where, minlength=len(texts) * dim).reshape(len(texts), dim)
            length = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
            return (out / np.where(length > 0, length, 1.0)).astype(np.float32)

        return embed

    return build


def embed_udf(factory: EmbedderFactory, model: str | None = None, batch: int = S.CHUNK_SIZES["openai"]):
    """A column function text -> array<float>; the embedder sees at most ``batch`` texts per call."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def embed(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = factory()
        for texts in column:
            there = texts.is_valid().to_numpy(zero_copy_only=False)
            known = texts.filter(there)
            made = [embedder(known.slice(at, batch).to_pylist(), model) for at in range(0, len(known), batch)]
            lengths = np.zeros(len(texts), np.int32)
            lengths[there] = [len(v) for part in made for v in part]
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int32)])
            # a null in front of its end makes a list null
            offsets = pa.array(ends, pa.int32(), mask=np.append(~there, False))
            flat = np.concatenate([np.ravel(v) for part in made for v in ([part] if isinstance(part, np.ndarray) else part)] or [[]])
            yield pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float32()))

    # keeps the optimizer from moving filters on the vectors, and so a second run, below a distinct
    return embed.asNondeterministic()


def embed_prompts(
    rows: DataFrame, factory: EmbedderFactory, text: str = "text", keys: tuple[str, ...] = ("model",), batch: int = 512
) -> DataFrame:
    """Vectors of the distinct texts per key; each text is embedded once, however often it is asked.

    Texts without words (zero vectors) are left out: they have no distance to anything.
    """
    distinct = rows.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keys, text).distinct()
    vec = embed_udf(factory, batch=batch)(F.col(text))
    return distinct.withColumn("vec", vec).filter(F.exists("vec", lambda x: x != 0))


def _embed_chunk(factory: EmbedderFactory):
    """One call: the texts of one chunk of one job, in order."""
    made = []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if not made:
            made.append(factory())  # once per task
        pdf = pdf.sort_values("pos")
        vectors, error = [None] * len(pdf), None
        try:
            vectors = list(made[0](pdf["text"].tolist(), pdf["model"].iat[0]))
        except Exception as e:  # whatever the embedder raises fails the job
            error = str(e) or type(e).__name__
        return pd.DataFrame({"job_id": pdf["job_id"], "pos": pdf["pos"], "vec": vectors, "error": error})

    return run


def run_embedding_jobs(
    jobs: DataFrame, inputs: DataFrame, factory: EmbedderFactory, sizes: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Run batch embedding jobs: (result per job, vectors).

    ``jobs``: job_id, provider, model. ``inputs``: job_id, pos, text, one row per text, so that a
    job with very many texts is spread over all tasks and never gathered in one. A call gets the
    texts of one chunk (``pos`` divided by the provider's chunk size), so calls and errors do not
    depend on the partitions. Any failing call fails the whole job and discards its vectors; the
    error of the first failing chunk is kept. A provider without a chunk size has the least. The
    vectors stay in long form, ordered by ``pos`` within the job.
    """
    spark = jobs.sparkSession
    sizes = sizes or S.CHUNK_SIZES
    known = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])
    size = F.coalesce(F.try_element_at(known, F.col("provider")), F.lit(min(sizes.values())))
    work = inputs.join(jobs.select("job_id", "provider", "model"), "job_id").select(
        "job_id", "pos", "text", "model", F.floor(F.col("pos") / size).alias("chunk")
    )
    id_type = inputs.schema["job_id"].dataType.simpleString()
    path = scratch_path(spark, "embedded")
    # both results read the vectors, so they are computed once and kept in the shared folder
    work.groupBy("job_id", "chunk").applyInPandas(
        _embed_chunk(factory), f"job_id {id_type}, pos int, vec array<float>, error string"
    ).write.parquet(path)
    embedded = spark.read.parquet(path)
    outcome = embedded.groupBy("job_id").agg(
        F.count("*").alias("n"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"),
        F.max(F.when(F.col("pos") == 0, F.size("vec"))).alias("dimensions"),
    )
    ok = F.col("error").isNull()
    results = jobs.join(outcome, "job_id", "left").select(
        *[c for c in jobs.columns if c not in ("status", "error")],
        F.when(ok, "succeeded").otherwise("failed").alias("status"),
        F.when(ok, F.coalesce("n", F.lit(0))).alias("count"),
        F.when(ok, F.coalesce("dimensions", F.lit(0))).alias("dimensions"),
        "error",
    )
    failed = outcome.filter(F.col("error").isNotNull()).select("job_id")
    vectors = embedded.join(failed, "job_id", "left_anti").select("job_id", "pos", "vec")
    return results, vectors
