"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontaminate,
    fill_middle,
    fingerprint,
    language,
    merkle,
    mixing,
    near_dedup,
    neighbours,
    packing,
    quality,
    secrets_scan,
    suffix_dedup,
    window_dedup,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.shares(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.strike_repeats(table(spark, sf_dir, "documents"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    return found.select("doc_id", "n_shingles", "component_id", kept)


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op8_neighbours_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of op8 next to those of the same search without its stopping test."""
    vectors, asked = table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0
    found = neighbours.recall(neighbours.nearest(vectors, asked), neighbours.nearest(vectors, asked, sure=1.0))
    return found.select("expected", (F.col("found") >= 0.9 * F.col("expected")).alias("good"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.secret_spans(table(spark, sf_dir, "documents"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decontaminate.n_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        (F.size("items") + F.col("nameless").cast("int")).cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transform(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.proofs(table(spark, sf_dir, "documents"), merkle.tampered())
    folded = merkle.fold(F.coalesce("claim", "leaf"), F.col("path"))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_suffix_dedup,
        op3_language,
        op4_quality,
        op5_window_dedup,
        op6_fingerprint,
        op7_near_dedup,
        op8_neighbours,
        op8_neighbours_recall,
        op9_packing,
        op10_secrets,
        op11_decontamination,
        op12_fill_middle,
        op13_merkle,
    )
}

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: Words, sources in order, targets by raising the level until no source is above its top, and the
#: integers crossed along each source by size.
_MIXING = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len({_WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0 * sum(size)::DOUBLE AS top,
    list_value(3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE)[1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)] AS weight
  FROM sized GROUP BY source),
total AS (SELECT 1.5 * sum(source_size)::DOUBLE AS share FROM sources),
levels AS (
  SELECT 0 AS round, 0.0::DOUBLE AS level
  UNION ALL
  SELECT round + 1, next FROM (
    SELECT l.round, l.level,
      (SELECT (any_value(t.share) - coalesce(sum(CASE WHEN weight * l.level >= top THEN top END), 0))
        / sum(CASE WHEN weight * l.level >= top THEN NULL ELSE weight END) FROM sources, total t) AS next
    FROM levels l) WHERE next > level),
final AS (SELECT max(level) AS level FROM levels),
targets AS (SELECT source, source_size, least(weight * level, top) AS target FROM sources, final),
rates AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(round(t.target / t.source_size * 1000000000) AS BIGINT) ELSE 0 END AS expected,
    CAST('0x' || substr(md5('mix' || coalesce(d.source, '')), 1, 8) AS BIGINT) % 1000000000 AS shift
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
summed AS (
  SELECT *, shift + coalesce(sum(expected) OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rates)
SELECT doc_id, size, source_size, target,
  CAST(((before + expected) // 1000000000 - before // 1000000000) * size AS BIGINT) AS taken,
  CAST((before + expected) // 1000000000 - before // 1000000000 AS BIGINT) AS copies
FROM summed"""

_WINDOWS = rf"""
WITH texts AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
words AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws)::BIGINT)) AS i FROM texts),
starts AS (
  SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 34 <= len(ws) THEN md5(array_to_string(ws[i:i + 34], ' ')) END AS w FROM words),
counted AS (SELECT *, w IS NOT NULL AND count(*) OVER (PARTITION BY w) > 1 AS again FROM starts),
marked AS (
  SELECT *, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS gone
  FROM counted)
SELECT t.doc_id, CAST(len(t.ws) AS BIGINT) AS n_words, CAST(coalesce(m.n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(m.kept, '')) AS kept_sha256
FROM texts t LEFT JOIN (
  SELECT doc_id, sum(gone::INT) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM marked GROUP BY doc_id) m
USING (doc_id)"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_NEAR = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1)::BIGINT)) AS i FROM texts WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * pairs.n >= 85 * (a.n + b.n - pairs.n)),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM texts
  UNION
  SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)"""

_HIT = rf"""
WITH texts AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1)::BIGINT)) AS i FROM items WHERE len(ws) > 0)),
starts AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws)::BIGINT)) AS i FROM texts), (SELECT DISTINCT n FROM windows)
  WHERE i + n - 1 <= len(ws)),
found AS (SELECT doc_id, i, n, item_id FROM starts JOIN windows USING (n, w)),
hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

_MIDDLE = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM texts),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


_LEAF = " || ".join(_field(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}"))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32 of the decimal digits, bit by bit.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda r, c: list_reduce(list_prepend(xor(r, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))))"""

#: Trees of the sources and of their top nodes, level by level; then every leaf climbs both.
_TREES = rf"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_LEAF.format(text="text")}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_LEAF.format(text=_LOWERED)}) END AS claim,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
nodes AS (
  SELECT source, 0 AS level, i, n, leaf AS digest FROM leaves
  UNION ALL
  SELECT source, any_value(level) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY i))
  FROM nodes WHERE n > 1 GROUP BY source, i // 16),
tops AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, i, n, subroot AS digest FROM tops
  UNION ALL
  SELECT any_value(level) + 1, i // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY i // 16),
climb AS (
  SELECT doc_id, source, 0 AS level, i, n, '' AS proof, coalesce(claim, leaf) AS folded FROM leaves
  UNION ALL
  SELECT c.doc_id, any_value(c.source), any_value(c.level) + 1, any_value(c.i) // 16, (any_value(c.n) + 15) // 16,
    any_value(c.proof) || coalesce(string_agg(d.digest, '' ORDER BY d.i) FILTER (d.i <> c.i), ''),
    sha256(string_agg(CASE WHEN d.i = c.i THEN c.folded ELSE d.digest END, '' ORDER BY d.i))
  FROM climb c JOIN nodes d ON d.source IS NOT DISTINCT FROM c.source AND d.level = c.level AND d.i // 16 = c.i // 16
  WHERE c.n > 1 GROUP BY c.doc_id),
rise AS (
  SELECT c.doc_id, 0 AS level, t.i, t.n, c.proof, c.folded FROM climb c JOIN tops t ON t.source IS NOT DISTINCT FROM c.source WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, any_value(c.level) + 1, any_value(c.i) // 16, (any_value(c.n) + 15) // 16,
    any_value(c.proof) || coalesce(string_agg(d.digest, '' ORDER BY d.i) FILTER (d.i <> c.i), ''),
    sha256(string_agg(CASE WHEN d.i = c.i THEN c.folded ELSE d.digest END, '' ORDER BY d.i))
  FROM rise c JOIN upper d ON d.level = c.level AND d.i // 16 = c.i // 16 WHERE c.n > 1 GROUP BY c.doc_id)
SELECT r.doc_id, l.leaf, t.subroot, u.digest AS root, sha256(r.proof) AS proof_sha256, r.folded AS folded_root, r.folded = u.digest AS verified
FROM rise r JOIN leaves l ON l.doc_id = r.doc_id JOIN tops t ON t.source IS NOT DISTINCT FROM l.source, (SELECT digest FROM upper WHERE n = 1) u
WHERE r.n = 1"""

#: Every 200-byte string of every text by its start, those that start twice, and what their runs leave.
_STRINGS = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
starts AS (
  SELECT r, unnest(range(octet_length(b) - 199)) AS i, b FROM texts WHERE octet_length(b) >= 200),
strings AS (SELECT r, i, md5_number(array_slice(b, i + 1, i + 200)) AS s FROM starts),
repeated AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
hit AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM strings JOIN repeated USING (s)),
heads AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS span FROM hit),
spans AS (SELECT r, span, min(i) AS first, max(i) + 200 AS past FROM heads GROUP BY 1, 2),
gaps AS (SELECT r, first, past, coalesce(lag(past) OVER (PARTITION BY r ORDER BY first), 0) AS done FROM spans),
cut AS (
  SELECT r, sum(past - first) AS n_removed, count(*) AS n_spans, max(past) AS last,
    string_agg(hex(array_slice(b, done + 1, first)), '' ORDER BY first) AS head
  FROM gaps JOIN texts USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || hex(array_slice(b, coalesce(last, 0) + 1, octet_length(b))))) AS kept_sha256
FROM texts LEFT JOIN cut USING (r)"""

#: How many neighbours there are, by brute force over all pairs of a query and a vector.
_FOUND = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.e, b.e) DESC, b.vec_id) AS rank
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT count(*) AS expected, true AS good FROM pairs WHERE rank <= 20"""

ORACLES: dict[str, str] = {
    "op1_mixing": _MIXING,
    "op2_suffix_dedup": _STRINGS,
    "op5_window_dedup": _WINDOWS,
    "op7_near_dedup": _NEAR,
    "op8_neighbours_recall": _FOUND,
    "op11_decontamination": _HIT,
    "op12_fill_middle": _MIDDLE,
    "op13_merkle": _TREES,
}
