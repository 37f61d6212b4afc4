"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame functions only.

A text is the multiset of its paragraphs: the stretches that end with a line break or a mark such
as a full stop, comma or bar (``ENDS``); together they are the text, so nothing is left out. Each
paragraph is hashed to a wide vector, and the fingerprint is the sum of the vectors:

* ``EXACT`` lanes of 32 uniform bits modulo 2**32, for equality;
* 64 lanes modulo 2**32 for likeness: each adds the characters of the paragraphs that have its bit
  set; seen as signs, the sums have about the cosine of the two multisets weighted by length;
* the number of characters.

Sums do not depend on the order, and ``plus`` and ``minus`` insert or delete paragraphs without the
rest of the text. Equal texts have equal fingerprints.

Defined cases: a null text is empty; an empty text has the zero fingerprint, alike only to itself;
rows that repeat (id and text) follow one another in the order of the edited texts; very long texts
are hashed whole; an empty table gives no rows. Only doc_id and text are read; extra columns of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import keep
from .ranks import running

ENDS = r"(?<=[\n.;:!?|])"
EXACT = 8
LOW = 0xFFFFFFFF
PAIR = 0x100000001


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), ENDS, -1), lambda p: p != "")


def hashes(text: Column) -> Column:
    """128 bits and the characters of each paragraph."""
    bits = lambda p: (F.xxhash64(p).alias("a"), F.xxhash64(F.lit(1), p).alias("b"))
    return F.transform(paragraphs(text), lambda p: F.struct(*bits(p), F.char_length(p).cast("bigint").alias("n")))


def vector(hashed: Column) -> Column:
    """[characters, EXACT lanes, 32 pairs of likeness lanes], all bigint."""

    def exact(i):
        return F.aggregate(hashed, F.lit(0).cast("bigint"), lambda s, h: (s + F.xxhash64(h["a"], h["b"], i).bitwiseAND(LOW)).bitwiseAND(LOW))

    def pair(i):
        bits = lambda h: F.call_function("shiftright", h["a"], i).bitwiseAND(F.lit(PAIR))
        return F.aggregate(hashed, F.lit(0).cast("bigint"), lambda s, h: s + bits(h) * h["n"])

    return F.concat(
        F.array(F.aggregate(hashed, F.lit(0).cast("bigint"), lambda s, h: s + h["n"])),
        F.transform(F.sequence(F.lit(1), F.lit(EXACT)), exact),
        F.transform(F.sequence(F.lit(0), F.lit(31)), pair),
    )


def _combined(a: Column, b: Column, sign: int) -> Column:
    """Lane by lane modulo 2**32; a pair of lanes is combined half by half."""

    def lane(x, i):
        y = F.element_at(b, (i + 1).cast("int"))
        low = (x.bitwiseAND(LOW) + sign * y.bitwiseAND(LOW)).bitwiseAND(LOW)
        high = (F.shiftrightunsigned(x, 32) + sign * F.shiftrightunsigned(y, 32)).bitwiseAND(LOW)
        pairs = F.shiftleft(high, 32).bitwiseOR(low)
        return F.when(i == 0, x + sign * y).when(i <= EXACT, low).otherwise(pairs)

    return F.transform(a, lane)


def plus(a: Column, b: Column) -> Column:
    """The vector of both multisets together."""
    return _combined(a, b, 1)


def minus(a: Column, b: Column) -> Column:
    """The vector without the paragraphs of ``b``."""
    return _combined(a, b, -1)


def written(v: Column) -> Column:
    """The fingerprint as text: the lanes in hex."""
    lanes = F.transform(v, lambda x, i: F.lpad(F.lower(F.hex(x)), F.when((i > 0) & (i <= EXACT), 8).otherwise(16).cast("int"), F.lit("0")))
    return F.array_join(lanes, "")


def likeness(a: Column, b: Column) -> Column:
    """Cosine of the two multisets as far as the sign lanes tell, from 0 to 1."""

    def products(x: Column, y: Column) -> Column:
        n, m = x[0], y[0]

        def both(p, q):
            low = (2 * p.bitwiseAND(LOW) - n) * (2 * q.bitwiseAND(LOW) - m)
            high = (2 * F.shiftrightunsigned(p, 32) - n) * (2 * F.shiftrightunsigned(q, 32) - m)
            return low.cast("double") + high.cast("double")

        lanes = F.zip_with(F.slice(x, EXACT + 2, 32), F.slice(y, EXACT + 2, 32), both)
        return F.aggregate(lanes, F.lit(0.0), lambda s, t: s + t)

    length = F.sqrt(products(a, a)) * F.sqrt(products(b, b))
    cosine = F.when(length > 0, products(a, b) / length).otherwise(0.0)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine)))


def _ring(rows: DataFrame) -> DataFrame:
    """(a, b, next_a, next_b, n_chars, copies): classes of equal rows by descending doc_id, in a ring."""
    same = rows.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.min("n_chars").alias("n_chars"), F.count("*").alias("copies"))
    same = same.withColumn("one", F.lit(1).cast("bigint"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("a").asc(), F.col("b").asc()]
    placed = keep(running(same, "one", [], order, "place"), "order")
    n = max(placed.count(), 1)
    nexts = placed.select(F.col("a").alias("next_a"), F.col("b").alias("next_b"), F.col("place").alias("next_place"))
    ring = placed.join(nexts, (F.col("place") + 1) % F.lit(n) == F.col("next_place"))
    return keep(ring.select("a", "b", "next_a", "next_b", "n_chars", "copies"), "ring")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Whole texts are shuffled once, by a hash of the row; to its predecessor a document sends only
    the beginning that the edit needs, and its vector.
    """
    text = F.coalesce("text", F.lit(""))
    key = (F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(7), "text", "doc_id").alias("b"))
    rows = docs.select("doc_id", text.alias("text"), *key)
    ring = _ring(rows.select("doc_id", "a", "b", F.char_length("text").cast("bigint").alias("n_chars")))
    hashed = rows.withColumn("hashed", hashes(F.col("text")))
    vectors = hashed.select("doc_id", "text", "a", "b", vector(F.col("hashed")).alias("vector"))
    # one shuffle serves both sides: a row is read as itself and as the next one of another
    same_row = Window.partitionBy("a", "b").orderBy("a")
    numbered = vectors.withColumn("earlier", F.row_number().over(same_row) - 1)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    heads = numbered.filter("earlier = 0").join(ring.withColumnsRenamed({"a": "of_a", "b": "of_b", "next_a": "a", "next_b": "b"}), ["a", "b"])
    heads = heads.select(
        F.col("of_a").alias("a"), F.col("of_b").alias("b"), "n_chars", "copies", F.col("doc_id").alias("next_id"),
        F.col("vector").alias("next_vector"), F.substring("text", F.lit(1), half).alias("head"),
    )
    both = numbered.join(heads, ["a", "b"])
    # of equal rows each but the last has its equal as the next one
    again = F.col("earlier") + 1 < F.col("copies")
    head = F.when(again, F.substring("text", F.lit(1), half)).otherwise(F.col("head"))
    first = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    both = both.select(
        "doc_id", "n_chars", "vector",
        F.when(again, F.col("doc_id")).otherwise(F.col("next_id")).alias("next_id"),
        F.when(again, F.col("vector")).otherwise(F.col("next_vector")).alias("next_vector"),
        F.concat(first, head).alias("edited"),
    )
    both = both.select("*", F.sha2("edited", 256).alias("edited_sha256"), hashes(F.col("edited")).alias("hashed"))
    done = both.withColumn("edited_vector", vector(F.col("hashed")))
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        written(F.col("vector")).alias("fingerprint"),
        written(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
        "next_id",
    )
