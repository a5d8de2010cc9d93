"""Homomorphic multiset fingerprints of documents, with DataFrame functions only.

A document is the multiset of its paragraphs (lines split at \\n, empty ones included). Each
paragraph is hashed to a vector of 47 numbers, and a document's fingerprint is the sum of its
paragraphs' vectors modulo powers of two:

* 4 wide numbers modulo 2**62, hashed from the whole paragraph: they tell equality;
* 1 number modulo 2**62: how many pieces of up to eight words the paragraph has;
* 42 numbers of three lanes modulo 2**20 each: per lane, how many pieces have a hash bit set.
  A lane less half the number of pieces is a sum of random signs, so the product of two
  documents' lanes estimates how many pieces they share.

Sums do not depend on the order of paragraphs; `combine` adds the paragraphs of another text
and `remove` takes them away, without the rest of the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import SMALLEST, successors

WIDE, NARROW = 4, 42
_M62 = 2**62 - 1
_ONES = 1 | 1 << 21 | 1 << 42
_LANE = 2**20 - 1
_LANES = _LANE | _LANE << 21 | _LANE << 42
_PIECE = r"(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,8}"


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _sum(values: Column, part: Callable[[Column], Column], mask: int) -> Column:
    """Sum modulo the mask's powers; masked at every step, so it never leaves 63 bits."""
    return F.aggregate(values, _long(0), lambda acc, x: (acc + part(x)).bitwiseAND(mask))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with the fingerprint (array of 47 longs) of a text column; null counts as empty."""
    paragraphs = F.split(F.coalesce(F.col(text), F.lit("")), "\n")
    pieces = F.flatten(F.transform(F.col("_paragraphs"), lambda p: F.regexp_extract_all(p, F.lit(_PIECE), F.lit(0))))
    found = df.withColumn("_paragraphs", paragraphs).withColumn("_pieces", pieces)
    found = found.withColumn("_first", F.transform("_pieces", lambda p: F.xxhash64(p)))
    found = found.withColumn("_second", F.transform("_pieces", lambda p: F.xxhash64(p, F.lit(1))))
    wide = [
        _sum(F.col("_paragraphs"), lambda p, i=i: F.xxhash64(p, F.lit(i)).bitwiseAND(_M62), _M62) for i in range(WIDE)
    ]
    narrow = [
        _sum(F.col(source), lambda h, i=i: F.shiftrightunsigned(h, i).bitwiseAND(_ONES), _LANES)
        for source in ("_first", "_second")
        for i in range(NARROW // 2)
    ]
    vector = F.array(*wide, F.size("_pieces").cast("long"), *narrow)
    return found.withColumn(name, vector).drop("_paragraphs", "_pieces", "_first", "_second")


def _masks() -> Column:
    return F.array(*[_long(_M62)] * (WIDE + 1), *[_long(_LANES)] * NARROW)


def combine(a: Column, b: Column) -> Column:
    """The fingerprint of both documents' paragraphs together."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: x + y), _masks(), lambda s, m: s.bitwiseAND(m))


def remove(a: Column, b: Column) -> Column:
    """The fingerprint of `a` without the paragraphs of `b`.

    Each lane is raised by its modulus (the free bit above it) before the subtraction, so
    nothing is borrowed from the next lane.
    """
    raised = F.zip_with(a, _masks(), lambda x, m: x + F.when(m == _M62, _long(2**62)).otherwise(_long(_ONES << 20)))
    return F.zip_with(F.zip_with(raised, b, lambda x, y: x - y), _masks(), lambda s, m: s.bitwiseAND(m))


def _signs(vector: Column) -> Column:
    """Each lane as a signed sum of ±1: twice the count less the number of pieces."""
    pieces = F.element_at(vector, WIDE + 1)
    counts = F.flatten(
        F.transform(
            F.slice(vector, WIDE + 2, NARROW),
            lambda x: F.array(*[F.shiftright(x, s).bitwiseAND(_LANE) for s in (0, 21, 42)]),
        )
    )
    return F.transform(counts, lambda c: (F.pmod(c * 2 - pieces + 2**20, _long(2**21)) - 2**20).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def with_likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`df` with the likeness of two fingerprints: 1 for equal ones, else twice the shared pieces
    over all pieces, as estimated from 126 signs and held between 0 and 1."""
    found = df.withColumn("_a", _signs(F.col(a))).withColumn("_b", _signs(F.col(b)))
    found = found.withColumn("_ab", _dot(F.col("_a"), F.col("_b")))
    found = found.withColumn("_all", _dot(F.col("_a"), F.col("_a")) + _dot(F.col("_b"), F.col("_b")))
    share = F.when(F.col("_all") > 0, F.col("_ab") * 2 / F.nullif(F.col("_all"), F.lit(0.0))).otherwise(0.0)
    value = F.when(F.col(a) == F.col(b), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    return found.withColumn(name, value).drop("_a", "_b", "_ab", "_all")


def as_text(vector: Column) -> Column:
    """A fingerprint as lower-case hex, 16 digits a number."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def edited_fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of an edited copy and of the next document.

    The edited copy has its last quarter (rounded down, in code points) replaced by as many
    leading code points of the next document in ascending key, the first after the last. Null
    texts are empty; null keys come first, all of them as one key. Rows that repeat a key are
    all returned; as a next document, such a key stands for the smallest of its (leading text,
    fingerprint). Empty tables give an empty result; other columns are ignored.

    Texts are dealt once by key: both sides of the join below ask for the same columns of `own`,
    so Spark reuses its exchange. What moves on to the neighbour is the part that it needs.
    """
    base = df.select(
        F.coalesce(F.col(key).cast("long"), _long(SMALLEST)).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    quarter = F.floor(F.length("text") / 4)
    needs = base.groupBy("key").agg(F.max(quarter).alias("need"))
    order = successors(needs.select("key"))
    asked = needs.join(order, "key").select(F.col("next").alias("key"), F.col("key").alias("target"), "need")

    own = with_fingerprint(base, "text", "own").repartition("key")
    lent = (
        own.join(asked, "key")
        .select("target", F.struct(F.expr("substring(text, 1, int(need))").alias("lead"), "own").alias("after"))
        .groupBy("target")
        .agg(F.min("after").alias("after"))
        .withColumnRenamed("target", "key")
    )
    both = own.join(lent, "key").withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("_k", F.floor(F.col("n_chars") / 4).cast("int"))
    both = both.withColumn(
        "edited",
        F.concat(F.expr("substring(text, 1, int(n_chars - _k))"), F.expr("substring(after.lead, 1, _k)")),
    ).select("key", "n_chars", "edited", "own", F.col("after.own").alias("following"))
    both = with_fingerprint(both, "edited", "changed").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    both = with_likeness(with_likeness(both, "own", "changed", "near_edited"), "own", "following", "near_next")
    return both.select(
        F.nullif("key", _long(SMALLEST)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
