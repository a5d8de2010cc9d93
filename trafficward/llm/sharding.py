"""Jump consistent hashing: stable keys to shards without a ring table, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import numbered

_LOW = 2**32 - 1
_HALF = 2**16 - 1
#: Fixed value: the multiplier of the published generator, 2862933555777941757.
_MULTIPLIER = 2862933555777941757


def _step(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64 on two 32-bit halves; no product exceeds 62 bits."""
    m_hi, m_lo = _MULTIPLIER >> 32, _MULTIPLIER & _LOW
    top, bottom = m_lo >> 16, m_lo & _HALF
    a = lo * F.lit(bottom) + F.lit(1)
    b = lo * F.lit(top)
    low = a.bitwiseAND(_LOW) + F.shiftleft(b.bitwiseAND(_HALF), 16)
    carry = F.shiftright(a, 32) + F.shiftright(b, 16) + F.shiftright(low, 32)
    cross = hi * F.lit(bottom) + F.shiftleft((hi * F.lit(top)).bitwiseAND(_HALF), 16)
    high = carry + cross.bitwiseAND(_LOW) + (lo * F.lit(m_hi)).bitwiseAND(_LOW)
    return high.bitwiseAND(_LOW), low.bitwiseAND(_LOW)


def _walk(key: Column, shards: int, steps: int) -> Column:
    """State after at most `steps` jumps: the last bucket, the next one, and the generator."""
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(_LOW).alias("lo"),
    )

    def jump(s: Column, _: Column) -> Column:
        hi, lo = _step(s["hi"], s["lo"])
        next_j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(2**31)) / (F.shiftright(hi, 1) + 1).cast("double")))
        moved = F.struct(s["j"].alias("b"), next_j.cast("long").alias("j"), hi.alias("hi"), lo.alias("lo"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, jump)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard (int, 0 to shards − 1) of a 64-bit key; with one more shard, keys move only into it.

    Every jump goes at least one bucket ahead, so `shards` jumps always suffice; nearly all keys
    need a few, and only a key that is not done after 64 takes the long way. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    short = _walk(key, shards, min(shards, 64))
    if shards <= 64:
        return short["b"].cast("int")
    return F.when(short["j"] >= shards, short["b"]).otherwise(_walk(key, shards, shards)["b"]).cast("int")


def key_of(column: Column) -> Column:
    """A 64-bit key from any other stable value."""
    return F.xxhash64(column)


def assign_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), a row for each row.

    The key and the number of shards decide the shard; `grown_shard` is the shard with one more.
    `size` is the UTF-8 length plus 8 (null text: 8, crc32 0). `slot` counts from 0 inside a
    shard in order of key, then crc32 and size, so equal rows take neighbouring slots. A null
    key has the shard of key 0. An empty table gives an empty one; other columns are ignored.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    ).select(
        "*",
        F.lit("key").alias("law"),
        jump_shard(F.col("doc_id"), shards).alias("shard"),
        jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
    placed = numbered(rows, "shard", ["doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write_shards(df: DataFrame, path: str, shards: int, key: str = "doc_id") -> None:
    """Write the rows as one folder per shard; large shards are split over several files."""
    placed = df.withColumn("_shard", jump_shard(F.col(key), shards))
    spread = F.pmod(F.xxhash64(F.col(key)), F.lit(16))
    placed.repartition(F.col("_shard"), spread).write.partitionBy("_shard").parquet(path)
