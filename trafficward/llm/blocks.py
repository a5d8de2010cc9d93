"""Token ids in patched frame-of-reference blocks.

A token table has one row per segment: `part` and `seq` give the order, `n_ids` and `n_docs`
the sizes, `payload` the segment itself. Documents stand in ascending id and never span
segments. Spark's own writer commits the files, so a lost executor or a repeated task leaves
neither holes nor copies. A payload holds, little-endian:

    "PFB1", u32 ids per block, u64 ids, u64 documents
    u64 end of each document (in ids), i64 document ids, u8 1 where the id is null
    per block: u32 minimum, u8 width, u8 number of exceptions; u64 start of each block, and the end
    the blocks: ids less the minimum, `width` low bits each, packed from the low bit of 64-bit
    words; then the positions (u8) and high parts (u32) of the exceptions

The width is what the chosen percentile of a block's differences needs; what is above goes to
the block's exception list. The starts allow reading any range of ids alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import new_folder
from .common import parts_of, text_blocks
from .encoder import shared_encoder

BLOCK = 128
_HEAD = struct.Struct("<4sIQQ")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value below 2**32 needs (0 for 0)."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8) * (values > 0)


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for lengths[i] numbers each."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def pack_blocks(ids: np.ndarray, share: float = 0.9) -> bytes:
    """Block headers, starts and blocks of some ids; `share` is the percentile that chooses widths."""
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids) :] = ids[-1:] if len(ids) else 0
    full = full.reshape(n, BLOCK)
    least = full.min(axis=1) if n else np.zeros(0, np.uint32)
    over = full - least[:, None]
    rank = min(BLOCK - 1, max(0, int(np.ceil(share * BLOCK)) - 1))
    width = _bits(np.partition(over, rank, axis=1)[:, rank]) if n else np.zeros(0, np.uint8)
    high = over.astype(np.uint64) >> width[:, None].astype(np.uint64)
    row, place = np.nonzero(high)
    extra = np.bincount(row, minlength=n)
    starts = np.concatenate([[0], np.cumsum(width.astype(np.int64) * (BLOCK // 8) + extra * 5)])
    out = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        chosen = np.flatnonzero(width == w)
        low = np.ascontiguousarray(over[chosen].T).astype(np.uint64) & np.uint64((1 << int(w)) - 1)
        words = np.zeros((int(w) * BLOCK // 64, len(chosen)), np.uint64)
        for i in range(BLOCK):
            k, s = divmod(i * int(w), 64)
            words[k] |= low[i] << np.uint64(s)
            if s + int(w) > 64:
                words[k + 1] |= low[i] >> np.uint64(64 - s)
        flat = np.ascontiguousarray(words.T).view(np.uint8)
        out[starts[chosen][:, None] + np.arange(flat.shape[1])] = flat
    after = starts[:-1] + width.astype(np.int64) * (BLOCK // 8)
    order = np.arange(len(row)) - np.repeat(np.cumsum(extra) - extra, extra)
    out[after[row] + order] = place
    values = high[row, place].astype("<u4")
    out[(after[row] + extra[row] + 4 * order)[:, None] + np.arange(4)] = values.view(np.uint8).reshape(-1, 4)
    return b"".join(
        (least.astype("<u4").tobytes(), width.tobytes(), extra.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes(), out.tobytes())
    )


def unpack_blocks(data: memoryview, n_ids: int, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids from `first` up to `stop`; only the blocks that hold them are touched."""
    stop = n_ids if stop is None else stop
    n = -(-n_ids // BLOCK)
    least = np.frombuffer(data, "<u4", n)
    width = np.frombuffer(data, np.uint8, n, 4 * n)
    extra = np.frombuffer(data, np.uint8, n, 5 * n)
    starts = np.frombuffer(data, "<u8", n + 1, 6 * n).astype(np.int64)
    body = np.frombuffer(data, np.uint8, offset=6 * n + 8 * (n + 1))
    if stop <= first:
        return np.zeros(0, np.uint32)
    a, b = first // BLOCK, -(-stop // BLOCK)
    least, width, extra, starts = least[a:b], width[a:b], extra[a:b].astype(np.int64), starts[a:b]
    over = np.zeros((b - a, BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        chosen = np.flatnonzero(width == w)
        taken = body[starts[chosen][:, None] + np.arange(int(w) * BLOCK // 8)]
        words = np.ascontiguousarray(taken.view("<u8").T)
        low = np.empty((BLOCK, len(chosen)), np.uint64)
        for i in range(BLOCK):
            k, s = divmod(i * int(w), 64)
            low[i] = words[k] >> np.uint64(s)
            if s + int(w) > 64:
                low[i] |= words[k + 1] << np.uint64(64 - s)
        over[chosen] = (low & np.uint64((1 << int(w)) - 1)).T
    after = starts + width.astype(np.int64) * (BLOCK // 8)
    row = np.repeat(np.arange(b - a), extra)
    place = body[_spread(after, extra)]
    values = body[_spread(after + extra, 4 * extra)].view("<u4") if len(row) else np.zeros(0, np.uint32)
    over[row, place] |= values.astype(np.uint64) << width[row].astype(np.uint64)
    ids = (over + least[:, None].astype(np.uint64)).astype(np.uint32).reshape(-1)
    return ids[first - a * BLOCK : stop - a * BLOCK]


def pack_segment(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, share: float = 0.9) -> bytes:
    nulls = np.array([k is None for k in keys], np.uint8)
    numbers = np.array([0 if k is None else k for k in keys], "<i8")
    head = _HEAD.pack(b"PFB1", BLOCK, len(ids), len(keys))
    return head + np.cumsum(lengths).astype("<u8").tobytes() + numbers.tobytes() + nulls.tobytes() + pack_blocks(ids, share)


def open_segment(payload: bytes) -> tuple[list[int | None], np.ndarray, memoryview, int]:
    """Document ids, document ends, the blocks (for unpack_blocks) and the number of ids."""
    magic, block, n_ids, n_docs = _HEAD.unpack_from(payload)
    if (magic, block) != (b"PFB1", BLOCK):
        raise ValueError("not a token segment")
    at = _HEAD.size
    ends = np.frombuffer(payload, "<u8", n_docs, at).astype(np.int64)
    numbers = np.frombuffer(payload, "<i8", n_docs, at + 8 * n_docs).tolist()
    nulls = payload[at + 16 * n_docs : at + 17 * n_docs]
    return [None if z else k for k, z in zip(numbers, nulls)], ends, memoryview(payload)[at + 17 * n_docs :], n_ids


def write_tokens(
    df: DataFrame, path: str, vocabulary: str, spaced: bool, end: int,
    key: str = "doc_id", text: str = "text", segment_ids: int = 1 << 20, share: float = 0.9,
) -> None:
    """Encode whole texts and write them as a token table, in ascending key, nulls first.

    Null texts are empty and hold the end id alone. Rows with one key stand in order of text.
    An empty table writes no segments. A segment is closed at a document's end once it holds
    `segment_ids` ids, so a task holds one segment and one document at most.
    """
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    dealt = rows.repartitionByRange(parts_of(df.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary, spaced)
        keys, lengths, ids, held, seq, part = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            payload = pack_segment(keys, np.concatenate(lengths), flat, share)
            row = {"part": [part], "seq": [seq], "n_docs": [len(keys)], "n_ids": [len(flat)], "payload": [payload]}
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])
        for block, _, _ in text_blocks(batches):
            part = block.column("part")[0].as_py()
            found, per_text = encoder.encode(block.column("text").to_pylist(), end)
            keys += block.column("doc_id").to_pylist()
            lengths.append(per_text)
            ids.append(found)
            held += len(found)
            if held >= segment_ids:
                yield close()
                keys, lengths, ids, held, seq = [], [], [], 0, seq + 1
        if keys:
            yield close()

    dealt.withColumn("part", F.spark_partition_id()).mapInArrow(
        encode, "part int, seq int, n_docs long, n_ids long, payload binary"
    ).write.parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) per document of a token table.

    `start` counts the ids of all documents before. Segment sizes are summed per part, then over
    the parts (one row each); payloads are decoded where they are read.
    """
    table = spark.read.schema("part int, seq int, n_docs long, n_ids long, payload binary").parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    offsets = table.select("part", "seq", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)).alias("offset"))
    offsets = offsets.join(bases, "part").select("part", "seq", (F.col("base") + F.col("offset")).alias("base"))

    fields = [("part", pa.int32()), ("seq", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(*(batch.column(c) for c in ("part", "seq", "payload"))):
                keys, ends, data, n_ids = open_segment(payload.as_py())
                content = memoryview(unpack_blocks(data, n_ids).astype("<u4").tobytes())
                starts = np.concatenate([[0], ends[:-1]])
                cut = [content[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = {
                    "part": pa.repeat(part, len(keys)),
                    "seq": pa.repeat(seq, len(keys)),
                    "doc_id": keys,
                    "local": starts,
                    "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(x) for x in cut],
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": [bytes(x) for x in cut]} if with_ids else {}), schema=schema)

    kinds = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    rows = table.select("part", "seq", "payload").mapInArrow(decode, kinds)
    return rows.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids
    )


def encoded_documents(df: DataFrame, vocabulary: str = "word_bpe_49k.json", spaced: bool = False, end: int = 1) -> DataFrame:
    """Write a token table into the shared folder and read its documents back."""
    path = new_folder(df.sparkSession, "tokens")
    write_tokens(df, path, vocabulary, spaced, end)
    return read_documents(df.sparkSession, path)
