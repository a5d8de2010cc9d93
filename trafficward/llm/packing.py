"""Documents packed into token sequences by bounded-space online best fit."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stored, text_blocks
from .encoder import shared_encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_documents(
    df: DataFrame, vocabulary: str = "byte_bpe_50k.json", spaced: bool = True, end: int = 0, capacity: int = 2048,
    key: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and the end id, cut if longer
    than the capacity.

    Only the first piece of a cut document is shorter than the capacity. Null texts are empty
    (the end id alone); rows that repeat a key are each cut; other columns are ignored.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.binary())] * with_ids)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(vocabulary, spaced)
        for block, _, _ in text_blocks(batches):
            ids, per_text = encoder.encode(block.column("text").to_pylist(), end)
            content = memoryview(ids.astype("<u4").tobytes())
            rows = {f.name: [] for f in schema}
            begin = 0
            for doc, n in zip(block.column("doc_id").to_pylist(), per_text.tolist()):
                edges = [0, *range(n % capacity or capacity, n, capacity), n]
                for piece, (a, b) in enumerate(zip(edges, edges[1:])):
                    held = content[4 * (begin + a) : 4 * (begin + b)]
                    for name, value in zip(rows, (doc, piece, a, b - a, zlib.crc32(held))):
                        rows[name].append(value)
                    if with_ids:
                        rows["ids"].append(bytes(held))
                begin += n
            yield pa.RecordBatch.from_pydict(rows, schema=schema)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES + ", ids binary" * with_ids)


def best_fit(lengths: Iterable[int], capacity: int, open_bins: int) -> Iterator[tuple[int, int]]:
    """(bin, offset) for each length as it comes.

    The open bins' free spaces are the set bits of one number. The lowest set bit at or above a
    length is the tightest bin; if none is set and all places are taken, the fullest bin (the
    lowest set bit) closes and a new one opens.
    """
    by_space: dict[int, list[int]] = {}
    spaces = n_open = n_bins = 0

    def take(space: int) -> int:
        nonlocal spaces
        found = by_space[space].pop()
        if not by_space[space]:
            spaces ^= 1 << space
        return found

    for length in lengths:
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not between 1 and {capacity}")
        fits = spaces >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = take(space)
        else:
            if n_open == open_bins and length < capacity:
                take((spaces & -spaces).bit_length() - 1)
                n_open -= 1
            space, number = capacity, n_bins
            n_bins += 1
            n_open += length < capacity
        yield number, capacity - space
        space -= length
        if space:
            by_space.setdefault(space, []).append(number)
            spaces |= 1 << space
        elif length < capacity:
            n_open -= 1


def place_pieces(pieces: DataFrame, capacity: int = 2048, open_bins: int = 256, pieces_per_task: int = 250_000) -> DataFrame:
    """`pieces` (with a `length`) and their sequence_id and offset.

    Pieces come in a random but fixed order (a hash of doc_id and piece) and are packed by as many
    tasks as their number calls for; each task leaves at most `open_bins` sequences part empty, which
    is little beside the sequences it fills. A task keeps the open bins only.
    """
    wanted = max(1, -(-pieces.count() // pieces_per_task))
    order = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("_order", order).repartition(wanted, "_order")
    dealt = dealt.sortWithinPartitions("_order", "doc_id", "piece", "length").drop("_order")
    dealt = dealt.withColumn("_part", F.spark_partition_id())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrived: list[pa.RecordBatch] = []

        def lengths() -> Iterator[int]:
            for batch in batches:
                arrived.append(batch)
                yield from batch.column("length").to_pylist()

        places = best_fit(lengths(), capacity, open_bins)
        while True:
            first = next(places, None)
            if first is None:
                return
            batch = arrived[-1]
            found = [first, *(next(places) for _ in range(batch.num_rows - 1))]
            number, offset = np.array(found, np.int64).T
            part = batch.column("_part")[0].as_py()
            kept = batch.drop_columns(["_part"])
            kept = kept.append_column("sequence_id", pa.array(number + (part << 40)))
            yield kept.append_column("offset", pa.array(offset))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(pack, f"{kinds}, sequence_id long, offset long")


def packed_documents(df: DataFrame, capacity: int = 2048, **cutting) -> DataFrame:
    """The pieces of all documents with their places; an empty table gives an empty one."""
    return place_pieces(stored(cut_documents(df, capacity=capacity, **cutting), "pieces"), capacity)


def sequences(df: DataFrame, capacity: int = 2048, **cutting) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the packed sequences themselves, at most `capacity` ids each."""
    placed = packed_documents(df, capacity, with_ids=True, **cutting)
    held = F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    return placed.groupBy("sequence_id").agg(held.alias("_held")).select(
        "sequence_id",
        F.aggregate("_held", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("n_tokens"),
        F.transform("_held", lambda p: p["doc_id"]).alias("doc_ids"),
        F.aggregate("_held", F.lit(b""), lambda all_ids, p: F.concat(all_ids, p["ids"])).alias("ids"),
    )
