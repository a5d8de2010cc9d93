"""Phrase collocations from a weighted de Bruijn graph of words.

Edges are the longest grams (five words) with their counts; the nodes between them are the grams
of one word less that they overlap in. An edge leaves its node by its last word, so the count of a
shorter gram is the flow out of it, plus the pieces that end in it. A node whose whole flow goes
through one edge lies on a unary path and is compacted into that edge.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from .common import mix, parts_of, span_hashes, stored, text_blocks, word_spans

#: The characters that end a piece, besides line breaks 0x0A-0x0D.
PIECE_ENDS = b".,;:!?"
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(PIECE_ENDS)] = 0x0A
_END = np.zeros(256, bool)
_END[0x0A:0x0E] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 14  # a block of the sketch is 2**14 cells
_TABLE = 2 << 20  # bytes of text that are worked on at once


class _Words:
    """The words of a block of texts: spans, hashes that differ by language, and the words left in the piece."""

    def __init__(self, block: pa.RecordBatch, data: np.ndarray, at: np.ndarray, longest: int):
        folded = _FOLD[data]
        self.starts, self.ends, self.row = word_spans(folded, at)
        self.content = folded.tobytes()
        self.langs = block.column("lang").to_pylist()
        salts = {l: int.from_bytes(hashlib.blake2b(l.encode(), digest_size=8).digest(), "little") for l in set(self.langs)}
        n = len(self.starts)
        salt = np.array([salts[l] for l in self.langs], np.uint64)
        self.one = mix(span_hashes(folded, self.starts, self.ends) ^ salt[self.row]) if n else np.zeros(0, np.uint64)
        go_on = np.zeros(n, bool)  # the next word is in the same piece
        if n:
            ended = np.cumsum(_END[folded], dtype=np.int32)
            go_on[:-1] = (self.row[1:] == self.row[:-1]) & (ended[self.starts[1:]] == ended[self.ends[:-1] - 1])
        self.reach = np.ones(n, np.int8)
        further = go_on.copy()
        for _ in range(longest - 1):
            self.reach += further
            further[:-1] &= further[1:]
            further[-1:] = False
            further &= go_on
        self._grams = [self.one]

    def grams(self, m: int) -> np.ndarray:
        """The hash of the `m` words from each word on; meaningful where `reach` is `m` or more."""
        while len(self._grams) < m:
            k = len(self._grams)
            longer = self._grams[-1].copy()
            longer[:-k] = mix(longer[:-k] * _STEP + self.one[k:])
            self._grams.append(longer)
        return self._grams[m - 1]


def _blocks(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Words]:
    for block, data, at in text_blocks(batches, limit=_TABLE):
        yield _Words(block, data, at, longest)


class _Filter:
    """Cells that may hold grams of `least` occurrences, one bit map per length; its size is fixed."""

    def __init__(self, bits: int, maps: dict[int, np.ndarray]):
        self.bits, self.maps = bits, maps

    def cells(self, grams: np.ndarray) -> np.ndarray:
        return (grams >> np.uint64(64 - self.bits)).astype(np.int64)

    def may(self, words: _Words, m: int) -> np.ndarray:
        """Where a gram of `m` words starts that may be frequent."""
        cells = self.cells(words.grams(m))
        hit = (self.maps[m][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1
        return (hit != 0) & (words.reach >= m)


def _sketch(docs: DataFrame, known: _Filter, m: int, least: int, longest: int) -> _Filter:
    """The filter with one more map, for grams of `m` words: a cell is set when its grams together reach `least`.

    A task hands on the cells it met with their counts; the sums of a block of cells meet in one
    task, and a bit per cell reaches the driver. A gram is counted only where its parts of one
    word less may be frequent, if these are known; so no gram of `least` occurrences is missed.
    """
    dtype = np.uint16 if least < 1 << 16 else np.uint32
    bits = known.bits
    shared = docs.sparkSession.sparkContext.broadcast(known.maps)

    def rows_of(cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        blocks, at = np.unique(cells >> _BLOCK, return_index=True)
        spans = list(zip(at.tolist(), np.append(at[1:], len(cells)).tolist()))
        inside = (cells & ((1 << _BLOCK) - 1)).astype(np.uint16)
        counts = np.minimum(counts, np.iinfo(dtype).max).astype(dtype)
        columns = [
            pa.array(blocks.astype(np.int32)),
            pa.array([inside[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "cells", "counts"])

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        cells = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        at = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        return cells[at], np.add.reduceat(counts, at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = _Filter(bits, shared.value)
        held, size = [], 0
        for words in _blocks(batches, longest):
            start = words.reach >= m
            if m - 1 in have.maps:
                part = have.may(words, m - 1)
                start &= part
                start[:-1] &= part[1:]
            cells, counts = np.unique(have.cells(words.grams(m)[start]), return_counts=True)
            if len(cells):
                held.append((cells.astype(np.int32), counts.astype(np.int64)))
                size += len(cells)
            if size > 3_000_000:
                one = merged(held)
                held, size = [one], len(one[0])
                if size > 1_500_000:
                    yield rows_of(*one)
                    held, size = [], 0
        if held:
            yield rows_of(*merged(held))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << _BLOCK, np.int64)

        def done() -> pa.RecordBatch:
            flags = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([flags], pa.binary())], ["block", "flags"])

        for batch in batches:
            for block, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != at:
                    if at is not None:
                        yield done()
                    at = block
                    total[:] = 0
                total[np.frombuffer(cells, np.uint16)] += np.frombuffer(counts, dtype)
        if at is not None:
            yield done()

    counted = docs.mapInArrow(count, "block int, cells binary, counts binary")
    dealt = counted.repartition(parts_of(docs.sparkSession), "block").sortWithinPartitions("block")
    map_ = np.zeros(1 << (bits - 3), np.uint8)
    # at most 2**(bits - 14) rows of 2 kB, whatever the input
    for r in dealt.mapInArrow(reach, "block int, flags binary").toLocalIterator():
        flags = np.frombuffer(r["flags"], np.uint8)
        map_[r["block"] << (_BLOCK - 3) :][: len(flags)] = flags
    return _Filter(bits, known.maps | {m: map_})


def _starts(docs: DataFrame, known: _Filter, longest: int) -> DataFrame:
    """(lang, words, phrase, n): the longest gram from each word on that may be frequent, counted per task.

    A gram of `longest` words is an edge. A shorter one is a piece's end, or stands where every
    longer gram is rare; it corrects the flow of its node. Rows of zero words hold the number of
    all words.
    """
    bits = known.bits
    shared = docs.sparkSession.sparkContext.broadcast(known.maps)
    names = ["lang", "words", "phrase", "n"]

    def rows_of(held: dict) -> pa.RecordBatch:
        lang, words, phrase, n = zip(*held.values())
        columns = [pa.array(lang, pa.string()), pa.array(words, pa.int32()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = _Filter(bits, shared.value)
        held: dict[int, list] = {}
        totals: dict[str, int] = {}
        for words in _blocks(batches, longest):
            if not len(words.starts):
                continue
            for row, n in zip(*(x.tolist() for x in np.unique(words.row, return_counts=True))):
                totals[words.langs[row]] = totals.get(words.langs[row], 0) + n
            length = np.ones(len(words.starts), np.int8)
            on = have.may(words, 2)
            length += on
            if longest >= 3:
                triple = have.may(words, 3)
                for shift in range(longest - 2):
                    on[: len(on) - shift] &= triple[shift:]
                    on[len(on) - shift :] = False
                    length += on
            for m in range(1, longest + 1):
                where = np.flatnonzero(length == m)
                grams, first, counts = np.unique(words.grams(m)[where], return_index=True, return_counts=True)
                begin = where[first]
                lists = (grams.tolist(), begin.tolist(), words.starts[begin].tolist(), counts.tolist())
                for gram, i, _, n in zip(*lists):
                    old = held.get(gram)
                    if old is not None:
                        old[3] += n
                        continue
                    spans = zip(words.starts[i : i + m].tolist(), words.ends[i : i + m].tolist())
                    held[gram] = [words.langs[words.row[i]], m, b" ".join(words.content[a:b] for a, b in spans), n]
            if len(held) > 250_000:
                yield rows_of(held)
                held = {}
        if held:
            yield rows_of(held)
        if totals:
            yield rows_of({lang: [lang, 0, b"", n] for lang, n in totals.items()})

    return docs.mapInArrow(count, "lang string, words int, phrase string, n long")


def _bits(docs: DataFrame) -> int:
    """Cells of the sketch as a power of two: one for some seven words, 2**16 to 2**27 (16 MB a map)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(27, max(16, (size // 40).bit_length()))


def phrase_graph(
    df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 5, least: int = 100, bits: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of 1 to `longest` words met `least` times or more, and (lang, n).

    A-Z are lower-cased; texts are split at `.,;:!?` and 0x0A-0x0D into pieces, these at spaces and
    tabs into words; phrases never cross pieces. All is counted per language (null: `und`); `n`
    counts all words. A null or empty text has no words; an empty table gives empty ones; other
    columns are ignored.

    Edges are aggregated first: grams of `longest` words, and shorter ones where a piece ends. A
    filter of fixed size cuts edges where they certainly pass a node of fewer than `least`
    occurrences (sums over cells of two and three words, never too small); the count of what is
    left of an edge goes to its last frequent node, so all counts of frequent phrases are exact. On
    far more text than the filter has cells (some 50 GB at 2**27) it cuts less, and the shuffle of
    edges grows to some ten times the text; results stay the same. `bits` sets the cells.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases of at least two words, met at least once")
    docs = df.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text")
    )
    known = _Filter(min(_bits(docs) if bits is None else max(bits, _BLOCK), 31), {})
    known = _sketch(docs, known, 2, least, longest)
    if longest >= 3:
        known = _sketch(docs, known, 3, least, longest)
    edges = stored(
        _starts(docs, known, longest).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n")), "phrase-edges"
    )
    nodes = edges.where("words > 0").select(
        "lang", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("words")), lambda m: F.struct(m.alias("words"), F.expr("phrase").alias("edge")))).alias("p")
    ).select("lang", F.col("p.words").alias("words"), F.expr("substring_index(p.edge, ' ', p.words)").alias("phrase"), "n")
    flow = nodes.groupBy("lang", "words", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    totals = edges.where("words = 0").select("lang", "n")
    return stored(flow.select("lang", "phrase", "words", "f"), "phrase-nodes"), totals


def compacted(phrases: DataFrame, share: int = 100) -> DataFrame:
    """The phrases of two or more words that are no unary node: those left when unary paths are compacted.

    A phrase goes when one that is a word longer, on either side, carries `share` percent of its
    flow or more. A phrase inside a much longer one of that flow has such an edge too, as counts only
    fall along a path.
    """
    ends = F.array(
        F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring(phrase, locate(' ', phrase) + 1)")
    )
    through = phrases.where("words > 2").select("lang", F.explode(ends).alias("phrase"), "f")
    widest = through.groupBy("lang", "phrase").agg(F.max("f").alias("through"))
    both = phrases.where("words > 1").join(widest, ["lang", "phrase"], "left")
    return both.where(F.col("through").isNull() | (100 * F.col("through") < share * F.col("f"))).drop("through")


def scored_phrases(phrases: DataFrame, totals: DataFrame, candidates: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): each candidate at its lowest-scoring cut in two.

    The score is floor(1000·a·n / (l·r)) in decimals of 38 digits; equal scores take the cut with
    fewer words before it.
    """
    cuts = candidates.select(
        "lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    ).withColumns({"before": F.expr("substring_index(phrase, ' ', k)"), "after": F.expr("substring_index(phrase, ' ', k - words)")})
    left = phrases.select("lang", F.col("phrase").alias("before"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("after"), F.col("f").alias("r"))
    known = cuts.join(left, ["lang", "before"]).join(right, ["lang", "after"]).join(totals, "lang")
    above = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(17,0)") * F.col("n").cast("decimal(17,0)")
    below = F.col("l").cast("decimal(17,0)") * F.col("r").cast("decimal(17,0)")
    scored = known.withColumns({"above": above, "below": below}).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut"))
    return lowest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def collocations(
    df: DataFrame, lang: str = "lang", text: str = "text", longest: int = 5, least: int = 100, share: int = 100, top: int = 2000, bits: int | None = None
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    `phrase_graph` says what is counted, `compacted` which phrases go, `scored_phrases` how the
    rest is scored. Order: score and then count descending, then the phrase by its UTF-8 bytes.
    """
    phrases, totals = phrase_graph(df, lang, text, longest, least, bits)
    scored = scored_phrases(phrases, totals, compacted(phrases, share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first inside 64 parts of a language, so that at most 64 · top rows of it meet in one task
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = scored.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    placed = near.where(F.col("place") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return placed.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
