"""SimHash near-duplicates: fingerprints joined on pigeonhole blocks, then checked by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import SMALLEST, lower_ascii, run_hashes, span_hashes, stored, text_blocks, text_tag, unused, word_spans
from .graph import components

BITS = 64


def _fingerprint(text: bytes, width: int, seed: int) -> int:
    words = text.lower().split()  # on bytes: ASCII letters, and white space 0x20 and 0x09-0x0D
    if not words:
        return 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    joined = b" ".join(words)
    starts = (ends - lengths).tolist()
    stops = ends.tolist()
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - width + 1)
    last = min(width, len(words)) - 1
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[:n], stops[last:])), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):  # memory stays bounded for any text
        counts += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint as long): majority bits of the XXH64 of each shingle of `width` words.

    Letters A-Z are lower-cased. A text of fewer words has one shingle, one without words (also
    a null text) the fingerprint zero.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches):
            content = data.tobytes()
            found = [_fingerprint(content[a:b], width, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, fingerprint long")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _far(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(prints: DataFrame, distance: int = 2, blocks: int = 4, crowd: int = 512) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect all pairs within `distance` bits.

    The bits are split into `blocks`; a close pair differs in at most `distance` blocks, so for one
    choice of that many free blocks the rest is equal. Rows are joined on each such rest and
    kept where the distance holds. A rest with more than `crowd` fingerprints (a group of near
    copies, say) is not joined: there, each choice of `distance` free bits is masked, fingerprints
    with the same masked value are all within the distance, and each is linked to the smallest.
    So a row costs `crowd` comparisons or one row per choice of bits at most, with no link lost.
    """
    if not 0 < distance < blocks:
        raise ValueError("distance must be positive and below the number of blocks")
    step = BITS // blocks
    masks = [((1 << (step if i < blocks - 1 else BITS - step * i)) - 1) << (step * i) for i in range(blocks)]
    choices = [sum(masks[i] for i in free) for free in combinations(range(blocks), distance)]
    rests = [_signed(~free & (2**64 - 1)) for free in choices]
    keyed = prints.select(
        "fingerprint",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(r)).alias("rest")) for i, r in enumerate(rests)])
        ).alias("k"),
    ).select("fingerprint", "k.choice", "k.rest")
    sizes = keyed.groupBy("choice", "rest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keyed.join(sizes, ["choice", "rest"]), "simhash-blocks")

    light = shared.where(F.col("n") <= crowd)
    left, right = (light.select("choice", "rest", F.col("fingerprint").alias(c)) for c in ("a", "b"))
    pairs = left.join(right, ["choice", "rest"]).where((F.col("a") < F.col("b")) & (_far(F.col("a"), F.col("b")) <= distance))

    single = {
        i: [_signed(~sum(1 << b for b in bits) & (2**64 - 1)) for bits in combinations([b for b in range(BITS) if free >> b & 1], distance)]
        for i, free in enumerate(choices)
    }
    masked = None
    for i, keep in single.items():
        values = F.transform(F.array(*[F.lit(m) for m in keep]), lambda m: F.struct(m.alias("mask"), F.col("fingerprint").bitwiseAND(m).alias("value")))
        part = shared.where((F.col("n") > crowd) & (F.col("choice") == i)).select("fingerprint", F.explode(values).alias("k"))
        masked = part if masked is None else masked.unionByName(part)
    cliques = masked.groupBy("k").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z"), F.collect_set("fingerprint").alias("all"))
    stars = cliques.where("a < z").select("a", F.explode("all").alias("b")).where("a <> b")
    return pairs.select("a", "b").unionByName(stars)


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, distance: int = 2, blocks: int = 4, crowd: int = 512
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_links) for each row.

    Equal fingerprints are one node, so any number of copies costs one row in the joins; the
    component id is the smallest doc_id whose fingerprint can be reached over links of at most
    `distance` bits. Texts without words share the fingerprint zero and are linked like any other.
    Rows that repeat an id are each returned; null ids do not count as smallest (a component
    of null ids alone has a null id). Empty tables give an empty result.
    """
    signed = stored(fingerprints(df, key, text, width), "simhash")
    nodes = settle(signed.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(near_links(nodes.select("fingerprint"), distance, blocks, crowd))
    rooted = nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = settle(rooted).groupBy("root").agg(F.min("least").alias("component_id"))
    return (
        signed.join(rooted.select("fingerprint", "root"), "fingerprint")
        .join(named, "root")
        .select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
    )


# ---------------------------------------------------------------- near copies by the likeness of shingle sets

#: Cells in which texts are counted per shingle, to put common shingles last.
CELLS = 1 << 20
_SLICE = 1 << 16
#: Longs of a text's parity marks: a bit for each of 64 times as many classes of shingles.
MARKS = 16


def _shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text of a block, and whose they are, in order of text and hash.

    A text of fewer words has one shingle, one without words none.
    """
    low, n = lower_ascii(data), len(at) - 1
    starts, ends, text = word_spans(low, at)
    words = span_hashes(low, starts, ends)
    runs = run_hashes(words, width)
    inside = text[width - 1 :] == text[: len(text) - width + 1] if len(words) >= width else np.zeros(0, bool)
    shingles, owner = runs[inside], text[: len(runs)][inside]
    count = np.bincount(text, minlength=n)
    few = np.flatnonzero((count > 0) & (count < width))  # the whole sequence is one shingle
    first = np.cumsum(count) - count
    lone = np.array([run_hashes(words[first[i] : first[i] + count[i]], int(count[i]))[0] for i in few], np.uint64)
    shingles, owner = np.concatenate([shingles, lone]), np.concatenate([owner, few])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[fresh], owner[fresh]


def _majority(shingles: np.ndarray, owner: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: the bits set in over half of its distinct shingles; zero without any."""
    sums = np.zeros((len(n), BITS), np.int64)
    for i in range(0, len(shingles), _SLICE):  # memory stays bounded for any text
        part, mine = shingles[i : i + _SLICE], owner[i : i + _SLICE]
        heads = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums[mine[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
    return np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view("<i8")[:, 0]


def _marks(shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, MARKS) longs: for each class of shingles (their top bits), whether a text has an odd number of them.

    Two sets differ in at least as many shingles as their marks differ in bits.
    """
    classes = 64 * MARKS
    cell = owner * classes + (shingles >> np.uint64(64 - (classes.bit_length() - 1))).astype(np.int64)
    odd = np.bincount(cell, minlength=n * classes).reshape(n, classes) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<i8")


def _commonness(rows: DataFrame, width: int) -> np.ndarray:
    """For each cell of shingles, the number of bits of the count of texts that have one of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for _, data, at in text_blocks(batches):
            cells += np.bincount((_shingle_sets(data, at, width)[0] % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        if cells.any():
            for i in range(0, CELLS, _SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([i // _SLICE]), pa.array([cells[i : i + _SLICE].tobytes()])], ["slice", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for name, cells in zip(batch.column("slice").to_pylist(), batch.column("cells")):
                sums[name] = sums.get(name, 0) + np.frombuffer(cells.as_buffer(), np.int64)
        for name, cells in sums.items():
            bits = np.ceil(np.log2(cells + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([bits.tobytes()])], ["slice", "bits"])

    counted = rows.select("text").mapInArrow(count, "slice long, cells binary")
    found = counted.repartition("slice").mapInArrow(add, "slice long, bits binary").collect()
    out = np.zeros(CELLS, np.uint8)
    for r in found:
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.frombuffer(r["bits"], np.uint8)
    return out


def _signatures(rows: DataFrame, width: int) -> DataFrame:
    """(tag, least, n, fingerprint, marks, prefix, text): the number of distinct shingles, their SimHash, their
    parity marks and the first of them, common ones last.

    Two sets with a likeness of 0.8 share at least 4/5 of either, so one of the first n - ceil(4n/5) + 1
    of both, whatever order all texts go by. A text without words has the shingle 0 for a prefix.
    """
    common = rows.sparkSession.sparkContext.broadcast(_commonness(rows, width))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches):
            shingles, owner = _shingle_sets(data, at, width)
            n = np.bincount(owner, minlength=len(at) - 1)
            order = np.lexsort((shingles, common.value[(shingles % np.uint64(CELLS)).astype(np.int64)], owner))
            keep = n - (4 * n + 4) // 5 + 1
            place = np.arange(len(shingles)) - (np.cumsum(n) - n)[owner]
            few = shingles[order][place < keep[owner]]
            where = np.cumsum(np.where(n > 0, keep, 1))
            tokens = np.zeros(int(where[-1]), np.uint64)
            tokens[np.repeat(n > 0, np.where(n > 0, keep, 1))] = few
            prefix = pa.ListArray.from_arrays(pa.array(np.append(0, where).astype(np.int32)), pa.array(tokens.view(np.int64)))
            prints = pa.array(_majority(shingles, owner, n))
            marks = [pa.array(np.ascontiguousarray(m)) for m in _marks(shingles, owner, len(n)).T]
            marks = pa.StructArray.from_arrays(marks, [f"m{i}" for i in range(MARKS)])
            yield pa.RecordBatch.from_arrays(
                [block.column("tag"), block.column("key"), pa.array(n.astype(np.int32)), prints, marks, prefix, block.column("text")],
                ["tag", "key", "n", "fingerprint", "marks", "prefix", "text"],
            )

    kind = f"struct<{', '.join(f'm{i}: long' for i in range(MARKS))}>"
    signed = rows.select("tag", "key", "text").mapInArrow(
        sign, f"tag long, key long, n int, fingerprint long, marks {kind}, prefix array<long>, text string"
    )
    firsts = [F.first(c).alias(c) for c in ("n", "fingerprint", "marks", "prefix", "text")]
    return signed.groupBy("tag").agg(F.min("key").alias("least"), *firsts)


def _sets(asked: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(tag, shingles): the sets of the texts asked for by tag."""
    on = ["tag", "key"] if "key" in texts.columns else ["tag"]

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches):
            shingles, owner = _shingle_sets(data, at, width)
            cut = np.searchsorted(owner, np.arange(len(at))).tolist()
            found = [shingles[i:j].tobytes() for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([block.column("tag"), pa.array(found, pa.binary())], ["tag", "shingles"])

    found = texts.join(asked, on, "left_semi").dropDuplicates(on).select("tag", "text")
    return stored(found.mapInArrow(collect, "tag long, shingles binary"), "near-sets")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a likeness of 0.8 or more."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            close = []
            for one, two in zip(batch.column("one"), batch.column("two")):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, two))
                both = np.sort(np.concatenate([x, y]), kind="stable")  # two sorted runs
                close.append(9 * int(np.count_nonzero(both[1:] == both[:-1])) >= 4 * len(both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(close, pa.bool_()))

    full = pairs.select("a", "b").join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b")
    return stored(full.select("a", "b", "one", "two").mapInArrow(check, "a long, b long"), "near-links")


def _kin(sets: DataFrame, bands: int = 16, rows: int = 4) -> DataFrame:
    """Pairs (a, b) of tags that link texts of like sets to the first and the last text of their kind.

    Two texts are of a kind if the `rows` smallest values of a band agree, which two sets with a likeness of 0.8 do in
    two bands out of five. A text has `bands` kinds and at most two pairs for each, whatever the size of a kind.
    """
    mix = np.random.default_rng(7).integers(1 << 63, size=(2, bands * rows), dtype=np.uint64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((len(batch), bands), np.uint64)
            for i, raw in enumerate(batch.column("shingles")):
                shingles = np.frombuffer(raw.as_buffer(), np.uint64)
                if len(shingles):
                    lows = [int((((shingles ^ x) * (m | np.uint64(1))) >> np.uint64(8)).min()) for x, m in mix.T]
                    found[i] = [xxhash.xxh64_intdigest(repr(lows[j : j + rows]), j) for j in range(0, bands * rows, rows)]
            names = np.repeat(batch.column("tag").to_numpy(), bands)
            band = np.tile(np.arange(bands, dtype=np.int32), len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(band), pa.array(found.view(np.int64).ravel())], ["tag", "band", "kind"])

    kinds = stored(sets.mapInArrow(least, "tag long, band int, kind long"), "kinds")
    ends = kinds.groupBy("band", "kind").agg(F.min("tag").alias("low"), F.max("tag").alias("high")).where("low < high")
    met = kinds.join(ends, ["band", "kind"]).select("tag", F.explode(F.array("low", "high")).alias("end")).where("tag <> end")
    return met.select(F.least("tag", "end").alias("a"), F.greatest("tag", "end").alias("b")).distinct()


def _shared(nodes: DataFrame) -> DataFrame:
    """(token, tag) of the shingles that stand in more than one prefix: one pass over rows sorted by shingle."""

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, told = None, True  # the row before, and whether it was given
        for batch in batches:
            token, tag = (batch.column(c).to_numpy() for c in ("token", "tag"))
            if not len(token):
                continue
            if last is not None:
                token, tag = np.append(last[0], token), np.append(last[1], tag)
            same = token[1:] == token[:-1]
            keep = np.append(False, same) | np.append(same, False)
            if last is not None and told:
                keep[0] = False
            last, told = (token[-1], tag[-1]), bool(keep[-1]) or (len(token) == 1 and last is not None and told)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(tag[keep])], ["token", "tag"])

    rows = nodes.select(F.explode("prefix").alias("token"), "tag").repartition("token").sortWithinPartitions("token")
    return stored(rows.mapInArrow(several, "token long, tag long"), "shared-shingles")


def _merged(rooted: DataFrame) -> DataFrame:
    """`rooted` with one shingle of those that stand in the same texts (told by 128 bits of hash), and `times`, their number."""
    crowd = [F.count(F.lit(1)).alias("m"), *[F.bit_xor(F.xxhash64("tag", F.lit(i))).alias(f"x{i}") for i in (0, 1)]]
    same = rooted.groupBy("token").agg(*crowd).groupBy("m", "x0", "x1").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("times"))
    return rooted.join(same.select("token", "times"), "token")


def print_candidates(nodes: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Pairs (a, b) of tags whose SimHash fingerprints are equal or linked within `distance` bits.

    Texts with one fingerprint meet at the smallest tag of them, which stands for them in the joins on blocks.
    """
    signed = nodes.where("n > 0").select("tag", "fingerprint")
    prints = stored(signed.groupBy("fingerprint").agg(F.min("tag").alias("lead")), "fingerprints")
    equal = signed.join(prints, "fingerprint").where("tag <> lead").select(F.col("lead").alias("a"), F.col("tag").alias("b"))
    close = near_links(prints.select("fingerprint"), distance, blocks).distinct()
    one, two = (prints.select(F.col("fingerprint").alias(c), F.col("lead").alias(f"{c}_lead")) for c in ("a", "b"))
    close = close.join(one, "a").join(two, "b").select(F.least("a_lead", "b_lead").alias("a"), F.greatest("a_lead", "b_lead").alias("b"))
    return stored(equal.unionByName(close), "print-pairs")


def similar_links(nodes: DataFrame, texts: DataFrame | None = None, width: int = 5, crowd: int = 16) -> DataFrame:
    """Links (a, b) of tags that connect all pairs of texts whose shingle sets have a likeness of 0.8 or more.

    SimHash fingerprints within 2 bits, joined on pigeonhole blocks, are the first candidates, and each is
    confirmed by the sets. Fingerprints of a pair at 0.8 differ in some ten bits of 64, so blocks alone miss pairs;
    the exact way for the rest: such a pair shares a shingle of both prefixes, and pairs that do and are not
    connected yet are confirmed by the sets too, so none is missed. Texts that share a shingle are compared pair by pair, up to `crowd` of them. Of a
    larger crowd each is first compared with the ends of its kinds (`_kin`), then with one text, another one each round,
    while a tenth of these comparisons still links; what is then left unconnected is compared pair by pair. A pair is dropped
    unread if the shingles that it can share, in the prefixes and behind the one that ends first, are too
    few, and in a crowd, inside the join itself, if its parity marks differ in more bits than its sets may
    differ in shingles (a ninth of both together). `texts` has (tag, key, text); without it, `nodes` has the texts.
    """
    texts = nodes.select("tag", "text") if texts is None else texts
    named = nodes.select("tag", F.col("least").alias("key"))
    shared = _shared(nodes)
    sizes = shared.groupBy("token").agg(F.count(F.lit(1)).alias("m"))
    sized = shared.join(sizes, "token").join(nodes.select("tag", "n"), "tag")
    of_tag = sized.groupBy("tag").agg(F.count_if(F.col("m") <= crowd).alias("light"), F.count_if(F.col("m") > crowd).alias("heavy"))
    sized = stored(sized.join(of_tag, "tag"), "sized-shingles")
    fits = F.least("n", "n2") * 5 >= F.greatest("n", "n2") * 4
    differ = sum((_far(F.col(f"marks.m{i}"), F.col(f"marks2.m{i}")) for i in range(MARKS)), F.lit(0))
    marked = 9 * differ <= F.col("n") + F.col("n2")

    def paired(rows: DataFrame, others: str, apart: Column) -> DataFrame:
        """`others`: the number of a text's shared shingles that `rows` do not have."""
        rows = rows.withColumn("others", F.col(others)).select("token", "tag", "n", "others", "root", *[c for c in rows.columns if c in ("marks", "times")])
        other = rows.toDF(*[c if c == "token" else f"{c}2" for c in rows.columns])
        found = rows.join(other, "token").where((F.col("tag") < F.col("tag2")) & fits & apart)
        most = F.greatest("n", "n2")
        behind = F.greatest(F.floor((4 * most + 4) / 5) - 1, F.lit(0))
        times = F.sum("times") if "times" in rows.columns else F.count(F.lit(1))
        found = found.groupBy("tag", "tag2", "n", "n2").agg((times + F.first(F.least("others", "others2"))).alias("k"))
        found = found.where((F.col("k") + behind) * 9 >= (F.col("n") + F.col("n2")) * 4)
        return stored(found.select(F.col("tag").alias("a"), F.col("tag2").alias("b")), "near-pairs")

    def both(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("tag")).unionByName(pairs.select(F.col("b").alias("tag"))).distinct()

    pairs = print_candidates(nodes)
    links = _alike(pairs, _sets(both(pairs).join(named, "tag"), texts, width))
    roots = components(links).toDF("tag", "root")
    light = sized.where(F.col("m") <= crowd).join(roots, "tag", "left").withColumn("root", F.coalesce("root", "tag"))
    pairs = paired(light, "heavy", F.col("root") != F.col("root2"))
    links = links.unionByName(_alike(pairs, _sets(both(pairs).join(named, "tag"), texts, width)))
    crowded = sized.where(F.col("m") > crowd).select("token", "tag", "n", "light")
    if crowded.isEmpty():
        return links
    crowded = crowded.join(nodes.select("tag", "marks"), "tag")
    sets = _sets(crowded.select("tag").distinct().join(named, "tag"), texts, width)
    one, two = (nodes.select(F.col("tag").alias(s), F.col("n").alias(n), F.col("marks").alias(m)) for s, n, m in (("a", "n", "marks"), ("b", "n2", "marks2")))
    kin = _kin(sets).join(one, "a").join(two, "b").where(fits & marked).select("a", "b")
    links = links.unionByName(_alike(stored(kin, "kin"), sets))
    turn = 0
    while True:
        roots = components(links).toDF("tag", "root")
        rooted = crowded.join(roots, "tag", "left").select("token", "tag", "n", "light", "marks", F.coalesce("root", "tag").alias("root"))
        one = F.min(F.struct(F.xxhash64("tag", F.lit(turn)).alias("h"), "tag", "n", "marks", "root")).alias("s")
        mixed = rooted.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), one)
        rooted = stored(rooted.join(mixed.where("low < high").select("token", "s"), "token"), "crowded-shingles")
        star = rooted.where(F.col("root") != F.col("s.root")).withColumn("n2", F.col("s.n")).where(fits)
        star = star.withColumn("marks2", F.col("s.marks")).withColumn("close", marked)
        star = star.select(F.least("tag", "s.tag").alias("a"), F.greatest("tag", "s.tag").alias("b"), "close").distinct()
        star = stored(star, "near-stars")
        tried = star.count()
        found = _alike(star.where("close"), sets)
        links, turn = links.unionByName(found), turn + 1
        if not tried or 10 * found.count() < tried:
            return links.unionByName(_alike(paired(_merged(rooted), "light", (F.col("root") != F.col("root2")) & marked), sets))
        crowded = rooted.select("token", "tag", "n", "light", "marks")


def without_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """`df`, all columns, with one row of each group of near copies: the one with the smallest id.

    Near copies are linked where the sets of their shingles of `width` words have a likeness (shared over
    all) of 0.8 or more: candidates by SimHash, the rest by shared shingles, all told by the sets; shingles are
    64-bit hashes. Groups are all that links reach.
    Equal texts are one node; null texts are empty, and all texts without words are one
    group. Null ids come first; of rows equal in id and text one stays.
    """
    tag, order = unused(df, "_tag"), unused(df, "_key")
    smallest = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(SMALLEST).cast("long"))
    full = df.withColumn(tag, text_tag(text)).withColumn(order, smallest)
    texts = full.select(F.col(tag).alias("tag"), F.col(order).alias("key"), F.col(f"`{text}`").alias("text"))
    nodes = stored(_signatures(texts, width).drop("text"), "signatures")
    roots = components(similar_links(nodes, texts, width))
    rooted = nodes.join(roots.withColumnRenamed("node", "tag"), "tag", "left").select("tag", "least", F.coalesce("root", "tag").alias("root"))
    stay = rooted.groupBy("root").agg(F.min(F.struct("least", "tag")).alias("s"))
    stay = stay.select(F.col("s.least").alias(order), F.col("s.tag").alias(tag))
    left = full.join(stay, [order, tag], "left_semi").dropDuplicates([order, tag])
    return left.select(*[F.col(f"`{c}`") for c in df.columns])
