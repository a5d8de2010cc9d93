"""Document quality: base counts, and a hashed n-gram likelihood ratio of trusted to raw text.

Two multinomials over hashed byte n-grams are counted: one from labelled trusted documents, one
from all documents. A document's score is the mean over its n-grams of the log ratio of the two
(0 for a text without n-grams). One threshold, set from labelled documents that were not
counted, decides every document alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import run_hashes, span_hashes, text_blocks, word_spans

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Ratio:
    """Log ratio per bucket, and the score from which a document is kept."""

    order: int
    weights: np.ndarray
    threshold: float


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flagged bytes each text has."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[at[1:]] - sums[at[:-1]]


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys equal an earlier one, and which have any equal."""
    _, first, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    return first[inverse] != np.arange(len(keys)), count[inverse] > 1


def base_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text of a block."""
    n = len(at) - 1
    starts, ends, text = word_spans(data, at)
    inner = np.zeros(len(data), bool)
    lead = (data & 0xC0) != 0x80
    sums = np.concatenate([[0], np.cumsum(lead)])
    chars = np.bincount(text, weights=sums[ends] - sums[starts], minlength=n).astype(np.int64)

    # lines: cut at each \n and at the texts' ends
    inner[data == 10] = True
    stops = np.flatnonzero(inner)
    line_start = np.sort(np.concatenate([at[:-1], stops + 1]), kind="stable")
    line_end = np.sort(np.concatenate([stops, at[1:]]), kind="stable")
    with_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[with_word], line_end[with_word]
    line_text = np.searchsorted(at, line_start, "right") - 1
    salt = np.uint64(0x9E3779B97F4A7C15)
    line_keys = span_hashes(data, line_start, line_end) + line_text.astype(np.uint64) * salt
    repeated, _ = _again(line_keys)

    words = span_hashes(data, starts, ends)
    windows = run_hashes(words, 3)
    whole = text[2:] == text[:-2] if len(text) > 2 else np.zeros(0, bool)
    place = np.flatnonzero(whole)
    _, twice = _again(windows[place] + text[place].astype(np.uint64) * salt)
    covered = np.zeros(len(words), bool)
    for i in range(3):
        covered[place[twice] + i] = True
    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": chars,
        "n_symbols": _per_text(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_text[repeated], minlength=n),
        "n_repeat_words": np.bincount(text[covered], minlength=n),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])


def _grams(data: np.ndarray, at: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each byte n-gram inside a text."""
    found = (run_hashes(data.astype(np.uint64) + np.uint64(1), order) % np.uint64(buckets)).astype(np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[order - 1 :] == text[: len(text) - order + 1]
    return found[inside], text[: len(found)][inside]


def ratio_scores(data: np.ndarray, at: np.ndarray, order: int, weights: np.ndarray) -> np.ndarray:
    grams, text = _grams(data, at, order, len(weights))
    n = len(at) - 1
    total = np.bincount(text, weights=weights[grams], minlength=n)
    return total / np.maximum(1, np.bincount(text, minlength=n))


def _labelled(labels: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `rows` labelled ids, in order of a hash of the id, sorted, with their labels.

    A repeated id takes its lowest label; null ids and labels are left out.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    taken = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).toPandas().sort_values("doc_id")
    return taken["doc_id"].to_numpy(np.int64), taken["quality"].to_numpy(np.int64)


def fit_ratio(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3,
    buckets: int = 1 << 14, labelled_rows: int = 20_000, refused: float = 0.002,
) -> Ratio:
    """Fit the ratio and its threshold.

    The raw counts come from all documents. The trusted counts come from documents of quality 1
    among at most `labelled_rows` labelled ones, half of them (by a hash of the id). The other half
    sets the threshold, from the documents that pass the base rules: halfway between the score
    below which the share `refused` of the trusted ones lies and the highest scores (98th
    percentile) of the untrusted ones under that. Without any trusted document there is nothing to
    compare with, and all pass.
    """
    ids, quality = _labelled(labels, labelled_rows)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def known(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are labelled, and where in `ids`."""
        doc = block.column("doc_id")
        numbers = doc.fill_null(0).to_numpy(zero_copy_only=False)
        if not len(ids):
            return np.zeros(len(numbers), bool), np.zeros(len(numbers), np.int64)
        at = np.minimum(np.searchsorted(ids, numbers), len(ids) - 1)
        return (ids[at] == numbers) & doc.is_valid().to_numpy(zero_copy_only=False), at

    fold = np.array([int(x) & 1 for x in (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)], np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, trusted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for block, data, at in text_blocks(batches):
            grams, text_of = _grams(data, at, order, buckets)
            raw += np.bincount(grams, minlength=buckets)
            hit, where = known(block)
            if hit.any():
                hit[hit] = (quality[where[hit]] == 1) & (fold[where[hit]] == 0)
                trusted += np.bincount(grams[hit[text_of]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(raw), pa.array(trusted)], ["bucket", "raw", "trusted"])

    sums = rows.mapInArrow(count, "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toPandas()
    raw, trusted = np.zeros(buckets), np.zeros(buckets)
    raw[sums["bucket"]], trusted[sums["bucket"]] = sums["raw"], sums["trusted"]
    if not trusted.any():
        return Ratio(order, np.zeros(buckets), -np.inf)
    raw, trusted = raw + 1, trusted + 1
    weights = np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches):
            hit, where = known(block)
            good = hit & ~base_failed(base_counts(data, at))
            if good.any():
                scores = ratio_scores(data, at, order, weights)[good]
                yield pa.RecordBatch.from_arrays([pa.array(scores), pa.array(quality[where[good]])], ["score", "quality"])

    wanted = df.sparkSession.createDataFrame([(int(i),) for i in ids[fold == 1]], "doc_id long")
    held_back = rows.join(F.broadcast(wanted), "doc_id", "left_semi")
    found = held_back.mapInArrow(judge, "score double, quality long").toPandas()
    clean, junk = found["score"][found["quality"] == 1], found["score"][found["quality"] != 1]
    if not len(clean):
        return Ratio(order, weights, -np.inf)
    low = float(np.quantile(clean, refused))
    under = junk[junk < low]
    return Ratio(order, weights, (low + float(np.quantile(under, 0.98))) / 2 if len(under) else low)


def judged(df: DataFrame, ratio: Ratio, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, the counts, base_failed, score, kept) for each row.

    A null or empty text has no words and fails the base rules; rows that repeat an id are judged
    each; other columns are ignored.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches):
            counts = base_counts(data, at)
            failed = base_failed(counts)
            score = ratio_scores(data, at, ratio.order, ratio.weights)
            columns = [counts[c].astype(np.int64) for c in COUNTS] + [failed, score, ~failed & (score >= ratio.threshold)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *map(pa.array, columns)], schema=schema)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
    return rows.mapInArrow(judge, f"{kinds}, base_failed boolean, score double, kept boolean")


def kept_documents(df: DataFrame, ratio: Ratio, text: str = "text") -> DataFrame:
    """The rows of `df`, all columns, whose text passes both the base rules and the ratio."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches, text):
            good = ~base_failed(base_counts(data, at)) & (ratio_scores(data, at, ratio.order, ratio.weights) >= ratio.threshold)
            yield block.filter(pa.array(good))

    return df.mapInArrow(keep, df.schema)
