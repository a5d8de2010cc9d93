"""Long repeated word passages by recompression: locally consistent symbols, named by content.

Each text is parsed in rounds. The first names maximal runs of one word, every further round pairs
of neighbouring symbols: a hash of a symbol's name puts it on the left or the right side, and a
left symbol followed by a right one becomes one symbol. Names are 64-bit hashes of what they
stand for, so all tasks name alike without asking each other.

Beside its words, a symbol has a *reach*: the words that decided it, neighbours it was not merged
with included. Wherever these words stand again, so does the symbol. A symbol's reach lies in
its parent's, so each word has one highest symbol with a reach of at most (window + 1) / 2 words,
its *anchor*. Around the middle word of a window that reach lies inside the window: equal windows
have equal anchors at their middle words. So windows can only be equal where anchors are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import mix, powers, span_hashes, stored, text_blocks, text_tag, unused, word_spans

_ENDLESS = 1 << 30
_A = np.uint64(0xD6E8FEB86659FD93)


def anchors(words: np.ndarray, text: np.ndarray, window: int, rounds: int = 16) -> dict[str, np.ndarray]:
    """The anchors of some texts' words (hashes, with the number of their text), in order.

    `start` and `end` are the words an anchor stands for, `from_` and `to` its reach.
    """
    limit = (window + 1) // 2
    n = len(words)
    at = np.arange(n)
    name, start, end, low, high = words, at, at + 1, at.copy(), at + 1
    found = []
    for level in range(rounds):
        m = len(name)
        if m == 0:
            break
        owner = text[start]
        first = np.ones(m, bool)
        first[1:] = owner[1:] != owner[:-1]
        last = np.append(first[1:], True)
        left_low = np.where(first, low - _ENDLESS, np.append(0, low[:-1]))
        right_high = np.where(last, high + _ENDLESS, np.append(high[1:], 0))
        if level == 0:
            opens = first.copy()
            opens[1:] |= name[1:] != name[:-1]
            head = np.flatnonzero(opens)
            tail = np.append(head[1:], m) - 1
            length = (tail - head + 1).astype(np.uint64)
            new = np.where(length > 1, mix(name[head] * _A + length), name[head])
            new_low, new_high, new_end = left_low[head], right_high[tail], end[tail]
        else:
            left = (mix(name + mix(np.full(1, level, np.uint64))) & np.uint64(1)).astype(bool)
            merges = np.zeros(m, bool)
            merges[:-1] = left[:-1] & ~left[1:] & ~last[:-1]
            second = np.append(False, merges[:-1])
            opens = ~second
            head = np.flatnonzero(opens)
            pair = merges[head]
            tail = head + pair
            new = np.where(pair, mix(name[head] * _A + mix(name[tail] + np.uint64(level))), name[head])
            alone_low = np.where(left[head], low[head], left_low[head])  # a right symbol looks to its left
            alone_high = np.where(left[head], right_high[head], high[head])  # a left one to its right
            new_low = np.where(pair, low[head], alone_low)
            new_high = np.where(pair, high[tail], alone_high)
            new_low = np.minimum(new_low, low[tail])
            new_high = np.maximum(new_high, high[head])
            new_end = end[tail]
        parent = np.cumsum(opens) - 1
        done = (high - low <= limit) & ((new_high - new_low)[parent] > limit)
        found.append((start[done], end[done], low[done], high[done]))
        if level and not (new_high - new_low <= limit).any():
            break
        name, start, end, low, high = new, start[head], new_end, new_low, new_high
    else:
        done = high - low <= limit
        found.append((start[done], end[done], low[done], high[done]))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
    order = np.argsort(columns[0], kind="stable")
    return dict(zip(("start", "end", "from_", "to"), (c[order] for c in columns)))


class _Block:
    """The words of a block of texts, their anchors, and hashes of any run of words."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int) -> None:
        self.window, self.data = window, data
        self.word_start, self.word_end, self.text = word_spans(data, at)
        self.words = span_hashes(data, self.word_start, self.word_end)
        self.count = np.bincount(self.text, minlength=len(at) - 1)
        self.first = np.cumsum(self.count) - self.count
        self.sums = []
        for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
            up, down = powers(len(self.words) + 1, base)
            sums = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(self.words * up[:-1], out=sums[1:])
            self.sums.append((sums, down))

    def runs(self, low: np.ndarray, high: np.ndarray, which: int = 0) -> np.ndarray:
        sums, down = self.sums[which]
        return mix((sums[high] - sums[low]) * down[low] + (high - low).astype(np.uint64))

    def places(self) -> dict[str, np.ndarray]:
        """Anchors that hold the middle word of a window: their text, their number inside it, the
        middle words, and hashes of the reach (`key`) and of all words of these windows (`context`)."""
        found = anchors(self.words, self.text, self.window)
        owner = self.text[found["start"]]
        half = self.window // 2
        low = np.maximum(found["start"], self.first[owner] + half)
        high = np.minimum(found["end"], self.first[owner] + self.count[owner] - (self.window - 1 - half))
        number = np.arange(len(owner)) - np.searchsorted(owner, owner)
        ok = high > low
        key = self.runs(found["from_"][ok], found["to"][ok])
        shape = (found["start"] - found["from_"])[ok] * 64 + (found["end"] - found["start"])[ok]
        return {
            "text": owner[ok],
            "number": number[ok],
            "low": low[ok] - half,
            "high": high[ok] - half,
            "key": mix(key + shape.astype(np.uint64)),
            "context": self.runs(low[ok] - half, high[ok] - half + self.window - 1, 1),
        }


def _thin(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """For equal rows of one task: how many the first of them stands for (at most 2), and which are not first."""
    order = np.lexsort(columns)
    same = np.ones(max(0, len(order) - 1), bool)
    for c in columns:
        same &= c[order[1:]] == c[order[:-1]]
    head = np.append(True, ~same)[: len(order)]
    begins = np.flatnonzero(head)
    sizes = np.diff(np.append(begins, len(order)))
    weight, later = np.ones(len(order), np.int32), np.zeros(len(order), bool)
    weight[order[begins]] = np.minimum(sizes, 2)
    later[order[~head]] = True
    return weight, later


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _anchor_rows(texts: DataFrame, window: int, hot: np.ndarray, held: int) -> DataFrame:
    """(key, salt, context, n, done, tag, number): the anchors of all texts.

    Equal texts of one task are parsed once. Of anchors with equal windows in one task, only the
    first is sent to its key's group, for two; the others are done and go to groups of their
    own. Keys in `hot` are also dealt by context.
    """
    schema = pa.schema(
        [("key", pa.int64()), ("salt", pa.int32()), ("context", pa.int32()), ("n", pa.int32()), ("done", pa.bool_()), ("tag", pa.int64()), ("number", pa.int32())]
    )

    def send(parts: list[tuple], copies: set[int]) -> pa.RecordBatch:
        key, context, tag, number = (np.concatenate(c) for c in zip(*parts))
        weight, later = _thin((context, key))
        weight[np.isin(tag, np.fromiter(copies, np.int64, len(copies)))] = 2
        small = (context >> np.uint64(33)).astype(np.int32)
        own = np.where(later, mix(tag.view(np.uint64) * _A + number.astype(np.uint64)), key)
        salt = np.where(np.isin(key, hot) & ~later, small | np.int32(1), np.int32(0)).astype(np.int32)
        columns = [_signed(own), salt, small, weight, later, tag, number]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=schema)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, seen, copies, size = [], set(), set(), 0
        for block, data, at in text_blocks(batches):
            tags = block.column("tag").to_numpy()
            fresh = np.zeros(len(tags), bool)
            for i, tag in enumerate(tags.tolist()):
                if tag in seen:
                    copies.add(tag)
                else:
                    seen.add(tag)
                    fresh[i] = True
            found = _Block(data, at, window).places()
            own = fresh[found["text"]]
            parts.append((found["key"][own], found["context"][own], tags[found["text"][own]], found["number"][own].astype(np.int32)))
            size += int(own.sum())
            if size >= held:
                yield send(parts, copies)
                parts, seen, copies, size = [], set(), set(), 0
        if parts:
            yield send(parts, copies)

    return texts.mapInArrow(emit, "key long, salt int, context int, n int, done boolean, tag long, number int")


def _hot_keys(texts: DataFrame, window: int, held: int, share: int = 64, most: int = 10_000, least: int = 200) -> np.ndarray:
    """At most `most` keys that many texts share, from the texts with one of `share` hash values.

    They only steer how rows are dealt, never what is found.
    """
    some = texts.where(F.pmod(F.xxhash64("tag"), F.lit(share)) == 0)
    rows = _anchor_rows(some, window, np.zeros(0, np.uint64), held).where("NOT done")
    counts = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= least)
    found = counts.orderBy(F.desc("rows")).limit(most).toPandas()["key"]
    return found.to_numpy(np.int64).view(np.uint64)


def _marks(texts: DataFrame, window: int, held: int) -> DataFrame:
    """(tag, marks): per text the anchors that matter, as number * 4 + 1 if all its windows are repeated,
    + 2 if its windows must be compared one by one with those of other texts."""
    hot = _hot_keys(texts, window, held)
    rows = _anchor_rows(texts, window, hot, held)
    by_key = Window.partitionBy("key", "salt")
    by_context = Window.partitionBy("key", "salt", "context")
    rows = (
        rows.withColumn("n_context", F.sum("n").over(by_context))
        .withColumn("turn", F.row_number().over(by_context.orderBy("tag", "number")))
        .withColumn("n_key", F.sum("n").over(by_key))
    )
    sure = F.col("done") | (F.col("n_context") > 1)
    mixed = ~F.col("done") & (F.col("turn") == 1) & ((F.col("n_key") > F.col("n_context")) | (F.col("salt") != 0))
    mark = F.col("number") * 4 + sure.cast("int") + mixed.cast("int") * 2
    rows = rows.where(sure | mixed).select("tag", mark.alias("mark"))
    return rows.groupBy("tag").agg(F.collect_set("mark").alias("marks"))


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [low, high), and the range of each."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which], which


def _marked(block: pa.RecordBatch, found: dict[str, np.ndarray], bit: int) -> np.ndarray:
    """Which of the anchors of a block's texts have a mark with this bit."""
    marks = block.column("marks")
    text = np.repeat(np.arange(len(marks)), [len(m) if m.is_valid else 0 for m in marks])
    flat = marks.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    text, number = text[flat & bit > 0], flat[flat & bit > 0] >> 2
    return np.isin((found["text"].astype(np.int64) << 32) + found["number"], (text.astype(np.int64) << 32) + number)


def _windows(texts: DataFrame, window: int, held: int) -> DataFrame:
    """(tag, repeated): the first words (numbers in the text) of windows that are found repeated one by one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def send() -> pa.RecordBatch:
            one, two, tag, place = (np.concatenate(c) for c in zip(*parts))
            weight, later = _thin((two, one))
            own = np.where(later, mix(tag.view(np.uint64) * _A + place.astype(np.uint64)), one)
            columns = [_signed(own), (two >> np.uint64(33)).astype(np.int32), weight, later, tag, place]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["one", "two", "n", "done", "tag", "place"])

        for block, data, at in text_blocks(batches):
            content = _Block(data, at, window)
            found = content.places()
            chosen = _marked(block, found, 2)
            start, which = _spread(found["low"][chosen], found["high"][chosen])
            text = found["text"][chosen][which]
            stop = start + window
            tags = block.column("tag").to_numpy()
            parts.append((content.runs(start, stop), content.runs(start, stop, 1), tags[text], (start - content.first[text]).astype(np.int32)))
            size += len(start)
            if size >= held:
                yield send()
                parts, size = [], 0
        if parts:
            yield send()

    rows = texts.mapInArrow(emit, "one long, two int, n int, done boolean, tag long, place int")
    rows = rows.withColumn("times", F.sum("n").over(Window.partitionBy("one", "two"))).where("done OR times > 1")
    return rows.groupBy("tag").agg(F.collect_set("place").alias("repeated"))


def _strip(texts: DataFrame, window: int) -> DataFrame:
    """(tag, n_removed, kept): the texts with marks, without the words of repeated windows."""

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches):
            content = _Block(data, at, window)
            found = content.places()
            sure = _marked(block, found, 1)
            start, _ = _spread(found["low"][sure], found["high"][sure])
            single = block.column("repeated")
            lengths = [len(r) if r.is_valid else 0 for r in single]
            more = single.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.concatenate([start, more + np.repeat(content.first, lengths)])
            edge = np.bincount(start, minlength=len(content.words) + 1) - np.bincount(
                start + window, minlength=len(content.words) + 1
            )[: len(content.words) + 1]
            gone = np.cumsum(edge)[: len(content.words)] > 0
            raw = data.tobytes()
            kept, removed = [], []
            for first, count in zip(content.first.tolist(), content.count.tolist()):
                stay = np.flatnonzero(~gone[first : first + count]) + first
                removed.append(count - len(stay))
                spans = zip(content.word_start[stay].tolist(), content.word_end[stay].tolist())
                kept.append(b" ".join(raw[a:b] for a, b in spans))
            yield pa.RecordBatch.from_arrays(
                [block.column("tag"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["tag", "n_removed", "kept"]
            )

    return texts.mapInArrow(strip, "tag long, n_removed long, kept string")


def stripped(texts: DataFrame, window: int = 35, held: int = 500_000) -> DataFrame:
    """(tag, n_removed, kept) for each text that loses words, from (tag, text).

    A word is lost if it is in a window of `window` words that also starts anywhere else, in the
    same text or another; `kept` joins the remaining words by one space. Null texts are empty and
    lose nothing. Copies of a text count as further occurrences; the tag is a 64-bit hash of the text.

    Round 1 deals anchors by key. Anchors seen once are dropped; where the windows around an
    anchor are equal as a whole they are settled, and only anchors that share a key with different
    surroundings send single windows into round 2. Only texts with such anchors travel.
    """
    if window < 3:
        raise ValueError("a window has at least three words")
    texts = texts.select("tag", F.coalesce("text", F.lit("")).alias("text"))
    marks = stored(_marks(texts, window, held), "repeat-marks")
    marked = texts.join(marks, "tag").groupBy("tag").agg(F.first("text").alias("text"), F.first("marks").alias("marks"))
    marked = stored(marked, "repeat-texts")
    repeated = _windows(marked.where(F.exists("marks", lambda m: m.bitwiseAND(2) > 0)), window, held)
    return _strip(marked.join(repeated, "tag", "left"), window).where("n_removed > 0")


def removal_report(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row; rows that repeat an id are each returned."""
    tagged = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), text_tag(text).alias("tag"))
    lost = stripped(tagged.select("tag", "text"), window)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, at in text_blocks(batches):
            raw = data.tobytes()
            words = [raw[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            digests = [hashlib.sha256(b" ".join(w)).hexdigest() for w in words]
            columns = [block.column("doc_id"), block.column("tag"), pa.array(map(len, words), pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "n_words", "whole"])

    rows = tagged.mapInArrow(whole, "doc_id long, tag long, n_words long, whole string")
    changed = lost.select("tag", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(changed, "tag", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def without_repeats(df: DataFrame, text: str = "text", window: int = 35) -> DataFrame:
    """`df` with the remaining words, joined by one space, in place of each text that loses words."""
    tag, kept = unused(df, "_tag"), unused(df, "_kept")
    tagged = df.withColumn(tag, text_tag(text))
    lost = stripped(tagged.select(F.col(tag).alias("tag"), F.col(f"`{text}`").alias("text")), window)
    joined = tagged.join(lost.select(F.col("tag").alias(tag), F.col("kept").alias(kept)), tag, "left")
    return joined.select(*[F.coalesce(kept, f"`{c}`").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns])
