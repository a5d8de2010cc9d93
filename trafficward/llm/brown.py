"""Brown class-based bigrams: words in classes by exchange clustering, texts scored by class
transitions and word emissions.

The corpus is first coded in chunks: a chunk holds the tokens of some MB of text as numbers into its
own dictionary of word hashes. What tasks exchange are dictionary entries (one per word and chunk),
never tokens; all counts cover all training tokens.

1. Vocabulary: training counts per word.
2. Exchange: the bigram counts between the `frequent` commonest words are dealt by word. Each round,
   every one of these words is moved to the class that gains most likelihood while the others
   stay; only half of them (alternating) really move at a time, and a round that loses is undone.
3. All other words: in each chunk, a word's neighbours of step 2 vote for the class that explains
   them best; the class with most votes, weighted by occurrences, is the word's. Words without
   such a neighbour form a class of their own.
4. Probability of a word after another: transition between their classes, interpolated with the
   class's own share, times the word's share of its class. Shares are discounted by one constant;
   what is freed belongs to unknown words, so known and unknown words sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .blocks import pack_blocks, unpack_blocks
from .common import lower_ascii, span_hashes, stored, text_blocks, word_spans

#: The end of a text, as a word.
END = 0
UNKNOWN = 255
#: Chunks are rows of megabytes: writer and reader hold a row group of them.
_SMALL_GROUPS = {"parquet.block.size": 8 << 20}
_CHUNK = "chunk long, n_tokens long, tokens binary, words binary, counts binary, doc_ids array<long>, held array<boolean>, lengths array<int>"


@dataclass(frozen=True)
class Model:
    """Class sizes in tokens and types, transition counts between classes, and totals of training."""

    vocabulary: DataFrame  # word long, n long, class int
    classes: int
    discount: float
    smoothing: float
    tokens: np.ndarray
    types: np.ndarray
    n_tokens: int
    n_types: int
    end_class: int


def code_corpus(df: DataFrame, held_out, key: str = "doc_id", text: str = "text", chunk_tokens: int = 1_000_000) -> DataFrame:
    """The texts as chunks of token numbers; null texts hold the end alone.

    A-Z are lowered; words are runs of bytes outside space and \\t..\\r, told apart by 64-bit hashes.
    A chunk is closed at a text's end once it holds `chunk_tokens` tokens.
    """
    rows = df.select(
        F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
        F.coalesce(held_out, F.lit(False)).alias("held"), F.spark_partition_id().alias("part"),
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seq, part = [], 0, 0, 0
        for block, data, at in text_blocks(batches):
            low = lower_ascii(data)
            starts, ends, text_of = word_spans(low, at)
            lengths = np.bincount(text_of, minlength=len(at) - 1) + 1
            hashes = np.full(int(lengths.sum()), END, np.uint64)
            place = np.ones(len(hashes), bool)
            place[np.cumsum(lengths) - 1] = False
            hashes[place] = span_hashes(low, starts, ends)
            part = block.column("part")[0].as_py()
            parts.append((hashes, lengths, block.column("held").to_numpy(zero_copy_only=False), block.column("doc_id").to_pylist()))
            size += len(hashes)
            if size >= chunk_tokens:
                yield _chunk((part << 24) + seq, parts)
                parts, size, seq = [], 0, seq + 1
        if parts:
            yield _chunk((part << 24) + seq, parts)

    return rows.mapInArrow(code, _CHUNK)


def _chunk(name: int, parts: list[tuple]) -> pa.RecordBatch:
    hashes, lengths, held = (np.concatenate([p[i] for p in parts]) for i in range(3))
    words, numbers, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")  # common words get small numbers
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    numbers = rank[numbers]
    train = np.bincount(numbers[np.repeat(~held, lengths)], minlength=len(words))
    columns = [
        [name], [len(numbers)], [pack_blocks(numbers)], [words[order].tobytes()], [pack_blocks(train.astype(np.uint32))],
        [[i for p in parts for i in p[3]]], [held.tolist()], [lengths.tolist()],
    ]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, word hashes, training counts, text lengths, held-out flags of a chunk."""
    numbers = unpack_blocks(memoryview(row["tokens"]), row["n_tokens"]).astype(np.int64)
    words = np.frombuffer(row["words"], np.uint64)
    counts = unpack_blocks(memoryview(row["counts"]), len(words)).astype(np.int64)
    return numbers, words, counts, np.array(row["lengths"], np.int64), np.array(row["held"], bool)


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _follows(lengths: np.ndarray, held: np.ndarray) -> np.ndarray:
    """For each token of a chunk, whether it is a training token that has one before it in its text."""
    first = np.cumsum(lengths) - lengths
    ok = np.repeat(~held, lengths)
    ok[first] = False
    return ok


def vocabulary(chunks: DataFrame) -> DataFrame:
    """(word, n): each training word's count."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, counts in zip(batch.column("words"), batch.column("counts")):
                w = np.frombuffer(words.as_buffer(), np.int64)
                n = unpack_blocks(memoryview(counts.as_py()), len(w)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(w[n > 0]), pa.array(n[n > 0])], ["word", "n"])

    rows = chunks.select("words", "counts").mapInArrow(entries, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(chunks: DataFrame, top: np.ndarray) -> DataFrame:
    """(a, b, n): how often top word b follows top word a, the end of a text counting as before its first word."""
    order = np.argsort(top)
    known = top[order]
    m = len(top)
    end = int(np.flatnonzero(top == END)[0]) if (top == END).any() else -1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            numbers, words, _, lengths, held = _opened(row)
            at = np.minimum(np.searchsorted(known, words), m - 1)
            rank = np.where(known[at] == words, order[at], -1)[numbers]
            before = np.append(-1, rank[:-1])
            before[np.cumsum(lengths) - lengths] = end
            ok = np.repeat(~held, lengths) & (rank >= 0) & (before >= 0)
            pair, n = np.unique(before[ok] * m + rank[ok], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pair // m).astype(np.int32)), pa.array((pair % m).astype(np.int32)), pa.array(n)], ["a", "b", "n"])

    return chunks.mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def class_counts(links: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    """Bigram counts between classes (classes × classes, whatever the corpus)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(classes * classes)
        for b in batches:
            w, other, n = (b.column(c).to_numpy() for c in ("word", "other", "n"))
            out += np.bincount(of[w] * classes + of[other], weights=n, minlength=classes * classes)
        cell = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(out[cell])], ["cell", "n"])

    found = links.where("next").mapInArrow(count, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(classes * classes)
    out[found["cell"]] = found["n"]
    return out.reshape(classes, classes)


def likelihood(counts: np.ndarray) -> float:
    """Class bigram log-likelihood, less what the words alone give."""
    return float(_xlogx(counts).sum() - _xlogx(counts.sum(axis=0)).sum() - _xlogx(counts.sum(axis=1)).sum())


def best_class(counts: np.ndarray, now: int, after: np.ndarray, before: np.ndarray, own: float) -> tuple[int, float]:
    """The class that suits a word best, all others staying, and the gain over its present class.

    `after` and `before` count the classes of the words that follow and precede it (itself
    left out), `own` how often it follows itself.
    """
    g = counts.copy()
    g[now] -= after
    g[:, now] -= before
    g[now, now] -= own
    g = np.maximum(g, 0.0)
    n_after, n_before = after.sum() + own, before.sum() + own
    rows, columns = g.sum(axis=1), g.sum(axis=0)
    score = (_xlogx(g + after[None, :]) - _xlogx(g)).sum(axis=1) + (_xlogx(g + before[:, None]) - _xlogx(g)).sum(axis=0)
    d = np.diagonal(g)
    score += _xlogx(d + after + before + own) + _xlogx(d) - _xlogx(d + after) - _xlogx(d + before)
    # the word's neighbours count in the margins of their classes, wherever it goes
    rows, columns = rows + before, columns + after
    score -= _xlogx(rows + n_after) - _xlogx(rows) + _xlogx(columns + n_before) - _xlogx(columns)
    best = int(np.argmax(score))
    return best, float(score[best] - score[now])


def exchange(pairs: DataFrame, m: int, classes: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Class of each of the m top words, and the counts between classes."""
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), "n", F.lit(True).alias("next")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), "n", F.lit(False).alias("next"))
    )
    links = stored(both.repartition("word").sortWithinPartitions("word"), "class-bigrams")
    of = np.arange(m) % classes
    counts = class_counts(links, of, classes)
    value = likelihood(counts)

    def proposals(of: np.ndarray, counts: np.ndarray, share: int, turn: int) -> pd.DataFrame:
        def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = [tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("word", "other", "n", "next")) for b in batches]
            if not seen:
                return
            word, other, n, after = (np.concatenate(c) for c in zip(*seen))
            due = (word // classes + word + turn) % share == 0  # only these may move in this round
            word, other, n, after = word[due], other[due], n[due], after[due]
            mine, at = np.unique(word, return_inverse=True)
            itself = word == other
            table = np.zeros((2, len(mine), classes))
            np.add.at(table, ((~after).astype(int)[~itself], at[~itself], of[other[~itself]]), n[~itself])
            own = np.bincount(at[itself & after], weights=n[itself & after], minlength=len(mine))
            found = [best_class(counts, int(of[w]), table[0, i], table[1, i], own[i]) for i, w in enumerate(mine.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array([b for b, _ in found], pa.int32()), pa.array([g for _, g in found])], ["word", "class", "gain"])

        return links.mapInArrow(propose, "word int, class int, gain double").toPandas()

    share = 2
    for turn in range(rounds):
        found = proposals(of, counts, share, turn)
        found = found[found["gain"] > 1e-6]
        moved = of.copy()
        moved[found["word"]] = found["class"]
        new = class_counts(links, moved, classes)
        if likelihood(new) > value:
            of, counts, value = moved, new, likelihood(new)
        else:
            share *= 2  # too many moved at once
    return of, counts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _votes(chunks: DataFrame, top: np.ndarray, of: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(word, class, n): per chunk and word outside `top`, the class its neighbours in `top` speak for."""
    order = np.argsort(top)
    known, classes = top[order], len(counts)
    smooth = counts + 0.1
    ratio = np.log(smooth * smooth.sum() / (smooth.sum(axis=1, keepdims=True) * smooth.sum(axis=0, keepdims=True)))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            numbers, words, train, lengths, held = _opened(row)
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            class_of = np.where(known[at] == words, of[order[at]], -1)
            cls = class_of[numbers]
            follows = _follows(lengths, held)
            slots = []
            here = np.flatnonzero(follows & (cls < 0))
            here = here[cls[here - 1] >= 0]
            slots.append(numbers[here] * (2 * classes) + cls[here - 1])
            there = np.flatnonzero(follows & (cls >= 0))
            there = there[cls[there - 1] < 0]
            slots.append(numbers[there - 1] * (2 * classes) + classes + cls[there])
            cls = follows = here = there = None
            slot, n = np.unique(np.concatenate(slots), return_counts=True)
            other = np.flatnonzero((class_of < 0) & (train > 0))
            # words without any neighbour in `top` vote with weight 0 for the class of the unplaced
            best = np.full(len(words), classes, np.int32)
            table = np.concatenate([ratio, ratio.T])
            owner = slot // (2 * classes)
            bounds = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
            for i in range(0, len(bounds), 1 << 10):
                part = bounds[i : i + (1 << 10)]
                stop = bounds[i + len(part)] if i + len(part) < len(bounds) else len(slot)
                sums = np.add.reduceat(table[slot[part[0] : stop] % (2 * classes)] * n[part[0] : stop, None], part - part[0], axis=0)
                best[owner[part]] = np.argmax(sums, axis=1)
            heard = np.zeros(len(words), np.int64)
            np.add.at(heard, owner, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words[other].view(np.int64)), pa.array(best[other]), pa.array(heard[other])], ["word", "class", "n"]
            )

    return chunks.mapInArrow(vote, "word long, class int, n long")


def fit(chunks: DataFrame, classes: int = 64, frequent: int = 4096, rounds: int = 30, smoothing: float = 10.0) -> Model:
    """Fit the model on the training texts of some chunks. `classes` and `frequent` bound what the driver holds.

    The model has one class more than `classes`, for the words that no neighbour places.
    """
    if not 1 <= classes < UNKNOWN - 1:
        raise ValueError("between 1 and 253 classes")
    spark = chunks.sparkSession
    counted = stored(vocabulary(chunks), "vocabulary")
    totals = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    n_types, n_tokens, once, twice = (int(x) for x in totals)
    discount = min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5
    top = counted.orderBy(F.desc("n"), "word").limit(frequent).toPandas()["word"].to_numpy(np.int64).view(np.uint64)
    if not len(top):
        empty = spark.createDataFrame([], "word long, n long, class int")
        return Model(empty, classes + 1, discount, smoothing, np.zeros(classes + 1), np.zeros(classes + 1), 0, 0, 0)
    of, counts = exchange(_pairs(chunks, top), len(top), classes, rounds)
    # from Arrow: a Python list would start further workers on every executor
    fixed = spark.createDataFrame(pa.table({"word": _signed(top), "class": pa.array(of, pa.int32())}))
    votes = _votes(chunks, top, of, counts).groupBy("word", "class").agg(F.sum("n").alias("n"))
    chosen = votes.groupBy("word").agg(F.max_by("class", F.struct("n", -F.col("class"))).alias("class"))
    full = stored(counted.join(chosen.unionByName(fixed), "word"), "word-classes")
    sizes = full.groupBy("class").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types")).toPandas()
    tokens, types = np.zeros(classes + 1), np.zeros(classes + 1)
    tokens[sizes["class"]], types[sizes["class"]] = sizes["tokens"], sizes["types"]
    end = np.flatnonzero(top == END)
    end_class = int(of[end[0]]) if len(end) else int(full.where(F.col("word") == END).first()["class"])
    return Model(full, classes + 1, discount, smoothing, tokens, types, n_tokens, n_types, end_class)


def _classed(chunks: DataFrame, model: Model) -> DataFrame:
    """Per chunk, each token's class (one byte, 255 if unknown) and each text's sums over its words."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words in zip(batch.column("chunk"), batch.column("words")):
                w = np.frombuffer(words.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.repeat(chunk, len(w)), pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w)], ["chunk", "at", "word"])

    asked = chunks.select("chunk", "words").mapInArrow(look, "chunk long, at int, word long")
    answers = asked.join(model.vocabulary, "word").select("chunk", "at", "n", "class")
    tokens = chunks.select("chunk", "n_tokens", "tokens", (F.length("words") / 8).cast("int").alias("n_words"), "doc_ids", "held", "lengths")
    total = model.n_tokens + model.n_types + 1
    discount = model.discount
    fields = [("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("emitted", pa.list_(pa.float64())), ("classes", pa.binary())]
    schema = pa.schema(fields)

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        numbers, lengths = unpack_blocks(memoryview(row["tokens"]), row["n_tokens"]), np.array(row["lengths"], np.int64)
        n, cls = np.zeros(row["n_words"], np.int64), np.full(row["n_words"], UNKNOWN, np.uint8)
        at = right.column("at").to_numpy()
        n[at], cls[at] = right.column("n").to_numpy(), right.column("class").to_numpy()
        stops = np.cumsum(lengths)

        def per_text(value: np.ndarray) -> np.ndarray:
            return np.add.reduceat(value[numbers], stops - lengths)

        emitted = np.where(n > 0, np.log10(np.maximum(n - discount, 1e-300)), 0.0)
        columns = [
            [row["doc_ids"]], [row["held"]], [row["lengths"]], [per_text((n > 0).astype(np.int64)).tolist()],
            [per_text(np.log10((n + 1) / total)).tolist()], [per_text(emitted).tolist()], [cls[numbers].tobytes()],
        ]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    kinds = "doc_ids array<long>, held array<boolean>, lengths array<int>, known array<long>, base array<double>, emitted array<double>, classes binary"
    # the tokens of a chunk and the answers to its own words, both bounded by the chunk
    return tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(code, kinds)


def step_table(moves: np.ndarray, model: Model) -> np.ndarray:
    """log10 of a class after a class, per discounted count of the word; the last row follows an unknown
    word, column 255 is the probability of an unknown word. A row sums to one over all words."""
    c = model.classes
    share = model.tokens / max(1.0, model.tokens.sum()) if model.n_tokens else np.full(c, 1.0 / c)
    move = (moves + model.smoothing * share) / (moves.sum(axis=1, keepdims=True) + model.smoothing)
    move = np.vstack([move, share])
    sizes = np.maximum(model.tokens, 1.0)
    freed = move @ np.where(model.tokens > 0, model.discount * model.types / sizes, 0.0) if model.n_tokens else np.ones(c + 1)
    table = np.zeros((c + 1, 256))
    table[:, :c] = np.log10(np.maximum(move / sizes, 1e-300))
    table[:, UNKNOWN] = np.log10(np.maximum(freed, 1e-300))
    return table


def score(chunks: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each text of the chunks.

    The context of a text's first word is the end of a text; after an unknown word, classes have
    their own shares. Scores are log10 probabilities of all tokens, the end included.
    """
    classed = stored(_classed(chunks, model), "classed", **_SMALL_GROUPS)
    c, end_class, train_tokens = model.classes, model.end_class, model.n_tokens

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(256 * 256, np.int64)
        for row in _chunk_rows(batches):
            cls, before = _contexts(row, end_class)
            ok = np.repeat(~np.array(row["held"], bool), np.array(row["lengths"], np.int64))
            out += np.bincount(before[ok].astype(np.int64) * 256 + cls[ok], minlength=256 * 256)
        cell = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(out[cell])], ["cell", "n"])

    found = classed.select("held", "lengths", "classes").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    full = np.zeros(256 * 256)
    full[found["cell"]] = found["n"]
    table = step_table(full.reshape(256, 256)[:c, :c], model)
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("perplexity", pa.float64())]
    )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _chunk_rows(batches):
            cls, before = _contexts(row, end_class)
            lengths = np.array(row["lengths"], np.int64)
            steps = table[np.minimum(before, c), cls]
            found = np.add.reduceat(steps, np.cumsum(lengths) - lengths) + np.array(row["emitted"])
            columns = [row["doc_ids"], row["held"], lengths, row["known"], np.full(len(lengths), train_tokens), row["base"], found, 10.0 ** (-found / lengths)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    kinds = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return classed.mapInArrow(total, kinds)


def _contexts(row: dict, end_class: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's class and the class before it."""
    cls = np.frombuffer(row["classes"], np.uint8)
    lengths = np.array(row["lengths"], np.int64)
    before = np.append(np.uint8(0), cls[:-1])
    before[np.cumsum(lengths) - lengths] = end_class
    return cls, before


def scored_documents(df: DataFrame, held_out, key: str = "doc_id", text: str = "text", **fitting) -> DataFrame:
    """Fit on the rows where `held_out` is false or null, score all rows; empty tables give an empty result."""
    chunks = stored(code_corpus(df, held_out, key, text), "chunks", **_SMALL_GROUPS)
    return score(chunks, fit(chunks, **fitting))
