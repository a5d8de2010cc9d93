"""SentencePiece unigram segmentation: Viterbi over a double-array trie of pieces with log scores.

Spaces become the mark U+2581 and one stands before the text; a character that no piece begins
with as a whole falls back to its UTF-8 bytes. Decoding turns marks into spaces, bytes into
characters, and drops the leading space. (A mark in the text itself comes back as a space.)
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import text_blocks

MARK = "▁"
_MARK = MARK.encode()
#: A character without a piece costs this much more than the worst piece.
PENALTY = 10.0
_UNITS = re.compile(r" *[^ \n]+| +|\n")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces and their trie: `base[node] + byte` is the child's slot if `check[slot] == node`."""

    scores: np.ndarray  # per id
    text: np.ndarray  # bytes that each id stands for, one after the other
    starts: np.ndarray
    lengths: np.ndarray
    byte_ids: np.ndarray  # id of each byte
    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # id of the piece that ends at a node, or −1
    unknown: float
    longest: int


def build_trie(keys: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base, check and piece arrays of a double-array trie (root at 0), each node's children at the first free place."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, number in sorted(keys):
        node = 0
        for byte in key:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                ends.append(-1)
            node = children[node][byte]
        ends[node] = number
    size = 2 * len(children) + 1024
    used = bytearray(size)
    used[0] = 1
    base, check, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    slot = {0: 0}
    free, todo = 1, [0]
    for node in todo:
        piece[slot[node]] = ends[node]
        kids = list(children[node].items())
        if not kids:
            continue
        while used[free]:
            free += 1
        low = min(b for b, _ in kids)
        at, tries = max(1, free - low), 0
        while any(used[at + b] for b, _ in kids):
            at, tries = at + 1, tries + 1
        if tries > 64:  # nearly full here: later nodes start further on
            free = max(free, at + low - 64)
        if at + 512 > size:
            grow = size
            used.extend(bytes(grow))
            base, check, piece = (np.concatenate([a, np.full(grow, v, np.int32)]) for a, v in ((base, 0), (check, -1), (piece, -1)))
            size += grow
        base[slot[node]] = at
        for byte, kid in kids:
            used[at + byte] = 1
            check[at + byte] = slot[node]
            slot[kid] = at + byte
            todo.append(kid)
    return base, check, piece


def load_vocabulary(model: str = "piece_bpe_32k.model") -> Vocabulary:
    """Pieces and scores of a public SentencePiece model file (name or path); its own algorithm is not used."""
    import public_tokenizers
    import sentencepiece

    path = model if os.path.sep in model else public_tokenizers.path(model)
    source = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(source.get_piece_size())
    byte_ids = np.zeros(256, np.int64)
    keys, texts = [], []
    for i in ids:
        piece = source.id_to_piece(i)
        if source.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            texts.append(bytes([value]))
        elif source.is_control(i) or source.is_unknown(i) or source.is_unused(i):
            texts.append(b"")
        else:
            keys.append((piece.encode(), i))
            texts.append(piece.replace(MARK, " ").encode())
            if "\n" in piece or re.search(f"[^{MARK}]{MARK}", piece):
                raise ValueError("a piece crosses the places where texts are cut")
    scores = np.array([source.get_score(i) for i in ids])
    lengths = np.array([len(t) for t in texts], np.int64)
    base, check, piece = build_trie(keys)
    lowest = min(scores[i] for _, i in keys)
    return Vocabulary(
        scores, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths, byte_ids,
        base, check, piece, float(lowest) - PENALTY, max(len(k) for k, _ in keys),
    )


def _char_length(lead: np.ndarray) -> np.ndarray:
    return np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))


def viterbi(vocabulary: Vocabulary, units: list[bytes]) -> list[list[int]]:
    """Best segmentation of each unit; of equal scores, the one whose last piece is longest.

    All units advance together, byte by byte: from every position reached so far, rows walk
    down the trie until they fall off it.
    """
    v, n = vocabulary, len(units)
    sizes = np.array([len(u) for u in units], np.int64)
    width = int(sizes.max()) if n else 0
    grid = np.zeros((n, width + 1), np.uint8)
    grid[np.arange(width + 1)[None, :] < sizes[:, None]] = np.frombuffer(b"".join(units), np.uint8)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0.0
    back, last = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
    for i in range(width):
        rows = np.flatnonzero((best[:, i] > -np.inf) & (sizes > i))
        if not len(rows):
            continue
        char = _char_length(grid[rows, i])
        single = np.zeros(n, bool)
        alive, node = rows, np.zeros(len(rows), np.int32)
        for j in range(i, min(width, i + v.longest)):
            slot = v.base[node] + grid[alive, j]
            ok = (v.check[slot] == node) & (sizes[alive] > j)
            alive, node = alive[ok], slot[ok]
            if not len(alive):
                break
            hit = v.piece[node] >= 0
            at, number = alive[hit], v.piece[node[hit]]
            score = best[at, i] + v.scores[number]
            better = score > best[at, j + 1]
            at, number = at[better], number[better]
            best[at, j + 1], back[at, j + 1], last[at, j + 1] = score[better], i, number
            single[alive[hit][_char_length(grid[alive[hit], i]) == j + 1 - i]] = True
        lone = ~single[rows]
        at, end = rows[lone], np.minimum(i + char[lone], sizes[rows[lone]])
        score = best[at, i] + v.unknown
        better = score > best[at, end]
        at, end = at[better], end[better]
        best[at, end], back[at, end], last[at, end] = score[better], i, -1
    out = []
    byte_ids = v.byte_ids.tolist()
    for unit, starts, numbers in zip(units, back.tolist(), last.tolist()):
        ids, end = [], len(unit)
        while end:
            start = starts[end]
            if numbers[end] < 0:
                ids.extend(byte_ids[b] for b in reversed(unit[start:end]))
            else:
                ids.append(numbers[end])
            end = start
        out.append(ids[::-1])
    return out


def _viterbi_long(vocabulary: Vocabulary, unit: bytes) -> list[int]:
    """`viterbi` for one unit of any length, keeping one row."""
    v = vocabulary
    n = len(unit)
    base, check, piece = v.base, v.check, v.piece
    best, back, last = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] == -np.inf:
            continue
        lead = unit[i]
        char = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        node, single = 0, False
        for j in range(i, n):
            slot = int(base[node]) + unit[j]
            if check[slot] != node:
                break
            node = slot
            number = int(piece[node])
            if number >= 0:
                single |= j + 1 - i == char
                score = best[i] + float(v.scores[number])
                if score > best[j + 1]:
                    best[j + 1], back[j + 1], last[j + 1] = score, i, number
        end = min(n, i + char)
        if not single and best[i] + v.unknown > best[end]:
            best[end], back[end], last[end] = best[i] + v.unknown, i, -1
    ids, end = [], n
    while end:
        if last[end] < 0:
            ids.extend(int(v.byte_ids[b]) for b in reversed(unit[back[end] : end]))
        else:
            ids.append(last[end])
        end = back[end]
    return ids[::-1]


class Segmenter:
    """Encodes texts unit by unit: no piece crosses a space that follows something else, or a line end.

    So the best path of a text is the best paths of its units, and each distinct unit is
    searched once. At most `keep` units are remembered, then all are forgotten.
    """

    def __init__(self, vocabulary: Vocabulary, keep: int = 500_000, wide: int = 40) -> None:
        self.vocabulary, self.keep, self.wide = vocabulary, keep, wide
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, units: list[str]) -> None:
        coded = [u.replace(" ", MARK).encode() for u in units]
        found: list[list[int]] = [[]] * len(units)
        order = sorted(range(len(units)), key=lambda i: len(coded[i]))
        short = [i for i in order if len(coded[i]) <= self.wide]
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            for i, ids in zip(part, viterbi(self.vocabulary, [coded[i] for i in part])):
                found[i] = ids
        for i in order[len(short) :]:
            found[i] = _viterbi_long(self.vocabulary, coded[i])
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one after the other, and the ids per text (null: none)."""
        if len(self.numbers) > self.keep:
            self._forget()
        units = [_UNITS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        fresh = list(dict.fromkeys(u for x in units for u in x if u not in self.numbers))
        if fresh:
            self.numbers.update(zip(fresh, range(len(self.numbers), len(self.numbers) + len(fresh))))
            self._learn(fresh)
        counts = np.fromiter(map(len, units), np.int64, len(units))
        numbers = np.fromiter((self.numbers[u] for x in units for u in x), np.int64, int(counts.sum()))
        lengths = self.lengths[numbers]
        ids = self.ids[_ranges(self.starts[numbers], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
    """The texts of some ids; bytes that form no character come back as U+FFFD."""
    v = vocabulary
    lengths = v.lengths[ids]
    content = v.text[_ranges(v.starts[ids], lengths)].tobytes()
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(per_text)]
    cut = [content[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]
    return [(c[1:] if c[:1] == b" " else c).decode("utf-8", "replace") for c in cut]


def encoded(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each text. Null and empty texts have none; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(vocabulary)
        for block, _, _ in text_blocks(batches):
            ids, per_text = segmenter.encode(block.column("text").to_pylist())
            offsets = np.append(0, np.cumsum(per_text)).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), values], ["doc_id", "ids"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decoded(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                column = part.column("ids")
                per_text = np.array([len(x) if x.is_valid else 0 for x in column], np.int64)
                flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(decode_ids(vocabulary, flat, per_text), pa.string())], ["doc_id", "text"])

    rows = df.select(F.col(key).alias("doc_id"), F.col(ids).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trips(df: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_bytes, ids_crc32, score, decoded_sha256, same): each text's ids, and the text decoded from them.

    `n_bytes` counts byte tokens, `score` sums the other tokens' log scores, `same` tells whether the
    decoded text is the text with marks as spaces.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("score", pa.float64()), ("decoded_sha256", pa.string()), ("same", pa.bool_())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(vocabulary)
        is_byte = np.zeros(len(vocabulary.scores), bool)
        is_byte[vocabulary.byte_ids] = True
        for block, _, _ in text_blocks(batches):
            texts = block.column("text").to_pylist()
            ids, per_text = segmenter.encode(texts)
            back = decode_ids(vocabulary, ids, per_text)
            ends = np.cumsum(per_text)
            sums = [np.append(0, np.cumsum(x))[ends] for x in (is_byte[ids], np.where(is_byte[ids], 0.0, vocabulary.scores[ids]))]
            content = memoryview(ids.astype("<u4").tobytes())
            bounds = zip((4 * (ends - per_text)).tolist(), (4 * ends).tolist())
            columns = [
                block.column("doc_id"),
                per_text,
                np.diff(sums[0], prepend=0),
                [zlib.crc32(content[a:b]) for a, b in bounds],
                np.diff(sums[1], prepend=0.0),
                [hashlib.sha256(t.encode()).hexdigest() for t in back],
                [b == (t or "").replace(MARK, " ") for b, t in zip(back, texts)],
            ]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kinds = "doc_id long, n_tokens long, n_bytes long, ids_crc32 long, score double, decoded_sha256 string, same boolean"
    return rows.mapInArrow(run, kinds)
