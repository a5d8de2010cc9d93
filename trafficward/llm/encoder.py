"""Whole texts to token ids with a public tokenizer, remembering the ids of repeated units."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from .common import lower_ascii, span_hashes, word_spans

#: White space beyond ASCII, in UTF-8; units are cut at ASCII white space only.
_WIDE_SPACE = rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_WIDE_HEADS = [b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ENCODERS: dict[tuple[str, bool], "UnitEncoder"] = {}


def shared_encoder(vocabulary: str, spaced: bool) -> "UnitEncoder":
    """One encoder per Python worker, so that a task goes on with what earlier ones have learned."""
    key = (vocabulary, spaced)
    if key not in _ENCODERS:
        _ENCODERS[key] = UnitEncoder(vocabulary, spaced)
    return _ENCODERS[key]


class UnitEncoder:
    """Encodes texts as the tokenizers library does, each distinct unit once.

    A unit is a piece of text that the tokenizer's own first split never crosses: a run of letters
    (ASCII or Latin-1) at the head of a word, and what is left of the word up to ASCII white space; a
    word with a character beyond Latin-1's letters is one unit. Where white space counts (`spaced=True`, the byte-level
    split), the one space before goes with a word and other runs of white space are units too;
    where it is dropped (`spaced=False`), A-Z are lowered first. Texts with the string of an added
    token, and with `spaced` those with white space beyond ASCII, go whole to the library.

    Units of a block of texts are found and told apart in numpy by 64-bit hashes; only those not
    seen before become Python strings. At most `keep` units are remembered, then all are forgotten;
    one takes some 40 bytes, in arrays sorted by hash.
    """

    def __init__(self, vocabulary: str, spaced: bool, keep: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary)
        self.library = Tokenizer.from_file(path)
        self.spaced = spaced
        self.keep = keep
        added = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        odd = [re.escape(t) for t in added] + ([_WIDE_SPACE] if spaced else [])
        self.odd = re.compile(b"|".join(odd), re.IGNORECASE) if odd else None
        heads = {x for t in added for x in (t[:2], t[:2].lower(), t[:2].upper())}  # a block without any has no odd text
        self.heads = sorted(heads | (set(_WIDE_HEADS) if spaced else set()))
        self._forget()

    def _forget(self) -> None:
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # hashes in order, and whose they are
        self.ids, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each unit, in order."""
        starts, ends, row = word_spans(data, at)
        letter, wide = _LETTER[data], data >= 0x80
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs × and ÷
        for i in (lead, lead + 1):
            letter[i], wide[i] = True, False
        stops = np.append(np.flatnonzero(~letter), len(data))
        head = np.minimum(stops[np.searchsorted(stops, starts)], ends)
        wide = np.concatenate([[0], np.cumsum(wide)])
        head = np.where(wide[ends] > wide[starts], starts, head)
        begin = starts.copy()
        if self.spaced and len(starts):
            before = np.where(np.append(True, row[1:] != row[:-1]), at[row], np.append(0, ends[:-1]))
            glue = (starts > before) & (data[np.maximum(starts, 1) - 1] == 0x20)
            begin -= glue
        whole = head == starts
        parts = [(begin[~whole], head[~whole]), (np.where(whole, begin, head)[head < ends], ends[head < ends])]
        if self.spaced:
            lone = ~glue & (starts > before) if len(starts) else np.zeros(0, bool)
            if len(starts):
                cut = begin - lone  # white space that is no space stands alone before its word
                parts += [(before[cut > before], cut[cut > before]), (cut[lone], begin[lone])]
            last = at[:-1].copy()
            last[row] = ends  # the later word of a text wins
            parts.append((last[last < at[1:]], at[1:][last < at[1:]]))
        first, stop = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(first, kind="stable")
        return first[order], stop[order]

    def _joined(self, units: list[str]) -> list[list[int]] | None:
        """Ids of units of letters, encoded as one text and told apart by the library's word numbers."""
        glue = [0 if u[0] == " " else 1 for u in units] if self.spaced else [0] * len(units)
        text = "".join("\n" + u if g else u for u, g in zip(units, glue)) if self.spaced else " ".join(units)
        found = self.library.encode(text, add_special_tokens=False)
        place = np.cumsum(np.array(glue) + 1) - 1
        counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(units))
        if len(counts) != len(units) + sum(glue):
            return None
        ends = np.cumsum(counts)
        ids = found.ids
        return [ids[a:b] for a, b in zip((ends - counts)[place].tolist(), ends[place].tolist())]

    def _learn(self, units: list[str]) -> None:
        found: list[list[int] | None] = [None] * len(units)
        plain = [i for i, u in enumerate(units) if max(u) < "\u0100" and u.lstrip(" ").isalpha()]
        for at in range(0, len(plain), 10_000):
            part = plain[at : at + 10_000]
            for i, ids in zip(part, self._joined([units[i] for i in part]) or []):
                found[i] = ids
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, e in zip(rest, self.library.encode_batch_fast([units[i] for i in rest], add_special_tokens=False)):
            found[i] = e.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(lengths.sum()))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])

    def _numbers(self, names: np.ndarray, content: bytes, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The number of each unit, given by hash and a place where it stands; those not seen before are learned."""
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        found = np.empty(len(names), np.int32)
        found[known] = self.numbers[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            new = new[np.argsort(names[new])]
            found[new] = np.arange(len(self.names), len(self.names) + len(new), dtype=np.int32)
            self._learn([content[a:b].decode() for a, b in zip(first[new].tolist(), stop[new].tolist())])
            self.numbers = np.insert(self.numbers, at[new], found[new])
            self.names = np.insert(self.names, at[new], names[new])
        return found

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) one after the other, with `end` after each text, and the ids per text."""
        if len(self.names) > self.keep:
            self._forget()
        raw = [(t or "").encode() for t in texts]
        content, odd = b"".join(raw), {}
        if any(h in content for h in self.heads):
            odd = {i: self.library.encode(texts[i], add_special_tokens=False).ids for i, t in enumerate(raw) if self.odd.search(t)}
            for i in odd:
                raw[i] = b""
            content = b"".join(raw)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
        data = np.frombuffer(content, np.uint8)
        if not self.spaced:
            data = lower_ascii(data)
            content = data.tobytes()
        first, stop = self._units(data, at) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        inverse, names = pd.factorize(span_hashes(data, first, stop))
        where = np.empty(len(names), np.int64)
        where[inverse[::-1]] = np.arange(len(inverse))[::-1]  # the first place of each
        found = self._numbers(names, content, first[where], stop[where])
        numbers = found[inverse]
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        inside = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
        ids = self.ids[np.repeat(self.starts[numbers], lengths) + inside]
        bounds = np.concatenate([[0], ends])[np.searchsorted(first, at[1:], "left")]
        per_text = np.diff(bounds, prepend=0)
        if odd:
            place = np.repeat([bounds[i] for i in odd], [len(x) for x in odd.values()])
            ids = np.insert(ids, place, np.concatenate([np.array(x, np.uint32) for x in odd.values()]))
            for i, extra in odd.items():
                per_text[i] += len(extra)
        if end is not None:
            ids = np.insert(ids, np.cumsum(per_text), np.uint32(end))
            per_text = per_text + 1
        return ids, per_text
