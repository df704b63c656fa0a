"""Token ids of whole text columns with the ``tokenizers`` library, at a cost near that of reading them.

The two public vocabularies cut a text into pieces (words with their leading space, numbers, symbols, white space) that are
encoded one by one. Pieces are found with array operations, each distinct piece is encoded once per worker by the library's
model, and its ids are kept under a 64-bit hash in a bounded table, with the piece's letters, which are compared on every hit. Texts with characters outside a plain range (where Unicode
versions or normalisation could matter) and texts with the strings of special tokens go through the library as a whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ravelin.llm import memory, textops
from ravelin.llm.hashing import KeyTable

#: Entries of a worker's table of pieces; beyond it starts anew.
MOST_PIECES = 1 << 21
_OTHER, _LETTER, _NUMBER, _SPACE, _UNSAFE = range(5)
_PLAIN = 0x2100


def encoder(path: str) -> "Encoder":
    """The worker's encoder for a vocabulary file; it lives until the worker keeps something else."""
    return memory.kept(f"encoder:{path}", lambda: Encoder(path))


def _classes() -> np.ndarray:
    import regex

    out = np.full(_PLAIN, _UNSAFE, np.uint8)
    # fixed values: the plain ranges, without controls and letters that change their length in lower case
    plain = [*range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B), 0x20AC]
    for code in plain:
        ch = chr(code)
        out[code] = _LETTER if regex.match(r"\p{L}", ch) else _NUMBER if regex.match(r"\p{N}", ch) else _SPACE if regex.match(r"\s", ch) else _OTHER
    out[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
    out[0x130] = _UNSAFE
    return out


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.lower = (spec.get("normalizer") or {}).get("type") == "Sequence"
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.classes = _classes()
        # the printable stand-ins of the 256 bytes in byte-level vocabularies
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in keep]
        self.shown = np.zeros(256, np.uint32)
        self.shown[keep], self.shown[rest] = keep, 256 + np.arange(len(rest))
        self._clear()

    def _clear(self) -> None:
        self.known = KeyTable()
        self.at, self.many, self.flat, self.used = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32), np.zeros(1 << 17, np.uint32), 0
        # the pieces themselves: place and bytes of each, and all of them in a row with room for a last block
        self.place, self.bytes, self.letters, self.filled = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64), np.zeros(1 << 18, np.uint8), 0

    def _add(self, keys: np.ndarray, pieces: list[str], spans: list[np.ndarray]) -> None:
        # all pieces at once in the vocabulary's stand-ins; no plain piece holds the separator
        shown = self.shown[np.frombuffer("\x00".join(pieces).encode(), np.uint8)].tobytes().decode("utf-32-le")
        one = self.model.tokenize
        ids = [[t.id for t in one(p)] for p in shown.split(chr(self.shown[0]))]
        counts = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(counts.sum()))
        new = self.known.add(keys)
        while self.known.n > len(self.at):
            self.at, self.many = np.resize(self.at, 2 * len(self.at)), np.resize(self.many, 2 * len(self.many))
            self.place, self.bytes = np.resize(self.place, 2 * len(self.place)), np.resize(self.bytes, 2 * len(self.bytes))
        while self.used + len(flat) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.at[new] = self.used + np.cumsum(counts) - counts
        self.many[new] = counts
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        letters, sizes = np.concatenate(spans), np.array([len(x) for x in spans], np.int64)
        while self.filled + len(letters) + 8 > len(self.letters):
            self.letters = np.resize(self.letters, 2 * len(self.letters))
        self.place[new], self.bytes[new] = self.filled + np.cumsum(sizes) - sizes, sizes
        self.letters[self.filled : self.filled + len(letters)] = letters
        self.filled += len(letters)

    def _same(self, entry: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> bool:
        """Are the spans of ``raw`` the very pieces of their entries?"""
        if (self.bytes.take(entry) != lengths).any():
            return False
        here, there, places = textops.blocks(raw), textops.blocks(self.letters), self.place.take(entry)
        for left, at, rest in textops.block_steps(starts, lengths):
            if ((textops.masked(here[at], rest)) != textops.masked(there[places[left] + (at - starts[left])], rest)).any():
                return False
        return True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def column(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids, offsets of each row's ids) for runs of rows; null reads as empty."""
        for first, end, data, offsets in textops.chunks(column):
            text = data.tobytes().decode()
            head = (data & 0xC0) != 0x80
            at = np.concatenate(([0], np.cumsum(head)))[offsets]
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            kinds = self.classes.take(codes, mode="clip")
            bad = np.unique(np.searchsorted(at, np.flatnonzero((kinds == _UNSAFE) | (codes >= _PLAIN)), side="right") - 1).tolist()
            if any(s in text for s in self.special):
                bad = sorted({*bad, *(r for r in range(end - first) if any(s in text[at[r] : at[r + 1]] for s in self.special))})
            if not bad and (found := self._plain(text, codes, kinds, at)):
                yield first, end, *found
                continue
            wrong, parts = set(bad), []
            for r in range(end - first):
                own = slice(at[r], at[r + 1])
                found = None if r in wrong else self._plain(text[own], codes[own], kinds[own], np.array([0, at[r + 1] - at[r]]))
                parts.append(found[0] if found else self._ids(text[own]))
            yield first, end, np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def _plain(self, text: str, codes: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, offsets) of plain text; None if two of its pieces, or one and a known one, have one hash."""
        if not len(codes):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        if self.lower:
            text = text.lower()
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends = self._pieces(codes, kinds, at)
        # plain letters fit 16 bits
        raw = textops.padded(codes.astype("<u2").view(np.uint8))
        first, size = 2 * starts, 2 * (ends - starts)
        keys = textops.hashed(raw, first, first + size) | np.uint64(1 << 63)
        entry = self.known.find(keys)
        if (entry < 0).any():
            new, where = np.unique(keys[entry < 0], return_index=True)
            if self.known.n + len(new) > MOST_PIECES:
                self._clear()
                new, where = np.unique(keys, return_index=True)
                spans = where
            else:
                spans = np.flatnonzero(entry < 0)[where]
            own = list(zip(starts[spans].tolist(), ends[spans].tolist(), strict=True))
            self._add(new, [text[a:b] for a, b in own], [raw[2 * a : 2 * b] for a, b in own])
            entry = self.known.find(keys)
        if not self._same(entry, raw, first, size):
            return None
        counts = self.many.take(entry)
        total = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
        ids = self.flat.take(np.repeat(self.at.take(entry) - total[:-1], counts) + np.arange(total[-1]))
        return ids, total[np.searchsorted(starts, at)]

    def _pieces(self, codes: np.ndarray, kinds: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(codes)
        begin = np.ones(n + 1, bool)
        begin[1:n] = kinds[1:] != kinds[:-1]
        edges = np.zeros(n + 1, bool)
        edges[at] = True
        begin |= edges
        if self.lower:
            begin[:n] |= kinds == _NUMBER
        runs = np.flatnonzero(begin)
        # 's 't 'm 'd 're 've 'll after a lone apostrophe that no space precedes
        quotes = np.flatnonzero(codes == 0x27)
        quotes = quotes[begin[quotes] & begin[quotes + 1] & ~edges[quotes + 1]]
        if not self.lower:
            before = np.maximum(quotes - 1, 0)
            quotes = quotes[edges[quotes] | (codes[before] != 0x20)]
        joined = []
        for q in quotes.tolist():
            one, two = chr(codes[q + 1]), "".join(map(chr, codes[q + 1 : q + 3]))
            size = 1 if one in "stmd" else 2 if two in ("re", "ve", "ll") and not edges[q + 2] else 0
            if size:
                joined.append((q, size))
        # white space before another run of the text: its last character is a piece, or joins the run if it is a space
        if not self.lower:
            ends = runs[1:][(kinds[runs[1:] - 1] == _SPACE) & ~edges[runs[1:]]]
            begin[ends - 1] = True
            begin[ends[codes[ends - 1] == 0x20]] = False
        for q, size in joined:
            begin[q + 1] = False
            begin[q + 1 + size] = True
        starts = np.flatnonzero(begin[:n])
        ends = np.append(starts[1:], n)
        if self.lower:
            own = kinds[starts] != _SPACE
            starts, ends = starts[own], ends[own]
        return starts, ends
