"""Vectorised word work over Arrow string columns: splitting, lower-casing of A-Z and 64-bit hashing without a Python object per word."""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes that separate words in the two word rules.
SPACE = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

def separators(chars: bytes) -> np.ndarray:
    """A table over bytes; A-Z never separate, as they are lower-cased before splitting."""
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, np.uint8)] = True
    table[ord("A") : ord("Z") + 1] = False
    return table


SPACE_SEP, ALNUM_SEP = separators(SPACE), separators(NOT_ALNUM)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
#: By number of bytes that count: the mask of a little-endian block of 8.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)
#: Spans of more bytes are hashed one by one.
_LONG = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    data, offsets = text_buffers(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        end = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        end = min(n, max(end, first + 1))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets by text): words are maximal runs of bytes that don't separate, and never span texts."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    own = ~table[data]
    begin = own.copy()
    begin[1:] &= ~own[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[heads] = own[heads]
    close = own.copy()
    close[:-1] &= ~own[1:]
    tails = heads[1:] - 1
    close[tails] = own[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def padded(data: np.ndarray) -> np.ndarray:
    """``data`` and 8 zero bytes, so that a block of 8 bytes can be read at each of its places."""
    raw = np.zeros(len(data) + 8, np.uint8)
    raw[:-8] = data
    return raw


def blocks(raw: np.ndarray) -> np.ndarray:
    """The little-endian block of 8 bytes at each place of ``padded`` bytes, without a copy."""
    return np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))


def block_steps(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(spans, place of their next block, bytes that remain), all spans at once, until none remains; empty spans have one step."""
    left, at, rest = np.arange(len(starts)), starts, lengths
    while len(left):
        yield left, at, rest
        on = np.flatnonzero(rest > 8)
        left, at, rest = left[on], at[on] + 8, rest[on] - 8


def masked(block: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The blocks without bytes behind the ends of their spans."""
    short = np.flatnonzero(rest < 8)
    block[short] &= _MASK[rest[short]]
    return block


def new_key() -> tuple[int, int]:
    """A secret of 128 bits. Hashes that tasks compare with each other need one key, drawn by the driver; within a worker ``OWN`` does."""
    return secrets.randbits(64), secrets.randbits(64)


OWN = new_key()
#: For hashes whose hits are all compared by letters.
OPEN = (0x0706050403020100, 0x0F0E0D0C0B0A0908)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(v: list[np.ndarray]) -> None:
    """One SipHash round over all spans at once."""
    v[0] = v[0] + v[1]
    v[2] = v[2] + v[3]
    v[1] = _turned(v[1], 13) ^ v[0]
    v[3] = _turned(v[3], 16) ^ v[2]
    v[0] = _turned(v[0], 32) + v[3]
    v[2] = v[2] + v[1]
    v[3] = _turned(v[3], 21) ^ v[0]
    v[1] = _turned(v[1], 17) ^ v[2]
    v[2] = _turned(v[2], 32)


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: tuple[int, int] = OWN) -> np.ndarray:
    """64-bit hashes of spans of ``padded`` bytes: SipHash (one round a block, three at the end) with a secret key.

    Without the key nobody can look for two texts that meet, as anyone could with a fixed scramble: such a pair would count as
    equal words. Long spans go through BLAKE2b with the same key.
    """
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    secret = b"".join(k.to_bytes(8, "little") for k in key)
    for k in np.flatnonzero(lengths > _LONG):
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8, key=secret).digest(), "little")
    few, view = np.flatnonzero(lengths <= _LONG), blocks(raw)
    begin = [key[0] ^ 0x736F6D6570736575, key[1] ^ 0x646F72616E646F6D, key[0] ^ 0x6C7967656E657261, key[1] ^ 0x7465646279746573]
    # spans of more blocks go on, those that end drop out; the length is part of the last block's round
    v = [np.full(len(few), np.uint64(x)) for x in begin]
    for left, at, rest in block_steps(starts[few], lengths[few]):
        if len(left) < len(v[0]):
            v = [x[keep] for x in v]
        block = masked(view[at], rest)
        v[3] = v[3] ^ block
        _round(v)
        v[0] = v[0] ^ block
        keep = rest > 8
        done = np.flatnonzero(~keep)
        if len(done):
            own = few[left[done]]
            last = [x[done] for x in v]
            last[3] = last[3] ^ lengths[own].astype(np.uint64)
            _round(last)
            last[0] = last[0] ^ lengths[own].astype(np.uint64)
            last[2] = last[2] ^ np.uint64(0xFF)
            for _ in range(3):
                _round(last)
            out[own] = last[0] ^ last[1] ^ last[2] ^ last[3]
        keep = np.flatnonzero(keep)
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True, key: tuple[int, int] = OWN) -> np.ndarray:
    """64-bit hashes of byte spans; with ``fold`` equal for spans that differ in the case of A-Z only."""
    return hashed(padded(_FOLD[data] if fold else data), starts, ends, key)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` values; result i covers values i to i + n - 1 (the caller skips runs over a text's end)."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count]
    return mixed(out)


def whole_run(hashes: np.ndarray) -> np.uint64:
    """The hash of a whole short sequence; its length is part of it, so that it differs from a window of another length."""
    return windows(hashes, len(hashes))[0] ^ np.uint64(len(hashes) * 0xA24BAED4963EE407 % (1 << 64))
