"""Words of texts and 64-bit hashes of word windows, by array operations on UTF-8 bytes.

Both word classes in use cut at ASCII bytes only, so bytes stand for code points: every byte of a
character beyond ASCII belongs to a word. A-Z is hashed as a-z. Hashes find candidates; who needs
certainty compares the words.
"""

from __future__ import annotations

import numpy as np

#: Longest run of window words, and bytes hashed at a time.
MOST_WORDS, STRETCH = 16, 1 << 19
_codes = np.arange(256)
_UPPER = (_codes >= 0x41) & (_codes <= 0x5A)
LOWER = np.where(_UPPER, _codes + 32, _codes).astype("u1")
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower-cased, and of words [^\x20\x09-\x0D]+.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80) | _UPPER
VISIBLE = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype="u8")[LOWER]
_STEP = np.random.default_rng(17).integers(1, 1 << 63, MOST_WORDS, dtype="u8") | np.uint64(1)
_LENGTH = np.random.default_rng(19).integers(1, 1 << 63, MOST_WORDS + 1, dtype="u8")
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n at least."""
    size = max(2 * STRETCH, 1 << n.bit_length())
    if size not in _tables:
        _tables.clear()
        bases = (_BASE, pow(_BASE, -1, 1 << 64))
        _tables[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, "u8"), np.full(size - 1, b, "u8")])) for b in bases)
    return _tables[size]


def words_of(text: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of each word of a text given as bytes."""
    edges = np.diff(is_word[text].view("i1"), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = np.empty(len(starts), "u8")
    first = 0
    while first < len(starts):  # a stretch of whole words
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + STRETCH, "right")))
        a, b = int(starts[first]), int(ends[last - 1])
        power, inverse = _powers(b - a + 1)
        total = np.zeros(b - a + 1, "u8")
        np.cumsum(_VALUE[text[a:b]] * power[: b - a], out=total[1:])
        s, e = starts[first:last] - a, ends[first:last] - a
        h = (total[e] - total[s]) * inverse[s]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xD6E8FEB86659FD93)
        hashes[first:last] = h ^ (h >> np.uint64(29))
        first = last
    return starts, ends, hashes


def window_hashes(words: np.ndarray, lengths: list[int]) -> dict[int, np.ndarray]:
    """For each window length, the hash of the window that starts at each word."""
    out, total = {}, np.zeros(len(words), "u8")
    for n in range(1, max(lengths, default=0) + 1):
        if len(words) < n:
            break
        total = total[: len(words) - n + 1] + words[n - 1 :] * _STEP[n - 1]
        if n in lengths:
            mixed = (total ^ (total >> np.uint64(32))) * np.uint64(_BASE) + _LENGTH[n]
            out[n] = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return out
