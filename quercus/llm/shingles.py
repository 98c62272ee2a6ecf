"""Multisets of word shingles as 64-bit numbers, worked out for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text worked on at once; a longer text is a group of its own.
GROUP = 4 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ROOT = np.uint64(0xD6E8FEB86659FD93)  # odd, so it has an inverse modulo 2 ** 64
_UNROOT = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers that spreads every bit."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word, in order. Words are runs without ASCII white space, A-Z in lower case."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    rolled = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_ROOT, len(data)), out=rolled[1:])
    hashes = (rolled[ends] - rolled[starts]) * _powers(_UNROOT, len(data))[starts]
    edges = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(edges, starts, "right"), mix(hashes ^ (ends - starts).astype(np.uint64))


def groups(texts) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first, texts as bytes) for groups of up to GROUP bytes; null is empty."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        if held and size + len(raw) > GROUP:
            yield first, held
            first, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield first, held


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, count), sorted; a text of fewer words, but not none, is one shingle."""
    row, word = word_hashes(texts)
    if not len(row):
        return row, word, row
    n = np.bincount(row, minlength=len(texts))
    rolled = np.zeros(len(word), np.uint64)
    for k in range(words):
        # words beyond the end of a short text count as none
        m = max(len(word) - k, 0)
        inside, part = np.zeros(len(word), bool), np.zeros(len(word), np.uint64)
        inside[:m] = row[:m] == row[k : k + m]
        part[:m] = word[k : k + m]
        rolled = mix(rolled ^ np.where(inside, part, np.uint64(k)))
    place = np.arange(len(word)) - (np.cumsum(n) - n)[row]
    whole = place <= np.maximum(n[row] - words, 0)
    row, rolled = row[whole], rolled[whole]
    by = np.lexsort((rolled, row))
    row, rolled = row[by], rolled[by]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (rolled[1:] != rolled[:-1])])
    return row[first], rolled[first], np.diff(np.r_[first, len(row)])


def tokens(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token), sorted: the multiset of shingles as a set, the n-th copy of one being a token of its own.

    The Jaccard similarity of two such sets is the weighted one of the multisets.
    """
    row, shingle, count = shingles(texts, words)
    row, shingle = np.repeat(row, count), np.repeat(shingle, count)
    copy = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    token = np.where(copy == 0, shingle, mix(shingle ^ mix(copy.astype(np.uint64))))
    by = np.lexsort((token, row))
    return row[by], token[by]
