"""Hashes of words and word shingles, vectorised over batches of whole texts.

A word is a maximal run of characters outside ASCII white space. Texts are
joined with a space, so the work is a few numpy passes over the UTF-8 bytes:
the polynomial hash of a word is a difference of prefix sums modulo 2**64,
moved to exponent 0 by the inverse power of its start. Memory is the batch's
bytes, 8 bytes a word and a fixed number of bytes per ``SEGMENT``.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 19            # bytes hashed at a time (a longer word gets its own segment)
BASE = 0x9E3779B97F4A7C15    # odd, so it has an inverse modulo 2**64
_TABLES: dict = {}


def _tables(n: int):
    """Powers and inverse powers of BASE, byte classes; grown on demand."""
    if _TABLES.get("n", 0) < n:
        n = max(n, SEGMENT + 1)
        inverse = pow(BASE, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        _TABLES["n"] = n
        _TABLES["power"] = np.concatenate([one, np.multiply.accumulate(np.full(n, BASE, np.uint64))])
        _TABLES["inverse"] = np.concatenate([one, np.multiply.accumulate(np.full(n, inverse, np.uint64))])
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        _TABLES["lower"] = lower
        space = np.zeros(256, bool)
        space[[9, 10, 11, 12, 13, 32]] = True
        _TABLES["space"] = space
        other = np.zeros(256, bool)  # everything in ASCII but letters and digits
        other[:128] = True
        other[48:58] = other[65:91] = other[97:123] = False
        _TABLES["other"] = other
    return _TABLES


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts, lower: bool = True, gaps_of: str = "space"):
    """(hashes of all words of all texts in order, first-word index per text
    with the total appended). A null text has no words. ``gaps_of``: words are
    parted by ASCII white space ("space"), or by every ASCII character that is
    neither letter nor digit ("other")."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.fromiter((len(r) + 1 for r in raw), np.int64, len(raw))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    t = _tables(SEGMENT)
    starts_all, hashes = [], []
    at, end = 0, len(data) if raw else 0
    while at < end:
        to = min(at + SEGMENT, end)
        if to < end:  # cut after a separator
            gaps = np.flatnonzero(t[gaps_of][data[at:to]])
            while not len(gaps):
                to = min(to + SEGMENT, end)
                gaps = np.flatnonzero(t[gaps_of][data[at:to]])
            to = at + int(gaps[-1]) + 1
        part = data[at:to]
        t = _tables(len(part) + 1)
        space = t[gaps_of][part]
        edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        values = (t["lower"][part] if lower else part).astype(np.uint64) + np.uint64(1)
        values *= t["power"][: len(part)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        h = (sums[last] - sums[first]) * t["inverse"][first]
        hashes.append(mix(h + (last - first).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        starts_all.append(first + at)
        at = to
    starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
    out = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return out, np.searchsorted(starts, offsets)


def runs_of(texts, chars: int = 1 << 22):
    """(from, to) of runs of neighbouring texts (or their lengths) with about
    ``chars`` characters together, so that a batch of long texts is worked off in bounded memory."""
    at = size = 0
    for i, t in enumerate(texts):
        n = t if isinstance(t, int) else len(t) if t else 0
        if size and size + n > chars:
            yield at, i
            at, size = i, 0
        size += n
    if len(texts) > at:
        yield at, len(texts)


def shingle_sets(texts, words: int, lower: bool = True):
    """Per text the sorted distinct hashes of its ``words``-word shingles; a
    text of fewer words has its whole sequence as one shingle, one without
    words the empty set. Returns a list of uint64 arrays."""
    h, ptr = word_hashes(texts, lower)
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(words, n)):
        step = np.uint64((2 * k + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
        rolled[: n - k] += mix(h[k:] + step) if k else mix(h + step)
    rolled = mix(rolled)
    out = []
    for i in range(len(ptr) - 1):
        a, b = int(ptr[i]), int(ptr[i + 1])
        if b - a >= words:
            s = np.sort(rolled[a: b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:  # fewer words than a shingle: one hash over the whole sequence
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = mix(whole * np.uint64(31) + h[k: k + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
