"""Vectorised word splitting and hashing over batches of texts (numpy, no per-word Python)."""

from __future__ import annotations

import numpy as np

_M = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 17
_TABLES: dict = {}


def _table() -> np.ndarray:
    """A fixed odd 64-bit number for each byte."""
    if "t" not in _TABLES:
        x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        _TABLES["t"] = mix64(x) | np.uint64(1)
    return _TABLES["t"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _TABLES.get("p")
    if have is None or len(have[0]) < n:
        n = max(n, 2 * _SLICE)
        both = []
        for b in (_BASE, _INV):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _TABLES["p"] = tuple(both)
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def separators(kind: str) -> np.ndarray:
    """Which bytes stand between words: "space" (white space) or "alnum" (ASCII that is neither letter nor digit). Both contain the line feed."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[[9, 10, 11, 12, 13, 32]] = True
    else:
        out[:128] = True
        out[48:58] = out[65:91] = out[97:123] = False
    return out


def _lower() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def word_hashes(texts, kind: str = "space", prefixes: tuple[int, ...] = ()):
    """Hashes of the lower-cased (A-Z) words of each text, one text after the other.

    Returns (hashes, bounds[, prefix hashes ...]): ``bounds`` has the place of each text's
    first word and, at its end, the number of words. A null text has no words. A prefix
    hash covers a word's first n bytes (the whole word if it is shorter). Texts are worked
    off in slices that fit a processor's cache; a long text spans several.
    """
    sep, lower, table = separators(kind), _lower(), _table()
    table = table[lower]
    parts, extra, bounds = [], [[] for _ in prefixes], np.zeros(len(texts) + 1, np.int64)
    total = 0
    k = 0
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    while k < len(raw):
        first, size = k, 0
        while k < len(raw) and (k == first or size + len(raw[k]) < _SLICE):
            size += len(raw[k]) + 1
            k += 1
        joined = b"\n".join(raw[first:k]) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        offsets = np.zeros(k - first + 1, np.int64)
        np.cumsum([len(x) + 1 for x in raw[first:k]], out=offsets[1:])
        at, starts_all = 0, []
        while at < len(buf):
            end = min(len(buf), at + 2 * _SLICE)
            if end < len(buf):  # not within a word
                while end > at and not sep[buf[end - 1]]:
                    end -= 1
                if end == at:
                    end = at + 2 * _SLICE
                    while not sep[buf[end - 1]]:
                        end += 1
            b = buf[at:end]
            word = ~sep[b]
            edge = np.flatnonzero(word[1:] != word[:-1]) + 1
            if len(word) and word[0]:
                edge = np.concatenate(([0], edge))
            starts, ends = edge[0::2], edge[1::2]  # the slice ends with a separator
            power, inverse = _powers(len(b) + 1)
            v = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(table[b] * power[: len(b)], out=v[1:])
            parts.append(mix64((v[ends] - v[starts]) * inverse[starts]))
            for n, to in zip(prefixes, extra):
                cut = np.minimum(starts + n, ends)
                to.append(mix64((v[cut] - v[starts]) * inverse[starts] + np.uint64(n)))
            starts_all.append(starts + at)
            at = end
        starts = np.concatenate(starts_all) if starts_all else np.zeros(0, np.int64)
        bounds[first : k + 1] = total + np.searchsorted(starts, offsets)
        total += len(starts)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint64)
    return (join(parts), bounds, *(join(x) for x in extra))


def hash_word(word: str) -> int:
    """The hash of one lower-cased word, as ``word_hashes`` makes it."""
    return int(word_hashes([word])[0][0])
