"""Vectorised hashing of whole texts: words, windows and the rarest gram of each window.

All functions take and return numpy arrays. Hashes are polynomials modulo 2**64
with an odd base, so that the hash of any span is read off two prefix sums.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 1 << 19  # units hashed at once; bounds the memory of a task whatever a text's length


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Base:
    """Powers of one hash base."""

    def __init__(self, value: int, size: int = CHUNK + 4096):
        def powers(v: int) -> np.ndarray:
            out = np.full(size + 1, v, dtype=U)
            out[0] = 1
            return np.cumprod(out, dtype=U)

        self.up, self.down = powers(value), powers(pow(value, -1, 2**64))

    def prefix(self, codes: np.ndarray) -> np.ndarray:
        if len(codes) >= len(self.up):
            self.__init__(int(self.up[1]), 2 * len(codes))
        out = np.zeros(len(codes) + 1, dtype=U)
        np.cumsum(codes * self.up[: len(codes)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * self.down[lo])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Hash of every run of ``k`` codes."""
        return mix((prefix[k:] - prefix[:-k]) * self.down[: len(prefix) - k])


_BASES: dict[int, Base] = {}


def base(which: int) -> Base:
    if which not in _BASES:
        _BASES[which] = Base((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[which])
    return _BASES[which]


#: A random code for each byte value.
BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def byte_table(separators: bytes, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(is a separator, code) of each byte; ``fold`` gives ASCII letters of both cases one code."""
    sep = np.zeros(256, dtype=bool)
    sep[list(separators)] = True
    codes = BYTE_CODES.copy()
    if fold:
        codes[65:91] = codes[97:123]
    return sep, codes


SPACES = byte_table(b" \t\n\x0b\x0c\r")
#: Words of letters, digits and bytes beyond ASCII, whatever their case.
PLAIN_WORDS = byte_table(bytes(b for b in range(128) if not chr(b).isalnum()), fold=True)


def words(text: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word of one text, in bounded pieces."""
    sep, codes = table
    data = np.frombuffer(text, dtype=np.uint8)
    parts, at, n = [], 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        while end < n and not sep[data[end - 1]]:  # a piece ends behind a separator
            cut = end + CHUNK
            ahead = np.flatnonzero(sep[data[end : min(n, cut)]])
            end = end + int(ahead[0]) + 1 if len(ahead) else min(n, cut)
        parts.append(_words(data[at:end], sep, codes, at))
        at = end
    if not parts:
        return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]


def _words(data, sep, codes, at):
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = sep[data]
    lo = np.flatnonzero(gap[:-1] & ~gap[1:])[: len(data)]
    hi = np.flatnonzero(~gap[:-1] & gap[1:])
    b = base(0)
    return b.spans(b.prefix(codes[data]), lo, hi), lo + at, hi + at


def word_batches(texts: list[bytes], table, size: int = CHUNK):
    """Many texts at once: yields (first text, end text, hash, first byte, end byte, first word of each text + end).

    Texts are joined by a separator, in groups of at most ``size`` bytes or one text.
    """
    i = 0
    while i < len(texts):
        j, total = i, 0
        while j < len(texts) and (j == i or total + len(texts[j]) + 1 <= size):
            total += len(texts[j]) + 1
            j += 1
        hashes, lo, hi = words(b"\n".join(texts[i:j]), table)
        ends = np.cumsum([0] + [len(t) + 1 for t in texts[i:j]])
        yield i, j, hashes, lo, hi, np.searchsorted(lo, ends)
        i = j


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` neighbours."""
    size = 1
    while size * 2 <= w:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return v if size == w else np.minimum(v[: len(v) - (w - size)], v[w - size :])


def ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, lo + n), one after the other."""
    total = int(n.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)
    return first + np.arange(total)


def segments(codes: np.ndarray, doc_lo: np.ndarray, doc_hi: np.ndarray, width: int, k: int):
    """Cut the windows of ``width`` codes into runs that share their anchor.

    The anchor of a window is its ``k``-gram of least hash, so it depends on the
    window's content alone: equal windows have equal anchors at the same place.
    ``doc_lo``/``doc_hi`` bound the texts inside ``codes`` (at most 2**20 codes).
    Returns (text, first window, windows, distance of the anchor, anchor hash, hash of all codes of the run).
    """
    empty = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U, U))
    windows = np.maximum(doc_hi - doc_lo - width + 1, 0)
    if not windows.sum():
        return empty
    b0, b1 = base(0), base(1)
    p0, p1 = b0.prefix(codes), b1.prefix(codes)
    grams = b0.grams(p0, k)
    mask = U((1 << 20) - 1)
    ranked = (grams & ~mask) | np.arange(len(grams), dtype=U)
    anchor = (sliding_min(ranked, width - k + 1) & mask).astype(np.int64)
    at = ranges(doc_lo, windows)
    of = np.repeat(np.arange(len(doc_lo)), windows)
    anchor = anchor[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(at)))
    lo, anchor, of = at[first], anchor[first], of[first]
    whole = b1.spans(p1, lo, lo + n - 1 + width)
    whole = mix(whole ^ mix(n.astype(U) * U(1024) + (anchor - lo).astype(U)))
    return of, lo - doc_lo[of], n, anchor - lo, grams[anchor], whole


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the ranges [lo, hi) as disjoint ranges in order; touching ranges become one."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]
