"""Words of many texts at once as 64-bit hashes, computed on the bytes of an Arrow buffer."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)
_ROOT = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _ROOT.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """A table over the 256 bytes, true inside the inclusive ``ranges``."""
    out = np.zeros(256, bool)
    for low, high in ranges:
        out[low : high + 1] = True
    return out


SPACE = separators((0x20, 0x20), (0x09, 0x0D))
NOT_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the n + 1 word offsets of the texts. No word crosses a text.

    ``kinds``: 256 small numbers, or separators as booleans. A word is a run of bytes of one kind other than 0.
    """
    if kinds.dtype == bool:
        kinds = (~kinds).astype(np.uint8)
    kind = np.zeros(len(raw) + 2, np.uint8)
    kind[1:-1] = kinds[raw]
    turn = kind[1:] != kind[:-1]
    turn[bounds] = True
    starts = np.flatnonzero(turn & (kind[1:] > 0))
    ends = np.flatnonzero(turn & (kind[:-1] > 0))
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash for each word, of its bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), BASE, np.uint64))
    values = BYTE_VALUES[raw[place + np.repeat(starts, lengths)]] * powers[place]
    return mix(np.add.reduceat(values, first))


def runs_of(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``k`` words from each place on, and whether these lie in one text."""
    acc = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + len(acc)])
    end = np.repeat(offsets[1:], np.diff(offsets))
    return acc, np.arange(len(acc)) + k <= end[: len(acc)]


def shingles(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words, and the text of each; a text with fewer words, but some, is one run."""
    n = np.diff(offsets)
    acc, whole = runs_of(hashes, offsets, k)
    runs, of = acc[whole], np.repeat(np.arange(len(n)), n)[: len(acc)][whole]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        extra = np.zeros(len(few), np.uint64)
        for j in range(k - 1):
            on = n[few] > j
            at = np.where(on, offsets[few] + j, 0)
            extra = np.where(on, mix(extra * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[at] + np.uint64(1)), extra)
        runs, of = np.concatenate((runs, extra)), np.concatenate((of, few))
        order = np.argsort(of, kind="stable")
        runs, of = runs[order], of[order]
    return runs, of
