"""Numpy fingerprints of bytes, words and windows, shared by the operators on word and byte runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
#: Random code of each byte, and the same with A-Z read as a-z.
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and _BASE**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _UNBASE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of codes[j] * base**j for j < i, so any run's fingerprint is a difference."""
    up, _ = powers(len(codes))
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up, out=out[1:])
    return out


def run_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed fingerprints of the runs [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start])


def blocks(column: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts that hold about `most` bytes; the array has no nulls."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the place of each text's first word (one more entry than texts)."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = ~SPACE[data]
    inside = word[1:-1]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    start = np.flatnonzero(inside & (~word[:-2] | border[:-1]))
    end = np.flatnonzero(inside & (~word[2:] | border[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


#: Value of each (place in a word, byte) up to PLACES; later places are computed.
PLACES = 64


def _place_codes(byte_codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Values of bytes at places of a word: mixed, so no value of one place is a multiple of another's."""
    return mix(byte_codes + place.astype(np.uint64) * np.uint64(_BASE))


_TABLES = {id(code): _place_codes(code[None, :], np.arange(PLACES)[:, None]).ravel() for code in (BYTE_CODE, LOWER_CODE)}


def word_hashes(data: np.ndarray, offsets: np.ndarray, code: np.ndarray = BYTE_CODE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every word, and the place of each text's first word.

    A word's fingerprint is the mixed sum of independent values of its (place, byte) pairs, so it has no algebraic
    structure that words of any length could exploit (a polynomial modulo 2**64 has: Thue-Morse words collide).
    """
    start, end, first = split_words(data, offsets)
    size = end - start
    ends = np.cumsum(size)
    place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
    letters = data[SPACE[data] == 0] if len(place) != len(data) else data
    values = _TABLES[id(code)][np.minimum(place, PLACES - 1) * 256 + letters]
    far = np.flatnonzero(place >= PLACES)
    if len(far):
        values[far] = _place_codes(code[letters[far]], place[far])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return mix(sums[ends] - sums[ends - size] + size.astype(np.uint64) * np.uint64(_UNBASE)), first
