"""Word and shingle hashes of many texts at once, with numpy, inside tasks.

Texts are UTF-8 bytes. All word patterns used here tell words from gaps by ASCII
characters alone, so bytes decide: every byte over 127 belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are hashed together; bounds the arrays of a step.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)) | U(1)


_BYTE = constants(256, 11)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_STEP = constants(64, 23)
_BASE = U(0x2545F4914F6CDD1D)
#: _BASE is odd: times this it is 1, modulo 2**64.
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
#: Bytes whose sum is taken at once, so that what is at work stays in the cache.
_BITS = 15
_STRIDE = 1 << _BITS
_POWERS = np.cumprod(np.full(_STRIDE, _BASE))
_BACK = np.cumprod(np.concatenate([[U(1)], np.full(_STRIDE - 1, _INVERSE)]))


def _steps(n: int, back: bool = False) -> np.ndarray:
    """Powers of _BASE, or of its inverse, for each stride of ``n`` bytes."""
    each = _BACK[-1:] * _INVERSE if back else _POWERS[-1:]
    return np.cumprod(np.concatenate([[U(1)], np.repeat(each, n // _STRIDE)]))


def _sums(values: np.ndarray, data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Sum of the bytes' values times powers of _BASE before each of the sorted places."""
    out, far, held = np.empty(len(place), U), _steps(len(data)), np.zeros(1, U)
    total, cuts = np.empty(_STRIDE + 1, U), np.searchsorted(place, np.arange(0, len(data) + _STRIDE, _STRIDE))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        step = values[data[i * _STRIDE : (i + 1) * _STRIDE]]
        step *= _POWERS[: len(step)]
        step *= far[i]
        total[:1] = held
        np.cumsum(step, out=total[1 : len(step) + 1])
        total[1 : len(step) + 1] += held
        out[a:b] = total[place[a:b] - i * _STRIDE]
        held = total[len(step) : len(step) + 1].copy()
    out[cuts[-1] :] = held
    return out


def gaps(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of the bytes between words, from inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Fixed by the words' patterns: blank, tab to carriage return; and all of ASCII but digits and small letters.
WHITE = gaps((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = gaps((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NOT_ALNUM_EITHER_CASE = NOT_ALNUM.copy()
NOT_ALNUM_EITHER_CASE[65:91] = False


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Neighbouring texts, each followed by a line feed, in blocks of about BLOCK bytes
    (a longer text is a block of its own): index of the first, bytes, where texts begin
    and the block ends."""
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        held.append(text or b"")
        size += len(held[-1]) + 1
        if size >= BLOCK or i + 1 == len(texts):
            ends = np.cumsum([0] + [len(t) + 1 for t in held])
            yield first, np.frombuffer(b"\n".join(held) + b"\n", np.uint8), ends
            first, size, held = i + 1, 0, []


def words(data: np.ndarray, gap: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of every word; ``fold`` takes A-Z as a-z."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(gap[data], out=inside[1:-1])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2].copy(), edge[1::2].copy()
    if not len(start):
        return np.zeros(0, U), start, end
    total = _sums(_FOLDED if fold else _BYTE, data, edge)
    # sums from the start of a word on, with the powers from 0 on
    value = (total[1::2] - total[::2]) * _BACK[start & (_STRIDE - 1)]
    value *= _steps(len(data), back=True)[start >> _BITS]
    return mix(value + (end - start).astype(U)), start, end


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; the last k - 1 positions have none."""
    if len(word) < k:
        return np.zeros(0, U)
    n = len(word) - k + 1
    out = word[:n] * _STEP[0]
    for i in range(1, k):
        out = out + word[i : n + i] * _STEP[i]
    return mix(out + U(k))


def shingle_sets(texts: list[bytes | None], k: int = 5) -> Iterator[np.ndarray]:
    """Each text's set of distinct ``k``-word shingles, sorted; of fewer words, the whole
    sequence is one; without words the set is empty."""
    for _, data, ends in blocks(texts):
        word, start, _ = words(data, WHITE)
        place = np.searchsorted(start, ends)
        rolled = shingles(word, k)
        for a, b in zip(place[:-1], place[1:], strict=True):
            if b - a >= k:
                found = np.sort(rolled[a : b - k + 1])
                new = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=new[1:])
                yield found[new]
            else:
                yield shingles(word[a:b], int(b - a)) if b > a else np.zeros(0, U)
