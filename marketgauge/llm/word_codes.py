"""Stable 64-bit codes of words and of runs of words, made with arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FACTOR = 0x9E3779B97F4A7C15
SLICE = 200_000  # bytes that are worked on together
TABLE = 4096
# Fixed value: ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def powers(factor: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    np.multiply.accumulate(np.full(n - 1, factor, dtype=np.uint64), out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(FACTOR))
FOLDED = BYTES.copy()
FOLDED[ord("A"):ord("Z") + 1] = BYTES[ord("a"):ord("z") + 1]
PLACES = powers(0xD1342543DE82EF95, TABLE)
FAR = powers(pow(0xD1342543DE82EF95, TABLE, 2 ** 64), TABLE)


def codes_of(data: np.ndarray, bounds: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words in `data`, and how many words begin before each of `bounds`, the places
    where texts begin and end. `fold` takes A-Z for a-z.

    A word's code is a sum of its bytes' random values times powers of their places in it.
    """
    inside = ~SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[bounds < len(data)]
    begins[edges] = inside[edges]
    words = np.searchsorted(np.flatnonzero(begins), bounds)
    letters = data[inside]
    first = np.flatnonzero(begins[inside])
    if not len(first):
        return np.zeros(0, dtype=np.uint64), words
    place = np.arange(len(letters)) - np.repeat(first, np.diff(np.append(first, len(letters))))
    values = (FOLDED if fold else BYTES)[letters] * PLACES[place & (TABLE - 1)]
    if place.max() >= TABLE:
        far = place // TABLE
        values *= (FAR if far.max() < TABLE else powers(int(FAR[1]), int(far.max()) + 1))[far]
    return mixed(np.add.reduceat(values, first)), words


def code_slices(column: pa.Array, fold: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, codes, bounds) for slices of a binary column without NULLs: text
    k of a slice has the codes from bounds[k] to bounds[k + 1]."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
        a, b = int(ends[i]), int(ends[j])
        if b - a <= 4 * SLICE:
            yield i, *codes_of(data[a:b], ends[i:j + 1] - a, fold)
        else:  # one very long text, cut at white space
            parts = []
            while a < b:
                cut = min(a + SLICE, b)
                while cut < b and not SPACE[data[cut]]:
                    cut += 1
                parts.append(codes_of(data[a:cut], np.array([0, cut - a]), fold)[0])
                a = cut
            codes = np.concatenate(parts)
            yield i, codes, np.array([0, len(codes)])
        i = j


def runs(codes: np.ndarray, size: int, factor: int = FACTOR) -> np.ndarray:
    """A code for each run of `size` words: sums of powers, built by doubling, then mixed."""
    done, made = 0, np.zeros(len(codes), dtype=np.uint64)
    step, width = codes, 1
    while width <= size:
        if size & width:
            n = max(0, len(codes) - done - width + 1)
            made = made[:n] + step[done:done + n] * np.uint64(pow(factor, done, 2 ** 64))
            done += width
        if width * 2 <= size:
            step = step[:-width] + step[width:] * np.uint64(pow(factor, width, 2 ** 64))
        width *= 2
    return mixed(made)
