"""Periodic runs in texts, found along diagonals of equal words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SHORTEST = 12  # words of a run, and at least two periods
GRAM = 6  # words that any run shares with itself, one period on
WORDS = 200_000  # words of texts that are worked on together
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType())
                                for n in ("start", "length", "period")]))


def least_overlap(lag: np.ndarray | int) -> np.ndarray | int:
    """Words on a diagonal that a run of this period has at least."""
    return np.maximum(SHORTEST - lag, lag)


def named(keys: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """Small numbers for keys that are found twice or more, by place; -1 elsewhere."""
    out = np.full(size, -1, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.cumsum(new) - 1
    again = np.bincount(number)[number] > 1 if len(keys) else number.astype(bool)
    out[places[order[again]]] = number[again]
    return out


def joined_names(left: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs made of a named run and the one `by` words on, and their places."""
    at = np.flatnonzero((left[:-by] >= 0) & (left[by:] >= 0)) if by < len(left) else np.zeros(0, int)
    return left[at] * (len(left) + 1) + left[at + by], at


class Texts:
    """Words of several texts one after another, with exact names for runs of 2, 4, 8.. words.

    A name is given to runs that are found twice in one text. Runs of twice the length are pairs
    of named ones, so each level looks only at what the level below has left.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        self.words, self.bounds = words, bounds
        self.text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        self.names = [words]
        at = np.flatnonzero(self.text[1:] == self.text[:-1])
        many = int(words.max(initial=0)) + 1
        keys = words[at] * many + words[at + 1]
        if many * many * len(bounds) < 2 ** 62:
            keys += self.text[at] * many * many
        else:
            keys = np.unique(keys, return_inverse=True)[1] * len(bounds) + self.text[at]
        self.names.append(named(keys, at, len(words)))

    def level(self, j: int) -> np.ndarray:
        """Names of the runs of 2 ** j words."""
        while len(self.names) <= j:
            below = self.names[-1]
            keys, at = joined_names(below, 2 ** (len(self.names) - 1))
            self.names.append(named(keys, at, len(self.words)))
        return self.names[j]

    def pairs(self, j: int, stride: int, lags: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """(place, lag) of equal runs of 2 ** j + 2 words in one text, the first of them at a
        multiple of `stride`, the second `lags` words on."""
        keys, at = joined_names(self.level(j), 2)
        # Runs of other texts have other names: level 1 tells the texts apart.
        name = named(keys, at, len(self.words))
        at = np.flatnonzero(name >= 0)
        if not len(at):
            return at, at
        at = at[np.argsort(name[at], kind="stable")]
        width = 2 * len(self.words) + 2
        key = name[at] * width + at
        seeds = at[at % stride == 0]
        base = name[seeds] * width + seeds
        low = np.searchsorted(key, base + lags[0], "left")
        count = np.searchsorted(key, base + min(lags[1], len(self.words)), "right") - low
        first = np.repeat(seeds, count)
        inner = np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
        return first, at[np.repeat(low, count) + inner] - first

    def reach(self, at: np.ndarray, lag: np.ndarray, most: int, step: int) -> np.ndarray:
        """How many words, fewer than `most`, going forth (step 1) or back (-1) from `at` equal
        those one lag on, inside the text."""
        done = np.zeros(len(at), dtype=np.int64)
        size = 1
        while size * 2 < most:
            size *= 2
        while size:
            names = self.level(size.bit_length() - 1)
            a = at + done if step > 0 else at - done - size
            text = self.text[np.minimum(at + lag - 1, len(self.words) - 1)]
            fits = ((a >= self.bounds[text]) & (a + lag + size <= self.bounds[text + 1]))
            a = np.where(fits, a, 0)
            b = np.where(fits, a + lag, 0)
            same = fits & (names[a] >= 0) & (names[a] == names[b])
            done += np.where(same, size, 0)
            size //= 2
        return done


def diagonals(texts: Texts, j: int, stride: int, lags: tuple[int, int]
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, length, lag) of the stretches of equal words on the diagonals of these lags."""
    gram = 2 ** j + 2
    at, lag = texts.pairs(j, stride, lags)
    order = np.lexsort((at, lag))
    at, lag = at[order], lag[order]
    # A pair that begins within what its lag has covered so far is not extended again.
    new = np.ones(len(at), dtype=bool)
    new[1:] = ((lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + gram)
               | (texts.text[at[1:]] != texts.text[at[:-1]]))
    starts = np.flatnonzero(new)
    first, lag = at[starts], lag[starts]
    end = at[np.append(starts[1:], len(at)) - 1] + gram if len(starts) else first
    hope = end - first + 2 * (stride - 1) >= least_overlap(lag)
    first, end, lag = first[hope], end[hope], lag[hope]
    end = end + texts.reach(end, lag, stride, 1)
    first = first - texts.reach(first, lag, stride, -1)
    long = end - first >= least_overlap(lag)
    return first[long], (end - first)[long], lag[long]


def runs_of(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the texts, by start, then period.

    `words` numbers the words of all texts, text k has those from bounds[k] to bounds[k + 1].
    """
    found = [(np.zeros(0, np.int64),) * 3]
    longest = int(np.diff(bounds).max(initial=0))
    if longest >= SHORTEST:
        texts = Texts(words, bounds)
        # Any run of a period below 8 shares 6 words with itself; one of a period from 2^t on
        # shares 2^t, in which a run of half the length begins at a multiple of the stride.
        found.append(diagonals(texts, 2, 1, (1, 7)))
        t = 3
        while 2 ** (t + 1) <= longest and (texts.level(t - 1) >= 0).any():
            found.append(diagonals(texts, t - 1, 2 ** (t - 1) - 1, (2 ** t, 2 ** (t + 1) - 1)))
            t += 1
    start, overlap, period = (np.concatenate(c) for c in zip(*found))
    length = overlap + period
    # A stretch found for several periods has the least: the others are its multiples.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.ones(len(start), dtype=bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of neighbours whose sizes come to about `most`; a larger one is alone."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def collapsed_texts(texts: list[bytes]) -> tuple[list[int], pa.Array, list[str]]:
    """Numbers of words, runs, and what is left with one period of each run, for whole texts."""
    known: dict[bytes, int] = {}
    parts = [t.split() for t in texts]  # white space of bytes is the ASCII one
    bounds = np.cumsum([0, *map(len, parts)])
    words = np.fromiter((known.setdefault(w, len(known)) for p in parts for w in p),
                        dtype=np.int64, count=bounds[-1])
    start, length, period = runs_of(words, bounds)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    dropped = np.cumsum(edges) > 0
    owner = np.searchsorted(bounds, start, "right") - 1
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1))
    kept = []
    for k, p in enumerate(parts):
        if offsets[k] < offsets[k + 1]:
            gone = dropped[bounds[k]:bounds[k + 1]].tolist()
            p = [w for w, g in zip(p, gone) if not g]
        kept.append(b" ".join(p).decode())
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
        [pa.array(start - bounds[owner], pa.int64()), pa.array(length, pa.int64()),
         pa.array(period, pa.int64())], names=["start", "length", "period"]))
    return np.diff(bounds).tolist(), runs, kept


def find_runs(docs: DataFrame, text: str = "text", names: tuple[str, str, str] = (
        "n_words", "runs", "collapsed"), words: int = WORDS) -> DataFrame:
    """Adds `n_words`, `runs` (array of start, length, period in words, by start, then period) and
    `collapsed`, the words left when each run keeps one period, joined by blanks.

    A run is a stretch of words, as long as it can be, with smallest period q (words q apart are
    equal) and at least max(12, 2 q) words. A word goes if any run has it after its first q words.

    Runs of six words (more for longer periods) that a text has twice seed the diagonals of their
    lag; a lag's furthest covered place keeps a stretch from being extended twice. For a period
    from 2^t on seeds begin at every (2^(t-1) - 1)th word alone, so a text of n words has some
    n log n pairs at most, even if it is one word over and over.

    Rows are looked at one by one, so equal rows fare equally and keys may be NULL or repeat; NULL
    and empty texts have no words, no runs and an empty `collapsed`. An empty table gives no rows.
    Other columns go through, columns of the new names are replaced. No exchange. Texts are put
    together up to `words` words; a longer one is worked on alone.
    """
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.LongType()),
                           T.StructField(names[1], RUN), T.StructField(names[2], T.StringType())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text).cast(pa.large_binary())
            # Two bytes a word at least.
            sizes = [len(x.as_buffer() or b"") // 2 for x in column]
            for a, b in slices(sizes, 3 * words):
                n_words, runs, kept = collapsed_texts(
                    [x.as_py() or b"" for x in column.slice(a, b - a)])
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(a, b - a).columns, pa.array(n_words, pa.int64()), runs,
                     pa.array(kept, pa.string())], names=[*batch.schema.names, *names])

    return docs.mapInArrow(found, schema)
