"""Substring dedup by suffix trees that are built apart for each prefix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .word_codes import code_slices, runs

WINDOW = 35
PREFIX = 12
GROUP = 250_000  # suffixes of one prefix that are put into memory together
BATCH = 600_000  # words of suffixes a tree is built over, whole groups apart
PLACE = 28  # bits of a place in a text
NO_KEY = -2 ** 63
SECOND = 0xD6E8FEB86659FD93  # factor of the second half of a window's code
LINKS = ("id long, hash long, grams array<long>, first array<int>, last array<int>, "
         "times array<int>")
PARTS = ("id long, hash long, first int, gram long, words binary, h1 long, h2 long, "
         "starts array<int>")
SPANS = "id long, hash long, start int, stop int"


def anchors(codes: np.ndarray, window: int, prefix: int
            ) -> tuple[np.ndarray, ...]:
    """Prefix codes, each with the first and last window of a run that it anchors, and how many
    anchors the run has.

    A window's anchor is the run of `prefix` words in it with the least code, the leftmost of
    equals. Equal windows have their anchors at one place: all their suffixes from the anchor on
    begin with the same prefix. Neighbouring anchors of one prefix (a text that repeats itself)
    make one run.
    """
    grams = runs(codes, prefix)
    order = (grams >> np.uint64(PLACE) << np.uint64(PLACE)).astype(np.uint64) | np.arange(
        len(grams), dtype=np.uint64)
    least, width, size = order, 1, window - prefix + 1
    while width * 2 <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < size:
        least = np.minimum(least[:len(order) - size + 1], least[size - width:])
    at = (least & np.uint64(2 ** PLACE - 1)).astype(np.int64)
    moves = np.concatenate(([True], at[1:] != at[:-1]))
    gram = grams[at].view(np.int64)
    new = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    return gram[new], new, np.append(new[1:], len(at)) - 1, np.add.reduceat(moves, new, dtype=int)


def ranks(values: np.ndarray) -> np.ndarray:
    """Equal values get equal small numbers."""
    order = np.argsort(values)
    sorted_ = values[order]
    step = np.concatenate(([False], sorted_[1:] != sorted_[:-1]))
    out = np.empty(len(values), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


def repeated_suffixes(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Which suffixes (places in `words`, numbers of words) lie below an inner node of at least
    `depth` words in the suffix tree.

    The tree's nodes are found level by level: two suffixes are below one node of three times the
    depth if their three parts are below equal nodes of the level before. The last level is `depth`
    itself; a node there with two suffixes is inner.
    """
    level, reach = words.astype(np.int64), 1
    while reach * 3 <= depth:
        n = len(level) - 2 * reach
        base = int(level.max()) + 1
        pair = level[:n] * base + level[reach:n + reach]
        if base ** 3 >= 2 ** 63:
            pair = ranks(pair)
        level = ranks(pair * base + level[2 * reach:n + 2 * reach])
        reach *= 3
    node = level[starts]
    done = reach
    while done < depth:  # parts may overlap: what is equal stays equal
        step = min(reach, depth - done)
        part = level[starts + done + step - reach]
        node = ranks(node * (int(level.max()) + 1) + part)
        done += step
    node = ranks(node)
    return np.bincount(node)[node] > 1


def spans_of(rows: list[tuple], window: int) -> pa.RecordBatch:
    """Spans of words to remove in whole groups of suffix runs."""
    known: dict[bytes, int] = {}
    texts = [r[4].split(b" ") for r in rows]
    width = np.array([len(t) for t in texts])
    begin = np.cumsum(width) - width
    words = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t),
                        dtype=np.int64, count=width.sum())
    windows = width - window + 1
    row = np.repeat(np.arange(len(rows)), windows)
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    hit = repeated_suffixes(words, begin[row] + inner, window)
    row, inner = row[hit], inner[hit]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1))) if len(
        row) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(row))[:len(starts)] - 1
    owner = row[starts]
    first = np.array([r[2] for r in rows], dtype=np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([r[0] for r in rows], dtype=np.int64)[owner]),
         pa.array(np.array([r[1] for r in rows], dtype=np.int64)[owner]),
         pa.array((first[owner] + inner[starts]).astype(np.int32)),
         pa.array((first[owner] + inner[ends] + window).astype(np.int32))],
        ["id", "hash", "start", "stop"])


def repeated_spans(texts: DataFrame, window: int = WINDOW, prefix: int = PREFIX,
                   group: int = GROUP) -> DataFrame:
    """(id, hash, start, stop): words that lie in a window which starts anywhere else too.

    1. Each window is given a prefix: the one its anchor begins with. 2. Prefixes found once hold
    no repeat; their windows are dropped. 3. Windows of one prefix go to one task, as runs of words
    around the anchor, and a suffix tree is built over whole groups that fit into memory. 4. A
    prefix of more than `group` suffixes is made longer, up to the whole window: its suffixes are
    counted by their whole prefix with sums made before the exchange, and no task holds them all.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, codes, words in code_slices(batch.column(2), fold=False):
                for k in np.flatnonzero(np.diff(words) >= window):
                    rows.append((ids[lo + k], hashes[lo + k], *anchors(
                        codes[words[k]:words[k + 1]], window, prefix)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int32())),
                 pa.array(cols[4], pa.list_(pa.int32())), pa.array(cols[5], pa.list_(pa.int32()))],
                ["id", "hash", "grams", "first", "last", "times"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "hash", "first", "gram", "words", "h1", "h2", "starts"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(),
                 pa.int64(), pa.list_(pa.int32())]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows: list[tuple] = []
            for k, (i, h, x, found) in enumerate(zip(*(batch.column(c) for c in range(4)))):
                i, h, words = i.as_py(), h.as_py(), x.as_py().split()
                hot = []
                for a in found.as_py():
                    if a["hot"]:
                        hot.append(np.arange(a["first"], a["last"] + 1))
                    else:
                        rows.append((i, h, a["first"], a["gram"],
                                     b" ".join(words[a["first"]:a["last"] + window]), None, None,
                                     None))
                if hot:  # one row for each different window of the text, with all its places
                    starts = np.concatenate(hot)
                    codes = next(code_slices(batch.column(2).slice(k, 1), fold=False))[1]
                    ones = runs(codes, window).view(np.int64)[starts]
                    twos = runs(codes, window, SECOND).view(np.int64)[starts]
                    order = np.lexsort((starts, twos, ones))
                    starts, ones, twos = starts[order], ones[order], twos[order]
                    new = np.flatnonzero(np.concatenate((
                        [True], (ones[1:] != ones[:-1]) | (twos[1:] != twos[:-1]))))
                    rows += [(i, h, None, None, None, int(ones[n]), int(twos[n]), at)
                             for n, at in zip(new, np.split(starts, new[1:]))]
                if len(rows) > 20_000:
                    yield packed(rows)
                    rows = []
            if rows:
                yield packed(rows)

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in range(5))):
                if held > BATCH and r[3] != last:
                    yield spans_of(rows, window)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4]) // 6
                last = r[3]
        if rows:
            yield spans_of(rows, window)

    found = cut(texts.mapInArrow(find, LINKS)).select("id", "hash", F.explode(F.arrays_zip(
        F.col("grams").alias("gram"), "first", "last", "times")).alias("a")).select(
            "id", "hash", "a.*")
    often = found.groupBy("gram").agg(F.sum("times").alias("times"), F.sum(
        F.col("last") - F.col("first") + 1).alias("n"))

    def parts(hot: bool) -> DataFrame:
        some = often.filter((F.col("times") > 1) & ((F.col("n") > group) == hot))
        wanted = found.join(some.select("gram"), "gram").groupBy("id", "hash").agg(F.collect_set(
            F.struct("first", "last", "gram", F.lit(hot).alias("hot"))).alias("found"))
        return texts.join(wanted.hint("shuffle_hash"), ["id", "hash"]).mapInArrow(split, PARTS)

    near = (parts(False).select("id", "hash", "first", "gram", "words")
            .repartition("gram").sortWithinPartitions("gram").mapInArrow(trees, SPANS))
    deep = parts(True).select("id", "hash", "h1", "h2", "starts")
    twice = (deep.groupBy("h1", "h2").agg(F.sum(F.size("starts")).alias("n")).filter("n > 1")
             .drop("n"))
    far = deep.join(twice, ["h1", "h2"]).select("id", "hash", F.explode("starts").alias("start"))
    return near.unionByName(far.withColumn("stop", F.col("start") + window))


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW,
                   prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """key, n_words, n_removed and `kept` (the words left, joined by blanks) of every document.

    A word goes if any window of `window` words over it starts anywhere else too, in this or
    another document; all copies of a passage go, judged on the input. NULL and empty texts, and
    texts with fewer words than a window, lose nothing. Rows of one key are documents of their
    own: repeated rows are copies of each other. Keys are longs above -2 ** 63 or NULL. Other
    columns are dropped; an empty table gives no rows.
    """
    texts = docs.select(F.coalesce(F.col(key), F.lit(NO_KEY)).alias("id"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("hash"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("words"))
    spans = repeated_spans(texts, window, prefix, group).groupBy("id", "hash").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for x, found in zip(batch.column(1), batch.column(2)):
                words = x.as_py().split()
                spans_ = found.as_py()
                counts.append(len(words))
                if spans_:
                    gone = np.zeros(len(words), dtype=bool)
                    for s in spans_:
                        gone[s["start"]:s["stop"]] = True
                    words = [words[i] for i in np.flatnonzero(~gone)]
                removed.append(counts[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = texts.join(spans, ["id", "hash"], "left").select("id", "words", "spans").mapInArrow(
        strip, "id long, n_words long, n_removed long, kept string")
    return out.select(F.nullif("id", F.lit(NO_KEY)).alias(key), "n_words", "n_removed", "kept")
