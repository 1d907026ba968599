"""Token counts from pieces counted once for each distinct pre-token."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_codes import mixed

# White space of plain texts; characters that libraries class as space or not; letters
# that every library takes for letters.
CHUNK = re.compile(r" ?[^\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    -⁯"
                 "　﻿]").search
LETTERS = re.compile("(?: ?[A-Za-zÀ-ÖØ-öø-ɏ]+)").fullmatch

BLOCK_CHARS = 32_000_000
BLOCK_DOCS = 65_000  # below 2 ** 16, as places in a block take two bytes
HOT_SHARE = 16  # a pre-token in one of so many documents of a block is spread over SALTS tasks
SALTS = 256
HELD = 2_000_000  # sums a task holds before it passes them on
NO_KEY = -2 ** 63
POSTINGS = "pretoken string, salt int, block long, docs binary, counts binary"
PARTIAL = "block long, kind int, docs binary, counts binary"


class PreTokens:
    """Cuts texts into the pre-tokens of a byte-level tokenizer file, as the library does."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len)[::-1]))
                                  + ")") if added else None
        self.added = set(added)

    def chunks(self, text: str) -> list[str]:
        """Runs that no pre-token reaches across; special strings of the file stand alone."""
        parts = self.special.split(text) if self.special else [text]
        if len(parts) == 1 and not ODD(text):
            return CHUNK(text)
        out: list[str] = []
        for p in parts:
            if p in self.added:
                out.append(p)
            elif ODD(p):
                out += self.cut(p)
            else:
                out += CHUNK(p)
        return out

    def cut(self, chunk: str) -> list[str]:
        if LETTERS(chunk) or chunk in self.added:
            return [chunk]
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def pieces(self, pretoken: str) -> int:
        if pretoken in self.added:
            return 1
        return sum(len(self.library.model.tokenize(p))
                   for p, _ in self.library.pre_tokenizer.pre_tokenize_str(pretoken))


LOADED: dict[str, PreTokens] = {}


def pre_tokens(path: str) -> PreTokens:
    if path not in LOADED:
        LOADED[path] = PreTokens(path)
    return LOADED[path]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the values of each."""
    if not len(keys):
        return keys, values
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(values, first)


def binaries(starts: np.ndarray, data: np.ndarray) -> pa.Array:
    """One binary value for each run of `data` (runs begin at `starts`)."""
    ends = np.append(starts, len(data)) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [
        None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Block:
    """Documents whose frequencies are turned round together: for each pre-token, where it is."""

    def __init__(self, cutter: PreTokens) -> None:
        self.cutter, self.keys, self.sizes, self.chars = cutter, [], [], 0
        self.places: dict[str, int] = {}
        self.chunks: list[np.ndarray] = []

    def add(self, key: int | None, text: bytes) -> None:
        place, found = self.places, self.cutter.chunks(text.decode())
        self.chunks.append(np.array([place.setdefault(c, len(place)) for c in found],
                                    dtype=np.int64))
        self.keys.append(NO_KEY if key is None else key)
        self.sizes.append(len(text))
        self.chars += len(text)

    def postings(self, number: int) -> Iterator[pa.RecordBatch]:
        n = len(self.keys)
        lengths = [len(c) for c in self.chunks]
        pairs = np.concatenate(self.chunks)
        self.chunks.clear()
        # In place: a block's tokens are there once, not in several arrays.
        pairs *= n
        pairs += np.repeat(np.arange(n, dtype=np.int32), lengths)
        pairs.sort()
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(
            pairs) else np.zeros(0, np.int64)
        times = np.diff(np.append(first, len(pairs)))
        pairs = pairs[first]
        # Each chunk becomes its pre-tokens.
        names: dict[str, int] = {}
        parts = [[names.setdefault(p, len(names)) for p in self.cutter.cut(c)]
                 for c in self.places]
        self.places.clear()
        width = np.array([len(p) for p in parts], dtype=np.int64)
        flat = np.array([i for p in parts for i in p], dtype=np.int64)
        begin = np.cumsum(width) - width
        chunk, doc = pairs // n, pairs % n
        many = width[chunk]
        inner = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        token = flat[np.repeat(begin[chunk], many) + inner]
        pairs, times = summed(token * n + np.repeat(doc, many), np.repeat(times, many))
        more = -(-times // 255)  # counts take one byte: a larger one is cut up
        rest = times - 255 * (more - 1)
        pairs, last = np.repeat(pairs, more), np.cumsum(more) - 1
        counts = np.full(len(pairs), 255, dtype=np.uint8)
        counts[last] = rest
        token, doc = pairs // n, (pairs % n).astype(np.uint16)
        starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(
            token) else np.zeros(0, np.int64)
        seen = np.diff(np.append(starts, len(token)))
        salt = np.where(seen * HOT_SHARE >= n, salt_of(number), 0).astype(np.int32)
        listed = list(names)
        for a in range(0, len(starts), 100_000):  # several batches: each is small
            part = starts[a:a + 100_000]
            lo, hi = part[0], starts[a + 100_000] if a + 100_000 < len(starts) else len(token)
            yield pa.RecordBatch.from_arrays(
                [pa.array(listed[a:a + len(part)]), pa.array(salt[a:a + len(part)]),
                 pa.array(np.full(len(part), number)), binaries(part - lo, doc[lo:hi]),
                 binaries(part - lo, counts[lo:hi])],
                ["pretoken", "salt", "block", "docs", "counts"])
        # The block's documents travel as the postings of the empty pre-token.
        yield pa.RecordBatch.from_pydict(
            {"pretoken": [""], "salt": pa.array([salt_of(number)], pa.int32()), "block": [number],
             "docs": [np.array(self.keys, np.int64).tobytes()],
             "counts": [np.array(self.sizes, np.int64).tobytes()]})


def salt_of(block: int) -> int:
    """A block's salt: its partition, in the upper bits of its number, counts as its place does."""
    return int(mixed(np.array([block + 1], dtype=np.uint64))[0] % SALTS)


def count_tokens(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (UTF-8) and n_tokens of every whole text, for a byte-level tokenizer file.

    Documents are turned into postings (pre-token, block of documents, places and counts). The
    postings of a pre-token meet in one task, which counts its pieces once and passes on sums for
    the documents; pre-tokens that very many documents hold are spread over SALTS tasks by block.
    Then the sums of a block meet its documents. No ids are made. A task holds one block or HELD
    sums at a time, however many documents share a pre-token.

    NULL text is the empty text with 0 tokens. Rows of one key stay rows of their own; a NULL key
    stays NULL. Other columns are dropped; an empty table gives no rows. `docs` should be read
    from a table: blocks are cut in the order in which a partition is read.
    """
    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, number = pre_tokens(path), TaskContext.get().partitionId() << 24
        block = Block(cutter)
        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1)):
                block.add(k.as_py(), x.as_py() or b"")
                if block.chars > BLOCK_CHARS or len(block.keys) >= BLOCK_DOCS:
                    yield from block.postings(number)
                    block, number = Block(cutter), number + 1
        if block.keys:
            yield from block.postings(number)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, last, pieces = pre_tokens(path), None, 0
        keys, sums, held = [], [], 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            weights = np.zeros(len(names), dtype=np.int64)
            for i, name in enumerate(names):  # sorted: equal pre-tokens follow each other
                if name and name != last:
                    last, pieces = name, cutter.pieces(name)
                weights[i] = pieces if name else 0
            lists = np.array([not n for n in names])
            for i in np.flatnonzero(lists):
                row = batch.slice(i, 1)
                yield partial(row.column(2), [0], row.column(3), row.column(4))
            batch = batch.filter(pa.array(~lists))
            if batch.num_rows:
                doc, width = joined(batch.column(3), np.uint16)
                count, _ = joined(batch.column(4), np.uint8)
                block = np.asarray(batch.column(2))
                k, s = summed(np.repeat(block << 16, width) + doc,
                              np.repeat(weights[~lists], width) * count)
                keys.append(k)
                sums.append(s)
                held += len(k)
            if held > HELD:
                k, s = summed(np.concatenate(keys), np.concatenate(sums))
                keys, sums, held = [k], [s], len(k)
                if held > HELD // 2:
                    yield sums_of(k, s)
                    keys, sums, held = [], [], 0
        if keys:
            yield sums_of(*summed(np.concatenate(keys), np.concatenate(sums)))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = None, np.zeros(2 ** 16, dtype=np.int64)
        listed: tuple[np.ndarray, np.ndarray] | None = None
        for batch in batches:
            for block, kind, docs_, counts in zip(*(batch.column(i) for i in range(4))):
                if block.as_py() != current:
                    if listed:
                        yield counted(*listed, total)
                    current, listed = block.as_py(), None
                    total[:] = 0
                if kind.as_py() == 0:
                    listed = (np.frombuffer(docs_.as_py(), np.int64),
                              np.frombuffer(counts.as_py(), np.int64))
                else:
                    total[np.frombuffer(docs_.as_py(), np.uint16)] += np.frombuffer(
                        counts.as_py(), np.int32)
        if listed:
            yield counted(*listed, total)

    source = docs.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    postings = source.mapInArrow(posted, POSTINGS).repartition("pretoken", "salt")
    parts = postings.sortWithinPartitions("pretoken").mapInArrow(weighed, PARTIAL)
    sums = parts.repartition("block").sortWithinPartitions("block")
    out = sums.mapInArrow(gathered, "key long, n_bytes long, n_tokens long")
    return out.select(F.nullif("key", F.lit(NO_KEY)).alias(key), "n_bytes", "n_tokens")


def joined(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values in all binaries of a column, and how many each has."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset:column.offset + len(column) + 1]
    values = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]].view(kind)
    return values, np.diff(ends) // np.dtype(kind).itemsize


def partial(block, kind, docs, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(block, pa.int64()), pa.array(kind, pa.int32()), docs, counts],
        ["block", "kind", "docs", "counts"])


def sums_of(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    block = keys >> 16
    starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    return partial(block[starts], np.ones(len(starts), np.int32),
                   binaries(starts, (keys & 0xFFFF).astype(np.uint16)),
                   binaries(starts, sums.astype(np.int32)))


def counted(keys: np.ndarray, sizes: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(sizes), pa.array(total[:len(keys)])],
        ["key", "n_bytes", "n_tokens"])
