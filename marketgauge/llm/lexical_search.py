"""Ranked lexical search over an index by document length."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

TOP = 10
# Fixed values of the score: full credit of a term, saturation, and the share of the length in it.
CREDIT, TF_SCALE, LENGTH_SCALE = 1_000_000_000, 1000, 8
LENGTH_SHARE = 90
# A block of items: so many at most, with so many terms together (one item may have more).
BLOCK_ITEMS, BLOCK_TERMS = 2048, 400_000
ROWS_PER_TASK = 20_000
POSTINGS = 4_000_000  # postings of whole strata that a task holds at once
SALTS = 64
# Bytes of terms, A-Z as a-z; all others part the terms.
LETTERS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())


def terms_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all characters above ASCII, A-Z as a-z."""
    return text.translate(LETTERS).split()


def item_blocks(items: DataFrame, text: str, most_items: int, most_terms: int
                ) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Blocks of (row of the item, its different terms), read one partition after another."""
    block, held = [], 0
    for row in items.toLocalIterator():
        terms = sorted(set(terms_of((row[text] or "").encode())))
        if block and (len(block) >= most_items or held + len(terms) > most_terms):
            yield block
            block, held = [], 0
        block.append((row, terms))
        held += len(terms)
    if block:
        yield block


def document_terms(docs: DataFrame, key: str, text: str, vocabulary: list[bytes]) -> DataFrame:
    """(key, n, terms, times): a document's number of terms, and those of the vocabulary in it by
    their numbers, with how often it has each."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType),
                           T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("times", T.ArrayType(T.IntegerType()))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: i for i, w in enumerate(vocabulary)}
        for batch in batches:
            n, terms, times, offsets = [], [], [], [0]
            for x in batch.column("text").cast(pa.large_binary()):
                words = terms_of(x.as_py() or b"")
                found = Counter(map(number.get, words))
                found.pop(None, None)
                n.append(len(words))
                terms.extend(found.keys())
                times.extend(found.values())
                offsets.append(len(terms))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(at, pa.array(times, pa.int32()))],
                names=["key", "n", "terms", "times"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        counted, schema)


@dataclass
class Stratum:
    """Postings of the documents of one normaliser, by term, with the impact of each."""

    docs: int
    terms: np.ndarray  # those that any document has, rising
    begins: np.ndarray  # of a term's postings, and the end of the last
    doc: np.ndarray
    impact: np.ndarray
    best: np.ndarray  # highest impact of each term

    @staticmethod
    def of(m: int, weights: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray
           ) -> "Stratum":
        order = np.lexsort((-times, terms))
        doc = np.repeat(np.arange(len(sizes)), sizes)[order]
        terms, times = terms[order], times[order]
        # One impact for each different number of times, whatever the term.
        tf, which = np.unique(times.astype(np.int64), return_inverse=True)
        credit = (CREDIT * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)
        impact = weights[terms] * credit[which]
        first = np.flatnonzero(np.concatenate(([True], terms[1:] != terms[:-1])))
        return Stratum(len(sizes), terms[first], np.append(first, len(terms)), doc, impact,
                       impact[first])

    def bounds(self, asked: np.ndarray, ends: np.ndarray, vocabulary: int) -> np.ndarray:
        """No document of the stratum scores more for each of the items."""
        of_term = np.zeros(vocabulary, dtype=np.int64)
        of_term[self.terms] = self.best
        sums = np.concatenate(([0], np.cumsum(of_term[asked])))
        return sums[ends] - sums[np.concatenate(([0], ends[:-1]))]

    def scores(self, asked: np.ndarray) -> np.ndarray:
        """Score of every document for an item with these terms, rising."""
        at = np.searchsorted(self.terms, asked)
        at = at[self.terms[np.minimum(at, len(self.terms) - 1)] == asked]
        begin, count = self.begins[at], self.begins[at + 1] - self.begins[at]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        place += np.repeat(begin, count)
        out = np.zeros(self.docs, dtype=np.int64)
        np.add.at(out, self.doc[place], self.impact[place])
        return out


@dataclass
class Search:
    """The best documents of a task for a block of items, and the scores that still count."""

    asked: list[np.ndarray]
    weights: np.ndarray
    top: int

    def __post_init__(self):
        self.all = np.concatenate(self.asked)
        self.ends = np.cumsum([len(a) for a in self.asked])
        # The `top` best scores of each item so far; a document below the least is out.
        self.held = np.zeros((len(self.asked), self.top), dtype=np.int64)

    def visit(self, strata: list[tuple[int, Stratum]]) -> Iterator[tuple[int, int, int]]:
        """(item, row, score) of documents that may be among the best; `strata` come with the
        number of their first row. Strata are visited in the order of their bounds for an item,
        until a bound is below the score that counts."""
        bounds = np.stack([s.bounds(self.all, self.ends, len(self.weights)) for _, s in strata])
        for item, asked in enumerate(self.asked):
            found: list[tuple[int, int]] = []
            held = self.held[item]
            for k in np.argsort(-bounds[:, item], kind="stable"):
                least = max(1, int(held.min()))
                if bounds[k, item] < least:
                    break
                first, stratum = strata[k]
                scores = stratum.scores(asked)
                rows = np.flatnonzero(scores >= least)
                # Rows of a stratum are in the order of their keys: equal scores, smaller key.
                rows = rows[np.argsort(-scores[rows], kind="stable")[:self.top]]
                found += [(first + int(r), int(scores[r])) for r in rows]
                merged = np.sort(np.concatenate((held, scores[rows])))
                held[:] = merged[len(merged) - self.top:]
            least = held.min()
            yield from ((item, row, score) for row, score in found if score >= least)


def best_in_tasks(index: DataFrame, asked: list[np.ndarray], weights: np.ndarray, top: int,
                  postings: int) -> DataFrame:
    """(item, key, score) of the documents that are among the best of their task. `index` holds m,
    key, terms and times, in each partition by m, then key."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), index.schema["key"],
                           T.StructField("score", T.LongType())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(asked, weights, top)
        waiting: list[pa.RecordBatch] = []  # rows that are not in a visited stratum yet
        held = 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch.column("terms").flatten())
            if held >= postings:
                yield visited(search, pa.Table.from_batches(waiting).combine_chunks())
                waiting, held = [], 0
        if waiting:
            yield visited(search, pa.Table.from_batches(waiting).combine_chunks())

    def visited(search: Search, rows: pa.Table) -> pa.RecordBatch:
        m = rows.column("m").to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        strata = []
        for a, b in zip(begins, np.append(begins[1:], len(m))):
            part = rows.slice(a, b - a)
            lists = part.column("terms").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            strata.append((int(a), Stratum.of(
                int(m[a]), weights, sizes, lists.flatten().to_numpy(),
                part.column("times").combine_chunks().flatten().to_numpy())))
        hits = list(search.visit(strata))
        item, row, score = ([h[i] for h in hits] for i in range(3))
        keys = rows.column("key").take(pa.array(row, pa.int64())).combine_chunks()
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        return pa.RecordBatch.from_arrays(
            [pa.array(item, pa.int32()), keys, pa.array(score, pa.int64())],
            names=["item", "key", "score"])

    return index.select("m", "key", "terms", "times").mapInArrow(searched, schema)


def search_block(docs: DataFrame, block: list, key: str, text: str, top: int,
                 rows_per_task: int, postings: int) -> DataFrame | None:
    """(item, key, score, rank) for a block of items; None if no document can be found."""
    vocabulary = sorted({w for _, terms in block for w in terms})
    number = {w: i for i, w in enumerate(vocabulary)}
    if not vocabulary:
        return None
    asked = [np.array([number[w] for w in terms], dtype=np.int64) for _, terms in block]
    index = cut(document_terms(docs, key, text, vocabulary))
    total = index.filter("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    if not total.docs:
        return None
    # One row for each term of the vocabulary, which the block bounds.
    holding = {r.term: r["count"] for r in index.select(F.explode("terms").alias("term"))
               .groupBy("term").count().collect()}
    weights = np.array([math.floor(1000 * math.log(
        (2 * total.docs + 2) / (2 * holding.get(i, 0) + 1))) for i in range(len(vocabulary))],
        dtype=np.int64)
    m = F.expr(f"{100 - LENGTH_SHARE}L + (({LENGTH_SHARE}L * n * {total.docs}L) div {total.terms}L)")
    rows = index.filter(F.size("terms") > 0).withColumn("m", m)
    # Documents of one m lie together, and go on in the next task where they are many. Strata are
    # in the order of a hash: those of long documents, with most postings, are not neighbours.
    strata = rows.repartitionByRange(
        max(1, -(-total.docs // rows_per_task)), F.xxhash64("m"), "m", F.xxhash64("key", "n")
    ).sortWithinPartitions("m", F.col("key").asc_nulls_last())
    found = best_in_tasks(strata, asked, weights, top, postings)
    order = [F.desc("score"), F.col("key").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS))
    for keys in ([F.col("item"), salt], [F.col("item")]):
        found = found.withColumn("rank", F.row_number().over(
            Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return found


def ranked_search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text",
                  item_key: str = "item_id", item_text: str = "text", top: int = TOP,
                  rows_per_task: int = ROWS_PER_TASK, postings: int = POSTINGS,
                  block_items: int = BLOCK_ITEMS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_key, rank, key, score): the `top` documents of highest score above 0 for each item.

    The score sums w * ((10^9 tf) div (1000 tf + 8 m)) over the item's different terms, with
    w = floor(1000 ln((2 N + 2) / (2 df + 1))) and the document's length in m = 10 + (90 n N) div L.

    Documents are put in strata of one m. In a stratum postings are by term and falling tf, so an
    impact is computed once for each tf and the first posting of a term bounds the others; the sum
    of these bounds over an item's terms bounds the stratum. Each task visits its strata for an
    item by falling bound until none can reach the item's best.

    Each row of `items` is an item; rows of one key and text are ranked each by itself. Each row of
    `docs` is a document; equal scores go by key, NULL last. NULL and empty texts have no terms;
    items without terms and documents without any give no rows, empty tables none. Extra columns
    don't matter. Items are worked on in blocks that bound what is sent to tasks; each block reads
    all documents. Strata may be cut between tasks and are held up to `postings` postings.
    """
    spark = docs.sparkSession
    out_type = T.StructType([items.schema[item_key], T.StructField("rank", T.IntegerType()),
                             docs.schema[key], T.StructField("score", T.LongType())])
    results = []
    few = items.select(item_key, item_text)
    for block in item_blocks(few, item_text, block_items, block_terms):
        found = search_block(docs, block, key, text, top, rows_per_task, postings)
        if found is None:
            continue
        names = spark.createDataFrame([(i, row[item_key]) for i, (row, _) in enumerate(block)],
                                      T.StructType([T.StructField("item", T.IntegerType()),
                                                    T.StructField("name", items.schema[item_key]
                                                                  .dataType)]))
        results.append(cut(found.join(F.broadcast(names), "item").select(
            F.col("name").alias(item_key), "rank", F.col("key").alias(key), "score")))
    out = spark.createDataFrame([], out_type)
    for r in results:
        out = out.unionByName(r)
    return out
