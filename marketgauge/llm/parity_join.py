"""Near duplicates by a join of parity sketches of word n-gram sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, cut_counted, run_folder, scratch
from .components import components
from .texts import spare
from .word_codes import code_slices, mixed, runs

SHINGLE = 5
PERCENT = 80
SKETCH = 1024  # bits of the sketch that candidates are sifted by
SMALL = 16  # sets below this have a block for each of their elements
BLOCKS = 11  # blocks of the first band above it (16 to 31 elements); doubled in each next band
COMMON = 0.001  # share of the documents that makes an element common
COMMON_KEPT = 1_000_000  # the most common ones that are sent to all tasks, 8 MB; they settle an
#                          order of blocks alone, so the result is the same with fewer
TURNS = 3  # more leaders that signatures try before their pairs are compared: saves work alone
HOT = 100_000  # a key with more than this part of all rows is sent to all tasks: fewer than HOT keys
MEMBERS = 1000  # members of a hot signature that are compared in one block
NO_KEY = -2 ** 63
SETS = ("id long, code long, n int, h1 long, h2 long, sketch array<long>, element long, "
        "times long")


def set_slices(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, elements, bounds) for slices of a column of texts. An element is
    the code of a run of `size` words, of all words if there are fewer; the elements of a text are
    distinct and sorted."""
    for lo, codes, words in code_slices(column, fold=True):
        whole = runs(codes, size)
        count = np.diff(words)
        keep = np.maximum(count - size + 1, 0)
        short = np.flatnonzero((count > 0) & (count < size))
        keep[short] = 1
        bounds = np.concatenate(([0], np.cumsum(keep)))
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1] - words[:-1], keep)
        elements = whole[np.minimum(at, max(len(whole) - 1, 0))] if len(whole) else np.zeros(
            len(at), dtype=np.uint64)
        for k in short:
            width = int(count[k])
            elements[bounds[k]] = runs(codes[words[k]:words[k + 1]], width)[0] ^ np.uint64(
                size - width)
        for a, b in zip(bounds[:-1], bounds[1:]):
            elements[a:b].sort()
        new = np.ones(len(elements), dtype=bool)
        new[1:] = elements[1:] != elements[:-1]
        new[bounds[:-1][keep > 0]] = True
        yield lo, elements[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def digests(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each whole set, whatever the order; 0 for empty sets."""
    filled = np.flatnonzero(np.diff(bounds))
    one, two = (np.zeros(len(bounds) - 1, dtype=np.uint64) for _ in range(2))
    if len(filled):
        one[filled] = np.bitwise_xor.reduceat(mixed(elements), bounds[:-1][filled])
        two[filled] = np.add.reduceat(mixed(elements ^ np.uint64(77)), bounds[:-1][filled])
    return one.view(np.int64), two.view(np.int64)


def sketches(elements: np.ndarray, bounds: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """A row of 64-bit words for each set. Each element flips one bit: the sketches of two sets
    differ in at most as many bits as the sets in elements."""
    n = len(bounds) - 1
    of = np.repeat(np.arange(n), np.diff(bounds)) * bits
    bit = (mixed(elements ^ np.uint64(5)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(of + bit, minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(n, bits // 64)


class Common:
    """Whether elements are common ones: a table of bits tells most that aren't."""

    def __init__(self, sorted_: np.ndarray) -> None:
        self.sorted = sorted_
        self.table = np.zeros(2 ** 20, dtype=bool)
        self.table[(sorted_ >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, elements: np.ndarray) -> np.ndarray:
        out = self.table[(elements >> np.uint64(44)).astype(np.int64)]
        if out.any():
            asked = elements[out]
            at = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
            out[out] = self.sorted[at] == asked
        return out


def most_apart(n: np.ndarray | int, percent: int = PERCENT):
    """Elements in which a set of n and any partner of at least this likeness can differ."""
    return n * (100 - percent) // percent


def bands_of(n: int, percent: int) -> list[int]:
    """The band of a set's size, and the next one if a partner may be there."""
    band = max(0, (n // SMALL).bit_length())
    over = SMALL << band
    return [band, band + 1] if 100 * n >= percent * over else [band]


def signatures(elements: np.ndarray, common: Common, percent: int) -> np.ndarray:
    """Codes of sketch blocks such that two linked sets have one in common.

    The sketch of a band is cut into blocks; a block's digest is the parity (xor) of the codes of
    the elements in it. Linked sets differ in d elements at most, so all but d of their blocks are
    equal: of the blocks in any fixed order, the first d + 1 of both sets hold an equal one. Blocks
    of several elements and without common ones stand first: chance and shared passages seldom make
    those equal.
    """
    n = len(elements)
    rare = ~common(elements)
    out = []
    for band in bands_of(n, percent):
        if band == 0:
            parity, count, plain = elements, np.ones(n, np.int64), rare
            apart = n - -(-n * percent // 100)
        else:
            k = BLOCKS << (band - 1)
            block = (mixed(elements ^ np.uint64(9)) % np.uint64(k)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            at = block[order]
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            filled = at[first]
            parity = np.arange(k, dtype=np.uint64)
            parity[filled] ^= np.bitwise_xor.reduceat(elements[order], first)
            count = np.bincount(block, minlength=k)
            plain = np.bincount(block, weights=~rare, minlength=k) == 0
            apart = most_apart(n, percent)
        code = mixed(parity + np.uint64(0x9E3779B97F4A7C15 * (band + 1) % 2 ** 64))
        # Both sets rank a block alike: by what is in it alone.
        place = np.where(count == 0, 5, np.where(plain, 2, 4) - (count > 1))
        rank = (place.astype(np.uint64) << np.uint64(60)) | (code >> np.uint64(4))
        out.append(code[np.argsort(rank)[:apart + 1]])
    return np.concatenate(out)


def shingle_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row for each document (id, n, h1, h2, sketch), and for each task its common elements
    with the number of its documents that hold them."""
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs_held = 0
        for batch in batches:
            for lo, elements, bounds in set_slices(batch.column(1), size):
                n = len(bounds) - 1
                none = pa.nulls(n, pa.int64())
                flat = sketches(elements, bounds)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]),
                    pa.array(flat.ravel()))
                one, two = digests(elements, bounds)
                yield rows(batch.column(0).slice(lo, n), batch.column(2).slice(lo, n),
                           np.diff(bounds).astype(np.int32), one, two, lists, none, none)
                held.append(elements)
                docs_held += n
                if sum(map(len, held)) > 2_000_000:
                    yield common_of(held, docs_held)
                    held, docs_held = [], 0
        if held:
            yield common_of(held, docs_held)

    def rows(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
            ["id", "code", "n", "h1", "h2", "sketch", "element", "times"])

    def common_of(held: list[np.ndarray], docs_held: int) -> pa.RecordBatch:
        found, times = np.unique(np.concatenate(held), return_counts=True)
        some = times >= max(3, COMMON * docs_held)
        n = int(some.sum())
        return rows(*(pa.nulls(n, k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int64(),
                                               pa.int64(), pa.list_(pa.int64()))),
                    found[some].view(np.int64), times[some])

    return docs.mapInArrow(measured, SETS)


def buckets(texts: DataFrame, common: np.ndarray, size: int, percent: int) -> DataFrame:
    """(sig, node, leader): members of the signatures that several sets have.

    A task passes on one row for each signature, its least node; the others of the task follow
    that leader and go elsewhere. So a signature comes to the exchange once for each task, however
    many sets hold it. Behind the exchange, the least of those nodes leads the others.
    """
    sent = texts.sparkSession.sparkContext.broadcast(common)
    names = ["sig", "node", "leader"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common_ = Common(sent.value)
        sigs, nodes, held, seen = [], [], 0, set()
        for batch in batches:
            for _, elements, bounds in set_slices(batch.column(1), size):
                for node, a, b in zip(digests(elements, bounds)[0].tolist(), bounds.tolist(),
                                      bounds[1:].tolist()):
                    # Single elements are equal or apart; copies are one node.
                    if b - a < 2 or node in seen:
                        continue
                    seen.add(node)
                    found = signatures(elements[a:b], common_, percent)
                    sigs.append(found.view(np.int64))
                    nodes.append(np.full(len(found), node, np.int64))
                    held += len(found)
                if held > 700_000:
                    yield led(np.concatenate(sigs), np.concatenate(nodes))
                    sigs, nodes, held, seen = [], [], 0, set()
        if held:
            yield led(np.concatenate(sigs), np.concatenate(nodes))

    def led(sig: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.concatenate(([True], sig[1:] != sig[:-1]))
        leader = node[np.flatnonzero(new)[np.cumsum(new) - 1]]
        return pa.RecordBatch.from_arrays(
            [pa.array(sig), pa.array(node), pa.array(leader, mask=new)], names)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by signature and node: a run's first row is its leader. Followers go through."""
        waiting = None  # the leader of the run at a batch's end, and whether it has been given out
        for batch in batches:
            follows = batch.column(2).is_valid()
            yield batch.filter(follows)
            heads = batch.filter(pc.invert(follows))
            sig, node = np.asarray(heads.column(0)), np.asarray(heads.column(1))
            if not len(sig):
                continue
            if waiting:
                sig, node = np.append(waiting[0], sig), np.append(waiting[1], node)
            new = np.concatenate(([True], sig[1:] != sig[:-1]))
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            leader = node[starts[run]]
            many = np.append(np.diff(starts), len(sig) - starts[-1])[run] > 1
            many[0] &= not (waiting and waiting[2])
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (sig, node, leader)],
                                             names)
            a = starts[-1]
            given = len(sig) - a > 1 or bool(waiting and waiting[2] and a == 0)
            waiting = (sig[a:a + 1], node[a:a + 1], given)

    schema = "sig long, node long, leader long"
    # The leaders of a signature go to one task, followers anywhere.
    spread = F.when(F.col("leader").isNull(), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64("node"), F.lit(4096)))
    return (texts.mapInArrow(local, schema).repartition("sig", spread)
            .sortWithinPartitions("sig", "node").mapInArrow(joined, schema))


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and sketches leave room for a link between the sets of two rows."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch",
                                   lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                        F.lit(0), lambda t, x: t + x)
    return ((na * 100 >= nb * percent) & (nb * 100 >= na * percent)
            & (apart * (100 + percent) <= (na + nb) * (100 - percent)))


def sets_in(column: pa.Array, size: int) -> list[np.ndarray]:
    return [elements[a:b] for _, elements, bounds in set_slices(column, size)
            for a, b in zip(bounds, bounds[1:])]


def verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets, made anew from the texts, are linked."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 400):
                part = batch.slice(lo, 400)
                x, y = (sets_in(part.column(i), size) for i in (2, 3))
                both = np.array([len(np.intersect1d(s, t, assume_unique=True))
                                 for s, t in zip(x, y)])
                every = np.array([len(s) + len(t) for s, t in zip(x, y)]) - both
                yield part.select(["a", "b"]).filter(pa.array(100 * both >= percent * every))

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(
        check, "a long, b long")


def rarest(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(sig, node, own): the finest blocks, of one element each, that the sets of `texts` (node,
    text) must be compared by; the rarest of these sets' elements stand first.

    Of the blocks in the order of how many of the sets have them, the first n - ceil(percent n) + 1
    of both sets of a link hold an equal one. Elements of one set alone lead to no one: they only
    take places, so pages that share a template and have texts of their own need few blocks or
    none. `own` marks sets with so many of those that no two marked ones link: if both lack
    u > n (100 - percent) / (100 + percent) elements of each other, too few are left in common.
    """
    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = np.asarray(batch.column(0))
            for lo, elements, bounds in set_slices(batch.column(1), size):
                n = np.diff(bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(nodes[lo:lo + len(n)], n)),
                     pa.array(np.repeat(n, n).astype(np.int32)),
                     pa.array(elements.view(np.int64))], ["node", "n", "sig"])

    rows, total = cut_counted(texts.mapInArrow(exploded, "node long, n int, sig long"))
    times = cut(rows.groupBy("sig").agg(F.count("*").alias("times")).filter("times > 1"))
    hot = times.filter(F.col("times") > total / HOT)
    shared = rows.join(F.broadcast(hot), "sig").unionByName(
        rows.join(F.broadcast(hot.select("sig")), "sig", "left_anti")
        .join(times.filter(F.col("times") <= total / HOT), "sig"))
    of_set = shared.groupBy("node").agg(F.any_value("n").alias("n"), F.sort_array(F.collect_list(
        F.struct("times", "sig"))).alias("shared"))
    alone = F.col("n") - F.size("shared")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    return of_set.select(
        "node", (alone * (100 + percent) > F.col("n") * (100 - percent)).alias("own"),
        F.explode(F.slice("shared.sig", F.lit(1), F.greatest(first - alone, F.lit(0))))
        .alias("sig"))


def across(open_: DataFrame, info: DataFrame, texts: DataFrame, size: int, percent: int
           ) -> DataFrame:
    """Candidates (a, b) among the nodes of `open_` (node, label) that have different labels.

    Members of a signature meet the ones that are not marked `own`; members of a signature with
    more than a 100,000th of all rows do so in blocks of about MEMBERS.
    """
    named = open_.select("node", "label").distinct()
    rows, total = cut_counted(rarest(texts.join(named.select("node"), "node"), size, percent)
                              .join(named, "node"))
    groups = rows.groupBy("sig").agg(
        F.count("*").alias("n"), F.min("own").alias("all_own"), F.min("label").alias("lo"),
        F.max("label").alias("hi")).filter("NOT all_own AND lo <> hi").select("sig", "n")
    groups = cut(groups)
    hot = groups.filter(F.col("n") > max(MEMBERS, total / HOT)).select(
        "sig", F.ceil(F.col("n") / MEMBERS).cast("int").alias("blocks"))
    cold = groups.join(F.broadcast(hot), "sig", "left_anti").select("sig")
    members = rows.join(F.broadcast(hot), "sig").unionByName(
        rows.join(F.broadcast(hot.select("sig")), "sig", "left_anti").join(cold, "sig")
        .withColumn("blocks", F.lit(1)))
    members = cut(members.join(info.drop("rep"), "node"))
    x = members.filter("NOT own").withColumn("block", F.explode(
        F.sequence(F.lit(0), F.col("blocks") - 1))).alias("x")
    y = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).alias(
        "y")
    # Of two nodes that are both not marked, the pair is made once.
    once = F.when(F.col("y.own"), F.col("x.label") != F.col("y.label")).otherwise(
        F.col("x.label") < F.col("y.label"))
    pairs = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.block") == F.col("y.block"))
                   & once & may_link("x", "y", percent))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id",
                    size: int = SHINGLE, percent: int = PERCENT, codes: bool = False) -> DataFrame:
    """key, n_shingles and component_id of every document; with `codes` also `code`, xxhash64 of
    the text, and `component`, a number of the component itself (NULL for empty sets): rows may
    share keys, and then components may share their least one.

    A document's set has its distinct runs of `size` words, ASCII letters made small; all its words
    as one if there are fewer. Two documents link if their sets' Jaccard likeness is at least
    `percent` in a hundred; component_id is the least key that links lead to, its own included.
    NULL and empty texts have an empty set and link with nothing. Rows of one key are documents of
    their own. Keys are longs above -2 ** 63; NULL stands before all. Other columns are dropped;
    an empty table gives no rows.

    Copies are one node from the start. Each signature links its members to one leader, so a
    signature of n sets gives n candidates. The members of signatures that are not yet in one
    component then meet a few leaders more; sets that are still apart are joined by blocks of one
    element, the rarest first, across components alone: pairs inside a component need no link of
    their own. Sizes and
    sketches sift candidates, sets made from whole texts decide. The result is written; what was
    written on the way is removed.
    """
    outer = run_folder(docs.sparkSession)
    with scratch(docs.sparkSession):
        return cut(grouped(docs, text, key, size, percent, codes), outer)


def grouped(docs: DataFrame, text: str, key: str, size: int, percent: int,
            codes: bool = False) -> DataFrame:
    texts = docs.select(F.coalesce(F.col(key), F.lit(NO_KEY)).alias("id"),
                        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
                        F.xxhash64(text).alias("code"))
    rows = cut(shingle_sets(texts, size, percent))
    sets = rows.filter("id IS NOT NULL").select("id", "code", "n", "h1", "h2", "sketch")
    least = max(3, int(COMMON * sets.count()))
    common = (rows.filter("element IS NOT NULL").groupBy("element").agg(F.sum("times").alias("t"))
              .filter(F.col("t") >= least).orderBy(F.desc("t"), "element").limit(COMMON_KEPT))
    common = np.array(sorted(r[0] for r in common.select("element").collect()),
                      dtype=np.int64).view(np.uint64)
    nodes = cut(sets.filter("n > 0").groupBy("h1", "h2", "n").agg(
        F.min("id").alias("rep"), F.any_value("sketch").alias("sketch")))
    info = nodes.select(F.col("h1").alias("node"), "n", "sketch", "rep")
    members = cut(buckets(texts, common, size, percent))
    of_sig = members.select("sig", "node").union(members.select("sig", "leader")).distinct()
    wanted = info.join(of_sig.select("node").distinct(), "node")

    def those_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # another row of the same key may have another text
            made = [digests(e, b)[0] for _, e, b in set_slices(batch.column(1), size)]
            same = np.concatenate(made or [np.zeros(0, np.int64)]) == np.asarray(batch.column(0))
            yield batch.filter(pa.array(same))

    known = cut(texts.join(wanted.hint("shuffle_hash"), F.col("id") == F.col("rep"))
                .select("node", "text").mapInArrow(those_of, "node long, text binary")
                .dropDuplicates(["node"]))

    def linked(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b): sifted by sizes and sketches, then verified."""
        x, y = info.alias("x"), info.alias("y")
        sifted = (pairs.distinct().join(x, F.col("a") == F.col("x.node"))
                  .join(y, F.col("b") == F.col("y.node")).filter(may_link("x", "y", percent)))
        return cut(verified(sifted.select("a", "b"), known, size, percent))

    def undecided(rows: DataFrame, found: DataFrame) -> DataFrame:
        """(sig, node, label) of the signatures whose members are not yet in one component."""
        labelled = rows.select("sig", "node").join(found, "node", "left").select(
            "sig", "node", F.coalesce("component", "node").alias("label"))
        ends = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        return cut(labelled.join(ends.filter("lo <> hi").select("sig"), "sig"))

    links = linked(members.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    found = components(links)
    open_ = undecided(of_sig, found)
    pivots = open_.groupBy("sig").agg(*[F.min(F.struct(
        F.xxhash64("node", F.lit(turn)).alias("order"), "node", "label")).alias(f"p{turn}")
        for turn in range(TURNS)])
    pivots = pivots.select("sig", F.explode(F.array_distinct(F.array(*[
        F.struct(f"p{turn}.node", f"p{turn}.label") for turn in range(TURNS)]))).alias("p"))
    pairs = open_.join(pivots, "sig").filter(F.col("label") != F.col("p.label"))
    more = linked(pairs.select(F.col("node").alias("a"), F.col("p.node").alias("b")))
    found = components(found.toDF("a", "b").union(more))
    open_ = undecided(open_, found)
    pairs = across(open_, info, known, size, percent)
    found = components(found.toDF("a", "b").union(verified(pairs, known, size, percent)))

    of_node = nodes.select("h1", "h2", "n", "rep").join(
        found.withColumnRenamed("node", "h1"), "h1", "left").withColumn(
        "component", F.coalesce("component", "h1"))
    lowest = of_node.groupBy("component").agg(F.min("rep").alias("lowest"))
    of_node = of_node.join(lowest, "component").select("h1", "h2", "n", "lowest", "component")
    return sets.drop("sketch").join(of_node, ["h1", "h2", "n"], "left").select(
        F.nullif("id", F.lit(NO_KEY)).alias(key), F.col("n").cast("long").alias("n_shingles"),
        F.nullif(F.when(F.col("n") > 0, F.col("lowest")).otherwise(F.col("id")), F.lit(NO_KEY))
        .alias("component_id"), *[F.col(c) for c in (("code", "component") if codes else ())])


def survivors(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = SHINGLE,
              percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay if one of each component does: the one with the least key (NULL
    before all), of several texts with that key the one with the least code, of equal texts one.

    Rows without words link with nothing: of those, only rows of equal key and text are one. The
    choice is one aggregate over components of rows, not of keys, so rows of one key or of none
    are kept or dropped by themselves. Other columns go through; an empty table gives no rows.
    """
    found = near_duplicates(docs, text, key, size, percent, codes=True)
    row = F.struct(F.col(key).alias("id"), F.col("code"))
    # NULL keys come first in a struct's order.
    chosen = found.filter("n_shingles > 0").groupBy("component").agg(F.min(row).alias("row"))
    alone = found.filter("n_shingles = 0").select(row.alias("row")).distinct()
    of, code, mine = spare(docs, "_of", "_code", "_mine")
    first = chosen.select("row").unionByName(alone).select(
        F.col("row.id").alias(of), F.col("row.code").alias(code))
    # A NULL text has the code of its seed, as xxhash64 gives it.
    each = docs.withColumn(mine, F.xxhash64(text)).dropDuplicates([key, mine])
    kept = each.join(first, F.col(key).eqNullSafe(F.col(of)) & (F.col(mine) == F.col(code)),
                     "left_semi")
    return kept.drop(mine)
