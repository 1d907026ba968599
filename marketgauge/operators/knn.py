"""k-nearest-neighbour vote as a partitioned join: exact, and over hash tables.

Train vectors are grouped by their nearest pivot. The triangle inequality tells from the group
radii which groups can hold a neighbour of a query, so a query is sent to those only. Groups are
split into chunks and queries into blocks, so a task sees a bounded piece of either side, and it
returns at most k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checked_broadcast, cut, cut_counted

PIVOTS = 64
TRAIN_CHUNK = 20_000
QUERY_BLOCK = 5_000
# Copies of queries that a task makes at a time; train rows beside the k nearest whose distance is
# worked out exactly.
SENT_ROWS, SPARE = 20_000, 8
# Of the hashed way: tables, train rows of a bucket, buckets a query goes to in each table.
TABLES, BUCKET, PROBES = 8, 2_000, 6


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of `a` to every row of `b`, in small slices."""
    out = np.empty((len(a), len(b)))
    rows = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), rows):
        diff = a[i:i + rows, None, :] - b[None, :, :]
        out[i:i + rows] = np.sqrt(np.einsum("qtd,qtd->qt", diff, diff))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype="float64")


def _pivots(train: DataFrame, n: int, seed: int) -> np.ndarray:
    """`n` vectors picked by hash: a fixed small sample, whatever the table size."""
    rows = train.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("vec").collect()
    return np.array([r.vec for r in rows], dtype="float64")


def _assign(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it."""
    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["vec"]), pivots)
                yield pdf.assign(cell=d.argmin(axis=1).astype("int32"), far=d.min(axis=1))

    return df.mapInPandas(near, "id long, label string, vec array<double>, cell int, far double")


def _reach(queries: DataFrame, pivots: np.ndarray, radius: np.ndarray, count: np.ndarray,
           k: int) -> DataFrame:
    """One row per (query, group that may hold one of its k nearest neighbours)."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            d = _distances(_matrix(pdf["vec"]), pivots)
            # Every member of a group lies within d + radius; the groups that first reach k
            # members bound the k-th distance from above.
            upper = np.where(count > 0, d + radius, np.inf)
            order = np.argsort(upper, axis=1)
            enough = np.cumsum(count[order], axis=1) >= k
            last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(count) - 1)
            bound = np.take_along_axis(upper, order, axis=1)[np.arange(len(d)), last]
            reach = (count > 0) & (d - radius <= bound[:, None] * (1 + 1e-12) + 1e-12)
            q, cell = np.nonzero(reach)
            # A query may reach every group: a slice of its copies at a time.
            for lo in range(0, len(q), SENT_ROWS):
                part = pdf.iloc[q[lo:lo + SENT_ROWS]]
                yield part.assign(cell=cell[lo:lo + SENT_ROWS].astype("int32"))

    return queries.mapInPandas(spread, "id long, vec array<double>, cell int")


def _sifted(asked: np.ndarray, known: np.ndarray, top: int
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, distances, sure): the `top` nearest rows of `known` for each of `asked`, equal
    distances by place.

    One product of matrices tells squared distances to within a bound on its rounding; a few rows
    more than asked for are worked out exactly. It is sure where no other row can be as near.
    """
    wide = min(len(known), top + SPARE)
    with np.errstate(invalid="ignore", over="ignore"):
        a, b = np.einsum("qd,qd->q", asked, asked), np.einsum("td,td->t", known, known)
        rough = a[:, None] + b - 2 * (asked @ known.T)
        near = np.argpartition(rough, wide - 1, axis=1)[:, :wide]
        edge = np.take_along_axis(rough, near, axis=1).max(axis=1)
        near.sort(axis=1)
        diff = asked[:, None, :] - known[near]
        d = np.sqrt(np.einsum("qtd,qtd->qt", diff, diff))
        place = np.argsort(d, axis=1, kind="stable")[:, :top]
        near, d = np.take_along_axis(near, place, axis=1), np.take_along_axis(d, place, axis=1)
        error = 8 * (asked.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(a) + np.sqrt(b.max())) ** 2
        sure = np.isfinite(d[:, -1]) & ((d[:, -1] ** 2 < edge - error) | (wide == len(known)))
    return near, d, sure


def _nearest(k: int):
    def one(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(train):
            return pd.DataFrame({"id": [], "train_id": [], "label": pd.Series([], dtype=object),
                                 "dist": []})
        train = train.iloc[np.argsort(train["id"].to_numpy(), kind="stable")]
        asked, known = _matrix(queries["vec"]), _matrix(train["vec"])
        ids, labels = train["id"].to_numpy(), train["label"].to_numpy()
        top = min(k, len(train))
        owner, found, dist = [], [], []
        # A slice of queries at a time: memory follows the train chunk, not chunk times block.
        rows = max(1, 1_000_000 // len(train))
        for lo in range(0, len(asked), rows):
            part = asked[lo:lo + rows]
            near, d, sure = _sifted(part, known, top)
            for i in np.flatnonzero(~sure):
                far = _distances(part[i:i + 1], known)[0]
                last = np.partition(far, top - 1)[top - 1]
                # Ties at the k-th place go to the smaller id, as in the final merge.
                some = np.flatnonzero(far <= last)
                near[i] = some[np.argsort(far[some], kind="stable")[:top]]
                d[i] = far[near[i]]
            owner.append(np.repeat(queries["id"].to_numpy()[lo:lo + rows], top))
            found.append(near.ravel())
            dist.append(d.ravel())
        found = np.concatenate(found)
        return pd.DataFrame({"id": np.concatenate(owner), "train_id": ids[found],
                             "label": pd.Series(labels[found], dtype=object),
                             "dist": np.concatenate(dist)})
    return one


def nearest_neighbours(train: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS,
                       train_chunk: int = TRAIN_CHUNK, query_block: int = QUERY_BLOCK,
                       seed: int = 42) -> DataFrame:
    """(id, train_id, label, dist): the k nearest train rows of every query row.

    `train` has id, label, vec; `queries` has id, vec.
    """
    train = train.select(F.col("id").cast("long").alias("id"),
                         F.col("label").cast("string").alias("label"),
                         F.col("vec").cast("array<double>").alias("vec"))
    queries = queries.select(F.col("id").cast("long").alias("id"),
                             F.col("vec").cast("array<double>").alias("vec"))
    centres = _pivots(train, pivots, seed)
    placed = cut(_assign(train, centres))
    # One row per pivot on either side.
    radius, count = np.zeros(len(centres)), np.zeros(len(centres), dtype="int64")
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"),
                                        F.count("*").alias("n")).collect():
        radius[r.cell], count[r.cell] = r.far, r.n
    sent = cut(_reach(queries, centres, radius, count, k))
    asked = {r.cell: r.n for r in sent.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    chunks = F.element_at(F.array(*[F.lit(max(1, math.ceil(int(n) / train_chunk)))
                                    for n in count]), F.col("cell") + 1)
    blocks = F.element_at(F.array(*[F.lit(max(1, math.ceil(asked.get(i, 0) / query_block)))
                                    for i in range(len(centres))]), F.col("cell") + 1)
    mine = F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")
    # Each train chunk meets each query block of its group once.
    left = (sent.withColumns({"_n": blocks, "_chunks": chunks}).withColumn("block", mine)
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
            .drop("_n", "_chunks"))
    right = (placed.drop("far").withColumns({"_n": chunks, "_blocks": blocks})
             .withColumn("chunk", mine)
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
             .drop("_n", "_blocks"))
    keys = ["cell", "chunk", "block"]
    near = (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInPandas(lambda q, t: _nearest(k)(q, t),
                           "id long, train_id long, label string, dist double"))
    first = Window.partitionBy("id").orderBy("dist", "train_id")
    return (near.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
            .drop("_r"))


def _met(sent: DataFrame, placed: DataFrame, on: Sequence[str], k: int, train_chunk: int,
         query_block: int) -> DataFrame:
    """(id, train_id, label, dist): the k nearest train rows of each query row within each bucket.
    Large buckets are cut into chunks of train rows and blocks of queries, which all meet."""
    parts = (placed.groupBy(*on).agg(F.ceil(F.count("*") / train_chunk).alias("_chunks"))
             .join(sent.groupBy(*on).agg(F.ceil(F.count("*") / query_block).alias("_blocks")),
                   list(on)))
    parts = checked_broadcast(parts)
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = (sent.join(parts, list(on)).withColumn("block", mine("_blocks"))
            .withColumn("chunk", each("_chunks")).drop("_chunks", "_blocks"))
    right = (placed.join(parts, list(on)).withColumn("chunk", mine("_chunks"))
             .withColumn("block", each("_blocks")).drop("_chunks", "_blocks"))
    keys = [*on, "chunk", "block"]
    return (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInPandas(lambda q, t: _nearest(k)(q, t),
                           "id long, train_id long, label string, dist double"))


def hashed_neighbours(train: DataFrame, queries: DataFrame, k: int, tables: int = TABLES,
                      bucket: int = BUCKET, probes: int = PROBES, train_chunk: int = TRAIN_CHUNK,
                      query_block: int = QUERY_BLOCK, seed: int = 42) -> DataFrame:
    """(id, train_id, label, dist): k near train rows of every query row, most of them the nearest.

    Each of `tables` hash tables cuts the space by random planes through the middle of a small
    sample, as many as leave about `bucket` train rows together. A query goes to its own bucket
    and to the `probes` - 1 behind the planes it is nearest to, in each table: the same number
    whatever the table's size, where the exact way sends it to every group in reach. Distances of
    what is met are exact; `recall_of` measures what is missed.
    """
    train = train.select(F.col("id").cast("long").alias("id"),
                         F.col("label").cast("string").alias("label"),
                         F.col("vec").cast("array<double>").alias("vec"))
    queries = queries.select(F.col("id").cast("long").alias("id"),
                             F.col("vec").cast("array<double>").alias("vec"))
    stored, n = cut_counted(train)
    middle = _pivots(stored, PIVOTS, seed)
    if not len(middle):
        return stored.sparkSession.createDataFrame(
            [], "id long, train_id long, label string, dist double")
    bits = max(1, math.ceil(math.log2(max(1.0, n / bucket))))
    planes = np.random.default_rng(seed).normal(size=(tables, middle.shape[1], bits))
    centre = middle.mean(axis=0)
    weights = 1 << np.arange(bits, dtype="int64")

    def hashed(most: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                x = _matrix(pdf["vec"]) - centre
                for t in range(tables):
                    side = x @ planes[t]
                    own = ((side > 0) * weights).sum(axis=1)
                    yield pdf.assign(table=t, bucket=own)
                    # Behind the nearest planes, one at a time, then the two nearest at once.
                    near = np.argsort(np.abs(side), axis=1)
                    for p in range(min(most - 1, bits)):
                        yield pdf.assign(table=t, bucket=own ^ weights[near[:, p]])
                    if most - 1 > bits > 1:
                        both = weights[near[:, 0]] ^ weights[near[:, 1]]
                        yield pdf.assign(table=t, bucket=own ^ both)
        return run

    placed = cut(stored.mapInPandas(
        hashed(1), "id long, label string, vec array<double>, table int, bucket long"))
    sent = cut(queries.mapInPandas(hashed(probes), "id long, vec array<double>, table int, bucket long"))
    near = _met(sent, placed, ["table", "bucket"], k, train_chunk, query_block)
    # A train row that is met in several tables counts once.
    first = Window.partitionBy("id").orderBy("dist", "train_id")
    return (near.dropDuplicates(["id", "train_id"])
            .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k).drop("_r"))


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, neighbours, recall) of found against exact neighbours of the queries in `exact`. A
    neighbour is found if one as near is: equal distances are interchangeable."""
    worst = exact.groupBy("id").agg(F.max("dist").alias("far"), F.count("*").alias("n"))
    hits = (found.join(worst, "id").filter(F.col("dist") <= F.col("far") * (1 + 1e-9))
            .groupBy("id").agg(F.count("*").alias("hits")))
    return worst.join(hits, "id", "left").agg(
        F.count("*").alias("queries"), F.sum("n").alias("neighbours"),
        (F.sum(F.least(F.coalesce("hits", F.lit(0)), "n")) / F.sum("n")).alias("recall"))


def votes_of(near: DataFrame, by: Sequence[str] = ("id",)) -> DataFrame:
    """(by.., prediction, score): the label with the largest inverse-distance weight and its
    share. Rows at distance 0 outvote all others; ties go to the smaller label."""
    exact = F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy(*by))
    weight = F.when(exact == 1, (F.col("dist") == 0).cast("double")).otherwise(1 / F.col("dist"))
    votes = near.withColumn("w", weight).groupBy(*by, "label").agg(F.sum("w").alias("w"))
    best = F.min_by("label", F.struct(-F.col("w"), "label"))
    return votes.groupBy(*by).agg(best.alias("prediction"),
                                  (F.max("w") / F.sum("w")).alias("score"))


def knn_vote(train: DataFrame, queries: DataFrame, k: int = 7, **options) -> DataFrame:
    """(id, prediction, score) of every query row by the vote of its k nearest train rows."""
    return votes_of(nearest_neighbours(train, queries, k, **options))


def k_search(df: DataFrame, fold: str, ks: Sequence[int], **options) -> DataFrame:
    """(k, mean_accuracy, std_accuracy, rank) over folds, best first; ties to the smaller k.

    Each fold is asked once with the largest k; the nearest rows of that answer give every
    smaller k. `df` has id, label, vec and `fold`.
    """
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    near = None
    for f in folds:
        part = nearest_neighbours(df.filter(F.col(fold) != f), df.filter(F.col(fold) == f),
                                  max(ks), **options).withColumn("fold", F.lit(f))
        near = part if near is None else near.unionByName(part)
    place = F.row_number().over(Window.partitionBy("id").orderBy("dist", "train_id"))
    tried = near.withColumn("_r", place).withColumn("k", F.explode(F.filter(
        F.array(*map(F.lit, ks)), lambda k: k >= F.col("_r"))))
    votes = votes_of(tried, ["k", "fold", "id"])
    truth = df.select("id", F.col("label").cast("string").alias("truth"))
    hits = votes.join(truth, "id").groupBy("k", "fold").agg(
        F.avg((F.col("prediction") == F.col("truth")).cast("double")).alias("accuracy"))
    means = hits.groupBy("k").agg(F.avg("accuracy").alias("mean_accuracy"),
                                  F.stddev_pop("accuracy").alias("std_accuracy"))
    best = Window.orderBy(F.desc(F.round("mean_accuracy", 9)), "k")  # one row for each k
    return means.withColumn("rank", F.row_number().over(best))
