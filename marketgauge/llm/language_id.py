"""Language identification: family first, then one against one within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

# Families of closely related languages. A language of none is a family by itself.
FAMILIES = {"germanic": ("en", "de", "nl", "sv", "da", "no"),
            "romance": ("fr", "es", "it", "pt", "ro", "ca")}
UNKNOWN = "und"
FEATURES = 2048
SAMPLE_ROWS = 2_400
FOLDS = 5


def fold_of(key: str, folds: int = FOLDS) -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def family_of(lang: str, families=FAMILIES) -> str:
    return next((f for f, members in families.items() if lang in members), lang)


def features(text: bytes, size: int = FEATURES) -> np.ndarray:
    """Hashed counts of runs of one to three UTF-8 bytes of the whole text, as square roots on the
    unit sphere. ASCII letters are made small, digits are left out."""
    a = np.frombuffer(text.lower().translate(None, b"0123456789"), dtype=np.uint8).astype(np.uint32)
    total = np.zeros(size)
    for k, factors in ((1, (40503,)), (2, (40503, 10007)), (3, (40503, 10007, 2999))):
        if len(a) >= k:
            h = sum(f * a[i:len(a) - k + 1 + i] for i, f in enumerate(factors)) + 7919 * k
            h ^= h >> 11
            total += np.bincount(h % size, minlength=size)
    v = np.sqrt(total)
    return v / max(np.linalg.norm(v), 1e-12)


@dataclass(frozen=True)
class Plane:
    """A linear machine: positive for `yes`, else `no`."""

    yes: str
    no: str
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class LanguageModel:
    """`families`: one machine for each pair of families; `members`: for each family, one for each
    pair of its languages; `langs`: the languages of each family."""

    families: list[Plane]
    members: dict[str, list[Plane]]
    langs: dict[str, list[str]]

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        if not self.langs:
            return UNKNOWN, 0.0
        family, sure = vote(sorted(self.langs), self.families, v)
        lang, surer = vote(self.langs[family], self.members[family], v)
        return lang, sure * surer


def vote(names: list[str], planes: list[Plane], v: np.ndarray) -> tuple[str, float]:
    """The name with most wins, ties by the sum of its margins; score: the least probability with
    which it beats another, 0 to 1."""
    wins, margins, least = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0), {}
    for p in planes:
        m = float(v @ p.weights + p.bias)
        for name, margin in ((p.yes, m), (p.no, -m)):
            wins[name] += margin > 0
            margins[name] += margin
            least[name] = min(least.get(name, 1.0), 1 / (1 + np.exp(-4 * np.clip(margin, -9, 9))))
    best = max(names, key=lambda n: (wins[n], margins[n]))
    return best, float(least.get(best, 1.0))


def labelled_sample(docs: DataFrame, text: str, lang: str, key: str, rows: int) -> DataFrame:
    """(lang, v) of about `rows` labelled rows, as many of each language as there are or its share.

    Rows are taken by a hash of the key, so the sample is the same at every run. A language's
    share of `rows` is the bound on what is fitted, whatever the size of the table.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}
    if not counts:
        return labelled.select(lang, F.array().cast("array<double>").alias("v"))
    place = F.pmod(F.xxhash64(F.col(key)), F.lit(1_000_000))
    share = F.lit(0)
    for name, n in counts.items():
        wanted = -(-1_000_000 * rows // (len(counts) * n))
        share = F.when(F.col(lang) == name, F.lit(min(wanted, 1_000_000))).otherwise(share)
    schema = T.StructType([T.StructField("lang", T.StringType()),
                           T.StructField("v", T.ArrayType(T.DoubleType()))])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(x.as_py()) for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, type=pa.list_(pa.float64()))], ["lang", "v"])

    return labelled.filter(place < share).select(lang, text).mapInArrow(vectors, schema)


def fit_plane(sample: DataFrame, column: str, yes: str, no: str) -> Plane:
    rows = sample.filter(F.col(column).isin(yes, no)).withColumn(
        "label", (F.col(column) == yes).cast("double"))
    fitted = LinearSVC(maxIter=30, regParam=1e-4, standardization=False).fit(rows)
    return Plane(yes, no, fitted.coefficients.toArray(), float(fitted.intercept))


def fit_languages(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
                  families=FAMILIES, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fits the machines on a bounded sample of the labelled rows of `docs`."""
    sample = cut(labelled_sample(docs, text, lang, key, sample_rows))
    names = sorted(r[0] for r in sample.select("lang").distinct().collect())
    langs: dict[str, list[str]] = {}
    for n in names:
        langs.setdefault(family_of(n, families), []).append(n)
    of = F.lit(None).cast("string")
    for n in names:
        of = F.when(F.col("lang") == n, F.lit(family_of(n, families))).otherwise(of)
    ready = sample.select("lang", of.alias("family"), array_to_vector("v").alias("features")).cache()
    try:
        top = [fit_plane(ready, "family", a, b) for a, b in combinations(sorted(langs), 2)]
        members = {f: [fit_plane(ready, "lang", a, b) for a, b in combinations(ls, 2)]
                   for f, ls in langs.items()}
    finally:
        ready.unpersist()
    return LanguageModel(top, members, langs)


def predict_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score` (0 to 1), from the whole text alone.

    NULL, empty and letterless texts are `und` with score 0, as is every text if nothing was
    learned. Equal texts have equal results; an empty table gives no rows. Other columns go
    through, columns of the new names are replaced. No exchange.
    """
    docs = docs.drop("lang_pred", "score", "_letters").withColumn(
        "_letters", F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    kept = [c for c in docs.columns if c != "_letters"]
    schema = T.StructType([*docs.select(*kept).schema.fields,
                           T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(features(x.as_py())) if has.as_py() else (UNKNOWN, 0.0)
                     for x, has in zip(batch.column(text).cast(pa.large_binary()),
                                       batch.column("_letters"))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], [*kept, "lang_pred", "score"])

    return docs.mapInArrow(predicted, schema)
