"""Quality rules as a short-circuit cascade, cheapest rejections first."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ASCII white space, and the characters that count as symbols.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 2_000


class Measured:
    """A text and what is counted in it; each count is made once, when first asked for."""

    def __init__(self, text: bytes) -> None:
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text.translate(None, SPACE).decode())

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return sum(1 for line in self.text.split(b"\n") if line.strip())

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [line for line in self.text.split(b"\n") if line.strip()]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that are found twice or more."""
        if self.n_words < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in self.words], dtype=np.int64)
        _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
        _, window, counts = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True,
                                      return_counts=True)
        again = counts[window] > 1
        covered = np.zeros(len(ids), dtype=bool)
        for k in range(3):
            covered[k:len(ids) - 2 + k] |= again
        return int(covered.sum())

    @cached_property
    def cases(self) -> tuple[int, int]:
        """Upper and lower case letters of the Latin-1 range."""
        points = np.frombuffer(self.text.decode().encode("utf-32-le"), dtype=np.uint32)
        kinds = CASE[np.minimum(points, 256)]
        return int((kinds == 1).sum()), int((kinds == 2).sum())


# 1 for A-Z and their Latin-1 kin, 2 for the lower case letters.
CASE = np.array([1 if chr(i).isupper() else 2 if chr(i).islower() and i not in (0xAA, 0xBA) else 0
                 for i in range(256)] + [0], dtype=np.uint8)


@dataclass(frozen=True)
class Rule:
    """`rejects` says whether a text breaks the rule. Base rules alone make `base_failed`."""

    name: str
    rejects: Callable[[Measured], bool]
    base: bool = False


RULES = (
    Rule("too_short", lambda d: d.n_words < 50, base=True),
    Rule("repeats_itself", lambda d: 100 * d.n_repeat_words > 50 * d.n_words, base=True),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("word_length", lambda d: not 3 * d.n_words <= d.word_chars <= 12 * d.n_words),
    Rule("same_lines", lambda d: 2 * d.n_dup_lines > d.n_lines),
    Rule("shouting", lambda d: 10 * d.cases[0] > 6 * sum(d.cases)),
)


def texts_of(batch: pa.RecordBatch, text: str) -> Iterator[bytes]:
    """The texts of a batch one at a time, NULL as empty."""
    for x in batch.column(text).cast(pa.large_binary()):
        yield x.as_py() or b""


def rule_order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
               key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules, highest rejections per second first.

    Each rule is timed by itself on a seeded sample of about `sample_rows` rows. The sample settles
    the order alone: whatever the order, the same texts pass. Ties keep the order of `rules`.
    """
    step = max(1, docs.count() // sample_rows)
    sample = docs.select(key, text).filter(F.pmod(F.xxhash64(F.col(key)), F.lit(step)) == 0)

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected = [0.0] * len(rules), [0] * len(rules)
        for batch in batches:
            for x in texts_of(batch, text):
                for i, rule in enumerate(rules):
                    begun = time.perf_counter()
                    rejected[i] += bool(rule.rejects(Measured(x)))
                    spent[i] += time.perf_counter() - begun
        yield pa.RecordBatch.from_pydict(
            {"rule": [r.name for r in rules], "seconds": spent, "rejected": rejected})

    found = sample.mapInArrow(timed, "rule string, seconds double, rejected long").groupBy(
        "rule").agg((F.sum("rejected") / F.greatest(F.sum("seconds"), F.lit(1e-9))).alias("gain"))
    gain = {r["rule"]: r["gain"] for r in found.collect()}
    return [r.name for r in sorted(rules, key=lambda r: -gain.get(r.name, 0.0))]


def quality_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text",
                    key: str = "doc_id", order: list[str] | None = None,
                    measures: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS,
                    name: str = "kept") -> DataFrame:
    """Adds `name`, whether the text breaks no rule, and the `measures` of `Measured` asked for.

    The rules run in the order of their rejections per cost, and a text that breaks one is not put
    to the rest. NULL and empty texts have no words and break `too_short`. Each row is judged by
    itself, so equal rows fare equally; an empty table gives no rows. Other columns go through,
    columns of the new names are replaced. No exchange but for the order's counts.
    """
    order = order or rule_order(docs, rules, text, key, sample_rows)
    ranked = sorted(rules, key=lambda r: order.index(r.name))
    with_base = "base_failed" in measures
    counts = [m for m in measures if m != "base_failed"]
    docs = docs.drop(name, *measures)
    new = [(name, pa.bool_()), *[(m, pa.int64()) for m in counts],
           *([("base_failed", pa.bool_())] if with_base else [])]
    schema = T.StructType([*docs.schema.fields, *[
        T.StructField(n, T.BooleanType() if t == pa.bool_() else T.LongType()) for n, t in new]])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in new]
            for x in texts_of(batch, text):
                d = Measured(x)
                broken = next((r for r in ranked if r.rejects(d)), None)
                rows[0].append(broken is None)
                for i, m in enumerate(counts):
                    rows[1 + i].append(getattr(d, m))
                if with_base:
                    rows[-1].append(broken is not None and (broken.base or any(
                        r.rejects(d) for r in rules if r.base)))
            added = [pa.array(r, type=t) for r, (_, t) in zip(rows, new)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added],
                                             names=[*batch.schema.names, *[n for n, _ in new]])

    return docs.mapInArrow(judged, schema)
