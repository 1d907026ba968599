"""The queries against their SQL, and the pipeline stage by stage against brute force."""

import re
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
import verify
from marketgauge.llm.oracles import ORACLES
from marketgauge.llm.quality_cascade import RULES, Measured
from marketgauge.llm.queries import QUERIES

from .conftest import FOLDER
from .test_tables import linked


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(FOLDER).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    assert verify.compare(spark, con, name, FOLDER).startswith("ok")


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def test_stages(spark, documents):
    stages = dict(corpus_pipeline.STAGES)

    def take(name, docs):
        out = stages[name](spark, docs, FOLDER).cache()
        assert name == "piece_ids" or out.columns == documents.columns
        return out, [r.asDict() for r in out.collect()]

    docs, rows = take("quality_rules", documents)
    source = [r.asDict() for r in documents.collect()]
    good = [r for r in source if not any(
        x.rejects(Measured((r["text"] or "").encode())) for x in RULES)]
    assert sorted(map(str, rows)) == sorted(map(str, good))

    groups = linked([(r["doc_id"], r["text"]) for r in rows])
    docs, kept = take("ngram_jaccard_join", docs)
    assert sorted(r["doc_id"] for r in kept) == sorted({g[2] for g in groups})

    docs, clean = take("secret_scans", docs)
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in kept)
    assert not any(re.search(r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", r["text"]) for r in clean)
    assert all(r["n_chars"] == len(r["text"]) for r in clean)

    docs, mixed = take("source_mix", docs)
    times = Counter(r["doc_id"] for r in mixed)
    assert set(times) <= {r["doc_id"] for r in clean} and max(times.values()) <= 2
    size = {r["doc_id"]: len(r["text"].split()) for r in clean}
    assert abs(sum(size[k] * n for k, n in times.items()) / sum(size.values()) - 1.5) < 0.2

    docs, ids = take("piece_ids", docs)
    library = sentencepiece.SentencePieceProcessor(
        model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r["doc_id"]: r["text"] for r in clean}
    assert Counter(r["doc_id"] for r in ids) == times
    for r in ids:
        assert r["ids"] == library.encode(text[r["doc_id"]]) + [library.eos_id()]
        assert r["n_tokens"] == len(r["ids"]) and r["round_trip"]


def test_stages_take_odd_and_empty_tables(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            assert docs.count() <= 2 * table.count()
