"""Operators that judge each row by itself."""

import math
import re

import public_tokenizers
from pyspark.sql import functions as F

from marketgauge.llm.language_id import fit_languages, fold_of, predict_languages
from marketgauge.llm.piece_codec import PieceCodec, encode_pieces
from marketgauge.llm.quality_cascade import RULES, Measured, quality_cascade, rule_order
from marketgauge.llm.queries import MEASURES
from marketgauge.llm.secret_scan import redact, scan_secrets

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_cascade_measures(odd, empty, odd_rows):
    out = quality_cascade(odd, measures=MEASURES)
    assert out.count() == len(odd_rows)
    assert out.dtypes[-1] == ("base_failed", "boolean")
    for r in out.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        lines = [x for x in (r.text or "").split("\n") if x.strip("\x20\t\n\x0b\x0c\r")]
        windows = list(zip(words, words[1:], words[2:]))
        again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} \
            if len(words) < 500 else None
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum((r.text or "").count(c) for c in "#*$%&|<>")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert again is None or r.n_repeat_words == len(again)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert quality_cascade(empty).count() == 0


def test_cascade_order_changes_no_verdict(odd):
    def verdicts(order):
        return sorted(map(str, quality_cascade(odd, order=order).select("doc_id", "kept").collect()))

    names = [r.name for r in RULES]
    assert verdicts(names) == verdicts(names[::-1]) == verdicts(None)
    assert sorted(rule_order(odd)) == sorted(names)


def test_cascade_stops_at_the_first_broken_rule():
    d = Measured(b"short text")
    assert next(r.name for r in RULES if r.rejects(d)) == "too_short"
    assert "n_repeat_words" not in d.__dict__


def test_codec_is_the_library(documents, odd, empty):
    columns = {"ids": lambda e: e.ids, "n_tokens": lambda e: e.n_tokens,
               "back": lambda e: e.decoded}
    kinds = {"ids": "string", "n_tokens": "bigint", "back": "string"}
    library = PieceCodec(MODEL).library
    for df in (documents, odd):
        rows = encode_pieces(df, MODEL, columns, kinds).collect()
        assert len(rows) == df.count()
        for r in rows:
            ids = library.encode(r.text or "") + [library.eos_id()]
            assert r.ids == " ".join(map(str, ids)) and r.n_tokens == len(ids)
            assert r.back == library.decode(ids)
    assert encode_pieces(empty, MODEL, columns, kinds).count() == 0


def test_codec_long_and_short_agendas_agree():
    codec = PieceCodec(MODEL)
    for text in ("▁internationalization", "▁" * 40, "aaaaaaaaaaaaaaaaaaa", "▁naïve漢字"):
        assert codec.merged_long(list(text)) == codec.merged_short(list(text))
        assert codec.encoded("▁" + "ab" * 5000)  # beyond the short agenda


def entropy(window):
    return -sum(window.count(c) / len(window) * math.log2(window.count(c) / len(window))
                for c in set(window))


def test_secrets(spark, odd, empty):
    token = "zQ3kL9xV7bN2mW5rT8yU1pJ4"
    texts = [("token: short token=abcdefghijkl1", "assign:13:32"),
             ("PassWord=\"hunter2hunter2\"", "assign:0:24"), ("AKIA0123456789ABCDE.", "access:0:19"),
             (f"é {token} x", "entropy:2:26"), (f"example-{token}", ""),
             ("zzzzzzzzzzzzzzzzzzzzzzzzzzzzzz1", ""), ("0123456789abcdef0", "hex:0:17"),
             (None, ""), ("", "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id int, text string")
    for r in scan_secrets(df).collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.secrets)
        assert got == texts[r.doc_id][1], (r.text, got)
    assert max(entropy(token[i:i + 20]) for i in range(5)) > 3.85
    clean = {r.doc_id: r.text for r in redact(df).collect()}
    assert clean[3] == "é [SECRET] x" and clean[7] is None and clean[8] == ""
    assert clean[1] == "[SECRET]\"" and clean[4] == texts[4][0]
    assert scan_secrets(odd).count() == odd.count() and scan_secrets(empty).count() == 0
    assert "[SECRET]" in [r.text for r in redact(odd).filter("doc_id = 17").collect()][0]


def test_languages(documents, odd, empty):
    model = fit_languages(documents.filter(fold_of("doc_id") != 0))
    found = predict_languages(documents, model)
    held = found.filter(fold_of("doc_id") == 0)
    right = held.filter("lang_pred = lang").count() / held.count()
    assert right > 0.95
    rows = predict_languages(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    assert predict_languages(empty, model).count() == 0
    nothing = fit_languages(empty)
    assert {r.lang_pred for r in predict_languages(odd, nothing).collect()} == {"und"}
    # Neither key nor source nor label is looked at.
    other = predict_languages(documents.select(
        (-F.col("doc_id")).alias("doc_id"), "text", F.lit("xx").alias("lang")), model)
    assert sorted((-r.doc_id, r.lang_pred, r.score) for r in other.collect()) == sorted(
        (r.doc_id, r.lang_pred, r.score) for r in found.collect())
