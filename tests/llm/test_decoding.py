"""Decoding of ids against the library."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from marketgauge.llm import piece_codec
from marketgauge.llm.piece_codec import codec, decode_pieces, encode_pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
IDS = {"ids": lambda e: e.numbers, "decoded": lambda e: e.decoded}
TYPES = {"ids": "array<int>", "decoded": "string"}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_any_ids_decode_as_in_the_library(spark, library):
    r = random.Random(9)
    size = library.vocab_size()
    bytes_ = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    lists = [[r.randrange(size) for _ in range(r.randrange(40))] for _ in range(200)]
    # Single bytes that form characters, and such that form none.
    lists += [[bytes_[b] for b in "é漢😀".encode()] + [r.randrange(300, size)] for _ in range(5)]
    lists += [[r.choice(bytes_) for _ in range(r.randrange(1, 9))] for _ in range(60)]
    lists += [[], [library.eos_id()], [library.bos_id(), library.unk_id(), library.eos_id()]]
    lists += [library.encode(t) for t in (" a", "  two", "▁ mark", "\n", "x ▁y ", "é\x00z")]
    df = spark.createDataFrame(list(enumerate(lists)) + [(10 ** 6, None)],
                               "doc_id long, ids array<int>").withColumn("decoded", F.lit("old"))
    got = {row.doc_id: row.decoded for row in decode_pieces(df.repartition(3), MODEL).collect()}
    assert got.pop(10 ** 6) is None
    assert got == {i: library.decode(ids) for i, ids in enumerate(lists)}
    assert decode_pieces(df.limit(0), MODEL).count() == 0


def test_ids_without_a_piece_fail(spark):
    df = spark.createDataFrame([(1, [5, 10 ** 7])], "doc_id long, ids array<int>")
    with pytest.raises(PythonException):
        decode_pieces(df, MODEL).collect()


def test_texts_come_back_from_their_ids(spark, odd, library):
    out = encode_pieces(odd.select("doc_id", "text"), MODEL, IDS, TYPES).cache()
    for r in out.collect():
        assert r.decoded == library.decode(list(r.ids)), r.text
    again = decode_pieces(out, MODEL, name="again")
    assert again.filter(~F.col("again").eqNullSafe(F.col("decoded"))).count() == 0


def test_a_lost_id_is_seen(monkeypatch):
    """What is called decoded is made of the ids."""
    c = piece_codec.PieceCodec(MODEL)
    text = "plain words, and more of them"
    assert c.encode_batch([text])[0].decoded == text
    segment = next(s for s in c.known if s.endswith("more"))
    c.known[segment] = c.names[codec(MODEL).library.piece_to_id("▁less")]
    assert c.encode_batch([text])[0].decoded == "plain words, and less of them"
