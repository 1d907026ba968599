"""SentencePiece encoding and decoding of merge-type vocabularies."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = "▁"  # fixed value: the mark that stands for a blank in a vocabulary
SHORT = 64  # symbols up to which a list is the faster agenda
NONE = 2 ** 62  # rank of a pair that is no piece
CACHE = 500_000  # segments a worker keeps
UNKNOWN = " ⁇ ".encode()  # fixed value: the text of the unknown id
CHARS = 2_000_000  # characters that are encoded together


class Encoded(NamedTuple):
    """A text, its ids with the end id (decimals and blanks), their number, the decoded text."""

    text: str
    ids: str
    n_tokens: int
    decoded: str

    @property
    def numbers(self) -> np.ndarray:
        return np.fromstring(self.ids, dtype=np.int32, sep=" ")


class PieceCodec:
    """Encodes by an agenda of adjacent symbol pairs, and decodes, as the library does.

    Text is cut where no piece can reach across: before a mark behind another character, and
    around line ends if no piece of several characters holds one. Each distinct segment is merged
    once, checked against the library, and kept. Vocabularies with other normalisation than the
    identity with a mark put before the text, or without byte pieces, are refused.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = model.ModelProto()
        proto.ParseFromString(self.library.serialized_model_proto())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if (norm.precompiled_charsmap or not norm.add_dummy_prefix
                or norm.remove_extra_whitespaces or not norm.escape_whitespaces
                or train.treat_whitespace_as_suffix or not train.byte_fallback
                or train.model_type != train.BPE):
            raise ValueError(f"{path}: not a plain merge vocabulary with byte pieces")
        normal = model.ModelProto.SentencePiece.NORMAL
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == normal}
        scores = sorted({p.score for p in proto.pieces if p.type == normal}, reverse=True)
        place = {score: i for i, score in enumerate(scores)}
        self.ranks = {p.piece: place[p.score] for p in proto.pieces if p.type == normal}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.end = self.library.eos_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path}: a piece holds a blank behind another character")
        self.lines = not any("\n" in p for p in self.ids if len(p) > 1)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if self.lines
                                   else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.names = [str(i) for i in range(len(proto.pieces))]
        # What an id stands for in a text: a piece, one byte, or nothing (control pieces).
        kinds = type(proto.pieces[0])
        self.spelt = {name: b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)])
                      if p.type == kinds.BYTE else UNKNOWN if p.type == kinds.UNKNOWN
                      else p.piece.encode() for name, p in zip(self.names, proto.pieces)}
        self.known: dict[str, str] = {}  # the ids of a segment
        self.again: set[str] = set()

    def merged(self, segment: str) -> list[str]:
        """Symbols after all merges: the best score first, then the leftmost pair."""
        return (self.merged_short if len(segment) <= SHORT else self.merged_long)(list(segment))

    def merged_short(self, symbols: list[str]) -> list[str]:
        """The agenda as a list of the ranks of neighbours: its first minimum is next."""
        rank = self.ranks.get
        agenda = [rank(a + b, NONE) for a, b in zip(symbols, symbols[1:])]
        while agenda and (best := min(agenda)) != NONE:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], NONE)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], NONE)
        return symbols

    def merged_long(self, symbols: list[str]) -> list[str]:
        """The agenda as a heap, so that a long segment takes n log n steps."""
        n, rank = len(symbols), self.ranks.get
        agenda = [(r, i) for i in range(n - 1)
                  if (r := rank(symbols[i] + symbols[i + 1], NONE)) != NONE]
        heapq.heapify(agenda)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while agenda:
            best, left = heapq.heappop(agenda)
            right = after[left]
            if not symbols[left] or right == n or rank(symbols[left] + symbols[right]) != best:
                continue  # a merge has changed this pair
            symbols[left] += symbols[right]
            symbols[right] = ""
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
            for at in (before[left], left):
                if at >= 0 and after[at] < n:
                    r = rank(symbols[at] + symbols[after[at]], NONE)
                    if r != NONE:
                        heapq.heappush(agenda, (r, at))
        return [s for s in symbols if s]

    def encoded(self, segment: str) -> list[int]:
        pieces = self.merged(segment)
        out = [self.ids.get(s) for s in pieces]
        if None not in out:
            return out
        return [i for s, known in zip(pieces, out) for i in (
            [known] if known is not None else [self.bytes[b] for b in s.encode()])]

    def learn(self, segments: list[str]) -> None:
        """Encodes new segments and holds each against the library, both ways."""
        ids = [self.encoded(s) for s in segments]
        # The library puts a mark before a text; others are shown to it behind a line end.
        asked = [s[1:] if s[0] == SPACE else "\n" + s for s in segments]
        told = self.library.encode(asked, num_threads=1)
        back = self.library.decode(ids, num_threads=1)
        names, known = self.names, self.known
        for s, ask, mine, theirs, text in zip(segments, asked, ids, told, back):
            if s[0] != SPACE:
                theirs = theirs[2:]
                same = text == s
            else:
                same = text == (ask.replace(SPACE, " ") if SPACE in ask else ask)
            # A mark alone has nothing to merge, and no text of its own to ask with.
            if not same or theirs != mine and s != SPACE:
                raise ValueError(f"the library encodes {s!r} in another way")
            known[s] = " ".join([names[i] for i in mine])

    def normalized(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def decode(self, ids: list[str]) -> str:
        """The text of ids, given as decimal numbers: pieces put together, single bytes as the
        characters that they form across pieces, marks as blanks but for the first."""
        spelt = b"".join(map(self.spelt.__getitem__, ids))
        try:
            text = spelt.decode()
        except UnicodeDecodeError:  # bytes that form no character, which no text is encoded to
            return self.library.decode([int(i) for i in ids])
        return text[text.startswith(SPACE):].replace(SPACE, " ")

    def encode_batch(self, texts: list[str]) -> list[Encoded]:
        cut = [self.segments(self.normalized(t)) for t in texts]
        wanted = set().union(*cut)
        if len(self.known) > CACHE:  # those that came again of late stay
            self.known = {s: k for s, k in self.known.items() if s in self.again}
            self.again = set()
        self.again |= self.known.keys() & wanted
        new = wanted.difference(self.known)
        if new:
            self.learn(list(new))
        ids_of, end, out = self.known.__getitem__, self.names[self.end], []
        for text, segments in zip(texts, cut):
            ids = " ".join([*map(ids_of, segments), end])
            listed = ids.split(" ")
            out.append(Encoded(text, ids, len(listed), self.decode(listed)))
        return out


CODECS: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for a worker process, with the segments it has learnt."""
    if path not in CODECS:
        CODECS[path] = PieceCodec(path)
    return CODECS[path]


ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(),
         "array<int>": pa.list_(pa.int32())}


def encode_pieces(docs: DataFrame, path: str, columns: dict[str, Callable[[Encoded], object]],
                  types: dict[str, str], text: str = "text", drop: tuple[str, ...] = ()
                  ) -> DataFrame:
    """Adds a column for each of `columns`: a function of what was encoded.

    `types` has the Spark types of the new columns (those of ARROW), `drop` names columns that are
    not wanted in the result. Texts are taken whole, NULL as the empty text, whose ids are the end
    id alone. Rows are encoded one by one in Arrow batches with no exchange: equal rows give equal
    results, an empty table no rows; other columns go through, columns of the new names are
    replaced. A worker keeps about CACHE segments, and works on and gives out about CHARS
    characters, or one text, at a time.
    """
    source = docs.drop(*columns)
    kept = [f for f in source.schema.fields if f.name not in drop]
    schema = T.StructType([*kept, *[T.StructField(n, T._parse_datatype_string(types[n]))
                                    for n in columns]])
    names = [f.name for f in kept]

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
        begin, texts, size = 0, [], 0
        for i, x in enumerate(batch.column(text)):
            texts.append(x.as_py() or "")
            size += len(texts[-1])
            if size > CHARS:
                yield begin, texts
                begin, texts, size = i + 1, [], 0
        if texts:
            yield begin, texts

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for begin, texts in parts(batch):
                found = c.encode_batch(texts)
                new = [pa.array([fn(e) for e in found], type=ARROW[types[n]])
                       for n, fn in columns.items()]
                part = batch.slice(begin, len(texts))
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *new],
                                                 names=[*names, *columns])

    return source.mapInArrow(encoded, schema)


def decode_pieces(docs: DataFrame, path: str, ids: str = "ids", name: str = "decoded"
                  ) -> DataFrame:
    """Adds `name`: the text of the ids in the array column `ids`, as the library decodes them.

    Control ids give nothing, NULL ids NULL, no ids the empty text; an id that the vocabulary lacks
    (or a NULL in the array) fails the job. Rows are decoded one by one in Arrow batches with no
    exchange; other columns go through, a column of the new name is replaced.
    """
    source = docs.drop(name)
    schema = T.StructType([*source.schema.fields, T.StructField(name, T.StringType())])

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            texts = [None if x.as_py() is None else c.decode([str(i) for i in x.as_py()])
                     for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=[*batch.schema.names, name])

    return source.mapInArrow(decoded, schema)
