"""Encoding a corpus with a public byte-level BPE vocabulary through a sentencepiece model.

The model is serialised here, directly from the vocabulary: each token becomes
a piece spelled in the printable stand-ins of its bytes, scored by the negative of its
rank, so that the best merge is the one of lowest rank; normalisation is the
identity.  Texts are cut into pre-tokens, each of which is encoded by itself.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.sources.tables import table

#: Folder of the public vocabulary files; a parameter of every function that reads them.
VOCABULARIES = "/opt/tokenizers"

#: Fixed value: how byte_bpe_50k cuts a text into pre-tokens (white space is Unicode's property).
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Distinct pre-tokens a worker remembers before it starts anew.
_REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable, else the next from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: bytes are length-delimited, floats 32 bits wide, ints varints."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a file of base64 tokens and ranks, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [tokens[i] for i in range(len(tokens))]


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks of ``tokens``; the id after the last is unknown."""
    letters = byte_letters()
    pieces = []
    for rank, token in enumerate(tokens):
        spelled = "".join(letters[b] for b in token).encode()
        pieces.append(_field(1, _field(1, spelled) + _field(2, float(-rank)) + _field(3, 1)))
    unknown = len(tokens)
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one model; made once per Python worker."""

    def __init__(self, model: bytes):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(PRE_TOKEN).findall
        letters = byte_letters()
        self.to_letters = {b: c for b, c in enumerate(letters)}
        self.to_bytes = {ord(c): chr(b) for b, c in enumerate(letters)}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        pre_tokens = self.cut(text)
        new = [t for t in dict.fromkeys(pre_tokens) if t not in known]
        if new:
            if len(known) > _REMEMBERED:
                known.clear()
                new = list(dict.fromkeys(pre_tokens))
            spelled = [t.encode().decode("latin-1").translate(self.to_letters) for t in new]
            known.update(zip(new, self.processor.encode(spelled, num_threads=1)))
        for t in pre_tokens:
            out += known[t]
        return out

    def decode(self, ids: list[int]) -> str:
        spelled = "".join(self.processor.id_to_piece(i) for i in ids)
        return spelled.translate(self.to_bytes).encode("latin-1").decode()


_codecs: dict[int, Codec] = {}


def _codec(model: bytes) -> Codec:
    key = hash(model)
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row, in one pass and without a shuffle.

    Null and empty texts have the empty list; no special token is ever emitted,
    also where its string stands in a text.  Rows are neither merged nor
    dropped; a null key stays null.  Decoding the ids gives the text again.
    """
    spark = df.sparkSession
    model = spark.sparkContext.broadcast(model_bytes(read_ranks(vocabulary)))  # 1 MB, the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    rows = df.select(key, text)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = f"{VOCABULARIES}/byte_bpe_50k.tiktoken") -> DataFrame:
    """``key`` and ``text`` of every row of ids; an empty list gives the empty text, null gives null."""
    model = df.sparkSession.sparkContext.broadcast(model_bytes(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in batches:
            texts = [None if x is None else codec.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    rows = df.select(key, ids)
    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, text string")


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_texts(table(spark, root, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids}

SQL: dict[str, str] = {}
