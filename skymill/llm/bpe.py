"""Byte-level BPE on sentencepiece: the model file is serialised from a rank vocabulary, nothing is trained.

Every token of the vocabulary becomes a piece in which each byte is one printable character, scored by its
negative rank, under a normaliser that changes nothing. Sentencepiece then merges the same pairs in the same
order as a rank-based encoder. Decoding maps pieces back to bytes.

Null and empty texts have no tokens. Equal rows are encoded alike; very long pre-tokens are encoded uncached. An empty
table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .common import CACHE_CHARS, CACHE_WORDS, map_rows, text_list, worker_state


def byte_alphabet() -> list[str]:
    """One printable character for each byte: its own where Latin-1 prints it, else the next one from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


ALPHABET = byte_alphabet()
#: latin-1 code point -> mapped character, for str.translate.
TO_PIECE = {b: c for b, c in enumerate(ALPHABET)}
FROM_PIECE = {ord(c): b for b, c in enumerate(ALPHABET)}


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: bytes | int) -> bytes:
    """A protobuf field: length-delimited for bytes, a varint for an int."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank vocabulary; a piece's id is its rank.

    Ranks must be 0..n-1 and hold all 256 single bytes, else ValueError.
    """
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must be 0 to n-1 without gaps")
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    normal, unknown, bpe = 1, 2, 2
    pieces = [(to_piece(t), -float(rank), normal) for rank, t in enumerate(tokens)] + [("\ue000", 0.0, unknown)]
    out = [_field(1, _field(1, p.encode()) + b"\x15" + struct.pack("<f", score) + _field(3, kind)) for p, score, kind in pieces]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + b"".join(_field(n, (1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def to_piece(data: bytes) -> str:
    return data.decode("latin-1").translate(TO_PIECE)


def from_piece(piece: str) -> bytes:
    return piece.translate(FROM_PIECE).encode("latin-1")


class ByteBPE:
    """Encoder and decoder over a serialised model; pre-tokens are cached within a bound."""

    def __init__(self, model: bytes, pattern: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.words = regex.compile(pattern).findall
        n = self.processor.get_piece_size() - 1
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        self.whole = {p: (i,) for i, p in enumerate(pieces)}
        self.tokens = [from_piece(p) for p in pieces]
        self.decimal = [str(i) for i in range(n)]
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text: every match of the pattern is encoded by itself."""
        split = [self.words(t) for t in texts]
        cache = self.cache
        missing = list({w for words in split for w in words if w not in cache})
        if len(cache) > CACHE_WORDS:
            cache.clear()
            missing = list({w for words in split for w in words})
        mapped = [to_piece(w.encode()) for w in missing]
        ids = [self.whole.get(p) for p in mapped]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.processor.encode([mapped[i] for i in rest], out_type=int, num_threads=1), strict=True):
            ids[i] = tuple(x)
        cache.update(zip(missing, ids, strict=True))
        out = []
        for words in split:
            doc: list[int] = []
            for w in words:
                doc += cache[w]
            out.append(doc)
        for w in missing:
            if len(w) > CACHE_CHARS:
                del cache[w]
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def _encoder(model: bytes, pattern: str) -> ByteBPE:
    """The worker's own encoder."""
    return worker_state(("bpe", hash(model), pattern), lambda: ByteBPE(model, pattern))


def encode_documents(docs: DataFrame, model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text; null text: no ids."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = _encoder(model, pattern).encode_batch(text_list(batch.column(1)))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_rows(docs, [id_col, text_col], run, "doc_id long, ids array<int>", keeps=True)


def decode_documents(encoded: DataFrame, model: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes that each row's ids stand for; null ids: empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decode = _encoder(model, pattern).decode
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x or []) for x in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "data"])

    return map_rows(encoded, [id_col, ids_col], run, "doc_id long, data binary", keeps=True)


def round_trip_digests(docs: DataFrame, model: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text is encoded and its ids decoded in one pass over the table."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _encoder(model, pattern)
        decimal, rows = bpe.decimal, []
        for ids in bpe.encode_batch(text_list(batch.column(1))):
            rows.append((len(ids), hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()))
        n, encoded, decoded = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(encoded), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_rows(docs, [id_col, text_col], run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
