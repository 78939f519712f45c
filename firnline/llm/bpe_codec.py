"""Byte-level BPE by a sentencepiece model that is written out directly from a rank file.

Each rank becomes a piece whose bytes are mapped to printable characters and whose score is the negative rank, so that
sentencepiece merges in the order of the ranks; normalisation is the identity. Texts are split into pre-tokens by the
pattern, each pre-token is encoded by the model, and ids are decoded by the inverse of the byte mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import small_batches, text_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Pre-tokens whose ids a worker remembers; more are forgotten together, so its memory is bounded.
REMEMBERED = 1_000_000
#: About how many bytes those take; very long ones count.
REMEMBERED_BYTES = 64 << 20
_NORMAL, _UNKNOWN = 1, 2


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next of those from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file, by rank."""
    with open(path, "rb") as f:
        ranks = sorted((int(rank), base64.b64decode(piece)) for piece, rank in map(bytes.split, f))
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError(f"ranks in {path} are not 0 to {len(ranks) - 1}")
    return [piece for _, piece in ranks]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A field of a protocol buffer: an int as varint, a float in four bytes, bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialised_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; one more id stands for unknown characters."""
    shown = byte_characters()
    out = [_field(1, _field(1, "".join(shown[b] for b in piece).encode()) + _field(2, -float(rank)) + _field(3, _NORMAL)) for rank, piece in enumerate(pieces)]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, _UNKNOWN)))
    trainer = _field(3, 2) + _field(4, len(pieces) + 1) + _field(40, len(pieces))  # model_type BPE, vocab_size, unk_id
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, all white space kept and not escaped
    return b"".join([*out, _field(2, trainer), _field(3, normalizer)])


class Codec:
    """Encoder and decoder of one rank file and splitting pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.pieces = read_ranks(path)
        self.shown = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(self.pieces))
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0
        back = {c: b for b, c in self.shown.items()}
        self.decoded = [bytes(back[ord(c)] for c in self.model.id_to_piece(i)) for i in range(len(self.pieces))]

    def _learn(self, pre_tokens: list[str]) -> None:
        encoded = self.model.encode([self._show(t) for t in pre_tokens], num_threads=1)
        self.known.update(zip(pre_tokens, [array("I", ids).tobytes() for ids in encoded], strict=True))
        self.known_bytes += 5 * sum(map(len, pre_tokens))

    def _show(self, pre_token: str) -> str:
        if pre_token.isascii() and pre_token.isprintable():  # only the space is shown as another character
            return pre_token.replace(" ", chr(self.shown[0x20]))
        return pre_token.encode().decode("latin-1").translate(self.shown)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pre_tokens = self.split(text)
        known = self.known
        if new := {t for t in pre_tokens if t not in known}:
            if len(known) + len(new) > REMEMBERED or self.known_bytes > REMEMBERED_BYTES:
                known.clear()
                self.known_bytes = 0
                new = {*pre_tokens}
            self._learn([*new])
        return b"".join(map(known.__getitem__, pre_tokens))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids: each piece of the model by the inverse of the byte mapping."""
        return b"".join(map(self.decoded.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 and decoded_sha256 (lowercase hex), with_ids: also ids.

    ids_sha256 is of the ids as little-endian unsigned 32-bit integers, decoded_sha256 of the bytes that they decode
    to. A null text counts as empty: no tokens, both hashes of no bytes. Other columns are not read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            encoded = [own.encode(t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id"),
                pa.array([len(x) // 4 for x in encoded], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in encoded]),
                pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in encoded]),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype("int32") for x in encoded], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
