"""SentencePiece encoding that keeps offsets, and decoding (operator 10).

The text is first normalised by longest-prefix matches in the model's compiled character map (a double-array trie); the
normaliser records for each normalised byte the source byte it came from. The library's own encoder gives the ids; each
piece's span in the normalised text then projects through that record to bytes of the source text.

Null text counts as empty; empty text has no ids, no spans and decodes to an empty string. Repeated rows give repeated results;
further columns are ignored except those named in `keep`. Texts are taken whole, however long; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textloom.llm.common import slices, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_file(model: str) -> str:
    """A path as it is; a bare name is looked up among the public tokenizers of the machine that runs this."""
    if os.path.isabs(model):
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def _fields(blob: bytes):
    """(number, value) of each field of a protocol buffer message; values are ints or bytes."""
    at, end = 0, len(blob)

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            b = blob[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, blob[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, blob[at : at + n]
            at += n


class Normaliser:
    """Normalises bytes as a model's specification says and aligns the result with its source."""

    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, squeeze: bool = True, escape: bool = True, user_symbols: tuple[bytes, ...] = ()):
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape
        self.user_symbols = sorted(user_symbols, key=len, reverse=True)
        self.units, self.pool = (), b""
        if charsmap:
            (size,) = struct.unpack_from("<I", charsmap)
            self.units = struct.unpack_from(f"<{size // 4}I", charsmap, 4)
            self.pool = charsmap[4 + size :]
        self.space = SPACE if escape else b" "
        self._memo: dict[bytes, tuple[bytes, int]] = {}

    def longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(length, place in the pool) of the longest key of the character map that starts at `at`; length 0 if none does."""
        units, node, found = self.units, 0, (0, 0)
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def prefix(self, text: bytes, at: int) -> tuple[bytes, int]:
        """What the text at `at` begins with, normalised, and how many source bytes that takes."""
        for s in self.user_symbols:
            if text.startswith(s, at):
                return s, len(s)
        if self.units:
            n, place = self.longest(text, at)
            if n:
                return self.pool[place : self.pool.index(b"\0", place)], n
        lead = text[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return text[at : at + n], n

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them, and for the end, the source offset."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if not self.units and not self.user_symbols and not self.squeeze:
            return self._plain(text)
        out, where, at = bytearray(), [], 0
        if self.squeeze:
            while at < len(text):
                piece, n = self.prefix(text, at)
                if piece != b" ":
                    break
                at += n
            if at == len(text):
                return b"", np.zeros(1, np.int64)
        if self.dummy_prefix:
            out += self.space
            where += [at] * len(self.space)
        after_space = self.squeeze
        while at < len(text):
            piece, n = self.prefix(text, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                piece_out = piece.replace(b" ", self.space)
                out += piece_out
                where += [at] * len(piece_out)
                after_space = self.squeeze and piece.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(self.space):
                at = where[-len(self.space)]
                del out[-len(self.space) :]
                del where[-len(self.space) :]
        return bytes(out), np.array([*where, at], np.int64)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The identity map, without a loop over bytes: only spaces change their width."""
        out = text.replace(b" ", self.space)
        data = np.frombuffer(text, np.uint8)
        # within a character every byte points to the character's start
        starts = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
        where = np.repeat(starts, np.where(data == 32, len(self.space), 1))
        if self.dummy_prefix:
            out = self.space + out
            where = np.concatenate([np.zeros(len(self.space), np.int64), where])
        return out, np.append(where, len(text))


class Encoder:
    """One model: the library's encoder and decoder, its normaliser, and the width of each piece."""

    def __init__(self, model: str):
        import sentencepiece

        path = model_file(model)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, spec = [], {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    pieces.append((piece.get(1, b""), piece.get(3, NORMAL)))
                elif number == 3:
                    spec |= dict(_fields(value))  # a message that comes twice is merged
        self.normalise = Normaliser(spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), tuple(p for p, kind in pieces if kind == USER))
        self.width = np.array([1 if kind == BYTE else 0 if kind == CONTROL else -1 if kind == UNKNOWN else len(p) for p, kind in pieces], np.int64)
        self.decimal = [str(i) for i in range(len(pieces))]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)

    def spans(self, text: bytes, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Source byte ranges [start, end) of the pieces. Pieces of one source character (byte pieces) share its range."""
        normal, where = self.normalise(text)
        width = self.width[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
        if (width < 0).any():  # unknown characters: the library's own surface tells their width
            surface = [len(p.encode()) for p in self.library.encode(text.decode(errors="replace"), out_type=str)]
            width = np.array(surface, np.int64)
        ends = np.cumsum(width)
        if len(ends) and ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        starts = where[ends - width]
        stops = where[ends]
        inside = stops <= starts  # a byte piece ends within its character: its range is that of the whole character
        if inside.any():
            boundary = np.unique(where)
            stops = np.where(inside, boundary[np.minimum(np.searchsorted(boundary, starts, side="right"), len(boundary) - 1)], stops)
        return starts, np.maximum(stops, starts)


@lru_cache(maxsize=2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def encode(df: DataFrame, model: str = MODEL, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then ids, starts, ends (source byte offsets, one each per piece) and decoded."""
    types = [df.schema[c] for c in keep]
    out = pa.schema([("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())])

    def run(batches):
        enc = encoder(model)
        for b in slices(batches, text, 1 << 20):
            texts = [t or "" for t in b.column(text).to_pylist()]
            ids = enc.ids(texts)
            spans = [enc.spans(t.encode(), i) for t, i in zip(texts, ids, strict=True)]
            cols = [pa.array(ids, out.field(0).type), pa.array([s for s, _ in spans], out.field(1).type), pa.array([e for _, e in spans], out.field(2).type), pa.array(enc.decode(ids) if ids else [], pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *out.names])

    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    added = [StructField("ids", ArrayType(IntegerType())), StructField("starts", ArrayType(LongType())), StructField("ends", ArrayType(LongType())), StructField("decoded", StringType())]
    return df.select(*keep, text).mapInArrow(run, StructType([*types, *added]))


def encode_digests(df: DataFrame, model: str = MODEL) -> DataFrame:
    """Per document the digests of what encode() gives, taken in the same worker so that ids and spans need not travel.

    n_covered counts the source bytes inside some piece's span."""

    def run(batches):
        enc = encoder(model)
        decimal = enc.decimal
        for b in slices(batches, "text", 1 << 20):
            texts = [t or "" for t in b.column("text").to_pylist()]
            ids = enc.ids(texts)
            decoded = enc.decode(ids)
            covered = []
            for t, i in zip(texts, ids, strict=True):
                starts, ends = enc.spans(t.encode(), i)
                covered.append(int((ends - np.maximum(starts, np.concatenate([[0], np.maximum.accumulate(ends)[:-1]]))).clip(0).sum()) if i else 0)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join([decimal[x] for x in i]).encode()).hexdigest() for i in ids], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array(covered, pa.int64()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_covered"],
            )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_covered long")


def op10_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))
