"""Signature sniffing over binary media columns (operator 7).

An Aho-Corasick automaton finds all magic bytes in one pass; at each hit a validator for that format walks its structure and
confirms the lengths it declares. The format that validates at offset 0 corrects the declared type, and every validated item at
a later offset is carved with its exact length.

store_texts() stores texts losslessly as 8-bit samples: WAV (mono PCM), BMP or PNG (rows of 64 RGB pixels), by length.
Null content has no type and no carved items; null text is empty and pads to 192 spaces. Equal inputs give equal outputs, in
repeated rows too. Texts are taken whole, however long; further columns are ignored, except those named in `keep`; an empty table
gives an empty result. The automaton finds the marks that end an item as well, so repeated magic bytes don't make a text be
searched again and again.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from textloom.llm.common import slices, table

ROW = 192


def _png(b: bytes, at: int) -> int:
    """Each validator gives the length of a well-formed item at `at`, or 0."""
    pos, seen = at + 8, False
    while pos + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, pos)
        if pos + 12 + n > len(b) or not kind.isalpha():
            return 0
        if not seen and (kind != b"IHDR" or n != 13):
            return 0
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return 0
        seen = True
        pos += 12 + n
        if kind == b"IEND":
            return pos - at
    return 0


def _riff(kind: bytes):
    def valid(b: bytes, at: int) -> int:
        if b[at + 8 : at + 12] != kind or at + 12 > len(b):
            return 0
        size = 8 + struct.unpack_from("<I", b, at + 4)[0]
        if size < 20 or at + size > len(b):
            return 0
        pos = at + 12
        while pos + 8 <= at + size:
            pos += 8 + (n := struct.unpack_from("<I", b, pos + 4)[0]) + (n & 1)
        return size if pos in (at + size, at + size + 1) else 0

    return valid


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, pixels, header, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    if zero or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or packing > 6 or width <= 0 or not height or at + size > len(b):
        return 0
    need = pixels + (width * bits + 31) // 32 * 4 * abs(height)
    return size if pixels >= 14 + header and (packing or size >= need) else 0


def _gif(b: bytes, at: int) -> int:
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or at + 13 > len(b):
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    images = 0

    def blocks(pos):
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at if images else 0
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 <= len(b):
            flags = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
            images += 1
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos, frame = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return 0
        kind = b[pos + 1]
        if kind == 0xD9:
            return pos + 2 - at if frame else 0
        if kind == 0xFF or kind == 0x01 or 0xD0 <= kind <= 0xD7:
            pos += 1 if kind == 0xFF else 2
            continue
        n = struct.unpack_from(">H", b, pos + 2)[0]
        if n < 2 or pos + 2 + n > len(b):
            return 0
        frame |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        pos += 2 + n
        if kind == 0xDA:  # entropy-coded data up to the next marker
            while True:
                pos = b.find(b"\xff", pos)
                if pos < 0 or pos + 1 >= len(b):
                    return 0
                if b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7:
                    pos += 2
                else:
                    break
    return pos + 2 - at if frame and b[pos : pos + 2] == b"\xff\xd9" else 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    try:
        d = zlib.decompressobj(31)
        rest = memoryview(b)[at:]
        used = 0
        while not d.eof and used < len(rest):  # in pieces: the content isn't kept
            step = rest[used : used + 65536]
            used += len(step)
            piece = d.decompress(step, 1 << 20)
            while d.unconsumed_tail and piece:
                piece = d.decompress(d.unconsumed_tail, 1 << 20)
        return used - len(d.unused_data) if d.eof else 0
    except zlib.error:
        return 0


class Marks:
    """Where the marks stand that end items of some formats: found by the automaton too, so that no validator searches for them."""

    def __init__(self):
        self.places: dict[bytes, list[int]] = {m: [] for m in MARKS}

    def next(self, mark: bytes, at: int) -> int:
        """The first place from `at` on, or -1."""
        places = self.places[mark]
        k = bisect.bisect_left(places, at)
        return places[k] if k < len(places) else -1


MARKS = (b"%%EOF", b"startxref", b"PK\x05\x06")


def _pdf(b: bytes, at: int, marks: Marks) -> int:
    end = marks.next(b"%%EOF", at)
    return end + 5 - at if end > 0 and 0 < marks.next(b"startxref", at) < end else 0


def _zip(b: bytes, at: int, marks: Marks) -> int:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def _flac(b: bytes, at: int) -> int:
    return len(b) - at if at + 42 <= len(b) and b[at + 4] & 127 == 0 and b[at + 5 : at + 8] == b"\0\0\x22" else 0


def _ogg(b: bytes, at: int) -> int:
    pos = at
    while b[pos : pos + 4] == b"OggS" and pos + 27 <= len(b) and b[pos + 4] == 0:
        n = b[pos + 26]
        pos += 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if pos > len(b):
            return 0
    return pos - at


#: magic bytes, where they are in an item, type, validator
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF8", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WAVE", 8, "audio/wav", _riff(b"WAVE")),
    (b"WEBP", 8, "image/webp", _riff(b"WEBP")),
    (b"AVI ", 8, "video/avi", _riff(b"AVI ")),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
]


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, magic in enumerate([*(f[0] for f in FORMATS), *MARKS]):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def sniff_bytes(content: bytes | None) -> tuple[str | None, int, list[tuple[str, int, int]]]:
    """Type and validated length of what begins at offset 0, and (type, offset, length) of what is embedded.

    Items inside a carved item are not carved again; those inside the outer item are."""
    if not content:
        return None, 0, []
    kind, length, found, done = None, 0, [], 0
    hits, marks = [], Marks()
    for end, k in automaton().iter(content.decode("latin-1")):
        if k < len(FORMATS):
            hits.append((end - len(FORMATS[k][0]) + 1 - FORMATS[k][1], k))
        else:
            mark = MARKS[k - len(FORMATS)]
            marks.places[mark].append(end - len(mark) + 1)
    for at, k in sorted(hits):
        if at < 0 or at and at < done:
            continue
        _, lead, name, valid = FORMATS[k]
        if lead and content[at : at + 4] != b"RIFF":
            continue
        if n := valid(content, at, marks) if valid in (_pdf, _zip) else valid(content, at):
            if at == 0:
                if kind is None:
                    kind, length = name, n
            else:
                found.append((name, at, n))
                done = at + n
    return kind, length, found


def payload_of(content: bytes, kind: str | None) -> bytes | None:
    """The samples of a stored item: WAV data, BMP rows from the top, or PNG rows without filters. None: not one of ours."""
    if kind == "audio/wav":
        pos = 12
        while pos + 8 <= len(content):
            name, n = struct.unpack_from("<4sI", content, pos)
            if name == b"data":
                return content[pos + 8 : pos + 8 + n]
            pos += 8 + n + (n & 1)
    elif kind == "image/bmp":
        start, _, width, height = struct.unpack_from("<IIii", content, 10)
        return content[start : start + width * 3 * abs(height)]
    elif kind == "image/png":
        pos, parts, width = 8, [], 0
        while pos + 8 <= len(content):
            n, name = struct.unpack_from(">I4s", content, pos)
            if name == b"IHDR":
                width = struct.unpack_from(">I", content, pos + 8)[0]
            elif name == b"IDAT":
                parts.append(content[pos + 8 : pos + 8 + n])
            pos += 12 + n
        raw, step = zlib.decompress(b"".join(parts)), 3 * width + 1
        import numpy as np

        return np.frombuffer(raw, np.uint8).reshape(-1, step)[:, 1:].tobytes()
    return None


def padded(text: str | None) -> bytes:
    data = (text or "").encode()
    return data + b" " * (ROW - len(data) % ROW if len(data) % ROW or not data else 0)


def to_wav(samples: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I4s4sIHHIIHH4sI", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(samples)) + samples


def to_bmp(rows: bytes) -> bytes:
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, ROW // 3, -(len(rows) // ROW), 1, 24, 0, len(rows), 2835, 2835, 0, 0) + rows


def to_png(rows: bytes) -> bytes:
    import numpy as np

    grid = np.frombuffer(rows, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(grid), 1), np.uint8), grid], axis=1).tobytes()
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, len(grid), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 1)) + chunk(b"IEND", b"")


WRITERS = (("audio/wav", to_wav), ("image/bmp", to_bmp), ("image/png", to_png))


def store_texts(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media) per row of (doc_id, text). The declared type is wrong for a third of the lengths."""

    def run(batches):
        for b in slices(batches, most=4 << 20):
            size, declared, media = [], [], []
            for text in b.column("text").to_pylist():
                data = padded(text)
                size.append(len(text.encode()) if text else 0)
                k = len(data) // ROW % 3
                name, write = WRITERS[k]
                declared.append(name if size[-1] % 3 else "application/octet-stream")
                media.append(write(data))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(declared, pa.string()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "declared", "media"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, declared string, media binary")


CARVED = "array<struct<type:string,offset:long,length:long,sha256:string>>"


def sniff(df: DataFrame, content: str = "media", declared: str = "declared", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in `keep`, then type (null where nothing validates), type_corrected, valid_bytes, carved, and the samples'
    payload_bytes, payload_sha256 and tail_crc32 where the type is one that stores samples."""
    kept = df.select(*keep).schema
    item = pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])
    names = ["type", "type_corrected", "valid_bytes", "media_bytes", "media_sha256", "carved", "payload_bytes", "payload_sha256", "tail_crc32"]
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string(), pa.list_(item), pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        for b in slices(batches, content, 8 << 20):
            rows = []
            for data, said in zip(b.column(content).to_pylist(), b.column(declared).to_pylist(), strict=True):
                kind, length, found = sniff_bytes(data)
                samples = payload_of(data, kind) if kind else None
                rows.append(
                    (
                        kind,
                        kind is not None and kind != said,
                        length,
                        None if data is None else len(data),
                        None if data is None else hashlib.sha256(data).hexdigest(),
                        [{"type": t, "offset": o, "length": n, "sha256": hashlib.sha256(data[o : o + n]).hexdigest()} for t, o, n in found],
                        None if samples is None else len(samples),
                        None if samples is None else hashlib.sha256(samples).hexdigest(),
                        None if samples is None else zlib.crc32(samples[-16:]),
                    )
                )
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, *names])

    added = StructType.fromDDL("type string, type_corrected boolean, valid_bytes long, media_bytes long, media_sha256 string, carved " + CARVED + ", payload_bytes long, payload_sha256 string, tail_crc32 long")
    schema = StructType([*kept.fields, *added.fields])
    return df.select(*keep, content, declared).mapInArrow(run, schema)


def op7_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sniff(store_texts(table(spark, sf_dir, "documents")), keep=("doc_id", "n_bytes"))
    feature = F.concat_ws(";", "type", F.when(F.col("type_corrected"), "corrected").otherwise("as declared"), F.concat_ws(",", F.transform("carved", lambda c: F.concat_ws("@", c["type"], c["offset"].cast("string")))))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
