"""Media columns: store bytes as images or sound, find media by their signatures and check them.

An Aho-Corasick automaton locates all magic bytes of a value in one pass;
validators then confirm the structure and length of each format, so accidental
signatures don't count.  A value's type is what starts at its first byte and
fills it, whatever type was declared; media that lie further in are carved out.

Scale: one scan, no shuffle; a row at a time is held besides its Arrow batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a row of a stored image.
WIDTH = 576
#: What precedes a medium that is stored in an envelope.
ENVELOPE = b"Content-Type: application/octet-stream\r\n\r\n"
_PNG = b"\x89PNG\r\n\x1a\n"


def encode_png(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit grey samples, ``width`` a row, as a PNG image; the payload fills whole rows."""
    if not payload or len(payload) % width:
        raise ValueError(f"the payload's length must be a positive multiple of {width}")
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)
    parts = [_PNG]
    for kind, data in ((b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(rows.tobytes(), 1)), (b"IEND", b"")):
        parts += [struct.pack(">I", len(data)), kind, data, struct.pack(">I", zlib.crc32(kind + data))]
    return b"".join(parts)


def encode_bmp(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit samples, ``width`` (a multiple of four) a row, as a BMP image with a grey palette, first row on top."""
    if not payload or len(payload) % width or width % 4:
        raise ValueError(f"the payload's length must be a positive multiple of {width}, and that one of 4")
    begin = 14 + 40 + 1024
    head = struct.pack("<2sIIIIiiHHIIiiII", b"BM", begin + len(payload), 0, begin, 40, width, -(len(payload) // width), 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return head + bytes(c for k in range(256) for c in (k, k, k, 0)) + payload


def encode_wav(payload: bytes, width: int = WIDTH) -> bytes:
    """8-bit samples as mono PCM sound."""
    if not payload or len(payload) % width or len(payload) % 2:
        raise ValueError(f"the payload's length must be a positive even multiple of {width}")
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(form) + 8 + len(payload), b"WAVE") + form + struct.pack("<4sI", b"data", len(payload)) + payload


def _decode_png(image: bytes) -> tuple[np.ndarray, str]:
    at, data, shape = 8, [], (0, 0)
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        if kind == b"IHDR":
            width, height, bits, color, _, _, lace = struct.unpack_from(">IIBBBBB", image, at + 8)
            if (bits, color, lace) != (8, 0, 0):
                raise ValueError("not an 8-bit grey image")
            shape = (height, width)
        elif kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:], f"image/png {shape[1]}x{shape[0]} grey8"


def _decode_bmp(image: bytes) -> tuple[np.ndarray, str]:
    begin, _, width, height, planes, bits, packing = struct.unpack_from("<IIiiHHI", image, 10)
    if (planes, bits, packing) != (1, 8, 0) or height >= 0 or width <= 0 or width % 4:
        raise ValueError("not an 8-bit image with its first row on top")
    return np.frombuffer(image, np.uint8, -height * width, begin), f"image/bmp {width}x{-height} grey8"


def _decode_wav(sound: bytes) -> tuple[np.ndarray, str]:
    at, kind = 12, None
    while at + 8 <= len(sound):
        name, size = struct.unpack_from("<4sI", sound, at)
        if name == b"fmt ":
            kind = struct.unpack_from("<HHIIHH", sound, at + 8)
        elif name == b"data":
            if not kind or (kind[0], kind[1], kind[5]) != (1, 1, 8):
                raise ValueError("not 8-bit mono sound")
            return np.frombuffer(sound, np.uint8, size, at + 8), f"audio/wav {kind[2]} Hz mono8"
        at += 8 + size + (size & 1)
    raise ValueError("no samples")


def decode_samples(medium: bytes) -> tuple[np.ndarray, str] | None:
    """The 8-bit samples of a medium that ``encode_png``, ``encode_bmp`` or ``encode_wav`` can make, and what it is; None for any other."""
    read = _decode_png if medium.startswith(_PNG) else _decode_bmp if medium.startswith(b"BM") else _decode_wav if medium.startswith(b"RIFF") else None
    try:
        return read(medium) if read else None
    except (ValueError, struct.error, zlib.error):
        return None


def _png(b: bytes, at: int) -> int:
    end = at + 8
    first = True
    while end + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, end)
        stop = end + 12 + size
        if stop > len(b) or first and kind != b"IHDR" or struct.unpack_from(">I", b, stop - 4)[0] != zlib.crc32(b[end + 4 : stop - 4]):
            return 0
        end, first = stop, False
        if kind == b"IEND":
            return end - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if b[at + 3 : at + 6] not in (b"87a", b"89a") or at + 13 > len(b):
        return 0
    flags = b[at + 10]
    end = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    while end < len(b):
        if b[end] == 0x3B:
            return end + 1 - at
        if b[end] == 0x21:
            end += 2
        elif b[end] == 0x2C and end + 10 < len(b):
            flags = b[end + 9]
            end += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return 0
        while end < len(b) and b[end]:
            end += b[end] + 1
        end += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    end = at + 2
    while end + 4 <= len(b) and b[end] == 0xFF:
        mark = b[end + 1]
        size = struct.unpack_from(">H", b, end + 2)[0]
        if mark in (0x00, 0xD8) or size < 2:
            return 0
        end += 2 + size
        if mark == 0xDA:
            while (end := b.find(b"\xff", end)) >= 0 and end + 1 < len(b):
                if b[end + 1] == 0xD9:
                    return end + 2 - at
                if b[end + 1] != 0 and not 0xD0 <= b[end + 1] <= 0xD7:
                    break
                end += 2
            else:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if at + 26 > len(b):
        return 0
    size, _, begin, head = struct.unpack_from("<IIII", b, at + 2)
    planes = struct.unpack_from("<H", b, at + (22 if head == 12 else 26))[0] if at + 28 <= len(b) else 0
    return size if planes == 1 and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= begin <= size <= len(b) - at else 0


def _riff(b: bytes, at: int) -> int:
    if at + 12 > len(b) or b[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP"):
        return 0
    size = struct.unpack_from("<I", b, at + 4)[0] + 8
    end = at + 12
    while end < at + size:
        if end + 8 > len(b):
            return 0
        part = struct.unpack_from("<I", b, end + 4)[0]
        end += 8 + part + (part & 1)
    return size if end == at + size <= len(b) else 0


def _gzip(b: bytes, at: int) -> int:
    if at + 18 > len(b) or b[at + 3] & 0xE0:
        return 0
    unpack, end = zlib.decompressobj(31), at
    try:
        while end < len(b) and not unpack.eof:
            unpack.decompress(b[end : end + 65536], 1 << 20)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, 1 << 20)
            end += 65536
    except zlib.error:
        return 0
    return min(end, len(b)) - len(unpack.unused_data) - at if unpack.eof else 0


def _ogg(b: bytes, at: int) -> int:
    end, last = at, False
    while end + 27 <= len(b) and b.startswith(b"OggS\0", end) and not last:
        last = bool(b[end + 5] & 4)
        table = b[end + 27 : end + 27 + b[end + 26]]
        end += 27 + len(table) + sum(table)
    return end - at if last and end <= len(b) else 0


#: Magic bytes and the type that each announces.
MAGIC = {
    _PNG: "image/png",
    b"GIF8": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"BM": "image/bmp",
    b"RIFF": "riff",
    b"\x1f\x8b\x08": "application/gzip",
    b"OggS\0": "audio/ogg",
}
_RIFF_TYPES = {b"WAVE": "audio/wav", b"AVI ": "video/x-msvideo", b"WEBP": "image/webp"}
VALIDATORS: dict[str, Callable[[bytes, int], int]] = {
    "image/png": _png,
    "image/gif": _gif,
    "image/jpeg": _jpeg,
    "image/bmp": _bmp,
    "riff": _riff,
    "application/gzip": _gzip,
    "audio/ogg": _ogg,
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


_AUTOMATON: list[ahocorasick.Automaton] = []


def find_media(value: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of all media in a value whose structure holds, by start; those inside others too.

    The contents of media that lie in one another are the caller's to cut, once.
    """
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    found = []
    for last, (kind, size) in _AUTOMATON[0].iter(value.decode("latin-1")):
        start = last - size + 1
        if length := VALIDATORS[kind](value, start):
            found.append((_RIFF_TYPES[value[start + 8 : start + 12]] if kind == "riff" else kind, start, length))
    return sorted(found, key=lambda m: (m[1], -m[2]))


def sniff_media(rows: DataFrame, content_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """All columns of ``rows``, and ``sniffed_type``, ``type_ok`` and ``carved`` (array of type, start, length, content).

    sniffed_type is the type of the medium that fills the value from its first to
    its last byte, else application/octet-stream (null content: null).  type_ok
    tells if the declared type (null counts as none) is that; without
    ``declared_col`` it is null.  carved has all other media in the value, by
    start; one that lies in another carved one has a null content, as its bytes
    are there already.  Empty values hold none.  Input columns of those names are
    replaced; rows may repeat; an empty table gives an empty one.
    """
    rows = rows.drop("sniffed_type", "type_ok", "carved")
    names = rows.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    part = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("content", pa.binary())]))

    def sniff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                types, oks, carved = [], [], []
                for value, declared in zip(batch["__c"], batch["__d"].to_pylist(), strict=True):
                    value = value.as_py()
                    found = find_media(value) if value is not None else []
                    own = next((m for m in found if m[1] == 0 and m[2] == len(value)), None)
                    types.append(None if value is None else own[0] if own else "application/octet-stream")
                    oks.append(None if declared_col is None else types[-1] == declared)
                    parts, reach = [], 0
                    for k, a, n in found:
                        if (k, a, n) != own:
                            parts.append({"type": k, "start": a, "length": n, "content": value[a : a + n] if a >= reach else None})
                            reach = max(reach, a + n)
                    carved.append(parts)
                columns = [batch.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(types, pa.string()), pa.array(oks, pa.bool_()), pa.array(carved, part)], [*names, "sniffed_type", "type_ok", "carved"])

    declared = F.col(f"`{declared_col}`").cast("string") if declared_col else F.lit(None).cast("string")
    frame = rows.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{content_col}`").cast("binary").alias("__c"), declared.alias("__d"))
    return frame.mapInArrow(sniff, ", ".join([*kinds, "sniffed_type string, type_ok boolean, carved array<struct<type:string,start:long,length:long,content:binary>>"]))


_ENCODERS = (encode_png, encode_bmp, encode_wav)


def store_texts(docs: DataFrame, text_col: str = "text", width: int = WIDTH, mixed: bool = False) -> DataFrame:
    """All columns of ``docs``, and ``media`` and ``declared_type``: the text's UTF-8 bytes (null: none), filled up with bytes 255 to whole rows, stored as 8-bit samples.

    The form is a PNG image; with ``mixed``, the payload's CRC-32 chooses among
    PNG, BMP and WAV, and puts one in four into an envelope.  The declared type is
    image/png for all, as a careless source would have it.  Equal texts are stored
    alike.  Input columns of those names are replaced; rows may repeat; an empty
    table gives an empty one.
    """
    docs = docs.drop("media", "declared_type")
    names = docs.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]

    def stored(text: bytes) -> bytes:
        payload = text + b"\xff" * (-len(text) % width or (0 if text else width))
        if not mixed:
            return encode_png(payload, width)
        place, form = divmod(zlib.crc32(payload), len(_ENCODERS))
        medium = _ENCODERS[form](payload, width)
        return ENVELOPE + medium if place % 4 == 0 else medium

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 256):
                batch = whole.slice(s, 256)
                made = [stored(t.as_py() or b"") for t in batch["__t"]]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(made, pa.binary()), pa.array(["image/png"] * len(made))], [*names, "media", "declared_type"])

    frame = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").cast("binary").alias("__t"))
    return frame.mapInArrow(store, ", ".join([*kinds, "media binary, declared_type string"]))


def media_features(rows: DataFrame, content_col: str = "media") -> DataFrame:
    """Columns of ``rows`` but the content, and what reading a medium back shows: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The content is a medium such as ``store_texts`` makes; of others only
    media_bytes and media_sha256 are known, the rest is null.  Null content gives
    nulls.  Input columns of those names are replaced; rows may repeat; an empty
    table gives an empty one.
    """
    made = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    names = [c for c in rows.columns if c != content_col and c not in made]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value in batch["__c"]:
                medium = value.as_py()
                if medium is None:
                    out.append((None,) * 6)
                    continue
                stored = len(medium), hashlib.sha256(medium).hexdigest()
                found = decode_samples(medium)
                if found is None:
                    out.append((None, None, None, *stored, None))
                    continue
                samples, what = found
                payload = samples.tobytes()
                counts = np.bincount(samples.ravel(), minlength=256)
                p = counts[counts > 0] / samples.size
                mean = int((counts * np.arange(256)).sum()) / samples.size
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, f"{what} mean={mean:.4f} entropy={-(p * np.log2(p)).sum() + 0:.4f}"))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), *columns], [*names, *made])

    frame = rows.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{content_col}`").cast("binary").alias("__c"))
    ddl = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return frame.mapInArrow(read, ", ".join([*kinds, ddl]))
