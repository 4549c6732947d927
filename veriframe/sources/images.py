"""Image headers: width, height and channels of PNG, JPEG, BMP, WebP and TIFF bytes, without an imaging library."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import IMAGE_METADATA

EXTENSIONS = tuple("." + x for x in "bmp jpeg jpg png tif tiff webp".split())
_PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
Size = tuple[int, int, int]


def _png(b: bytes) -> Size | None:
    at, size, data = 8, None, b""
    while at + 12 <= len(b):
        n, kind = struct.unpack(">I4s", b[at : at + 8])
        body = b[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(b) or zlib.crc32(kind + body) != struct.unpack(">I", b[at + 8 + n : at + 12 + n])[0]:
            return None
        if kind == b"IHDR":
            w, h, _, color = struct.unpack(">IIBB", body[:10])
            size = (w, h, _PNG_CHANNELS.get(color, 0))
        elif kind == b"IDAT":
            data += body
        elif kind == b"IEND":
            break
        at += 12 + n
    try:
        zlib.decompress(data)
    except zlib.error:
        return None
    return size


def _jpeg(b: bytes) -> Size | None:
    at = 2
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return None
        kind = b[at + 1]
        if kind in (0xFF, 0x01) or 0xD0 <= kind <= 0xD8:
            at += 1 + (kind != 0xFF)
            continue
        (n,) = struct.unpack(">H", b[at + 2 : at + 4])
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(b):
                return None
            h, w, c = struct.unpack(">HHB", b[at + 5 : at + 10])
            return w, h, c
        at += 2 + n
    return None


def _bmp(b: bytes) -> Size | None:
    if len(b) < 30:
        return None
    w, h, _, bits = struct.unpack("<iiHH", b[18:30])
    return w, abs(h), 1 if bits <= 8 else 3 if bits <= 24 else 4


def _webp(b: bytes) -> Size | None:
    kind = b[12:16]
    if kind == b"VP8 " and len(b) >= 30:
        w, h = struct.unpack("<HH", b[26:30])
        return w & 0x3FFF, h & 0x3FFF, 3
    if kind == b"VP8L" and len(b) >= 25:
        (x,) = struct.unpack("<I", b[21:25])
        return (x & 0x3FFF) + 1, (x >> 14 & 0x3FFF) + 1, 4 if x >> 28 & 1 else 3
    if kind == b"VP8X" and len(b) >= 30:
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1, 4 if b[20] & 16 else 3
    return None


def _tiff(b: bytes) -> Size | None:
    end = "<" if b[:2] == b"II" else ">"
    (at,) = struct.unpack(end + "I", b[4:8])
    if at + 2 > len(b):
        return None
    (n,) = struct.unpack(end + "H", b[at : at + 2])
    tags = {277: 1}
    for k in range(n):
        e = b[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(e) < 12:
            return None
        tag, kind = struct.unpack(end + "HH", e[:4])
        tags[tag] = struct.unpack(end + ("H" if kind == 3 else "I"), e[8 : 10 if kind == 3 else 12])[0]
    return (tags[256], tags[257], tags[277]) if {256, 257} <= tags.keys() else None


def image_size(b: bytes | None) -> Size | None:
    """(width, height, channels), or None for bytes that are no whole image header."""
    if not b:
        return None
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            size = _png(b)
        elif b[:3] == b"\xff\xd8\xff":
            size = _jpeg(b)
        elif b[:2] == b"BM":
            size = _bmp(b)
        elif b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            size = _webp(b)
        elif b[:4] in (b"II*\x00", b"MM\x00*"):
            size = _tiff(b)
        else:
            return None
    except (struct.error, IndexError):
        return None
    return size if size and min(size) >= 1 else None


@F.pandas_udf(IMAGE_METADATA)
def _sizes(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(b) or (None, None, None) for b in content], columns=["width", "height", "channels"]).astype("Int32")


def image_metadata(content: Column) -> Column:
    """Struct of width, height, channels; its fields are null where the bytes can't be read."""
    return _sizes(content)
