"""What image containers say about themselves: size and orientation, from their headers alone.

Each container is walked from block to block by the lengths it states, to its end, so it does not matter how far behind other blocks a header lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Fixed values of the formats: magic bytes, start-of-frame markers of JPEG (all C0 to CF but C4, C8, CC), TIFF tags and field widths.
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
FRAME_MARKERS = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
JPEG_ENDS = frozenset({0xD9, 0xDA})
BARE_MARKERS = frozenset(range(0xD0, 0xD9)) | {0x01}
TAG_WIDTH, TAG_HEIGHT, TAG_ORIENTATION = 0x0100, 0x0101, 0x0112
EXIF_MARK = b"Exif\x00\x00"
FIELD_BYTES = {1: 1, 3: 2, 4: 4}

Block = tuple[object, int, int]  # name, start of the data, its length


def png_chunks(raw: bytes) -> Iterator[Block]:
    at = len(PNG_MAGIC)
    while at + 8 <= len(raw):
        length = int.from_bytes(raw[at : at + 4], "big")
        yield raw[at + 4 : at + 8], at + 8, length
        at += 12 + length


def webp_chunks(raw: bytes) -> Iterator[Block]:
    at = 12
    while at + 8 <= len(raw):
        length = int.from_bytes(raw[at + 4 : at + 8], "little")
        yield raw[at : at + 4], at + 8, length
        at += 8 + length + length % 2


def jpeg_segments(raw: bytes) -> Iterator[Block]:
    """Segments up to the first scan or the end of the image, which comes as a segment without data."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        if marker == 0xFF:  # fill byte
            at += 1
        elif marker in BARE_MARKERS:
            at += 2
        elif marker in JPEG_ENDS:
            yield marker, at, 0
            return
        else:
            length = int.from_bytes(raw[at + 2 : at + 4], "big")
            if length < 2:
                return
            yield marker, at + 4, length - 2
            at += 2 + length


def tiff_fields(raw: bytes, base: int = 0) -> dict[int, int]:
    """First values of the first directory's whole-number fields; ``base`` is where the TIFF header starts."""
    order = {b"II": "little", b"MM": "big"}.get(raw[base : base + 2])
    found: dict[int, int] = {}
    if order is None:
        return found
    number = lambda at, size: int.from_bytes(raw[at : at + size], order)
    first = base + number(base + 4, 4)
    for entry in range(number(first, 2)):
        at = first + 2 + 12 * entry
        if at + 12 > len(raw):
            break
        size = FIELD_BYTES.get(number(at + 2, 2))
        if size:
            found.setdefault(number(at, 2), number(at + 8, size))
    return found


def _is_webp(raw: bytes) -> bool:
    return raw[:4] == b"RIFF" and raw[8:12] == b"WEBP"


def _webp_size(raw: bytes) -> tuple[int, int] | None:
    for name, at, _ in webp_chunks(raw):
        little = lambda start, size: int.from_bytes(raw[start : start + size], "little")
        if name == b"VP8X" and at + 10 <= len(raw):
            return little(at + 4, 3) + 1, little(at + 7, 3) + 1
        if name == b"VP8L" and at + 5 <= len(raw) and raw[at] == 0x2F:
            bits = little(at + 1, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if name == b"VP8 " and at + 10 <= len(raw) and raw[at + 3 : at + 6] == b"\x9d\x01\x2a":
            return little(at + 6, 2) & 0x3FFF, little(at + 8, 2) & 0x3FFF
    return None


def size_of(raw: bytes | None) -> tuple[int, int] | None:
    """Width and height of a JPEG, TIFF or WebP file; None where the header does not get that far."""
    raw = raw or b""
    if raw[:2] == b"\xff\xd8":
        for marker, at, length in jpeg_segments(raw):
            if marker in FRAME_MARKERS and length >= 5 and at + 5 <= len(raw):
                return int.from_bytes(raw[at + 3 : at + 5], "big"), int.from_bytes(raw[at + 1 : at + 3], "big")
    elif raw[:4] in (b"II*\x00", b"MM\x00*"):
        fields = tiff_fields(raw)
        if TAG_WIDTH in fields and TAG_HEIGHT in fields:
            return fields[TAG_WIDTH], fields[TAG_HEIGHT]
    elif _is_webp(raw):
        return _webp_size(raw)
    return None


def _exif_start(raw: bytes) -> int | None:
    if raw[:2] in (b"II", b"MM"):
        return 0
    if raw[:2] == b"\xff\xd8":
        blocks, mark = list(jpeg_segments(raw)), EXIF_MARK
        starts = [at + len(mark) for marker, at, _ in blocks if marker == 0xE1 and raw.startswith(mark, at)]
        whole = any(marker in JPEG_ENDS for marker, _, _ in blocks)
    elif raw[:4] == PNG_MAGIC[:4]:
        blocks, mark = list(png_chunks(raw)), b"eXIf"
        starts, whole = [at for name, at, _ in blocks if name == mark], any(name == b"IEND" for name, _, _ in blocks)
    elif _is_webp(raw):
        starts = [at + (len(EXIF_MARK) if raw.startswith(EXIF_MARK, at) else 0) for name, at, _ in webp_chunks(raw) if name == b"EXIF"]
        return starts[0] if starts else None
    else:
        return None
    if starts or whole:
        return starts[0] if starts else None
    # the stated lengths lead nowhere: look for the mark itself
    at = raw.find(mark)
    return None if at < 0 else at + len(mark)


def orientation_of(raw: bytes | None) -> int:
    """EXIF orientation of a JPEG, PNG, WebP or TIFF file, 1 where there is none or it is no number from 1 to 8.

    A JPEG or PNG file whose blocks do not lead to its end is searched for the mark of an EXIF block instead.
    """
    raw = raw or b""
    base = _exif_start(raw)
    value = 1 if base is None else tiff_fields(raw, base).get(TAG_ORIENTATION, 1)
    return value if 1 <= value <= 8 else 1


def exif_orientation(content: Column | str) -> Column:
    """Orientation tag of image files; 1 where there is none."""
    @F.arrow_udf("int")
    def read(files: pa.Array) -> pa.Array:
        return pa.array([orientation_of(raw.as_py()) for raw in files], pa.int32())

    return read(content)


def header_size(content: Column | str) -> Column:
    """``struct<width, height>`` from JPEG, TIFF and WebP headers, null fields where they hold none."""
    shape = pa.struct([("width", pa.int32()), ("height", pa.int32())])

    @F.arrow_udf("struct<width:int,height:int>")
    def read(files: pa.Array) -> pa.Array:
        sizes = (size_of(raw.as_py()) or (None, None) for raw in files)
        return pa.array([{"width": _int(w), "height": _int(h)} for w, h in sizes], shape)

    return read(content)


def _int(n: int | None) -> int | None:
    return n if n is not None and n < 1 << 31 else None
