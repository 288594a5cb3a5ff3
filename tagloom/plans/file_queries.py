"""Image file queries: files made from all suppliers, written, listed, read and judged."""

from pyspark.sql import functions as F

from tagloom import fixed
from tagloom.functions.containers import exif_orientation
from tagloom.plans import bindings as B
from tagloom.plans.registry import query
from tagloom.session import shared_dir
from tagloom.sources import images as files

FAR = bytes(60_000)  # three blocks of this lie before a header or an EXIF block
EXTENSIONS = ["png", "GIF", "bmp", "JPG", "tiff", "webp"]


def big(x, size):
    return F.unhex(F.lpad(F.hex(x), 2 * size, "0"))


def little(x, size):
    return F.concat(*(F.unhex(F.lpad(F.hex(F.shiftright(x, 8 * k) % 256), 2, "0")) for k in range(size)))


def lit(*parts):
    return F.lit(b"".join(parts))


def jpeg_far(data=FAR):
    return F.concat(*[lit(b"\xff\xe2", (len(data) + 2).to_bytes(2, "big"), data)] * 3)


def tiff_fields(*fields):
    entries = [F.concat(lit(tag.to_bytes(2, "little"), b"\x04\x00\x01\x00\x00\x00"), little(value, 4)) for tag, value in fields]
    return F.concat(lit(b"II*\x00\x08\x00\x00\x00", len(fields).to_bytes(2, "little")), *entries, lit(bytes(4)))


def one_of(which, *values):
    return F.element_at(F.array(*values), (which + 1).cast("int"))


def png_head(w, h):
    return F.concat(lit(b"\x89PNG\r\n\x1a\n", bytes([0, 0, 0, 13]), b"IHDR"), big(w, 4), big(h, 4), lit(b"\x08\x06\x00\x00\x00", bytes(4)))


def headers(k, w, h):
    return one_of(
        k % 6, png_head(w, h), F.concat(lit(b"GIF89a"), little(w, 2), little(h, 2), lit(b"\x80\x00\x00")),
        F.concat(lit(b"BM", bytes(12), b"\x28\x00\x00\x00"), little(w, 4), little(h, 4)),
        F.concat(lit(b"\xff\xd8"), jpeg_far(), lit(b"\xff\xc0\x00\x11\x08"), big(h, 2), big(w, 2), lit(b"\x03")),
        tiff_fields((0x0100, w), (0x0101, h)),
        F.concat(lit(b"RIFF\x1e\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00", bytes(4)), little(w - 1, 3), little(h - 1, 3)),
    )


@query("files_headers", """
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'txt' ELSE ['png', 'GIF', 'bmp', 'JPG', 'tiff', 'webp'][(s_suppkey // 6) % 6 + 1] END AS ext FROM supplier),
f AS (SELECT 's' || k || '.' || ext AS file_name, ['png', 'gif', 'bmp', 'jpeg', 'tiff', 'webp'][k % 6 + 1] AS format, CAST(k % 500 + 1 AS INTEGER) AS width, CAST(k % 300 + 1 AS INTEGER) AS height, k % 10 = 3 AS below
  FROM s WHERE ext <> 'txt')
SELECT file_name, format, width, height, false AS recursive FROM f WHERE NOT below UNION ALL SELECT file_name, format, width, height, true FROM f""")
def file_headers(spark, sf):
    """One file per supplier: six formats under any of the extensions, a seventh of them no images by extension, a tenth in a folder below."""
    k, root = F.col("s_suppkey"), shared_dir(spark, "pictures")
    extension = F.when(k % 7 == 0, "txt").otherwise(one_of(F.floor(k / 6) % 6, *map(F.lit, EXTENSIONS)))
    path = F.concat(F.lit(root), F.when(k % 10 == 3, "/below").otherwise(""), F.lit("/s"), k.cast("string"), F.lit("."), extension)
    files.write_each(B.table(spark, sf, "supplier").select(path.alias("path"), headers(k, k % 500 + 1, k % 300 + 1).alias("content")))
    listed = lambda deep: files.sniff_header(files.scan_images(spark, root, deep)).select("file_name", "format", "width", "height", F.lit(deep).alias("recursive"))
    return listed(False).unionByName(listed(True))


@query("files_orientation", """
SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 10 BETWEEN 1 AND 8 THEN s_suppkey % 10 ELSE 1 END AS INTEGER) AS orientation FROM supplier""")
def file_orientation(spark, sf):
    """EXIF blocks behind 180,000 bytes of other blocks, in PNG, JPEG, TIFF and WebP files; no number from 1 to 8 counts as 1."""
    k = F.col("s_suppkey")
    exif = tiff_fields((0x0100, k), (0x0112, k % 10))
    length = F.length(exif)
    text = F.concat(*[lit(len(FAR).to_bytes(4, "big"), b"tEXt", FAR, bytes(4))] * 3)
    content = one_of(
        F.floor(k / 10) % 4,
        F.concat(png_head(k, k), text, big(length, 4), lit(b"eXIf"), exif, lit(bytes(8), b"IEND", bytes(4))),
        F.concat(lit(b"\xff\xd8"), jpeg_far(), lit(b"\xff\xe1"), big(length + 8, 2), lit(b"Exif\x00\x00"), exif, lit(b"\xff\xd9")),
        exif, F.concat(lit(b"RIFF", bytes(4), b"WEBP", b"ICCP", len(FAR).to_bytes(4, "little"), FAR, b"EXIF"), little(length, 4), exif),
    )
    return B.table(spark, sf, "supplier").select("s_suppkey", exif_orientation(content).alias("orientation"))


def _guarded(path):
    """A store that keeps some files locked: whoever runs this may read all local files."""
    if "locked" in path:
        raise PermissionError(path)
    return files.read_bytes(path)


KINDS = {"blank": "not_found", "missing": "not_found", "extension": "unsupported_format", "container": "unsupported_format", "corrupt": "corrupt_image", "denied": "access_denied", "io": "io_error"}
REASONS = [None, "extension", "container", "corrupt", "missing", "denied", "io", "blank"]


@query("files_failure_kinds", f"""
WITH s AS (SELECT s_suppkey AS k, {[r or '' for r in REASONS]}[s_suppkey % 8 + 1] AS reason FROM supplier)
SELECT CASE reason WHEN 'blank' THEN '  ' WHEN 'extension' THEN 's' || k || '.txt' WHEN 'denied' THEN 'locked' || k || '.png' ELSE 's' || k || '.png' END AS file_name,
       CASE reason {' '.join(f"WHEN '{r}' THEN '{kind}'" for r, kind in KINDS.items())} END AS kind,
       CASE reason {' '.join(f"WHEN '{r}' THEN '{text}'" for r, text in fixed.FAILURE_TEXTS.items())} END AS message FROM s WHERE reason <> ''""")
def file_failures(spark, sf):
    """One requested file per supplier: an eighth good, the others each with its own fault; a folder under a file's name cannot be read."""
    k, root = F.col("s_suppkey"), shared_dir(spark, "requested")
    kind = k % 8
    name = F.concat(F.when(kind == 5, "locked").otherwise("s"), k.cast("string"), F.when(kind == 1, ".txt").otherwise(".png"))
    asked = B.table(spark, sf, "supplier").select(kind.alias("kind"), F.when(kind == 7, "  ").otherwise(F.concat(F.lit(root + "/"), name)).alias("path"), k.alias("k"))
    good = png_head(F.col("k") + 1, F.col("k") + 1)
    content = F.when(F.col("kind") == 2, lit(b"no image")).when(F.col("kind") == 3, F.substring(good, 1, 12)).otherwise(good)
    place = F.when(F.col("kind") == 6, F.concat("path", F.lit("/inner.png"))).otherwise(F.col("path"))
    files.write_each(asked.filter("kind not in (4, 7)").select(place.alias("path"), content.alias("content")))
    found = files.sniff_header(files.read_each(asked, _guarded))
    return files.import_failure_kind(asked.select("path"), found).select("file_name", "kind", "message")
