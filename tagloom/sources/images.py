"""Image files: listing, header sniffing, classification of what cannot be imported."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tagloom import fixed
from tagloom.functions import file_name_of, is_blank
from tagloom.functions.containers import header_size


def has_image_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1)).isin(fixed.IMAGE_EXTENSIONS)


def scan_images(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """``path, length, modificationTime, content`` of image files, chosen by extension in any case.

    ``content`` is read only by plans that use it.
    """
    # the glob lets the reader skip other files; the column filter decides
    letters = lambda ext: "".join(f"[{c}{c.upper()}]" for c in ext)
    glob = "*.{" + ",".join(letters(e) for e in fixed.IMAGE_EXTENSIONS) + "}"
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob)
    return reader.load(paths).filter(has_image_extension(F.col("path")))


def _number(content: Column, at: int, size: int, little: bool = False) -> Column:
    """Unsigned integer of ``size`` bytes at 0-based position ``at``."""
    parts = [F.hex(F.substring(content, at + 1 + k, 1)) for k in range(size)]
    return F.conv(F.concat(*(reversed(parts) if little else parts)), 16, 10).cast("int")


def sniff_header(files: DataFrame) -> DataFrame:
    """Add ``format`` from the first bytes, ``width`` and ``height`` from the header; null for other files and where the header is cut.

    PNG, GIF and BMP carry them at fixed places; JPEG, TIFF and WebP are walked to the block that does. Nothing is decoded.
    """
    c = F.col("content")
    magic = F.hex(F.substring(c, 1, 12))
    kind = (
        F.when(magic.startswith("89504E470D0A1A0A"), "png")
        .when(magic.startswith("474946383761") | magic.startswith("474946383961"), "gif")
        .when(magic.startswith("FFD8FF"), "jpeg")
        .when(magic.startswith("424D"), "bmp")
        .when(magic.startswith("49492A00") | magic.startswith("4D4D002A"), "tiff")
        .when(magic.startswith("52494646") & magic.endswith("57454250"), "webp")
    )
    # only files whose header has to be walked travel to Python
    walked = header_size(F.when(kind.isin("jpeg", "tiff", "webp"), c))
    fixed_width = F.when(kind == "png", _number(c, 16, 4)).when(kind == "gif", _number(c, 6, 2, True)).when(kind == "bmp", _number(c, 18, 4, True))
    fixed_height = F.when(kind == "png", _number(c, 20, 4)).when(kind == "gif", _number(c, 8, 2, True)).when(kind == "bmp", F.abs(_number(c, 22, 4, True)))
    sized = files.select(*files.columns, walked.alias("__walked"))
    return sized.select(
        *files.columns, file_name_of(F.col("path")).alias("file_name"), kind.alias("format"),
        F.coalesce(fixed_width, "__walked.width").alias("width"), F.coalesce(fixed_height, "__walked.height").alias("height"),
    )


_READ = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary()), ("failure", pa.string())])


def _placed(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and place of a path or URI of any file system Arrow knows; without a scheme it is a local path."""
    path = re.sub("^file:/+", "/", path)
    return pafs.FileSystem.from_uri(path) if re.match("[A-Za-z][A-Za-z0-9+.-]+:", path) else (pafs.LocalFileSystem(), path)


def read_bytes(path: str) -> bytes:
    system, place = _placed(path)
    with system.open_input_stream(place) as file:
        return file.read()


def write_each(files: DataFrame) -> None:
    """Write every ``content`` to its ``path``, folders included: a job. Written again, a file holds the same bytes, so tasks may be repeated."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch["path"].to_pylist(), batch["content"]):
                system, place = _placed(path)
                system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(place) as file:
                    file.write(content.as_buffer())
            yield batch.select(["path"])

    files.select("path", "content").mapInArrow(rows, "path string").write.format("noop").mode("overwrite").save()


def read_each(requested: DataFrame, read: Callable[[str], bytes] = read_bytes) -> DataFrame:
    """``path, length, content, failure`` of every requested ``path``: a file that cannot be read becomes a row that says why instead of ending the job.

    ``failure`` is null for a file that was read, else ``denied``, ``missing`` or ``io``; a null or blank path is ``missing``. Repeated paths are read each time. Tasks hold one file at a time.
    ``read`` opens other stores than Arrow's file systems and tells the cases apart by Python's own errors.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch["path"].to_pylist():
                content, failure = None, None
                try:
                    if not (path or "").strip():
                        raise FileNotFoundError(path)
                    content = read(path)
                except PermissionError:
                    failure = "denied"
                except FileNotFoundError:
                    failure = "missing"
                except (OSError, ValueError):  # Arrow reports an unknown scheme as a wrong value
                    failure = "io"
                values = [path, None if content is None else len(content), content, failure]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _READ)], schema=_READ)

    return requested.select("path").mapInArrow(rows, "path string, length long, content binary, failure string")


def import_failure_kind(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Requested paths that cannot be imported, with kind and message.

    ``requested(path)``; ``found(path, format, width)`` from sniffing, null where the content is no image or its header is cut. Where ``found`` has the ``failure``
    of ``read_each``, files that could not be read are told apart.
    """
    failure = F.col("failure") if "failure" in found.columns else F.lit(None).cast("string")
    # a repeated path is judged once
    sniffed = found.groupBy(F.col("path").alias("f_path")).agg(F.min(F.struct(failure.alias("failure"), "format", "width")).alias("f")).select("f_path", "f.*")
    rows = requested.join(sniffed, F.col("path") == F.col("f_path"), "left")
    reason = (
        F.when(is_blank(F.col("path")), "blank")
        .when(F.col("f_path").isNull() | (F.col("failure") == "missing"), "missing")
        .when(~has_image_extension(F.col("path")), "extension")
        .when(F.col("failure").isin("denied", "io"), F.col("failure"))
        .when(F.col("format").isNull(), "container")
        .when(F.col("width").isNull() | (F.col("width") < 1), "corrupt")
    )
    kind = {
        "blank": "not_found", "missing": "not_found", "extension": "unsupported_format", "container": "unsupported_format", "corrupt": "corrupt_image",
        "denied": "access_denied", "io": "io_error",
    }
    pick = lambda table: F.try_element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("reason"))
    failed = rows.withColumn("reason", reason).filter("reason is not null")
    return failed.select(
        "path", F.coalesce(file_name_of(F.col("path")), F.lit("")).alias("file_name"), pick(kind).alias("kind"), pick(fixed.FAILURE_TEXTS).alias("message")
    )
