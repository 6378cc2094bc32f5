"""Media columns: payloads kept as images in archives, read by a data source.

Each payload is stored as a grey PNG of 8-bit samples, ``ROW`` samples to a
line, and the images as members of uncompressed ZIP archives in one directory.
``MediaArchives`` is a Spark data source over such a directory. Its plan lists
the archives and deals their bytes into ranges, so a large archive is shared
by several tasks and small ones share a task; a range owns the members whose
headers start in it. Member contents stream out in Arrow batches of bounded
size. A member that fails is read again from its own offset, up to
``retries`` times, with the file opened anew; one that keeps failing comes
back as a row with null content and an error, and the others are not touched.

Defined cases: a null or empty payload is one line of blanks; repeated rows
are members of their own; a null id is an empty name; an empty table gives no
archives and no rows; the input's other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, materialise, work_path, write_file

ROW = 192
BLANK = b" "
LEVEL = 6
ARCHIVE_BYTES = 32_000_000
PARTITION_BYTES = 16_000_000
BATCH_BYTES = 4_000_000
SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ---------------------------------------------------------------- the image


def padded(payload: bytes, row: int = ROW) -> bytes:
    size = max(row, -(-len(payload) // row) * row)
    return payload.ljust(size, BLANK)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(samples: bytes, n_bytes: int, row: int = ROW) -> bytes:
    """A grey 8-bit image of ``samples``; ``n_bytes`` is kept as a text field."""
    height = len(samples) // row
    lines = np.zeros((height, row + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, row)
    head = struct.pack(">IIBBBBB", row, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> tuple[bytes, int]:
    """Samples and ``n_bytes`` of an image that ``to_png`` made."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, width, height, n_bytes = 8, [], 0, 0, -1
    while at < len(data):
        (size,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4: at + 8], data[at + 8: at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            width, height, depth, color = struct.unpack(">IIBB", body[:10])
            if (depth, color) != (8, 0):
                raise ValueError("not an 8-bit grey image")
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n_bytes = int(body[6:])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line is filtered")
    return lines[:, 1:].tobytes(), n_bytes


def feature(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and the mean step between neighbours."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    level = np.arange(256)
    mean = float((counts * level).sum() / len(x))
    spread = float(np.sqrt((counts * (level - mean) ** 2).sum() / len(x)))
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.3f};deviation={spread:.3f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.3f}"


# ---------------------------------------------------------------- the archives


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Store every text as an image; returns the archive directory."""
    root = work_path(docs.sparkSession, "media")
    slim = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .packing import text_bytes

        part, made = TaskContext.get().partitionId(), 0
        held = archive = None

        def put():
            nonlocal held, made
            archive.close()
            write_file(f"{root}/part-{part:05d}-{made:04d}.zip", held.getvalue())
            held, made = None, made + 1

        n = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                if held is None:
                    held = io.BytesIO()
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
                archive.writestr(zipfile.ZipInfo(f"{'' if i is None else i}/{n}.png"), to_png(padded(text), len(text)))
                n += 1
                if held.tell() >= archive_bytes:
                    put()
        if held is not None:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], ["n"])

    materialise(slim.mapInArrow(run, "n long"), "media-count")
    return root


@dataclass
class ByteRanges(InputPartition):
    """Byte ranges ``(archive, start, end)`` for one task."""

    ranges: list

    def __init__(self, ranges):
        self.ranges = ranges


def plan_ranges(sizes: list[tuple[str, int]], target: int) -> list[list[tuple[str, int, int]]]:
    """Ranges of at most ``target`` bytes, several small ones to a task."""
    tasks, held, room = [], [], target
    for path, size in sizes:
        at = 0
        while at < size:
            take = min(target, size - at)
            if take > room:
                tasks.append(held)
                held, room = [], target
            held.append((path, at, at + take))
            at, room = at + take, room - take
    return [*tasks, held] if held else tasks


def read_member(fsys, path: str, offset: int) -> tuple[str, bytes]:
    """Name and content of the member whose local header is at ``offset``; checks its CRC."""
    with fsys.open_input_file(path) as src:
        src.seek(offset)
        head = src.read(30)
        if len(head) < 30 or head[:4] != b"PK\x03\x04":
            raise ValueError("no member header")
        flags, method, crc, size, name, extra = struct.unpack("<6xHH4xI4xIHH", head)
        if method or flags & 8:
            raise ValueError("the member is compressed or has no length in its header")
        label = src.read(name).decode()
        src.read(extra)
        content = src.read(size)
    if len(content) != size or zlib.crc32(content) != crc:
        raise ValueError("the member is damaged")
    return label, content


def members(fsys, path: str) -> list[tuple[int, str, int]]:
    """``(offset, name, size)`` of an archive's members, from its directory."""
    with fsys.open_input_file(path) as src, zipfile.ZipFile(src) as archive:
        return sorted((x.header_offset, x.filename, x.file_size) for x in archive.infolist())


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.target = int(options.get("partitionBytes", PARTITION_BYTES))
        self.retries = int(options.get("retries", 3))
        self.batch = int(options.get("batchBytes", BATCH_BYTES))

    def partitions(self):
        from pyarrow import fs

        fsys, path = filesystem(self.path)
        found = fsys.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        sizes = sorted((x.path, x.size) for x in found if x.is_file and x.path.endswith(".zip"))
        return [ByteRanges(r) for r in plan_ranges(sizes, self.target)] or [ByteRanges([])]

    def read(self, partition):
        import pyarrow as pa

        fsys, _ = filesystem(self.path)
        rows: list[tuple] = []
        size = 0
        names = ["archive", "offset", "member", "content", "error"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        def tried(fn, *args):
            """What ``fn`` gives and no error, or the last error of all tries."""
            for _ in range(self.retries + 1):
                try:
                    return fn(fsys, *args), None
                except (OSError, ValueError, struct.error, zipfile.BadZipFile) as e:
                    error = f"{type(e).__name__}: {e}"
            return None, error

        for path, start, end in partition.ranges:
            found, error = tried(members, path)
            if error:
                rows.append((path, start, None, None, error))
            for offset, name, _ in found or ():
                if not start <= offset < end:
                    continue
                got, error = tried(read_member, path, offset)
                content = got and got[1]
                rows.append((path, offset, name, content, error))
                size += len(content or b"")
                if size >= self.batch:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(directory)``."""

    @classmethod
    def name(cls):
        return "media_archives"

    def schema(self):
        return "archive string, offset long, member string, content binary, error string"

    def reader(self, schema):
        return MediaReader(self.options)


def read_archives(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows ``archive, offset, member, content, error`` of a directory's members."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def decode(found: DataFrame) -> DataFrame:
    """``member, error, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature`` of each member; a damaged image gives its error."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = "member string, error string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for name, content, error in zip(*(batch.column(k).to_pylist() for k in range(3))):
                row = {"member": name, "error": error}
                if content is not None:
                    try:
                        samples, n = from_png(content)
                        row |= {
                            "n_bytes": n, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]),
                            "media_bytes": len(content), "media_sha256": hashlib.sha256(content).hexdigest(), "feature": feature(samples),
                        }
                    except (ValueError, zlib.error) as e:
                        row["error"] = str(e)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return found.select("member", "content", "error").mapInArrow(run, schema)
