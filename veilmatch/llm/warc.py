"""ARC archives converted to WARC, with duplicates written as revisits.

An ARC file opens with a ``filedesc`` record that names its version. Version 1
headers have five fields and version 2 headers ten; the last is the block's
declared length, and fields are taken from the right, as old URLs hold spaces.
Each record may be a gzip member of its own or stand plainly in the file.

The conversion runs in three steps. Every ARC file is scanned for its records'
digests; the digests are grouped to choose one response for each payload; then
every ARC file is rewritten as a WARC file with synthesised record ids, dates,
types and digests. Only digests are shuffled, never payloads. Files are
written aside and published by a rename, so a task may run again.

Defined cases: a null page is an empty payload; payloads below
``min_revisit_bytes`` are always responses; among equal payloads the smallest
id that is not null is the response (of repeated ids, the first record by
archive and offset); equal rows get record ids of their own;
a null url is written as ``urn:missing``; empty tables give no archives.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone
from typing import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, materialise, work_path, write_file

MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 32_000_000
CHUNK = 32_768
GZIP_LEVEL = 1

#: The header definitions of both ARC versions and the revisit profile.
DEFINITIONS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def inflated(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """``(offset, content)`` of each gzip member of a stream."""
    offset, left = 0, b""
    while True:
        if not left:
            left = next(chunks, b"")
            if not left:
                return
        engine, out, used = zlib.decompressobj(31), [], 0
        while not engine.eof:
            if not left:
                left = next(chunks, b"")
                if not left:
                    raise ValueError(f"gzip member at {offset} is cut short")
            out.append(engine.decompress(left))
            used += len(left) - len(engine.unused_data)
            left = engine.unused_data
        yield offset, b"".join(out)
        offset += used


def chunks_of(uri: str) -> Iterator[bytes]:
    fsys, path = filesystem(uri)
    with fsys.open_input_stream(path, compression=None) as src:
        while data := src.read(CHUNK):
            yield data


# ---------------------------------------------------------------- ARC


def arc_record(version: int, url: str, ip: str, date: str, kind: str, block: bytes, name: str, offset: int) -> bytes:
    fields = [url, ip, date, kind]
    if version == 2:
        fields += ["200", hashlib.md5(block).hexdigest(), "-", str(offset), name]
    return " ".join([*fields, str(len(block))]).encode() + b"\n" + block + b"\n"


def arc_opening(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 converter\n{DEFINITIONS[version]}\n\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n".encode() + block


def parse_arc_header(line: bytes, version: int) -> dict:
    parts = line.decode("utf-8", "replace").rsplit(" ", {1: 4, 2: 9}[version])
    if len(parts) != {1: 5, 2: 10}[version]:
        raise ValueError(f"no version {version} header: {line[:200]!r}")
    out = {"url": parts[0], "ip": parts[1], "date": parts[2], "kind": parts[3], "length": int(parts[-1])}
    if version == 2:
        out |= {"status": parts[4], "checksum": parts[5], "location": parts[6]}
    return out


def _plain(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """``(offset, header line, block)`` of an uncompressed file, by declared lengths."""
    held, offset, need = bytearray(), 0, 0
    for data in chunks:
        held += data
        while len(held) >= need:
            skip = 0
            while held[skip: skip + 1] == b"\n":
                skip += 1
            end = held.find(b"\n", skip)
            if end < 0:
                break
            need = end + 1 + int(held[skip:end].rsplit(b" ", 1)[-1])
            if len(held) < need:
                break
            yield offset + skip, bytes(held[skip:end]), bytes(held[end + 1: need])
            del held[:need]
            offset, need = offset + need, 0
    if held.strip(b"\n"):
        raise ValueError(f"record at {offset} is cut short")


def read_arc(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict, bytes]]:
    """``(offset, header, block)`` of each record after the opening one."""
    first = next(chunks, b"")
    if not first:
        return

    def again():
        yield first
        yield from chunks

    if first[:2] == b"\x1f\x8b":
        raw = ((at, *data.split(b"\n", 1)) for at, data in inflated(again()))
    else:
        raw = _plain(again())
    version = None
    for at, line, block in raw:
        if version is None:
            version = int(block.split(b" ", 1)[0])
            if version not in DEFINITIONS or not line.startswith(b"filedesc:"):
                raise ValueError("not an ARC file of version 1 or 2")
            continue
        header = parse_arc_header(line, version)
        if len(block) < header["length"]:
            raise ValueError(f"record at {at} is shorter than declared")
        yield at, header, block[: header["length"]]


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP head (with its blank line) and payload of a block; no head when it is not HTTP."""
    if block.startswith(b"HTTP/"):
        end = block.find(b"\r\n\r\n")
        if end >= 0:
            return block[: end + 4], block[end + 4:]
    return b"", block


def http_field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*(.*?)\r?$", head)
    return found[1].decode() if found else None


# ---------------------------------------------------------------- WARC


def warc_date(arc_date: str) -> str:
    digits = arc_date.ljust(14, "0")
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def record_id(archive: str, offset: int, digest: str) -> str:
    """An id that the record's place and payload determine, so that equal rows get ids of their own."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive} {offset} {digest}')}>"


def warc_record(header: dict, block: bytes, archive: str, offset: int, refers_to: dict | None) -> bytes:
    """The WARC record of an ARC record; ``refers_to`` (path, offset, page_id, url, date) makes it a revisit."""
    head, payload = split_http(block)
    digest = hashlib.sha256(payload).hexdigest()
    page = http_field(head, "X-Page-Id")
    fields = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": record_id(archive, offset, digest),
        "WARC-Date": warc_date(header["date"]),
        "WARC-Target-URI": header["url"],
        "WARC-IP-Address": header["ip"],
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response" if head else header["kind"],
    }
    if page is not None:
        fields["X-Page-ID"] = page
    body = block
    if refers_to:
        first = record_id(refers_to["path"], refers_to["offset"], digest)
        fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": first, "WARC-Refers-To-Target-URI": refers_to["url"], "WARC-Refers-To-Date": warc_date(refers_to["date"])}
        if refers_to["page_id"] is not None:
            fields["X-Refers-To-Page-ID"] = str(refers_to["page_id"])
        fields["X-Payload-Length"] = str(len(payload))
        body = head
    fields["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(body).hexdigest()}"
    fields["Content-Length"] = str(len(body))
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def read_warc(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict, bytes]]:
    """``(offset, fields, block)`` of each record of a gzipped WARC file."""
    for at, data in inflated(chunks):
        head, rest = data.split(b"\r\n\r\n", 1)
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(fields["Content-Length"])]
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
            raise ValueError(f"record at {at} does not have its digest")
        yield at, fields, block


# ---------------------------------------------------------------- on Spark

_START = datetime(2010, 1, 1, tzinfo=timezone.utc)


def _each(archives: DataFrame, fn, schema: str) -> DataFrame:
    """Rows that ``fn(path, ...)`` yields from each row's columns, dealt in turn to as many tasks as there are archives."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    n = archives.count()

    def run(batches):
        import pyarrow as pa

        names, rows = kinds.names, []
        for batch in batches:
            for columns in zip(*(c.to_pylist() for c in batch.columns)):
                for row in fn(*columns):
                    rows.append(dict(zip(names, row)))
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, kinds)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    return archives.repartition(max(1, n)).mapInArrow(run, schema)


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages as ARC files in the shared folder, versions 1 and 2 by turns; returns ``path``."""
    root = work_path(pages.sparkSession, "arc")
    slim = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).cast("string").alias("u"), F.col(payload_col).cast("string").alias("p"))

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .packing import text_bytes

        part = TaskContext.get().partitionId()
        held: dict[int, list[bytes]] = {}
        size, made, paths = {1: 0, 2: 0}, 0, []

        def put(version):
            nonlocal made
            paths.append(f"{root}/part-{part:05d}-{made:03d}.arc.gz")
            write_file(paths[-1], b"".join(held.pop(version)))
            size[version] = 0
            made += 1

        turn = 0
        for batch in batches:
            for i, u, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2))):
                version, turn = 1 + turn % 2, turn + 1
                date = (_START + timedelta(seconds=(i or 0) % 100_000_000)).strftime("%Y%m%d%H%M%S")
                url = re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), u) if u else "urn:missing"
                number = "" if i is None else f"X-Page-Id: {i}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{number}Content-Length: {len(p)}\r\n\r\n"
                name = f"part-{part:05d}"
                if version not in held:
                    held[version] = [member(arc_opening(version, name, date))]
                held[version].append(member(arc_record(version, url, "192.0.2.1", date, "text/html", head.encode() + p, name, size[version])))
                size[version] += len(held[version][-1])
                if size[version] >= archive_bytes:
                    put(version)
        for version in list(held):
            put(version)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return materialise(slim.mapInArrow(run, "path string"), "arc-files")


def scan_arc(files: DataFrame) -> DataFrame:
    """``path, offset, page_id, url, date, payload_bytes, digest`` of every record."""

    def scan(path):
        for at, header, block in read_arc(chunks_of(path)):
            head, payload = split_http(block)
            page = http_field(head, "X-Page-Id")
            yield path, at, None if page is None else int(page), header["url"], header["date"], len(payload), hashlib.sha256(payload).hexdigest()

    return _each(files, scan, "path string, offset long, page_id long, url string, date string, payload_bytes long, digest string")


def revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``path, offset, refers`` of the records that repeat another's payload."""

    def place() -> Column:
        return F.struct(F.col("page_id").isNull().alias("missing"), "page_id", "path", "offset", "url", "date")

    long = records.where(F.col("payload_bytes") >= min_bytes).select("digest", "path", "offset", place().alias("own"))
    first = long.groupBy("digest").agg(F.min("own").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long.join(first, "digest").where((F.col("own.path") != F.col("refers.path")) | (F.col("own.offset") != F.col("refers.offset"))).select("path", "offset", "refers")


def convert(files: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """WARC files of ARC files (``path``), in the shared folder; returns ``path``.

    An archive's revisit decisions are gathered to one row, bounded by its
    records, and every archive is rewritten by a task of its own.
    """
    spark = files.sparkSession
    root = work_path(spark, "warc")
    files = files.select("path")
    records = materialise(scan_arc(files), "arc-records")
    decisions = revisits(records, min_bytes).groupBy("path").agg(F.collect_list(F.struct("offset", "refers")).alias("decisions"))

    def rewrite(source, decisions):
        refers = {d["offset"]: d["refers"] for d in decisions or ()}
        out = [member(warc_record(header, block, source, at, refers.get(at))) for at, header, block in read_arc(chunks_of(source))]
        name = source.rsplit("/", 1)[-1].removesuffix(".arc.gz").removesuffix(".arc")
        path = f"{root}/{hashlib.sha256(source.encode()).hexdigest()[:16]}/{name}.warc.gz"
        write_file(path, b"".join(out))
        yield (path,)

    return materialise(_each(materialise(files.join(decisions, "path", "left"), "arc-decisions"), rewrite, "path string"), "warc-files")


def read_back(files: DataFrame) -> DataFrame:
    """``page_id, url, date, payload_bytes, payload_digest, record_type, refers_to``
    of every WARC record; block and payload digests are verified."""

    def scan(path):
        for at, fields, block in read_warc(chunks_of(path)):
            _, payload = split_http(block)
            digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
            kind = fields["WARC-Type"]
            if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                raise ValueError(f"payload at {at} of {path} does not have its digest")
            size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload)
            page, other = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
            yield page and int(page), fields["WARC-Target-URI"], fields["WARC-Date"], size, digest, kind, other and int(other)

    return _each(files.select("path"), scan, "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long")
