"""Shared helpers: the shared work folder, materialised tables, file access."""

from __future__ import annotations

import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_MADE: dict[str, list[str]] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``. Only a single-JVM local session without
    that setting (as in tests) falls back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{tempfile.gettempdir()}/veilmatch-{spark.sparkContext.applicationId}"


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; nothing is created there yet. ``clear`` deletes what is."""
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage in a way that survives lost executors.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def filesystem(uri: str):
    """``(pyarrow filesystem, path)`` of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, data: bytes) -> None:
    """Write a small file and publish it by a rename, so retried tasks are safe."""
    fsys, path = filesystem(uri)
    parent = path.rsplit("/", 1)[0]
    fsys.create_dir(parent, recursive=True)
    temp = f"{parent}/_{uuid.uuid4().hex}"
    with fsys.open_output_stream(temp) as out:
        out.write(data)
    try:
        fsys.move(temp, path)
    except OSError:  # some stores don't rename onto a file; an earlier attempt wrote the same
        if fsys.get_file_info(path).size != len(data):
            raise
        fsys.delete_file(temp)


def read_file(uri: str) -> bytes:
    fsys, path = filesystem(uri)
    with fsys.open_input_stream(path) as src:
        return src.read()


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores behind it as keep it apart from the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_name(columns: list[str], name: str) -> str:
    """``name``, or a ValueError if the input holds a column of that name."""
    if free_name(columns, name) != name:
        raise ValueError(f"the input has a column {name!r}; give the result another name")
    return name


def clear(spark: SparkSession) -> None:
    """Delete the files and tables that operators of this session wrote in the shared folder.

    Results are read lazily, so call it when they have been used.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _MADE.pop(spark.sparkContext.applicationId, []):
        at = hadoop.Path(path)
        at.getFileSystem(conf).delete(at, True)


def id_crc_mod(column: str | Column, modulus: int) -> Column:
    """``crc32`` of the id's decimal text, modulo ``modulus`` (null id: of the empty text)."""
    text = F.coalesce(F.col(column).cast("string") if isinstance(column, str) else column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % F.lit(modulus)


def crc_mod(value, modulus: int) -> int:
    """The same in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


_CACHES: dict[str, object] = {}


def claim(name: str, clear) -> None:
    """Note that an operator now fills its cache in this worker, and empty all others.

    Workers live on from task to task, so that a cache pays; without this, the
    caches of a pipeline's stages would add up.
    """
    for other in [x for x in _CACHES if x != name]:
        _CACHES.pop(other)()
    _CACHES[name] = clear
