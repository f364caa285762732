"""Pack files: bodies as typed records behind each other, found again by file and offset.

A record is four letters of type (DATA, DATZ for a gzip body, INFO for a note; padded with spaces), the length of its data as
four bytes, lowest first, and the data. ``store`` writes each body once, a file per task, and keeps a Parquet table ``index`` with
each hash's file and offset, so that all snapshots of a hash share a place. That table is what counts: files of tasks that ran twice, or
of a job that was stopped, are in no row of it. Files are never changed; more bodies are more files.

``bodies`` reads the records that rows point at, each once, seeking to it; ``spark.read.format("pack")`` reads whole folders, or with
filters on ``file`` and ``offset`` (equal or in) only those records.
"""

from __future__ import annotations

import gzip
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Types of records, and the share of a body's size below which it's compressed.
DATA, ZIPPED, INFO, SHARE = "DATA", "DATZ", "INFO", 0.9
#: What the first record of a file says.
NOTE = b"bodies by hash"
_HEAD = struct.Struct("<4sI")
INDEX_SCHEMA = "data_hash string, file string, offset bigint, type string, stored bigint, size bigint"
RECORD_SCHEMA = "file string, offset bigint, type string, data binary"


def record(kind: str, data: bytes) -> bytes:
    if len(kind) > 4:
        raise ValueError("a type has four letters at most")
    return _HEAD.pack(kind.ljust(4).encode("ascii"), len(data)) + data


def packed(body: bytes, always: int | None = None) -> tuple[str, bytes]:
    """Type and data of a body: compressed where that takes less than nine tenths of it, and where it has more than ``always``
    bytes."""
    small = gzip.compress(body, mtime=0)
    return (ZIPPED, small) if len(small) < len(body) * SHARE or (always is not None and len(body) > always) else (DATA, body)


def unpacked(kind: str, data: bytes) -> bytes | None:
    """A record's body; None where it's damaged."""
    try:
        return gzip.decompress(data) if kind == ZIPPED else data
    except (OSError, EOFError, zlib.error):
        return None


def record_at(stream, offset: int) -> tuple[str, bytes] | None:
    """Type and data of the record at an offset; None where the file has no whole record there."""
    stream.seek(offset)
    head = stream.read(_HEAD.size)
    if len(head) < _HEAD.size:
        return None
    kind, size = _HEAD.unpack(head)
    data = stream.read(size)
    return (kind.decode("ascii", "replace").rstrip(), data) if len(data) == size else None


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _writer(path: str, always: int | None):
    """Per task one file; a row per body says where it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, f"{uuid.uuid4().hex}.pack", 0
        try:
            for b in batches:
                rows = []
                for key, body in zip(b.column("data_hash").to_pylist(), b.column("body"), strict=True):
                    if out is None:
                        store, base = _open(path)
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}")
                        at = out.write(record(INFO, NOTE))
                    kind, data = packed(body.as_py(), always)
                    rows.append((key, name, at, kind, len(data), len(body.as_py())))
                    at += out.write(record(kind, data))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])
        finally:
            if out is not None:
                out.close()

    return run


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{path}/index")


def _is_there(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf()).exists(where)


def store(snapshots: DataFrame, path: str, always: int | None = None) -> DataFrame:
    """Writes the bodies of ``snapshots`` (data_hash, body) that aren't in the packs under ``path`` yet, each hash once; rows with a
    null in either are left out. Bodies of more than ``always`` bytes are compressed whatever that saves. Gives the index: data_hash,
    file, offset, type, stored and whole size."""
    spark = snapshots.sparkSession
    new = snapshots.select("data_hash", "body").where("data_hash is not null and body is not null")
    if _is_there(spark, f"{path}/index"):
        new = new.join(index(spark, path).select("data_hash"), "data_hash", "left_anti")
    each = new.groupBy("data_hash").agg(F.any_value("body").alias("body"))
    each.mapInArrow(_writer(f"{path}/packs", always), INDEX_SCHEMA).write.mode("append").parquet(f"{path}/index")
    return index(spark, path)


def placed(snapshots: DataFrame, places: DataFrame) -> DataFrame:
    """``snapshots`` with file and offset of their bodies (null where there is none)."""
    return snapshots.join(places.select("data_hash", "file", "offset"), "data_hash", "left")


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from contextlib import ExitStack

        root, base = _open(path)
        name, stream = None, None
        with ExitStack() as opened:
            for b in batches:
                rows: list[tuple] = []
                for file, offset in zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), strict=True):
                    if file != name:
                        opened.close()
                        name, stream = file, opened.enter_context(root.open_input_file(f"{base}/{file}"))
                    found = record_at(stream, offset)
                    rows.append((file, offset, None if found is None else unpacked(*found)))
                    if len(rows) == 64:
                        yield _as_batch(rows)
                        rows = []
                yield _as_batch(rows)

    return run


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())], ["file", "offset", "body"])


def bodies(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (file, offset, others) with the body that is there: null without a place, or where the record is damaged. Each
    record is read once, however many rows point at it; the places of a large file are dealt over tasks."""
    places = rows.select("file", "offset").where("file is not null and offset is not null").distinct()
    dealt = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return rows.join(dealt.mapInArrow(_reader(f"{path}/packs"), "file string, offset bigint, body binary"), ["file", "offset"], "left")


def disk_size(spark: SparkSession, path: str) -> int:
    """Bytes of the pack files, listed by the driver."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/packs")
    files = where.getFileSystem(jvm.org.apache.spark.deploy.SparkHadoopUtil.get().conf())
    return files.getContentSummary(where).getLength() if files.exists(where) else 0


class _Records(InputPartition):
    def __init__(self, file: str, offsets: list[int] | None):
        self.file, self.offsets = file, offsets


class _PackReader(DataSourceReader):
    """A task per file; with filters those files and offsets only."""

    def __init__(self, path: str):
        self.path, self.files, self.offsets = path, None, None

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("file",):
                self.files = values if self.files is None else self.files & values
            elif values is not None and f.attribute == ("offset",):
                self.offsets = values if self.offsets is None else self.offsets & values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        root, base = _open(self.path)
        found = sorted(x.base_name for x in root.get_file_info(fs.FileSelector(base)) if x.is_file and x.base_name.endswith(".pack"))
        offsets = None if self.offsets is None else sorted(self.offsets)
        return [_Records(x, offsets) for x in found if self.files is None or x in self.files] or [_Records("", [])]

    def read(self, partition):
        if partition.offsets == []:
            return
        root, base = _open(self.path)
        with root.open_input_file(f"{base}/{partition.file}") as stream:
            offsets, at = iter(partition.offsets or ()), 0
            while True:
                at = next(offsets, None) if partition.offsets is not None else at
                found = None if at is None else record_at(stream, at)
                if found is not None:
                    yield partition.file, at, *found
                    at += _HEAD.size + len(found[1])
                elif at is None or partition.offsets is None:
                    return


class Pack(DataSource):
    """``spark.read.format("pack").load(uri of the packs)``: file, offset, type, data as stored."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _PackReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Filters reach the source where the session pushes them to Python sources, which this switches on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Pack)
