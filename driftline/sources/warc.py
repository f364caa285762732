"""WARC archives: records of files, responses of records, and a writer.

``read`` and ``read_stream`` take files of stores that Arrow reads, a record at a time, whatever the file's size: a task per
file, and several for a large gzip file of many members, each of which looks for the first member from its part on that
begins a record. The stream's offset is the files taken so far, so files may come in any order of time; each is read once.
``read_whole`` takes any store that Spark reads, a file at a time as one row. All inflate and parse piece by piece. A
damaged place ends its task's part of the file; what came before, and other parts, are kept. ``record_no`` is ascending within a file: the
byte at which a record's member (of other files, the record) begins, and one more for each further record of a member.

A body that is a gzip WARC file itself, stored in a member without being compressed, may be taken for members of the file
where a part begins within it; ``split`` set to 0 reads each file in one task.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

RECORD_SCHEMA = "file string, record_no bigint, record_type string, url string, record_date timestamp, content_type string, truncated string, headers map<string,string>, block binary"
_ROWS = 200


#: Bytes read at a time, and the longest header.
_PIECE, _HEAD = 1 << 20, 1 << 20
#: Bytes of a gzip file that a task reads.
SPLIT = 256 << 20


class _Inflated:
    """What a file holds from a place on, inflated member by member; other files as they are."""

    def __init__(self, pieces: Iterable[bytes], start: int = 0):
        self.pieces, self.start, self.zipped = pieces, start, False
        #: (place in what came out, byte of the file) at which members begin.
        self.members: deque[tuple[int, int]] = deque()

    def __iter__(self) -> Iterator[bytes]:
        d, head, fed, out = None, b"", self.start, 0
        for piece in self.pieces:
            if head is not None:
                head += piece
                if len(head) < 2:
                    continue
                piece, head = head, None
                self.zipped = piece[:2] == b"\x1f\x8b"
                if self.zipped:
                    d = zlib.decompressobj(31)
                    self.members.append((0, fed))
            fed += len(piece)
            while d is not None and piece:
                try:
                    more = d.decompress(piece)
                except zlib.error:
                    return
                out += len(more)
                yield more
                piece = d.unused_data if d.eof else b""
                if d.eof:
                    d = zlib.decompressobj(31)
                    self.members.append((out, fed - len(piece)))
            if d is None:
                yield piece
        if head:
            yield head

    def place(self, at: int) -> int:
        """The byte of the file at which the member begins that has place ``at``; of other files the place itself."""
        if not self.zipped:
            return self.start + at
        while len(self.members) > 1 and self.members[1][0] <= at:
            self.members.popleft()
        return self.members[0][1]


def located(pieces: Iterable[bytes], start: int = 0) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(byte at which its member begins, headers by lower-case name, block) of each whole record of a file's bytes from
    ``start`` on."""
    source = _Inflated(pieces, start)
    more, buffer, gone = iter(source), bytearray(), 0

    def filled(size: int) -> bool:
        while len(buffer) < size:
            piece = next(more, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while filled(2):
        if buffer[:2] == b"\r\n":
            del buffer[:2]
            gone += 2
            continue
        seen = 0
        while (end := buffer.find(b"\r\n\r\n", max(0, seen - 3))) < 0 and len(buffer) < _HEAD:
            seen = len(buffer)
            if not filled(seen + 1):
                return
        if end < 0 or not buffer.startswith(b"WARC/"):
            return
        lines = bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "")
        if not size.isdigit() or not filled(end + 4 + int(size)):
            return
        yield source.place(gone), headers, bytes(buffer[end + 4 : end + 4 + int(size)])
        del buffer[: end + 4 + int(size)]
        gone += end + 4 + int(size)


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each whole record of a file's bytes."""
    return ((h, block) for _, h, block in located(pieces))


def _date(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat((text or "").replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None)
    except ValueError:
        return None


_NAMES = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]


def _rows(file: str, pieces: Iterable[bytes], start: int = 0, end: int | None = None) -> Iterator[tuple]:
    """The records whose members begin from ``start`` on and before ``end``."""
    last, k = -1, 0
    for place, h, block in located(pieces, start):
        if end is not None and place >= end:
            return
        last, k = place, k + 1 if place == last else 0
        url = h.get("warc-target-uri", "").strip("<>") or None
        yield file, place + k, h.get("warc-type"), url, _date(h.get("warc-date")), h.get("content-type"), h.get("warc-truncated"), h, block


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """One row a record; see RECORD_SCHEMA. A file is a row first, so it has to fit in memory (2 GB at most)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                rows = _rows(file, [bytes(content)])
                while own := list(islice(rows, _ROWS)):
                    yield pd.DataFrame(own, columns=_NAMES)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, RECORD_SCHEMA)


class _Part(InputPartition):
    """Bytes ``start`` to ``end`` of a file; without an end all of it."""

    def __init__(self, file: str, start: int = 0, end: int | None = None):
        self.file, self.start, self.end = file, start, end


def _first_member(stream, start: int, end: int) -> int | None:
    """The first place from ``start`` on, before ``end``, at which a gzip member begins that begins a record."""
    stream.seek(start)
    held, at = b"", start
    while at < end:
        piece = stream.read(_PIECE)
        held += piece
        k = held.find(b"\x1f\x8b\x08")
        while k >= 0 and at + k < end:
            try:
                # what follows may not be read yet
                begun = zlib.decompressobj(31).decompress(held[k : k + 4096], 5)
            except zlib.error:
                begun = None
            if begun == b"WARC/":
                return at + k
            if begun is not None and len(held) - k < 4096 and piece:
                break
            k = held.find(b"\x1f\x8b\x08", k + 1)
        if not piece:
            return None
        keep = len(held) - k if k >= 0 else 2
        at, held = at + len(held) - keep, held[-keep:]
    return None


class _Files:
    """The files of a folder, and the parts that tasks read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def sizes(self) -> dict[str, int]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(base)
        files = [found] if found.is_file else store.get_file_info(fs.FileSelector(base, recursive=True))
        return {f.path: f.size for f in files if f.is_file and not f.base_name.startswith(("_", "."))}

    def parts(self, files: dict[str, int]) -> list[_Part]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        out = []
        for file, size in sorted(files.items()):
            if not 0 < self.split < size:
                out.append(_Part(file))
                continue
            with store.open_input_file(file) as stream:
                zipped = stream.read(2) == b"\x1f\x8b"
            out += [_Part(file, a, min(a + self.split, size)) for a in range(0, size, self.split)] if zipped else [_Part(file)]
        return out

    def rows(self, part: _Part) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_file(part.file) as stream:
            start = 0 if not part.start else _first_member(stream, part.start, part.end)
            if start is not None:
                stream.seek(start)
                yield from _rows(part.file, iter(lambda: stream.read(_PIECE), b""), start, part.end)


class _Reader(DataSourceReader):
    """A task per part of a file, which holds a piece of it and a record at a time."""

    def __init__(self, options: dict[str, str]):
        self.files = _Files(options)

    def partitions(self):
        return self.files.parts(self.files.sizes()) or [_Part("")]

    def read(self, partition):
        if partition.file:
            yield from self.files.rows(partition)


class _StreamReader(DataSourceStreamReader):
    """Files as they come. The offset has the names and sizes of those that were there."""

    def __init__(self, options: dict[str, str]):
        self.files = _Files(options)

    def initialOffset(self):
        return {"files": {}}

    def latestOffset(self):
        return {"files": self.files.sizes()}

    def partitions(self, start, end):
        return self.files.parts({f: n for f, n in end["files"].items() if f not in start["files"]}) or [_Part("")]

    def read(self, partition):
        if partition.file:
            yield from self.files.rows(partition)


def read(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """One row a record; see RECORD_SCHEMA. ``path`` is the URI of a file or folder; gzip files of more than ``split`` bytes are
    read in parts of that size."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("split", SPLIT if split is None else split).load()


def read_stream(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """As ``read``, of a folder into which files come. A file has to be whole when it comes under its name."""
    register(spark)
    return spark.readStream.format("warc").option("path", path).option("split", SPLIT if split is None else split).load()


def responses(records_: DataFrame) -> DataFrame:
    """Captures of gemini response records: status and meta from the header line, the rest is the body."""
    block = F.col("block")
    head = F.regexp_extract(F.decode(F.substring(block, 1, 1100), "ISO-8859-1"), r"^(\d{2})[ \t]*([^\r\n]*)\r?\n", 0)
    status, meta = F.regexp_extract(head, r"^(\d{2})", 1), F.trim(F.regexp_extract(head, r"^\d{2}[ \t]*([^\r\n]*)", 1))
    own = records_.where((F.col("record_type") == "response") & F.col("url").startswith("gemini://") & F.col("block").isNotNull()).where(head != "")
    # crawlers ask for robots files with a query of their own
    url = F.regexp_replace("url", r"(/robots\.txt)\?.*$", "$1")
    ok = status.startswith("2")
    return own.select(
        F.col("file"), F.col("record_no").alias("ingest_seq"), url.alias("url"), status.cast("int").alias("status_code"), meta.alias("meta"),
        F.when(ok, F.lower(F.trim(F.substring_index(meta, ";", 1)))).alias("mime_type"), F.nullif(F.lower(F.regexp_extract(meta, r"(?i)charset=([^;\s]+)", 1)), F.lit("")).alias("charset"),
        F.nullif(F.lower(F.regexp_extract(meta, r"(?i)lang=([^;\s]+)", 1)), F.lit("")).alias("language"), F.col("record_date").alias("received"),
        F.substring(block, F.length(head) + 1, F.octet_length(block)).alias("body"), F.col("truncated").isNotNull().alias("is_body_truncated"),
    )


def cleaned(records_: DataFrame) -> DataFrame:
    """Records as they should have been written: no query on robots files, digests that are null left out, TLS headers
    by their present names, metadata of sites that could never be reached left out."""
    names = F.transform_keys("headers", lambda k, v: F.when(k == "tls-cipher", "warc-cipher-suite").when(k == "tls-version", "warc-protocol").otherwise(k))
    fixed = records_.withColumn("url", F.regexp_replace("url", r"(/robots\.txt)\?.*$", "$1")).withColumn("headers", F.map_filter(names, lambda k, v: ~(k.endswith("digest") & v.rlike("(?i)null|^$"))))
    site = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    failed = fixed.where((F.col("record_type") == "response") & F.col("block").cast("string").startswith("49")).select(site.alias("_site")).distinct()
    joined = fixed.withColumn("_site", site)
    return joined.where("record_type <> 'metadata'").unionByName(joined.where("record_type = 'metadata'").join(failed, "_site", "left_anti").select(joined.columns)).drop("_site")


def first_records(records_: DataFrame, n: int, *order: str) -> DataFrame:
    """The first records, as they lie in the files or in another order; each task keeps n of its own, so nothing is gathered but these."""
    return records_.orderBy(*(order or ("file", "record_no"))).limit(n)


def certificates_once(captures: DataFrame) -> DataFrame:
    """``captures`` with the certificate of each site at its first capture alone, so that a writer's files together have it once,
    however they are dealt out. One row per site is shuffled."""
    site = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    first = captures.where("certificate_pem is not null").groupBy(site.alias("_site")).agg(F.min(F.struct("received", "url")).alias("_first"))
    joined = captures.join(first, site == F.col("_site"), "left")
    mine = F.struct("received", "url").eqNullSafe(F.col("_first"))
    return joined.withColumn("certificate_pem", F.when(mine, F.col("certificate_pem"))).drop("_site", "_first")


def record_id(kind: str, url: str | None, date: datetime) -> str:
    """The same for the same capture, so that a task that runs again writes the same file."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {url} {date}')}>"


def record(kind: str, url: str | None, date: datetime, content_type: str, block: bytes, **more: str | None) -> bytes:
    headers = {"WARC-Type": kind, "WARC-Record-ID": record_id(kind, url, date), "WARC-Date": date.strftime("%Y-%m-%dT%H:%M:%SZ"), "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}"}
    if url:
        headers["WARC-Target-URI"] = url
    headers |= {k.replace("_", "-"): v for k, v in more.items() if v} | {"Content-Type": content_type, "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in headers.items()), "\r\n"]).encode() + block + b"\r\n\r\n"


_NEEDED = ("url", "received", "status_code", "meta", "body", "is_body_truncated")
#: Columns that a capture may have besides those it must have.
_OPTIONAL = ("remote_address", "tls_protocol", "tls_cipher", "certificate_pem", "mime_type")


def capture(r: dict, certificates: set[str]) -> bytes:
    """The records of a capture: request, response, and the site's certificate where it's the first of the file."""
    url, date = r["url"], r["received"]
    more = {"WARC_IP_Address": r.get("remote_address"), "WARC_Protocol": r.get("tls_protocol"), "WARC_Cipher_Suite": r.get("tls_cipher")}
    body = bytes(r["body"] or b"")
    out = record("request", url, date, "application/gemini; msgtype=request", f"{url}\r\n".encode(), **more)
    more |= {"WARC_Concurrent_To": record_id("request", url, date), "WARC_Identified_Payload_Type": r.get("mime_type"), "WARC_Truncated": "length" if r["is_body_truncated"] else None}
    if body:
        more["WARC_Payload_Digest"] = f"sha256:{hashlib.sha256(body).hexdigest()}"
    out += record("response", url, date, "application/gemini; msgtype=response", f"{r['status_code']} {r['meta'] or ''}\r\n".encode() + body, **more)
    site = "/".join(url.split("/")[:3])
    if r.get("certificate_pem") and site not in certificates:
        certificates.add(site)
        out += record("metadata", url, date, "application/x-pem-file", r["certificate_pem"].encode(), WARC_Refers_To=record_id("response", url, date))
    return out


class _Writer(DataSourceWriter):
    """A file per task, under a name of its own until the job commits."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(self.path)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}"
        with store.open_output_stream(f"{base}/_{name}-{task.taskAttemptId()}") as out:
            certificates: set[str] = set()
            for r in iterator:
                out.write(capture({n: r[n] for n in (*_NEEDED, *_OPTIONAL) if n in r}, certificates))
        return _Done(f"_{name}-{task.taskAttemptId()}", f"{name}.warc")

    def commit(self, messages):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            store.move(f"{base}/{m.temporary}", f"{base}/{m.final}")

    def abort(self, messages):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m is not None:
                store.delete_file(f"{base}/{m.temporary}")


class _Done(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class Warc(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc").save(uri)``, the latter for rows of url, received,
    status_code, meta, body, is_body_truncated and, if there are any, _OPTIONAL."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
