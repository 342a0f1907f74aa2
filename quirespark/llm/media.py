"""Media columns in archives, read back through a data source of our own.

Writing: every task stores its rows as WAV files (8-bit mono samples) in one zip archive in
the shared folder, under a temporary name that is changed when the archive is complete. The
rows' ids and lengths are members of the archive as well, one for up to ``INDEXED`` rows. A
manifest table lists the archives of the tasks that ended, so attempts that were lost leave
nothing that is read. Reading: the driver plans byte ranges from the sizes in the manifest
alone. A range's task reads the archive's directory, takes the members whose headers start in
its range, checks each one's CRC and hands them on in Arrow batches of bounded bytes. A member
that fails is tried again from its own offset, alone, with a handle of its own.

Folders may be mounted ones or any that Arrow's file systems open (hdfs://, s3:// ...).
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quirespark.llm._common import named, shared_folder

RATE, ALIGN, BATCH_BYTES, RANGE_BYTES = 8000, 64, 8 << 20, 16 << 20
INDEXED, INDEX_BYTES = 4096, 1 << 20


def opened(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    if "://" in url:
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), url


def to_wav(raw: bytes) -> bytes:
    """A WAV file whose 8-bit samples are ``raw`` and zeros up to a positive multiple of 64."""
    payload = raw + bytes(-len(raw) % ALIGN or (ALIGN if not raw else 0))
    fmt = struct.pack("<HHIIHH", 1, 1, RATE, RATE, 1, 8)
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file of 8-bit mono samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, bits = 12, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            bits = struct.unpack_from("<HHIIHH", media, at + 8)
        if kind == b"data":
            if bits is None or (bits[0], bits[1], bits[5]) != (1, 1, 8):
                raise ValueError("not 8-bit mono samples")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _index(rows: list[tuple[int, str | None, int]]) -> bytes:
    """Numbers, ids and text lengths of members, as Arrow bytes: ids of any length, null apart from empty."""
    table = pa.table([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.large_string(), pa.int64()))], ["n", "id", "n_bytes"])
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every row's text; one row an archive: path (its name), bytes, members (rows stored).

    A row's member is named by its number in the archive. Members named by a first number and
    ``.ids`` hold the ids as text, and the texts' lengths in bytes, of the rows from there.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}.zip"
        members, index, held = 0, [], 0

        def put(archive: zipfile.ZipFile, name: str, data: bytes) -> None:
            info = zipfile.ZipInfo(name)
            info.compress_type = zipfile.ZIP_DEFLATED
            archive.writestr(info, data)

        with system.open_output_stream(f"{base}/{name}.tmp") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
            for batch in batches:
                for key, text in zip(batch.column(0), batch.column(1)):
                    raw, key = (text.as_py() or "").encode("utf-8", "surrogatepass"), key.as_py()
                    put(archive, f"{members:09d}.wav", to_wav(raw))
                    index.append((members, key, len(raw)))
                    members, held = members + 1, held + len(key or "")
                    if len(index) == INDEXED or held > INDEX_BYTES:
                        put(archive, f"{index[0][0]:09d}.ids", _index(index))
                        index, held = [], 0
            if index:
                put(archive, f"{index[0][0]:09d}.ids", _index(index))
        if members:
            system.move(f"{base}/{name}.tmp", f"{base}/{name}")
            size = system.get_file_info(f"{base}/{name}").size
            yield pa.record_batch([pa.array([name]), pa.array([size], pa.int64()), pa.array([members], pa.int64())], ["path", "bytes", "members"])
        else:
            system.delete_file(f"{base}/{name}.tmp")

    return docs.select(named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text")).mapInArrow(
        store, "path string, bytes long, members long"
    )


class ByteRange(InputPartition):
    def __init__(self, name: str, begin: int, end: int):
        self.name, self.begin, self.end = name, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.manifest = options.get("manifest")
        self.span = int(options.get("rangebytes", RANGE_BYTES))
        self.tries = int(options.get("tries", 3))

    def archives(self) -> Iterator[tuple[str, int]]:
        """Names and sizes: those of the manifest, or of all archives in the folder."""
        if self.manifest is None:
            system, base = opened(self.folder)
            found = system.get_file_info(fs.FileSelector(base, allow_not_found=True))
            yield from sorted((f.base_name, f.size) for f in found if f.base_name.endswith(".zip"))
            return
        system, base = opened(self.manifest)
        for batch in ds.dataset(base, filesystem=system, format="parquet").to_batches(columns=["path", "bytes"]):
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

    def partitions(self) -> list[ByteRange]:
        """Byte ranges of the archives, from their sizes; no directory is read here."""
        out = [ByteRange(name, at, min(at + self.span, size)) for name, size in self.archives() for at in range(0, size, self.span)]
        return out or [ByteRange("", 0, 0)]

    def take(self, f: pa.NativeFile, info: zipfile.ZipInfo) -> bytes:
        """One member's bytes by its offset, checked."""
        f.seek(info.header_offset)
        head = f.read(30)
        if head[:4] != b"PK\x03\x04":
            raise OSError("no member starts here")
        name, extra = struct.unpack_from("<HH", head, 26)
        f.seek(info.header_offset + 30 + name + extra)
        stored = f.read(info.compress_size)
        media = stored if info.compress_type == zipfile.ZIP_STORED else zlib.decompress(stored, -15, info.file_size or 1)
        if len(media) != info.file_size or zlib.crc32(media) != info.CRC:
            raise OSError("its bytes do not match its checksum")
        return media

    def member(self, f: pa.NativeFile, path: str, info: zipfile.ZipInfo) -> bytes:
        """take(), from the range's handle; tried again alone, each time with a new one."""
        system = opened(self.folder)[0]
        for attempt in range(self.tries):
            try:
                if not attempt:
                    return self.take(f, info)
                with system.open_input_file(path) as again:
                    return self.take(again, info)
            except (OSError, zlib.error) as e:
                if attempt + 1 == self.tries:
                    raise OSError(f"{path}, member {info.filename} at {info.header_offset}: {e}") from e
                time.sleep(0.05 * 2**attempt)
        raise AssertionError

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        system, base = opened(self.folder)
        path = f"{base}/{part.name}"
        with system.open_input_file(path) as f:
            with zipfile.ZipFile(f) as archive:
                listed = archive.infolist()
            indexes = sorted((int(i.filename[:-4]), i) for i in listed if i.filename.endswith(".ids"))
            firsts, known, facts = [n for n, _ in indexes], -1, {}
            rows: list[tuple] = []
            held = 0
            for info in listed:
                if not (part.begin <= info.header_offset < part.end and info.filename.endswith(".wav")):
                    continue
                number = int(info.filename[:-4])
                at = int(np.searchsorted(firsts, number, "right")) - 1
                if at != known:
                    table = pa.ipc.open_stream(self.member(f, path, indexes[at][1])).read_all()
                    known, facts = at, dict(zip(table["n"].to_pylist(), zip(table["id"].to_pylist(), table["n_bytes"].to_pylist())))
                media = self.member(f, path, info)
                rows.append((*facts[number], part.name, info.header_offset, media))
                held += len(media)
                if held >= BATCH_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
            if rows:
                yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "n_bytes", "archive", "offset", "media"])


class ArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(folder)``: id, n_bytes, archive, offset, media.

    Options: manifest (a Parquet table of path and bytes; all archives of the folder if not
    given), rangebytes, tries.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id string, n_bytes long, archive string, offset long, media binary"

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(self.options)


def signal_features(payload: bytes) -> str:
    """Mean, spread, share of zero crossings and loudest of eight bands of the samples' histogram."""
    x = np.frombuffer(payload, np.uint8)
    bands = np.bincount(x >> 5, minlength=8)
    total = int(x.sum(dtype=np.int64))
    squares = int(np.bincount(x, minlength=256).astype(np.int64) @ np.arange(256, dtype=np.int64) ** 2)
    mean = total / len(x)
    spread = max(squares / len(x) - mean * mean, 0.0) ** 0.5
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    return f"mean={mean:.4f};std={spread:.4f};crossings={crossings};band={int(bands.argmax())}"


def media_features(media: DataFrame, features: Callable[[bytes], str] = signal_features) -> DataFrame:
    """Digests and a feature string of every member, from the bytes that were read."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for m in batch.column(2):
                m = m.as_py()
                p = from_wav(m)
                out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-ALIGN:]), len(m), hashlib.sha256(m).hexdigest(), features(p)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            made = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.record_batch([*batch.columns[:2], *made], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("id", "n_bytes", "media").mapInArrow(
        measure,
        "id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Store all texts as media, read them back, and describe what was read.

    Null texts are empty ones: 64 zero samples. Repeated rows are members of their own; null
    ids stay null, apart from empty ones, and ids may be of any length. Very long texts are one
    member each (which has to fit in a task's memory), an empty table gives no member. Equal
    texts give equal media. Other columns are not read, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    folder = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    # One short row an archive, that is one a task: the archives that exist, whichever attempt made them.
    write_archives(docs, folder, id_col, text_col).write.parquet(f"{folder}/manifest")
    spark.dataSource.register(ArchiveSource)
    media = spark.read.format("media_archive").option("manifest", f"{folder}/manifest").option("rangebytes", str(range_bytes)).load(folder)
    made = media_features(media)
    return made.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
