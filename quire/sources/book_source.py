"""Book archives as a Spark data source: reads only what the catalogue of an archive needs, writes archives through a commit.

    spark.dataSource.register(BookSource)
    spark.read.format("quire_books").load(folder)                                # a row per archive
    plan.write.format("quire_books").mode("append").save(folder)                 # an archive per row

Files are reached through pyarrow's file systems (local and mounted paths, s3, gs, abfs, hdfs by their URIs), seekable, in the tasks."""

from __future__ import annotations

import contextlib
import hashlib
import heapq
import io
import json
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.sources.archives import RAW_SCHEMA, read_package
from quire.sources.stores import file_system, seekable

FORMAT = "quire_books"
#: Bytes of archives of a partition, about; what a task reads of them is less. An archive counts as so many at least.
PARTITION_BYTES, LEAST_BYTES = 128 << 20, 64 << 10
#: Archives of a batch of rows, and bytes of a member that are held at a time while it is copied.
ROWS, CHUNK = 64, 1 << 20
PLAN_SCHEMA = "path string, name string, opf_path string, opf binary, staged map<string,binary>"
MIMETYPE = b"application/epub+zip"


@dataclass
class Archives(InputPartition):
    files: list[tuple[str, int]]

    @property
    def bytes(self) -> int:
        return sum(max(size, LEAST_BYTES) for _, size in self.files)


def balanced(files: list[tuple[str, int]], most: int) -> list[Archives]:
    """Partitions of about ``most`` bytes, the largest files dealt first, each to the partition that has least."""
    total = sum(max(size, LEAST_BYTES) for _, size in files)
    out = [Archives([]) for _ in range(max(1, min(len(files), -(-total // most))))]
    heap = [(0, i) for i in range(len(out))]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        held, i = heapq.heappop(heap)
        out[i].files.append((path, size))
        heapq.heappush(heap, (held + max(size, LEAST_BYTES), i))
    return out


class BookSource(DataSource):
    """Options: path; recursive (true); extension (epub); partitionBytes. A folder's files are listed once, on the driver (some 200
    bytes each)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return " ".join(RAW_SCHEMA.split())

    def reader(self, schema: StructType) -> DataSourceReader:
        return BookReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BookWriter(self.options, schema.names, overwrite)


class BookReader(DataSourceReader):
    def __init__(self, schema: StructType, options):
        self.schema = schema
        self.path, self.recursive = options["path"], str(options.get("recursive", "true")).lower() == "true"
        self.extension, self.most = options.get("extension", "epub"), int(options.get("partitionBytes", PARTITION_BYTES))

    def partitions(self) -> list[Archives]:
        system, root, _ = file_system(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            found = [system.get_file_info(root)]
        else:
            found = _files(system, root, self.recursive)
        wanted = [(f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name.endswith(f".{self.extension}") and f.base_name[0] not in ".~_" and "/_" not in f.path[len(root) :]]
        return balanced(wanted, self.most)

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        system, _, prefix = file_system(self.path)
        shape = to_arrow_schema(self.schema)
        rows: list[dict] = []
        for path, _ in partition.files:
            try:
                with system.open_input_file(path) as file:
                    rows.append(read_package(prefix + path, seekable(file)))
            except OSError as e:  # it cannot be opened at all
                rows.append(read_package(prefix + path, None) | {"load_error": f"{type(e).__name__}: {e}"[:300]})
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, shape)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, shape)


@dataclass
class Written(WriterCommitMessage):
    """listed: the file of lines that tells what a task has written, in the task's own folder: [file in the staging folder or "", name it is to have, why it
    failed]. So what a task sends to the driver does not grow with its archives."""

    listed: str


def _files(system: fs.FileSystem, root: str, recursive: bool) -> Iterator[fs.FileInfo]:
    """What a folder holds, listed a folder at a time."""
    left = [root]
    while left:
        for f in system.get_file_info(fs.FileSelector(left.pop())):
            if f.type == fs.FileType.Directory and recursive:
                left.append(f.path)
            yield f


class BookWriter(DataSourceWriter):
    """A task writes its archives to a folder of its own attempt below the job's staging folder; the driver moves those of the
    attempts that Spark counts, and the staging folder goes. So a task that is tried again leaves one file, a job that fails none."""

    def __init__(self, options, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = options["path"], columns, overwrite
        self.job = options.get("job") or uuid.uuid4().hex
        lacks = {c.split(" ")[0] for c in PLAN_SCHEMA.split(", ")} - set(columns)
        if lacks:
            raise ValueError(f"a plan of archives needs the columns {', '.join(sorted(lacks))}")

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, iterator) -> Written:
        system, root, _ = file_system(self.path)
        task = TaskContext.get()
        own = f"{self._staging(root)}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        places = [self.columns.index(c) for c in ("path", "name", "opf_path", "opf", "staged")]
        with system.open_output_stream(f"{own}/listed") as listed:
            for k, row in enumerate(iterator):
                path, name, opf_path, opf, staged = (row[i] for i in places)
                part, error = f"{own}/{k}", ""
                try:
                    if not name or name.startswith(("/", "_", ".")) or ".." in name.split("/") or "\\" in name:
                        raise ValueError(f"{name!r} is no safe name")
                    if not self.overwrite and system.get_file_info(f"{root}/{name}").type != fs.FileType.NotFound:
                        raise FileExistsError(name)
                    change = dict(staged or {}) | ({opf_path: opf} if opf is not None else {})
                    copy_archive(path, system, part, {n: None if d is None else bytes(d) for n, d in change.items()})
                except Exception as e:  # noqa: BLE001 - a bad archive or name is reported, and the others are written
                    part, error = "", f"{type(e).__name__}: {e}"[:300]
                listed.write(json.dumps([part, name, error]).encode() + b"\n")
        return Written(f"{own}/listed")

    def commit(self, messages) -> None:
        system, root, _ = file_system(self.path)
        system.create_dir(f"{root}/_written", recursive=True)
        seen, folders = set(), set()  # of names only the hashes, and these only where files may be replaced
        with system.open_output_stream(f"{root}/_written/{self.job}.jsonl") as file:
            for message in filter(None, messages):
                for part, name, error in _lines(system, message.listed):
                    if part:
                        target = f"{root}/{name}"
                        key = hashlib.blake2b(name.encode(), digest_size=16).digest() if self.overwrite else None
                        if key in seen or not self.overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
                            error = f"FileExistsError: {name}"
                        else:
                            if self.overwrite:
                                seen.add(key)
                            folder = target.rsplit("/", 1)[0]
                            if folder not in folders:
                                system.create_dir(folder, recursive=True)
                                folders.add(folder)
                            system.move(part, target)
                    file.write(json.dumps({"name": name, "error": error}).encode() + b"\n")
        self._clear(system, root)

    def abort(self, messages) -> None:
        system, root, _ = file_system(self.path)
        self._clear(system, root)

    def _clear(self, system: fs.FileSystem, root: str) -> None:
        if system.get_file_info(self._staging(root)).type == fs.FileType.Directory:
            system.delete_dir(self._staging(root))


def _lines(system: fs.FileSystem, path: str) -> Iterator[list]:
    """The lines of a task's list, read one by one."""
    with system.open_input_stream(path, buffer_size=CHUNK) as file:
        for line in io.TextIOWrapper(file, encoding="utf-8"):
            yield json.loads(line)


def copy_archive(source: str | None, system: fs.FileSystem, target: str, change: dict[str, bytes | None]) -> None:
    """Write an archive anew: the first entry is the uncompressed mimetype, entries in ``change`` have its bytes or are left out (None), all
    others are copied, some of their bytes at a time. Without a source it has the entries in ``change`` alone."""
    with contextlib.ExitStack() as files:
        old = None
        if source:
            old_system, path, _ = file_system(source)
            old = files.enter_context(zipfile.ZipFile(seekable(files.enter_context(old_system.open_input_file(path)))))
        new = files.enter_context(zipfile.ZipFile(files.enter_context(system.open_output_stream(target)), "w", zipfile.ZIP_DEFLATED))
        new.writestr(zipfile.ZipInfo("mimetype"), MIMETYPE, zipfile.ZIP_STORED)
        for info in old.infolist() if old else []:
            if info.filename == "mimetype" or info.filename in change:
                continue
            copied = zipfile.ZipInfo(info.filename, info.date_time)
            copied.compress_type, copied.external_attr, copied.file_size = info.compress_type, info.external_attr, info.file_size
            with old.open(info) as member, new.open(copied, "w") as out:
                while part := member.read(CHUNK):
                    out.write(part)
        for name, data in change.items():
            if data is not None and name != "mimetype":
                new.writestr(name, data)


def scan_books(spark: SparkSession, folder: str, recursive: bool = True, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """One row per archive below a folder: its package as nested columns, or a load_error. Of an archive only the directory at
    its end, the container, the package document and the encryption list are read."""
    spark.dataSource.register(BookSource)
    return spark.read.format(FORMAT).option("recursive", str(recursive)).option("partitionBytes", str(partition_bytes)).load(folder)


def write_books(plan: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """Write an archive for each row of ``plan`` (path: the archive it is made from, or null for a new one, name below the folder, opf_path, opf: a new package document or
    null, staged: names to bytes, null to remove one). Returns (name, error) of every row; an empty error means that the file is there, whole.
    Existing files stay unless ``overwrite``, two rows of one name give one file and an error."""
    spark = plan.sparkSession
    spark.dataSource.register(BookSource)
    job = uuid.uuid4().hex
    plan.select(*[c.split(" ")[0] for c in PLAN_SCHEMA.split(", ")]).write.format(FORMAT).option("job", job).mode("overwrite" if overwrite else "append").save(folder)
    return spark.read.schema("name string, error string").json(f"{folder.rstrip('/')}/_written/{job}.jsonl")


def crc_and_size(data: bytes) -> tuple[int, int]:
    return zlib.crc32(data), len(data)
