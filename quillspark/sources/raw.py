"""Raw files as a Spark source: spark.read.format("quill_files") and readStream, with the rows of files.load().

    register(spark)
    docs = spark.read.format("quill_files").load("s3://bucket/folder")
    docs = spark.readStream.format("quill_files").option("maxFilesPerTrigger", "1000").load(folder)
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quillspark.sources import files

#: Bytes of files that one task reads, if it is more than one file.
PARTITION_BYTES = 64 << 20


class Files(InputPartition):
    """Files of one task: (path, bytes)."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.entries = entries


def listed(path: str) -> list[tuple[int, str, int]]:
    """(time of change in ns, path, bytes) of all files below a path, hidden ones left out, in order of time and path."""
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    scheme = path.split("://", 1)[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted((f.mtime_ns or 0, scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def parted(found: Sequence[tuple[int, str, int]], most: int) -> list[Files]:
    """Files of about equal bytes a task, the largest first dealt out; a large file has a task of its own."""
    total = sum(size for _, _, size in found)
    count = max(1, min(len(found), -(-total // most)))
    load, out = [0] * count, [[] for _ in range(count)]
    for _, path, size in sorted(found, key=lambda f: (-f[2], f[1])):
        i = load.index(min(load))
        out[i].append((path, size))
        load[i] += size + 4096
    return [Files(x) for x in out if x]


def rows_of(path: str) -> Iterator[tuple]:
    system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    with system.open_input_stream(at) as f:
        yield from files.parse(path if "://" in path else f"file:{path}", f.read(), files.EXTRACTORS)


class Reader(DataSourceReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def partitions(self) -> list[Files]:
        return parted(listed(self.path), self.most)

    def read(self, partition: Files | None) -> Iterator[tuple]:
        for path, _ in partition.entries if partition else []:  # without files Spark asks for a partition that is none
            yield from rows_of(path)


class StreamReader(DataSourceStreamReader):
    """Offsets are {"at": time, "path": path} of the last file that was taken, in the order of time and path, so a file is taken once.

    A file that appears with a time before the last one taken isn't found; writers should move files in when they are whole."""

    def __init__(self, path: str, most: int, most_files: int):
        self.path, self.most, self.most_files, self.planned = path, most, most_files, {"at": -1, "path": ""}

    def initialOffset(self) -> dict:
        return {"at": -1, "path": ""}

    def _between(self, start: dict, end: dict | None = None) -> list[tuple[int, str, int]]:
        first, last = (start["at"], start["path"]), (end["at"], end["path"]) if end else None
        return [f for f in listed(self.path) if first < f[:2] and (last is None or f[:2] <= last)]

    def latestOffset(self) -> dict:
        some = self._between(self.planned)[: self.most_files]
        if some:
            self.planned = {"at": some[-1][0], "path": some[-1][1]}
        return self.planned

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.planned = max(self.planned, end, key=lambda o: (o["at"], o["path"]))
        return parted(self._between(start, end), self.most)

    def read(self, partition: Files | None) -> Iterator[tuple]:
        for path, _ in partition.entries if partition else []:  # without files Spark asks for a partition that is none
            yield from rows_of(path)

    def commit(self, end: dict) -> None:
        pass


class QuillFiles(DataSource):
    """Options: path; partitionBytes, how much a task reads; maxFilesPerTrigger, how many files a micro-batch takes."""

    @classmethod
    def name(cls) -> str:
        return "quill_files"

    def schema(self) -> str:
        return files.DOCUMENT

    def _option(self, name: str, default: int) -> int:
        return int({k.lower(): v for k, v in self.options.items()}.get(name.lower(), default))

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self._option("partitionBytes", PARTITION_BYTES))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], self._option("partitionBytes", PARTITION_BYTES), self._option("maxFilesPerTrigger", 10_000))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(QuillFiles)
