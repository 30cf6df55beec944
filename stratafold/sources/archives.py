"""Archives as a data source: a partition for each archive, of which only the directory and the heads of members are read."""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stratafold.sources.packages import archive_members

MEMBERS = "path string, member string, size long, crc long, head binary, escapes boolean, warning string"


class Sought(io.RawIOBase):
    """A remote file as Python reads files: a seek to no place is an OSError, which readers of archives expect."""

    def __init__(self, file: object) -> None:
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        try:
            self.file.seek(at, whence)
        except ValueError as e:
            raise OSError(str(e)) from e
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def readinto(self, into: bytearray) -> int:
        got = self.file.read(len(into))
        into[: len(got)] = got
        return len(got)


class ArchivePart(InputPartition):
    """One archive, or a stretch of its members."""

    def __init__(self, path: str, start: int, stop: int | None) -> None:
        super().__init__((path, start, stop))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.glob = options["path"], options.get("glob", "*.zip")
        self.nested, self.largest = int(options.get("nested", 0)), int(options.get("largest", 256_000_000))
        self.stretch = int(options.get("stretch", 0))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = [info] if info.is_file else files.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(f.path for f in found if f.is_file and (info.is_file or fnmatch.fnmatch(f.base_name, self.glob)))
        parts = []
        for name in names:
            count = self._count(files, name) if self.stretch else 0
            edges = range(0, count, self.stretch) if count > self.stretch > 0 else [0]
            parts += [ArchivePart(name, k, k + self.stretch if count > self.stretch > 0 else None) for k in edges]
        return parts

    @staticmethod
    def _count(files: object, name: str) -> int:
        try:
            with files.open_input_file(name) as f, zipfile.ZipFile(io.BufferedReader(Sought(f))) as z:
                return len(z.infolist())
        except (zipfile.BadZipFile, OSError):
            return 0

    def read(self, partition: ArchivePart | None) -> Iterator[tuple]:
        from pyarrow import fs

        if partition is None:  # no archives
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        path, start, stop = partition.value
        try:
            with files.open_input_file(path) as f:
                yield from archive_members(path, io.BufferedReader(Sought(f)), self.nested, self.largest, start, stop)
        except OSError as e:
            yield path, None, None, None, None, None, str(e)


class ArchiveSource(DataSource):
    """``spark.read.format("archive_members")``: the members of the archives below a folder, as ``explode_archives`` gives them.

    Options: ``glob`` (of file names, ``*.zip``), ``nested`` and ``largest`` as there, and ``stretch``: archives with more
    members are read by several tasks. A task seeks in its archive, so the archive's size does not matter to memory.
    """

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: object) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """(path, member, size, crc, head, escapes, warning) of the files in the archives below ``path``; see ``ArchiveSource``."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_members").options(**options).load(path)
