"""A sink that writes one file a row under exact names, all of them or none.

    rows.select("path", "payload").write.format("foliate_files").mode("append").save(folder)

Tasks write below a hidden folder beside the names, each attempt into one of its own; when all have ended well the
files of the attempts that count are moved to their names, over older ones, and when the job fails the hidden folder
is deleted. A run that dies in the middle of moving leaves whole files only, and running it again ends it. folder is a
path or an address of any file system that Arrow knows (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "foliate_files"
#: Files written or moved between looks for folders that are there already.
KNOWN_FOLDERS = 10_000


def file_system(folder: str) -> tuple[afs.FileSystem, str]:
    """Arrow's file system of a folder, and the folder's path there."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]+:", folder):
        system, path = afs.FileSystem.from_uri(folder)
        return system, path.rstrip("/")
    return afs.LocalFileSystem(), folder.rstrip("/")


def below(base: str, path: str) -> str:
    """base/path, which must not lead out of base."""
    target = posixpath.normpath(posixpath.join(base, path))
    if not target.startswith(base + "/"):
        raise ValueError(f"not below {base}: {path}")
    return target


class _Folders:
    """Creates the folders of files, each once."""

    def __init__(self, system: afs.FileSystem):
        self.system, self.known = system, set()

    def for_file(self, target: str) -> None:
        folder = posixpath.dirname(target)
        if folder not in self.known:
            self.system.create_dir(folder, recursive=True)
            if len(self.known) >= KNOWN_FOLDERS:
                self.known.clear()
            self.known.add(folder)


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    files: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.hidden = folder, f".writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, base = file_system(self.folder)
        attempt, folders, n = f"{base}/{self.hidden}/{uuid.uuid4().hex}", _Folders(system), 0
        for batch in iterator:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for path, payload in zip(columns["path"], columns["payload"]):
                below(base, path.as_py())
                target = f"{attempt}/{path.as_py()}"
                folders.for_file(target)
                data = payload.as_py() or b""
                with system.open_output_stream(target) as out:
                    out.write(data if isinstance(data, bytes) else data.encode("utf-8", "surrogatepass"))
                n += 1
        return _Written(attempt, n)

    def commit(self, messages: list[_Written | None]) -> None:
        system, base = file_system(self.folder)
        folders, local = _Folders(system), isinstance(system, afs.LocalFileSystem)
        for message in messages:
            if message is None or not message.files:
                continue
            for info in system.get_file_info(afs.FileSelector(message.attempt, recursive=True)):
                if info.type != afs.FileType.File:
                    continue
                target = below(base, posixpath.relpath(info.path, message.attempt))
                folders.for_file(target)
                if not local and system.get_file_info(target).type == afs.FileType.File:
                    system.delete_file(target)  # a local move replaces
                system.move(info.path, target)
        self._clear(system, base)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, system: afs.FileSystem, base: str) -> None:
        if system.get_file_info(f"{base}/{self.hidden}").type == afs.FileType.Directory:
            system.delete_dir(f"{base}/{self.hidden}")


class ExactFiles(DataSource):
    """Columns path and payload (string or binary); append only, files of the same names are replaced."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, payload binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("files are replaced by name: use mode append")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExactFiles)
