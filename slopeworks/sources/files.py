"""What the file formats share: stores, listings, and a writer whose files appear only when all of them are whole."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; ``file:/x`` is how Hadoop writes ``file:///x``."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def listing(path: str, endings: tuple[str, ...]) -> list[str]:
    """Files of a folder with one of the endings, in order, or the file itself; names that begin with _ or . are none of them."""
    system, inside = store(path)
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    below = system.get_file_info(pafs.FileSelector(inside, recursive=True))
    names = sorted(f.path[len(inside) :].lstrip("/") for f in below if f.type == pafs.FileType.File)
    found = [f"{path.rstrip('/')}/{n}" for n in names if n.lower().endswith(endings) and not re.search(r"(^|/)[_.]", n)]
    if not found:
        raise FileNotFoundError(f"no {' or '.join(endings)} in {path}")
    return found


def opened(path: str) -> BinaryIO:
    system, inside = store(path)
    return system.open_input_file(inside)


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Formats for ``spark.read`` and ``df.write``; their classes travel by value, so workers need no copy of this package."""
    import sys

    for name in {s.__module__ for s in sources} | {__name__}:
        cloudpickle.register_pickle_by_value(sys.modules[name])
    for source in sources:
        spark.dataSource.register(source)


@dataclass
class Written(WriterCommitMessage):
    """The files of one task, still under their temporary names."""

    names: list[str]


class FileWriter(DataSourceArrowWriter):
    """Tasks write under a temporary name that no listing shows; only the commit gives the files of the attempts that count their own.

    A format implements ``contents``: names and contents of a task's files.
    """

    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite, self.mark = folder.rstrip("/"), overwrite, uuid.uuid4().hex

    def contents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
        raise NotImplementedError

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, top = store(self.folder)
        attempt, names = f"{top}/_temporary-{self.mark}/{uuid.uuid4().hex}", []
        for name, data in self.contents(batches):
            system.create_dir(attempt, recursive=True)
            with system.open_output_stream(f"{attempt}/{name}", compression=None) as out:
                out.write(data)
            names.append(f"{attempt}/{name}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = store(self.folder)
        system.create_dir(top, recursive=True)
        names = [n for m in messages if m for n in m.names]
        targets = [f"{top}/{n.rsplit('/', 1)[1]}" for n in names]
        if len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError("two tasks wrote a file of the same name: rows of one file have to be in one partition")
        if self.overwrite:
            for old in system.get_file_info(pafs.FileSelector(top)):
                if old.type == pafs.FileType.File:
                    system.delete_file(old.path)
        elif any(f.type != pafs.FileType.NotFound for f in system.get_file_info(targets)):
            self.abort(messages)
            raise FileExistsError(f"{self.folder} has files of these names")
        for name, target in zip(names, targets):
            system.move(name, target)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, top = store(self.folder)
        if system.get_file_info(f"{top}/_temporary-{self.mark}").type != pafs.FileType.NotFound:
            system.delete_dir(f"{top}/_temporary-{self.mark}")
