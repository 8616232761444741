"""Writing and reading whole files of own formats in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from quarry.session import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder's URI under ``spark.checkpoint.dir``, made here on the driver."""
    base = shared_dir(spark).rstrip("/")
    uri = f"{base}/{kind}-{uuid.uuid4().hex}"
    fs, path = open_fs(uri)
    fs.create_dir(path, recursive=True)
    return uri


def open_fs(uri: str):
    """(file system, path in it) of a URI; a plain path is local."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), uri.removeprefix("file:").replace("//", "", 1) if uri.startswith("file://") else uri[5:]
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """Written under a name of this attempt, then renamed: a retried task replaces the file whole."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, base = open_fs(folder)
        self.final = f"{base}/{name}"
        self.draft = f"{base}/.{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.draft)
        self.size = 0

    def write(self, data: bytes) -> int:
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.fs.move(self.draft, self.final)
        return self.final


def open_input(folder: str, name: str):
    fs, base = open_fs(folder)
    return fs.open_input_file(f"{base}/{name}")
