"""Files in the shared folder, written and range-read by executors through their URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def connect(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


class FolderWriter:
    """Creates uniquely named files below one folder.

    A retried or speculative task writes other names; only names in the manifest its successful
    attempt returns are ever read, so lost executors leave no wrong data.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.fs, self.path = connect(folder)
        self.fs.create_dir(self.path, recursive=True)

    def create(self, suffix: str):
        name = uuid.uuid4().hex + suffix
        return name, self.fs.open_output_stream(f"{self.path}/{name}", compression=None)


def open_file(folder: str, name: str):
    """A seekable reader of one file of a folder."""
    system, path = connect(folder)
    return system.open_input_file(f"{path}/{name}")
