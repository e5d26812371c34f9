"""Files that tasks write to and read from the shared folder, wherever Arrow can reach it."""

from __future__ import annotations

import uuid

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path for a Spark path such as ``/x``, ``file:/x`` or ``hdfs://host/x``."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def removed(folder: str) -> None:
    """Delete a folder of files that no task will read again."""
    store, root = at(folder)
    store.delete_dir(root)


class NewFile:
    """A file that shows under its name only when whole, so that a repeated task does no harm."""

    def __init__(self, folder: str, name: str):
        self.store, root = at(folder)
        self.path, self.aside = f"{root}/{name}", f"{root}/.{uuid.uuid4().hex}"
        self.store.create_dir(root)
        self.out = self.store.open_output_stream(self.aside)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def finish(self) -> int:
        self.out.close()
        self.store.move(self.aside, self.path)
        return self.size
