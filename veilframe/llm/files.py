"""Files that executors write and read themselves, in any file system that pyarrow knows."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext


def locate(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified folder, and its path there."""
    scheme, colon, path = folder.partition(":")
    if not colon:
        raise ValueError(f"{folder!r} names no file system; see common.qualified")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(folder)


def attempt_name(kind: str, suffix: str) -> str:
    """A name no other attempt of any task has: a lost or doubled attempt can't touch the file of the
    one whose rows are kept, and only those rows name a file."""
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():06d}-{task.taskAttemptId()}.{suffix}"
