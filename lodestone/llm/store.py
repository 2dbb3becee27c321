"""Binary files in the shared folder, reached from executors by the folder's URI."""

from __future__ import annotations


def at(uri: str):
    """The file system of a URI or absolute path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    system, path = at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None, buffer_size=1 << 20)


def open_at(uri: str):
    system, path = at(uri)
    return system.open_input_file(path)


def remove(uri: str) -> None:
    system, path = at(uri)
    system.delete_file(path)


def attempt() -> tuple[int, int]:
    """This task's partition and an attempt number that no other attempt has: what names a file safely."""
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId(), task.taskAttemptId()
