"""Folder moves through the Hadoop file system of the target path."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; one that is not there is fine, one that stays is an error."""
    fs, target = _fs(spark, path)
    fs.delete(target, True)
    if fs.exists(target):
        raise OSError(f"{path} could not be deleted")


def move(spark: SparkSession, source: str, target: str) -> None:
    fs, src = _fs(spark, source)
    _, dst = _fs(spark, target)
    if dst.getParent() is not None:
        fs.mkdirs(dst.getParent())
    if not fs.rename(src, dst):
        raise OSError(f"cannot move {source} to {target}")


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return sorted(s.getPath().toString() for s in fs.listStatus(target))


@contextmanager
def staging(spark: SparkSession, path: str) -> Iterator[str]:
    """A sibling folder to write to; it is removed again if the write fails."""
    parent, _, name = path.rstrip("/").rpartition("/")
    staged = f"{parent}/_staged_{name}_{uuid.uuid4().hex}"
    try:
        yield staged
    except BaseException:
        remove(spark, staged)
        raise


def publish_new(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write to a staged folder and move it to ``path``, which must not exist yet."""
    if path_exists(spark, path):
        raise FileExistsError(path)
    with staging(spark, path) as staged:
        write(staged)
        move(spark, staged, path)
    return path


def publish_swap(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Write to a staged folder, then put it in the place of ``path``.

    The old data stays until the new write has succeeded and comes back if the move fails.
    """
    with staging(spark, path) as staged:
        write(staged)
        if not path_exists(spark, path):
            move(spark, staged, path)
            return path
        old = f"{staged}_old"
        move(spark, path, old)
        try:
            move(spark, staged, path)
        except BaseException:
            move(spark, old, path)
            raise
    remove(spark, old)
    return path


def publish_together(spark: SparkSession, writes: dict[str, Callable[[str], None]], truncate: bool) -> None:
    """Write several folders, then replace or extend those at the given paths, all or none.

    Nothing moves before everything is written; if a move fails, the earlier ones are undone. Readers may see the
    moment between two moves; :class:`granary.sinks.snapshots.Snapshots` has no such moment.
    """
    done: list[tuple[str, str]] = []

    def step(source: str, target: str) -> None:
        move(spark, source, target)
        done.append((source, target))

    with ExitStack() as stack:
        staged = {path: stack.enter_context(staging(spark, path)) for path in writes}
        for path, write in writes.items():
            write(staged[path])
        try:
            for path, folder in staged.items():
                if not path_exists(spark, path):
                    step(folder, path)
                elif truncate:
                    step(path, f"{folder}_old")
                    step(folder, path)
                else:
                    for file in children(spark, folder):
                        name = file.rpartition("/")[2]
                        if name.startswith("part-"):
                            step(file, f"{path.rstrip('/')}/{name}")
        except BaseException:
            for source, target in reversed(done):
                move(spark, target, source)
            raise
    for folder in staged.values():
        remove(spark, f"{folder}_old")
        remove(spark, folder)
