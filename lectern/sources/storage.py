"""Small files and folders on whatever file system a path names, by the session's Hadoop configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    path: str
    is_dir: bool
    changed: int  # milliseconds


def _at(path: str):
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(path: str) -> bool:
    fs, p = _at(path)
    return fs.exists(p)


def entries(path: str) -> list[Entry]:
    """What stands directly in a folder, by name; nothing where there is no such folder."""
    fs, p = _at(path)
    if not fs.exists(p):
        return []
    found = [Entry(s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getModificationTime()) for s in fs.listStatus(p)]
    return sorted(found, key=lambda e: e.name)


def complete(path: str) -> bool:
    """Whether a table was written to its end."""
    return exists(f"{path}/_SUCCESS")


def make_dir(path: str) -> None:
    fs, p = _at(path)
    fs.mkdirs(p)


def delete(path: str) -> None:
    fs, p = _at(path)
    fs.delete(p, True)


def rename(old: str, new: str) -> bool:
    """Whether ``old`` is now ``new``; nothing that is there is replaced."""
    fs, p = _at(old)
    target = _at(new)[1]
    return not fs.exists(target) and fs.rename(p, target)


def write_text(path: str, text: str) -> None:
    """One UTF-8 file, replaced if it is there."""
    fs, p = _at(path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(path: str) -> str:
    fs, p = _at(path)
    with_lines = SparkSession.getActiveSession().read.text(p.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString(), wholetext=True).collect()
    return with_lines[0]["value"] if with_lines else ""
