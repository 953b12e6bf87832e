"""Small files in any store that Spark reaches, by its Hadoop file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its store."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing if it isn't there."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def create(spark: SparkSession, path: str, text: str) -> None:
    """A new file; an error if it exists."""
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Of the files below a path: their names, sizes and times."""
    fs, p = _fs(spark, path)
    found, todo = [], [p]
    while todo:
        for s in fs.listStatus(todo.pop()):
            if s.isDirectory():
                todo.append(s.getPath())
            else:
                found.append(f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}")
    return ";".join(sorted(found))
