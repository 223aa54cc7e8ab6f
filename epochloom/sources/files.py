"""Small files through Hadoop's file systems, so that any store works."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).
    Where that is unset a local one is made, but only if the whole session runs
    on one machine; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="epochloom-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def stamp(spark: SparkSession, path: str) -> tuple[int, int]:
    """Size and time of change of a file."""
    fs, p = _fs(spark, path)
    found = fs.getFileStatus(p)
    return found.getLen(), found.getModificationTime()


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """A file or a whole folder, between any two stores."""
    (a, p), (b, q) = _fs(spark, source), _fs(spark, target)
    b.mkdirs(q.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{source} could not be copied to {target}")


def listed(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: object) -> None:
    write_text(spark, path, json.dumps(value, indent=2, sort_keys=True, default=str))


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as a whole."""
    return spark.read.text(path, wholetext=True).first()[0]

