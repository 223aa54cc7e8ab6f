"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the only separator of words in the contracts.
WHITE = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder driver and executors share, from ``spark.checkpoint.dir``.

    Where that is unset a local folder is made, but only if the whole session
    runs on one machine; on a cluster it must be set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="epochloom-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def encode(text: str) -> bytes:
    """UTF-8 of a text that may hold lone surrogates (never from Parquet)."""
    return text.encode("utf-8", "surrogatepass")


def slices(batches, rows: int = 512):
    """Arrow batches cut into small ones, so that what is made of a batch of
    long texts stays small in a worker."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that extra columns can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
