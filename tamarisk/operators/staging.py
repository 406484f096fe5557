"""Tables settled on the shared file system, so that later jobs read them and lost executors cost nothing but their tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, plain: bool = False, rows: int = 0) -> DataFrame:
    """df written as Parquet below spark.checkpoint.dir and read back; on local masters without one, below a temporary folder.

    A table that is read has the size of its files, where a checkpoint keeps its plan's estimate, which self-joins square.
    `plain` leaves out Parquet's dictionaries, which put tens of millions of narrow rows into one split of the files.
    `rows`: the most that a file gets, where there is a bound. Files that share a split count with 4 MB each besides their
    size, so a split of 128 MB has at most 32 of them, however well their rows are packed.
    """
    spark = df.sparkSession
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tamarisk-")
        spark.conf.set("spark.checkpoint.dir", folder)
    path = f"{folder}/settled-{uuid.uuid4().hex}"
    df.write.option("parquet.enable.dictionary", not plain).option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
