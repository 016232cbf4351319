"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.storage import new_folder

#: A word is a longest run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a stage table as Parquet in the shared folder and read it back.

    Cuts lineage: what was written outlives any executor. Compressed, so smaller than a checkpoint.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


#: Rows at a time between Spark and Python where texts are sent; texts run to hundreds of kilobytes.
BATCH_ROWS = 1000
#: Settings by which an idle worker gives the memory of its last batches back.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after getting its session ready for Python workers.

    Arrow batches are lowered to BATCH_ROWS rows, which bounds a worker's memory, workers give memory
    back after a batch, and they look for this package where the driver found it.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [path for path in environment.get("PYTHONPATH", "").split(os.pathsep) if path]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    for setting, value in WORKER_MEMORY.items():
        environment.setdefault(setting, value)
    return df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
