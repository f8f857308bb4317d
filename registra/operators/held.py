"""Cutting a plan with a table written to the shared folder."""

from __future__ import annotations

import atexit
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from registra.session import shared_folder


_FOLDERS: set[str] = set()


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    folder = f"{shared_folder(spark)}/registra/{spark.sparkContext.applicationId}"
    _FOLDERS.add(folder)
    return folder


@atexit.register
def release() -> None:
    """Delete the tables this process has written: called when it ends, or earlier once results are no longer read."""
    while _FOLDERS:
        folder = _FOLDERS.pop()
        system, path = fs.FileSystem.from_uri(folder)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            system.delete_dir(path)


def held(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` once and go on from the files, compressed as the session says unless `compression` is named.

    Lost executors only cost the tasks they were running, the plan behind stays short, and later steps
    see real file sizes. Those of small tables let Spark decide on a broadcast; larger ones are measured when they are shuffled.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)
