"""Where plans keep what they write: the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from gavel.sources.landed import local


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only for a local master without it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gavel-")
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def dealt_out(rows: DataFrame, key: str) -> DataFrame:
    """The rows in as many partitions as keep all cores busy: a small file of many rows is else a few tasks, however much is done to each."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), key)


@contextmanager
def kept(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """The tables kept on disk within the block, in the partitions that they are in: joins and groups by these don't shuffle them again.

    A plan that adapts while it runs doesn't say beforehand how its rows will lie, so these don't.
    """
    spark, adapts = tables[0].sparkSession, "spark.sql.adaptive.enabled"
    before = spark.conf.get(adapts)
    spark.conf.set(adapts, "false")
    try:
        found = [df.persist(StorageLevel.DISK_ONLY) for df in tables]
    finally:
        spark.conf.set(adapts, before)
    try:
        yield found
    finally:
        for df in found:
            df.unpersist()


def landed_files(files: DataFrame, folder: str) -> None:
    """Write each row's ``body``, text or bytes, to the file of its ``name``, which may begin with a folder, in a mounted folder, inside tasks."""
    path = local(folder)
    os.makedirs(path, exist_ok=True)

    def put(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = {""}
        for part in parts:
            for inner in {os.path.dirname(name) for name in part["name"]} - made:
                os.makedirs(os.path.join(path, inner), exist_ok=True)
                made.add(inner)
            for name, body in zip(part["name"], part["body"], strict=True):
                with open(os.path.join(path, name), "wb") as f:
                    f.write(body.encode() if isinstance(body, str) else body)
            yield part[["name"]]

    files.select("name", "body").mapInPandas(put, "name string").write.format("noop").mode("overwrite").save()
