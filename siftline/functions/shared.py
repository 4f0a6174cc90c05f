"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where that is unset and the master local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("siftline.core.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siftline-")
        spark.conf.set("siftline.core.dir", base)
    return base.rstrip("/")


def kept(df: DataFrame, label: str = "kept") -> DataFrame:
    """``df`` written and read again: computed once, with no lineage that a lost executor could unroll."""
    path = f"{folder(df.sparkSession)}/siftline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
