"""Tables between the rounds of an iteration: written to the shared folder of spark.checkpoint.dir, so that plans stay
small and lost executors cost a reread only."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    out = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not out:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # on a cluster each machine would write to its own disk
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        out = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", out)
    return out.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{root(df.sparkSession)}/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._round_path = path
    return out


def dropped(df: DataFrame) -> None:
    if path := getattr(df, "_round_path", None):
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
