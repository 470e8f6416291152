"""Tables that a plan reads again and again, written once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What one broadcast may weigh.
MAX_BROADCAST_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only where that is unset in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def tabled(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: smaller than ``settled`` where texts are long, and read by columns."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def light(df: DataFrame, *texts: str) -> bool:
    """Whether a stored ``df``, whose bytes are mostly those of ``texts``, may be broadcast."""
    weight = df.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(64)))).first()[0] or 0
    return weight <= MAX_BROADCAST_BYTES
