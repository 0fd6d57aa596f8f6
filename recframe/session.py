"""Making the data source known to a session, and the folder that its executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from recframe.errors import SpecError


def register(spark: SparkSession) -> SparkSession:
    """Register `recframe` and let Python sources take filters; returns the session."""
    from recframe.sources.records import RecordDataSource

    if spark.conf.get("recframe.registered", None) is None:
        spark.dataSource.register(RecordDataSource)
        spark.conf.set("recframe.registered", "true")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Where that is unset a temporary folder serves, but only in local mode: on a cluster each executor would write to its own
    disk and what is read back would be a part, so that is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local"):
            raise SpecError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        base = tempfile.mkdtemp(prefix="recframe-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: fixed for all later passes, whichever executors are lost.

    Catalyst knows its true size, so it broadcasts the table only if that fits spark.sql.autoBroadcastJoinThreshold.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
