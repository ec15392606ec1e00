"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Frees a finished query's shuffle files; what is materialised needs them no more.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (as in tests) a
    temporary one is set; a cluster without one is an error.
    """
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        conf = spark.sparkContext.getCheckpointDir()
    if not conf:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="gridskein-")
        spark.sparkContext.setCheckpointDir(conf)
    return conf.rstrip("/")


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session that holds inside the block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, what: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gridskein/{what}-{uuid.uuid4().hex}"
    with setting(spark, _CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._gridskein_path = path
    return stored


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` has written for these frames; nothing that is still to run may read them."""
    for frame in frames:
        path = frame.sparkSession._jvm.org.apache.hadoop.fs.Path(frame._gridskein_path)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
