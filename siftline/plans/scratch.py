"""Where intermediate tables go."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new path under the cluster's shared checkpoint folder.

    Only a session on one machine, as in tests, may leave that unset and gets a
    local folder; on a cluster other machines would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="siftline-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file of a query's own, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of tables that nothing refers to any more.

    It does so once the driver has collected its garbage, which otherwise may be
    long after the next step has filled the disk.
    """
    gc.collect()
    spark._jvm.System.gc()
