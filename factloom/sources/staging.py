"""Tables written to the folder that driver and executors share, to cut the lineage of loops."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a session on one machine may leave it open."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back. The files go when the driver ends, or with :func:`dropped`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom/loop-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_drop_all)
    _left.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of a staged table that no later plan reads."""
    _remove(df.sparkSession, df.staged_path)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_all() -> None:
    for spark, path in _left:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone; the folder is the cluster's to clean then
            return
