"""The folder that driver and executors share, and tables staged in it.

Staging cuts lineage with files that outlive any executor. The folder comes from ``spark.checkpoint.dir``;
a temporary one is made only where the session names none, as in tests on one machine.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch for operators that hand whole texts to Python.
TEXT_BATCH_ROWS, TEXT_BATCH_BYTES = 1000, 16 << 20
_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/factloom/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_remove_all)
    _staged.append((spark, path))
    return path


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe against lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Remove a staged table that no later plan reads."""
    path = getattr(df, "staged_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _remove_all() -> None:
    for spark, path in _staged:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone; the folder belongs to the cluster's own clean-up then
            return


def text_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in rows and, as texts may be very long, in bytes. Holds for the session's
    later queries, which don't depend on it."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", TEXT_BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) > most:
            spark.conf.set(key, str(most))


def packed(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct ``row``, so that no name of theirs clashes with one of an operator."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
