"""Session helpers shared by every operator: table loading and lineage cuts that survive executor loss."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's `spark.checkpoint.dir`.

    Only where the master is local, so that executors and driver are one process, may it be unset; elsewhere a folder of
    one machine would lose rows, and this raises.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not path and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return path or os.path.join(tempfile.gettempdir(), "lorewell-shared")


_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """This application's folder in the shared one; it is removed when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark).rstrip('/')}/lorewell-{app}-{uuid.uuid4().hex[:8]}"

        def remove(path: str = _folders[app]) -> None:
            try:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
            except Exception:  # the session may be gone already
                pass

        atexit.register(remove)
    return _folders[app]


def cut(df: DataFrame, read_back: bool = True) -> DataFrame:
    """Write `df` once as a table in the shared folder and continue from it; partitions are not kept.

    The schema is read back from the files, so that a folder that the driver can't see raises. Without `read_back`, which
    takes a job, the files are listed for that.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if read_back:
        return df.sparkSession.read.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if not out.inputFiles():
        raise ValueError(f"the driver can't see the files of {path}")
    return out


def pin(df: DataFrame) -> DataFrame:
    """Write `df` once as a checkpoint in the shared folder and continue from it with the same partitions."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
