"""Shared storage for intermediate results.

``spark.checkpoint.dir`` names a folder that the driver and every executor can reach.  It is read from
the session; only where it is unset and Spark runs in one process (a local test session) is a temporary folder used instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session, without a trailing slash."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.cloakframe.shared.dir", None)
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("spark.cloakframe.shared.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/cloakframe-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from the files, so a lost
    executor costs no recomputation beyond them, and the plan above is not run again."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a ``cut`` that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, one for each stem (extra columns may clash with ours)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
