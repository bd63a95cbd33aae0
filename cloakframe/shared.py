"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names, which the driver and every
executor reach.  Only where the setting is missing (a local test session) a temporary folder is used."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.cloakframe.shared.dir", None)
    if not path:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="cloakframe-")
        spark.conf.set("spark.cloakframe.shared.dir", path)
    return path.rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, so that later steps neither repeat nor replan it."""
    path = f"{folder(df.sparkSession)}/cloakframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that was ``kept`` and that nothing reads any more."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.kept_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over at least four partitions for each core: text stages cost far more than dealing the rows.  A file may have all of
    them in one row group, which the number of partitions does not tell."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))
