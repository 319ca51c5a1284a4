"""Intermediate tables that cut the lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyframe.errors import ConfigurationError


def scratch_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only in local mode without one."""
    context = spark.sparkContext
    folder = (
        context.getCheckpointDir()
        or spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
    )
    if not folder:
        if not context.master.startswith("local"):
            raise ConfigurationError("set spark.checkpoint.dir to a folder all executors can reach")
        folder = tempfile.mkdtemp(prefix="recon-")
        context.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/recon-{context.applicationId}"


def spread(df: DataFrame, *by: str, light: bool = False) -> DataFrame:
    """`df` dealt over the tasks of the session by columns that tell its rows apart, before work that costs far
    more than moving a row. A scan follows the bytes of its files, and a small file holds many short rows.
    `light`: the rows are so short that adaptive execution would put them together again."""
    if not light:
        return df.repartition(*by)
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


def written(df: DataFrame) -> DataFrame:
    """Write `df` once and read it back.

    What several outputs share is computed once, survives the loss of executors, has exact
    statistics for the joins that follow, and is read column by column.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once nothing reads them any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
