"""Shared intermediate tables.

Results that feed several branches are written once as Parquet in the folder the
cluster names in ``spark.checkpoint.dir``, so later branches read only their own
columns and a lost executor costs no recomputation of the lineage. Only where the
setting is absent and Spark runs in one process (tests, a laptop) a local temporary
folder is used; on a cluster a missing setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


# Text work is far heavier than its bytes: let small stages keep all cores busy.
# With large inputs these settings change nothing, the advisory size rules there.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
    # At the default of 4 MB for each file, a reading task is given all large files of a staged table of up to some 100 MB.
    "spark.sql.files.openCostInBytes": "64KB",
}


def tune(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="faultline-")
        spark.conf.set(SETTING, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/faultline/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back with column pruning."""
    path = new_folder(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def globally_ranked(df: DataFrame, order: list, out: str, name: str) -> DataFrame:
    """Position 1..n in a total order, without bringing all rows to one task.

    Rows are range-partitioned and written in order; the position is the number of
    rows in earlier files plus the place inside the own file. Only one count per
    file is ever ordered in one place. ``order`` must end in a unique key, so that
    no range can be forced to grow by ties.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)
    rows = spark.read.schema(df.schema).parquet(path).select(
        *df.columns, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    part = F.regexp_extract("_file", r"^part-(\d+)", 1).cast("long")  # as text, part-100000 would come before part-99999
    earlier = Window.orderBy(part, "_file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_file").agg(F.count(F.lit(1)).alias("_n")).select(
        "_file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "_file").withColumn(out, F.col("_offset") + F.col("_row") + 1).drop("_file", "_row", "_offset")
