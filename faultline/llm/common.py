"""Helpers that several operators share: written intermediate tables and checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.staging import shared_folder

#: A join side is broadcast only when its counted rows stay within this; beyond it Spark plans a shuffle join.
BROADCAST_ROWS = 200_000


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the cluster's shared folder and read it back; this cuts the lineage."""
    path = f"{shared_folder(df.sparkSession)}/llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbers(df: DataFrame, name: str) -> DataFrame:
    """``written`` for rows of a few numbers: an eighth of the shuffle partitions is enough files for them."""
    return written(df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)), name)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows. ``df`` should be a written table of narrow rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores in front until no column has it; column names ignore case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out
