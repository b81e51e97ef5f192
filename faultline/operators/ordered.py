"""Order-dependent helpers that never put one whole key into one task.

A log can be one huge file, so a plain ``partitionBy(source).orderBy(line)``
window would give one task a third of the data. Lines are numbered uniquely
inside a source, so cutting them into blocks of ``BLOCK`` line numbers bounds
every window partition; only one summary row per block is then carried across.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 65536


def with_last_value(
    df: DataFrame, source: str, order: str, values: dict[str, str], block: int = BLOCK
) -> DataFrame:
    """Add, per ``out: column``, the last non-null value at or before each row."""
    blk = F.floor(F.col(order) / F.lit(block))
    local = (
        Window.partitionBy(source, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    rows = df.withColumn("_blk", blk)
    tails = rows.groupBy(source, "_blk").agg(
        *[
            F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_tail_{out}")
            for out, c in values.items()
        ]
    )
    earlier = (
        Window.partitionBy(source).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = tails.select(
        source,
        "_blk",
        *[F.last(f"_tail_{out}", True).over(earlier).alias(f"_carry_{out}") for out in values],
    )
    local_rows = rows.withColumns(
        {f"_local_{out}": F.last(c, True).over(local) for out, c in values.items()}
    )
    return (
        local_rows.join(carried, [source, "_blk"], "left")
        .withColumns(
            {out: F.coalesce(f"_local_{out}", f"_carry_{out}") for out in values}
        )
        .drop("_blk", *[f"_local_{o}" for o in values], *[f"_carry_{o}" for o in values])
    )
