"""Correlation of entries: a time-band self-join with a score.

Two sources of candidates, together exact and never quadratic:

* ``near``: entries at most 20 lines apart. Lines are unique in a source, so an
  entry has at most 40 of them. This also is the whole rule for entries without
  a stamp, and the only place where the line bonus applies.
* ``far``: stamped entries further apart. Their score depends only on *which*
  fields agree, so the nearest 20 lines on either side that agree on a set of
  fields and lie in the band contain everything the ranking can ask for
  (``band_search``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.signatures import correlation_group
from faultline.functions.text import first_nonblank, nonblank
from faultline.operators.band_search import far_pairs
from faultline.operators.ordered import BLOCK

WINDOW_SECONDS = 120
NEAR_LINES = 20
FULL_SCORE = 100
RELATED_LIMIT = 20
RELATED_SCORE = 40
# Points per agreeing field; bonus by line distance.
POINTS = {"cid": 100, "api": 35, "exc": 25, "srv": 20, "status": 20, "usr": 15, "env": 10}
LINE_BONUS = [(5, 20), (20, 10)]
FILLED = ["correlation_id", "api_path", "request_url", "server_name", "machine_name",
          "environment", "user_name"]


def match_keys(entries: DataFrame) -> DataFrame:
    """Narrow table of what the score compares; blanks become null."""
    def key(c: Column) -> Column:
        return F.when(nonblank(c), F.lower(c))

    return entries.select(
        "source",
        F.col("line_number").alias("line"),
        F.unix_micros("ts").alias("t"),
        key(F.col("correlation_id")).alias("cid"),
        key(F.col("api_path")).alias("api"),
        key(F.col("exception_type")).alias("exc"),
        key(first_nonblank(F.col("server_name"), F.col("machine_name"))).alias("srv"),
        F.col("http_status").cast("string").alias("status"),
        key(F.col("user_name")).alias("usr"),
        key(F.col("environment")).alias("env"),
    )


def _renamed(keys: DataFrame, prefix: str) -> DataFrame:
    return keys.select(*[F.col(c).alias(prefix + c) for c in keys.columns])


def line_bonus(distance: Column) -> Column:
    chain = None
    for limit, bonus in LINE_BONUS:
        chain = F.when(distance <= limit, bonus) if chain is None else chain.when(distance <= limit, bonus)
    return chain.otherwise(0)


def pair_score(left: str = "a_", right: str = "b_") -> Column:
    points = sum(
        F.when(F.col(left + k) == F.col(right + k), p).otherwise(0) for k, p in POINTS.items()
    )
    distance = F.abs(F.col(left + "line") - F.col(right + "line"))
    return F.least(points + line_bonus(distance), F.lit(FULL_SCORE)).cast("int")


def _in_band() -> Column:
    return F.abs(F.col("a_t") - F.col("b_t")) <= WINDOW_SECONDS * 1_000_000


def _ranked(scored: DataFrame) -> DataFrame:
    """Keep the best 20 per entry; the limit applies before the shuffle."""
    order = Window.partitionBy("source", "line").orderBy(
        F.desc("score"), F.asc("distance"), F.asc_nulls_first("other_t"), F.asc("other"))
    return (
        scored.filter(F.col("score") > 0)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= RELATED_LIMIT)
    )


def near_pairs(keys: DataFrame) -> DataFrame:
    """Pairs at most 20 lines apart that the time rule allows."""
    cell = F.floor(F.col("line") / F.lit(NEAR_LINES))
    a = _renamed(keys, "a_").withColumn(
        "_cell", F.explode(F.array(*[F.floor(F.col("a_line") / F.lit(NEAR_LINES)) + d for d in (-1, 0, 1)])))
    b = _renamed(keys.withColumn("cell", cell), "b_")
    both = F.col("a_t").isNotNull() & F.col("b_t").isNotNull()
    distance = F.abs(F.col("a_line") - F.col("b_line"))
    return a.join(
        b,
        (F.col("a_source") == F.col("b_source")) & (F.col("_cell") == F.col("b_cell"))
        & (distance > 0) & (distance <= NEAR_LINES) & (~both | _in_band()),
    )


def candidates(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Best 20 candidates of every entry: ``source, line, other, score, position``."""
    keys = match_keys(entries)
    near = near_pairs(keys).select(
        F.col("a_source").alias("source"), F.col("a_line").alias("line"), F.col("b_line").alias("other"), F.col("b_t").alias("other_t"),
        pair_score().alias("score"), F.abs(F.col("a_line") - F.col("b_line")).alias("distance"))
    far = far_pairs(keys, POINTS, FULL_SCORE, WINDOW_SECONDS, RELATED_LIMIT, NEAR_LINES, block)
    return _ranked(near.unionByName(far))


def correlate(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Entries with blanks filled from the best candidate, group, confidence, related lines."""
    ranked = candidates(entries, block)
    per_entry = ranked.groupBy("source", "line").agg(
        F.max(F.when(F.col("position") == 1, F.col("other"))).alias("_best_line"),
        F.max(F.when(F.col("position") == 1, F.col("score"))).alias("_best_score"),
        F.array_sort(F.collect_list(F.when(F.col("score") >= RELATED_SCORE, F.col("other")))).alias("related_lines"),
    )
    donors = entries.select(
        F.col("source").alias("_d_source"), F.col("line_number").alias("_d_line"),
        *[F.col(c).alias(f"_d_{c}") for c in FILLED])
    best = per_entry.join(
        donors, (F.col("source") == F.col("_d_source")) & (F.col("_best_line") == F.col("_d_line")), "left"
    ).withColumnRenamed("line", "line_number").drop("_d_source", "_d_line", "_best_line")
    merged = entries.join(best, ["source", "line_number"], "left")
    filled = merged.withColumns({c: first_nonblank(F.col(c), F.col(f"_d_{c}")) for c in FILLED})
    return filled.withColumns({
        "correlation_confidence": F.coalesce("_best_score", F.lit(0)),
        "related_lines": F.coalesce("related_lines", F.array().cast("array<bigint>")),
        "correlation_group": correlation_group(
            *[F.col(c) for c in ("correlation_id", "api_path", "server_name", "machine_name",
                                 "environment", "exception_type", "http_status")]),
    }).drop("_best_score", *[f"_d_{c}" for c in FILLED])
