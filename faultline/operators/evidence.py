"""Evidence of an incident: representative entries and related error patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.signatures import evidence_signature
from faultline.functions.text import first_nonblank, nonblank
from faultline.operators.incidents import ts_first

EVIDENCE_DEFAULT, EVIDENCE_MAX = 10, 25
PATTERN_LIMIT = 10


def _time_key() -> Column:
    return ts_first().alias("t")


def representative_evidence(entries: DataFrame, limit: int = EVIDENCE_DEFAULT) -> DataFrame:
    """Up to ``limit`` telling entries per incident, numbered by time.

    Slots (first, last, first with stack, first 5xx, first critical, first with
    correlation id) come first, then one entry per evidence signature by
    frequency, then entries in order. Each list is reduced to at most ``limit``
    rows per incident before it is shuffled, so a huge incident stays cheap.
    """
    if limit < 1:
        raise ValueError("at least one entry of evidence is needed")
    listed = max(limit, EVIDENCE_MAX)
    keyed = entries.select(
        "incident_id", "source", "line_number", _time_key(),
        nonblank(F.col("stack_trace")).alias("has_stack"),
        F.coalesce(F.col("http_status") >= 500, F.lit(False)).alias("failed"),
        (F.lower("severity") == "critical").alias("critical"),
        nonblank(F.col("correlation_id")).alias("has_id"),
        evidence_signature(*[F.col(c) for c in ("exception_type", "http_status", "api_path", "message")]).alias("sig"))
    entry = F.struct("source", "line_number", "t")
    first = lambda cond=None: F.min_by(entry, F.col("t") if cond is None else F.when(F.col(cond), F.col("t")))
    slots = keyed.groupBy("incident_id").agg(F.array(
        first(), F.max_by(entry, "t"), first("has_stack"), first("failed"), first("critical"), first("has_id")).alias("s"))
    slot_rows = slots.select("incident_id", F.posexplode("s").alias("slot", "e")).filter("e IS NOT NULL").select(
        "incident_id", "e.*", F.struct(F.lit(0).alias("kind"), F.col("slot").cast("long").alias("n"), F.col("e.t").alias("o")).alias("key"))
    by_frequency = Window.partitionBy("incident_id").orderBy(F.desc("n"), "e.t")
    group_rows = (
        keyed.groupBy("incident_id", "sig").agg(F.count(F.lit(1)).alias("n"), F.min_by(entry, "t").alias("e"))
        .withColumn("rn", F.row_number().over(by_frequency)).filter(F.col("rn") <= listed)
        .select("incident_id", "e.*", F.struct(F.lit(1).alias("kind"), (-F.col("n")).alias("n"), F.col("e.t").alias("o")).alias("key")))
    by_time = Window.partitionBy("incident_id").orderBy("t")
    fill_rows = (
        keyed.select("incident_id", "source", "line_number", "t")
        .withColumn("rn", F.row_number().over(by_time)).filter(F.col("rn") <= listed)
        .select("incident_id", "source", "line_number", "t", F.struct(F.lit(2).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("t").alias("o")).alias("key")))
    candidates = (
        slot_rows.unionByName(group_rows).unionByName(fill_rows)
        .groupBy("incident_id", "source", "line_number").agg(F.min("key").alias("key"), F.first("t").alias("t")))
    whole = Window.partitionBy("incident_id")
    chosen = (
        candidates.withColumn("slots", F.count_if(F.col("key.kind") == 0).over(whole))
        .withColumn("rn", F.row_number().over(whole.orderBy("key")))
        .filter(F.col("rn") <= F.greatest("slots", F.lit(limit)))
        .withColumn("evidence_no", F.row_number().over(whole.orderBy("t")))
        .filter(F.col("evidence_no") <= limit)
        .select("incident_id", "source", "line_number", "evidence_no"))
    return entries.join(chosen, ["incident_id", "source", "line_number"])


def evidence_environment(incidents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Environment of the incident, otherwise the first one its evidence names."""
    named = evidence.groupBy("incident_id").agg(
        F.min_by("environment", F.when(nonblank(F.col("environment")), F.col("evidence_no"))).alias("_env"))
    return incidents.select("incident_id", "environment").join(named, "incident_id", "left").select(
        "incident_id", first_nonblank(F.col("environment"), F.col("_env")).alias("environment"))


def error_pattern_match(incidents: DataFrame, summaries: DataFrame, limit: int = PATTERN_LIMIT) -> DataFrame:
    """The most frequent patterns whose exception and status fit an incident.

    A pattern without exception fits any; statuses must agree only when both are
    known. Every way to fit is an equality on (exception, status), so patterns are
    first cut to the best ten per such key and then joined by equality.
    """
    every = F.lit("*")
    status = F.coalesce(F.col("http_status").cast("string"), F.lit(""))
    rank = ["occurrence_count", "priority_score", "first_seen"]
    patterns = summaries.select(
        F.lower("exception_type").alias("exc"), F.explode(F.array(status, every)).alias("st"),
        F.col("signature").alias("pattern"), "message", "exception_type", "http_status", "occurrence_count",
        F.col("intelligence.priority_score").alias("priority_score"), "first_seen")
    order = [F.desc("occurrence_count"), F.desc("priority_score"), F.asc("first_seen")]
    best = (
        patterns.withColumn("rn", F.row_number().over(Window.partitionBy("exc", "st").orderBy(*order)))
        .filter(F.col("rn") <= limit).drop("rn"))
    wanted_exc = F.array_distinct(F.array(F.lit(""), F.lower("exception_type")))
    wanted_st = F.when(F.col("http_status").isNull(), F.array(every)).otherwise(
        F.array(F.lit(""), F.col("http_status").cast("string")))
    keys = incidents.select("incident_id", F.explode(wanted_exc).alias("exc"), wanted_st.alias("s")).select(
        "incident_id", "exc", F.explode("s").alias("st"))
    return (
        keys.join(best, ["exc", "st"])
        .withColumn("pattern_no", F.row_number().over(Window.partitionBy("incident_id").orderBy(*order)))
        .filter(F.col("pattern_no") <= limit)
        .select("incident_id", "pattern_no", "pattern", "message", "exception_type", "http_status", *rank[:1]))
