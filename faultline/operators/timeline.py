"""Timeline of an incident: consecutive evidence that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import nonblank, norm
from faultline.operators.report import is_unknown, value_or_unknown

GAP_SECONDS = 600
# Points of the timeline confidence; titles by event type.
BASE_POINTS = 30
POINTS = {"exception_type": 20, "message": 10, "correlation_id": 15, "api_path": 5}
STAMP_POINTS = 20
TITLES = {
    "FirstFailure": "First detected failure", "LastObserved": "Last observed failure",
    "CriticalFailure": "Critical failure detected",
}
SHOWN = ["severity", "exception_type", "message", "api_path", "server_name", "correlation_id"]


def timeline_groups(evidence: DataFrame) -> DataFrame:
    """Evidence with ``event_no``: a new event when exception, message or path
    change, or after more than ten minutes. At most 25 rows per incident."""
    rows = evidence.filter(
        F.col("ts").isNotNull() | F.col("line_number").isNotNull() | nonblank(F.col("message"))).withColumns(
        {c: value_or_unknown(F.col(c)) for c in SHOWN})
    order = Window.partitionBy("incident_id").orderBy(F.col("ts").asc_nulls_last(), "line_number", "source")
    changed = None
    for c in ("exception_type", "message", "api_path"):
        diff = norm(F.col(c)) != F.lag(norm(F.col(c))).over(order)
        changed = diff if changed is None else changed | diff
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))
    new = F.coalesce(changed, F.lit(False)) | F.coalesce(gap > GAP_SECONDS * 1_000_000, F.lit(False))
    return (
        rows.withColumns({"_new": new.cast("int"), "place": F.row_number().over(order)})
        .withColumn("event_no", (F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int"))
        .drop("_new"))


def timeline_events(groups: DataFrame) -> DataFrame:
    """One row per event of the timeline."""
    first = F.min_by(F.struct("ts", "line_number", *SHOWN), "place")
    events = groups.groupBy("incident_id", F.col("event_no").alias("sequence")).agg(
        F.count(F.lit(1)).alias("occurrence_count"), first.alias("f")).select(
        "incident_id", "sequence", "occurrence_count", "f.*")
    total = F.max("sequence").over(Window.partitionBy("incident_id"))
    kind = (
        F.when(F.col("sequence") == 1, "FirstFailure").when(F.col("sequence") == total, "LastObserved")
        .when(F.lower("severity") == "critical", "CriticalFailure").otherwise("RepeatedFailure"))
    title = None
    for k, t in TITLES.items():
        hit = F.col("event_type") == k
        title = F.when(hit, t) if title is None else title.when(hit, t)
    score = F.lit(BASE_POINTS) + F.when(F.col("ts").isNotNull(), STAMP_POINTS).otherwise(0)
    for c, p in POINTS.items():
        score = score + F.when(~is_unknown(F.col(c)), p).otherwise(0)
    many = F.concat(
        F.col("message"), F.lit(" This pattern occurred "), F.col("occurrence_count").cast("string"),
        F.lit(" times within the same timeline window."))
    return events.withColumn("event_type", kind).withColumns({
        "title": title.otherwise(F.when(~is_unknown(F.col("exception_type")), F.col("exception_type")).otherwise("Repeated application failure")),
        "description": F.when(F.col("occurrence_count") > 1, many).otherwise(F.col("message")),
        "confidence_score": score})
