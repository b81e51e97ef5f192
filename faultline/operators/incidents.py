"""Error summaries, gap-based incidents, their ranking, and overall health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.rules import intelligence
from faultline.functions.signatures import error_signature, incident_signature, incident_title
from faultline.functions.text import clamp, first_nonblank, nonblank
from faultline.plans.staging import globally_ranked

GAP_SECONDS = 30 * 60
SEVERITY_RANK = {"critical": 0, "error": 1, "warning": 2}
# Health penalty per incident by priority, and status bands.
HEALTH_PENALTY = {"Critical": 25, "High": 10, "Medium": 5, "Low": 1}
HEALTH_BANDS = [(90, "Healthy"), (70, "Degraded"), (40, "Poor")]


def ts_first(df_ts: str = "ts") -> Column:
    """Order key of an entry when a missing stamp sorts first."""
    return F.struct(
        F.col(df_ts).isNotNull(), F.coalesce(F.unix_micros(df_ts), F.lit(0)), "line_number", "source"
    )


def ts_last(df_ts: str = "ts") -> Column:
    """Order key of an entry when a missing stamp sorts last."""
    return F.struct(
        F.col(df_ts).isNull(), F.coalesce(F.unix_micros(df_ts), F.lit(0)), "line_number", "source"
    )


def severity_rank(c: Column) -> Column:
    chain = None
    for name, rank in SEVERITY_RANK.items():
        hit = F.lower(c) == name
        chain = F.when(hit, rank) if chain is None else chain.when(hit, rank)
    return chain.otherwise(3)


def error_summaries(entries: DataFrame) -> DataFrame:
    """One row per error signature with the first entry's texts and a count."""
    keyed = entries.withColumn(
        "signature",
        error_signature(*[F.col(c) for c in ("exception_type", "http_status", "api_path", "raw_content", "message")]),
    )
    grouped = keyed.groupBy("signature").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.min_by(F.struct("message", "exception_type", "http_status"), ts_first()).alias("_first"),
        F.min(ts_first()).alias("first_seen"),
    )
    return grouped.select(
        "signature", "_first.*", "occurrence_count", "first_seen",
    ).withColumn(
        "intelligence",
        intelligence(F.col("message"), F.col("exception_type"), F.col("http_status"), F.col("occurrence_count")),
    )


def summary_order() -> list[Column]:
    return [F.desc("intelligence.priority_score"), F.desc("occurrence_count"), F.asc("first_seen")]


def analysis_summary(entries: DataFrame, total_lines: DataFrame) -> DataFrame:
    """One row: lines, errors, warnings, first and last stamp."""
    totals = entries.agg(
        F.count_if(F.col("severity").isin("Error", "Critical")).alias("error_count"),
        F.count_if(F.col("severity") == "Warning").alias("warning_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    lines = total_lines.agg(F.coalesce(F.sum("total_lines"), F.lit(0)).alias("n")).scalar()
    return totals.withColumn("total_lines", lines)


def with_incident_signature(entries: DataFrame) -> DataFrame:
    fields = ("message", "exception_type", "http_status", "api_path", "server_name", "machine_name",
              "environment", "severity")
    return entries.withColumn("signature", incident_signature(*[F.col(c) for c in fields]))


def _slot() -> Column:
    """Entries of one signature in one slot are never a full gap apart."""
    return F.floor(F.unix_micros("ts") / F.lit(GAP_SECONDS * 1_000_000))


def session_map(keyed: DataFrame) -> DataFrame:
    """``(signature, slot) -> session``; one row per signature and half hour.

    Two entries in the same half-hour slot are less than 30 minutes apart, so a
    slot never splits. Entries are first reduced to slot bounds on the map side;
    only those bounds are ordered, so one hot signature is a short list of slots.
    Rows without a stamp belong to the last session of their signature.
    """
    slots = keyed.groupBy("signature", _slot().alias("slot")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    order = Window.partitionBy("signature").orderBy(F.col("slot").asc_nulls_last())
    gap = F.unix_micros("lo") - F.unix_micros(F.lag("hi").over(order))
    return (
        slots.withColumn("_new", F.coalesce((gap > GAP_SECONDS * 1_000_000).cast("int"), F.lit(0)))
        .withColumn(
            "session",
            F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long"),
        )
        .select("signature", "slot", "session")
    )


def incident_sessions(entries: DataFrame) -> DataFrame:
    """Entries with their incident ``signature`` and ``session`` number."""
    keyed = with_incident_signature(entries).withColumn("slot", _slot())
    sessions = session_map(keyed).select(
        F.col("signature").alias("_s"), F.col("slot").alias("_slot"), "session"
    )
    return keyed.join(
        sessions,
        (F.col("signature") == F.col("_s")) & F.col("slot").eqNullSafe(F.col("_slot")),
        "inner",
    ).drop("_s", "_slot", "slot")


def representative_order() -> Column:
    """Worst severity, highest status, with an exception, then earliest."""
    return F.struct(
        severity_rank(F.col("severity")),
        -F.coalesce("http_status", F.lit(0)),
        ~nonblank(F.col("exception_type")),
        ts_last(),
    )


def _first_where(value: Column, present: Column) -> Column:
    return F.min_by(value, F.when(present, ts_last()))


def incident_aggregates() -> list[Column]:
    server = first_nonblank(F.col("server_name"), F.col("machine_name"))
    first = {
        "exception_type": F.col("exception_type"),
        "api_path": F.col("api_path"),
        "server_name": server,
        "environment": F.col("environment"),
    }
    cid = F.col("correlation_id")
    key = F.when(nonblank(cid), F.lower(cid))
    return [
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count(F.lit(1)).alias("entry_count"),
        F.min_by(F.col("severity"), F.struct(severity_rank(F.col("severity")), ts_last())).alias("severity"),
        _first_where(F.col("http_status"), F.col("http_status").isNotNull()).alias("http_status"),
        *[F.coalesce(_first_where(v, nonblank(v)), F.lit("")).alias(n) for n, v in first.items()],
        F.min_by(
            F.struct("message", "exception_type", "http_status", "api_path", "severity", "source", "line_number"),
            representative_order(),
        ).alias("representative"),
        F.when(F.min(key).isNull(), "")
        .when(F.min(key) == F.max(key), _first_where(cid, nonblank(cid)))
        .otherwise("Multiple")
        .alias("correlation_id"),
    ]


def incidents(sessions: DataFrame) -> DataFrame:
    """One row per (signature, session); unranked."""
    rep = F.col("representative")
    return (
        sessions.groupBy("signature", "session")
        .agg(*incident_aggregates())
        .withColumn(
            "title",
            incident_title(rep["message"], rep["exception_type"], rep["http_status"], rep["api_path"], rep["severity"]),
        )
        .withColumn(
            "intelligence",
            intelligence(rep["message"], rep["exception_type"], rep["http_status"], F.col("entry_count")),
        )
        .withColumn("duration", F.col("ended_at") - F.col("started_at"))
    )


def incident_ranking(found: DataFrame) -> DataFrame:
    """Number incidents ``INC-0001``... by score, count, start."""
    order = [
        F.desc("intelligence.priority_score"), F.desc("entry_count"), F.asc_nulls_first("started_at"),
        F.asc("signature"), F.asc("session")]
    ranked = globally_ranked(found, order, "incident_no", "incident_order")
    number = F.col("incident_no").cast("string")
    return ranked.withColumn(
        "incident_id",
        F.concat(F.lit("INC-"), F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0"))),
    )


def _mode(found: DataFrame, column: str) -> DataFrame:
    """Most frequent non-blank value, first ranked on a tie."""
    counted = (
        found.filter(nonblank(F.col(column)))
        .groupBy(F.col(column).alias("v"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("incident_no").alias("first_no"))
    )
    return counted.agg(F.max_by("v", F.struct(F.col("n"), -F.col("first_no"))).alias("v"))


def application_health(ranked: DataFrame) -> DataFrame:
    """One row of counts, score, status, modes and mean duration (seconds)."""
    priority = F.col("intelligence.priority")
    seconds = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / F.lit(1_000_000)
    counts = ranked.agg(
        F.count(F.lit(1)).alias("active_incidents"),
        *[F.count_if(priority == p).alias(f"{p.lower()}_incidents") for p in HEALTH_PENALTY],
        F.coalesce(F.avg(seconds), F.lit(0.0)).alias("average_duration_seconds"),
    )
    penalty = sum(F.col(f"{p.lower()}_incidents") * n for p, n in HEALTH_PENALTY.items())
    score = clamp(F.lit(100) - penalty, 0, 100).cast("int")
    status = None
    for low, name in HEALTH_BANDS:
        hit = F.col("health_score") >= low
        status = F.when(hit, name) if status is None else status.when(hit, name)
    return counts.withColumn("health_score", score).withColumns(
        {
            "status": status.otherwise("Critical"),
            "most_impacted_server": F.coalesce(_mode(ranked, "server_name").scalar(), F.lit("-")),
            "most_impacted_api": F.coalesce(_mode(ranked, "api_path").scalar(), F.lit("-")),
            "most_common_exception": F.coalesce(_mode(ranked, "exception_type").scalar(), F.lit("-")),
        }
    )
