"""Queries over plain-text lines: assembly, fields, correlation, incidents, health."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import core_sql  # noqa: F401  (registers the SQL steps)
from checks import fixtures as fx
from checks.registry import check, flat, shared, stamp
from checks.sql import query
from faultline.functions import plain, signatures as sg
from faultline.operators import assemble as asm
from faultline.operators import correlate as corr
from faultline.operators import incidents as inc
from faultline.plans import analysis

ts_sql = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


@shared("plain_entries")
def entries(spark, sf):
    return asm.normalize_plain(fx.log_lines(spark, sf))


@shared("correlated_entries")
def correlated(spark, sf):
    return corr.correlate(entries(spark, sf))


@shared("sessions")
def sessions(spark, sf):
    return inc.incident_sessions(correlated(spark, sf))


@shared("ranked_incidents")
def ranked(spark, sf):
    return inc.incident_ranking(inc.incidents(sessions(spark, sf)))


@check("multiline_events", query("SELECT source, start_line, end_line, primary_line, raw_content FROM raw_events", "raw_events"))
def _(spark, sf):
    return asm.multiline_events(fx.log_lines(spark, sf))


@check("total_lines", query("SELECT 'plain' format, source, max(end_line) total_lines FROM raw_events GROUP BY source UNION ALL SELECT 'read', source, count(*) FROM log_lines GROUP BY source", "raw_events log_lines"))
def _(spark, sf):
    lines = fx.log_lines(spark, sf)
    plain_total = asm.total_lines_plain(asm.multiline_events(lines)).select(F.lit("plain").alias("format"), "source", "total_lines")
    read = asm.total_lines_read(lines).select(F.lit("read").alias("format"), "source", "total_lines")
    return plain_total.unionByName(read)


def classified(spark, sf):
    return asm.classify_plain(asm.multiline_events(fx.log_lines(spark, sf)))


FIELD_SQL = {
    "severity_plain": ("severity", "classed"),
    "exception_type": ("exception_type", "classed"),
    "http_status": ("http_status", "classed"),
    "timestamp_parse": (ts_sql("detected_ts") + " detected_ts", "classed"),
    "timestamp_carry_forward": (ts_sql("ts") + " ts", "classed_gap"),
}


def field_sql(name):
    column, step_name = FIELD_SQL[name]
    return query(f"SELECT source, start_line, {column} FROM {step_name}", step_name)


for _name in ("severity_plain", "exception_type", "http_status"):
    @check(_name, field_sql(_name))
    def _(spark, sf, column=FIELD_SQL[_name][0].replace("severity_plain", "severity")):
        return classified(spark, sf).select("source", "start_line", column)


@check("timestamp_parse", field_sql("timestamp_parse"))
def _(spark, sf):
    events = asm.detect_timestamps(asm.multiline_events(fx.log_lines(spark, sf)))
    return events.select("source", "start_line", stamp("detected_ts").alias("detected_ts"))


@check("timestamp_carry_forward", field_sql("timestamp_carry_forward"))
def _(spark, sf):
    events = asm.detect_timestamps(asm.multiline_events(fx.log_lines_with_gaps(spark, sf)))
    return asm.carry_timestamps(events).select("source", "start_line", stamp("ts").alias("ts"))


@check("relevant_entries", query(
    "SELECT source, severity, count(*) n FROM entries GROUP BY 1, 2", "entries"))
def _(spark, sf):
    return asm.relevant(classified(spark, sf)).groupBy("source", "severity").agg(F.count(F.lit(1)).alias("n"))


PAGE_URL = f"regexp_replace(regexp_extract(url || ' ' || html, '{plain.URL.replace(chr(39), chr(39) * 2)}', 0), '{plain.URL_TRAILING.replace(chr(39), chr(39) * 2)}', '')"


@check("request_url", f"SELECT page_id, {PAGE_URL} request_url FROM pages")
def _(spark, sf):
    content = F.concat_ws(" ", "url", "html")
    return fx.table(spark, sf, "pages").select("page_id", plain.request_url(content).alias("request_url"))


@check("api_path", f"""SELECT page_id, CASE WHEN regexp_matches(u, '{plain.URL_SHAPE}') THEN
    coalesce(nullif(regexp_extract(u, '{plain.URL_PATH}', 1), ''), '/') ELSE '' END api_path
    FROM (SELECT page_id, {PAGE_URL} u FROM pages)""")
def _(spark, sf):
    content = F.concat_ws(" ", "url", "html")
    return fx.table(spark, sf, "pages").select(
        "page_id", plain.api_path(plain.request_url(content)).alias("api_path"))


for _name, _cols in {
    "correlation_id": ["correlation_id"], "server_name": ["server_name"], "machine_name": ["machine_name"],
    "environment": ["environment"], "user_name": ["user_name"], "display_message": ["message"],
    "stack_trace": ["stack_trace"],
}.items():
    @check(_name, query(f"SELECT source, line_number, {', '.join(_cols)} FROM entries", "entries"))
    def _(spark, sf, cols=tuple(_cols)):
        return asm.normalize_plain(fx.log_lines(spark, sf)).select("source", "line_number", *cols)


ENTRY_LIST = ", ".join(ts_sql("ts") + " ts" if c == "ts" else c for c in asm.ENTRY_COLUMNS)


@check("normalize_entries_plain", query(f"SELECT {ENTRY_LIST} FROM entries_gap", "entries_gap"))
def _(spark, sf):
    return asm.normalize_plain(fx.log_lines_with_gaps(spark, sf)).withColumn("ts", stamp("ts"))


@check("correlate_entries", query(
    "SELECT source, line_number, other, score, pos FROM ranked_pairs", "ranked_pairs"))
def _(spark, sf):
    found = corr.candidates(entries(spark, sf))
    return found.select("source", F.col("line").alias("line_number"), "other", "score", F.col("position").alias("pos"))


@check("correlate_entries_crowded", query(
    "SELECT source, line_number, other, score, pos FROM ranked_pairs_crowded", "ranked_pairs_crowded"))
def _(spark, sf):
    day = F.unix_timestamp(F.date_trunc("day", "ts"))
    crowded = entries(spark, sf).withColumn("ts", F.timestamp_seconds(day + F.col("line_number") % 100))
    found = corr.candidates(crowded)
    return found.select("source", F.col("line").alias("line_number"), "other", "score", F.col("position").alias("pos"))


FILLED_SQL = ", ".join(corr.FILLED)


@check("correlation_fill", query(
    f"SELECT source, line_number, {FILLED_SQL}, correlation_confidence FROM correlated", "correlated"))
def _(spark, sf):
    return correlated(spark, sf).select("source", "line_number", *corr.FILLED, "correlation_confidence")


@check("related_lines", query(
    "SELECT source, line_number, array_to_string(related_lines, ';') related_lines FROM correlated", "correlated"))
def _(spark, sf):
    return correlated(spark, sf).select("source", "line_number", flat(F.col("related_lines")).alias("related_lines"))


@check("correlate_entries_unstamped", query(
    "SELECT source, line_number, correlation_confidence, correlation_id, array_to_string(related_lines, ';') related_lines FROM correlated_gap", "correlated_gap"))
def _(spark, sf):
    found = analysis.correlated_entries(asm.normalize_plain(fx.log_lines_with_gaps(spark, sf)))
    return found.select("source", "line_number", "correlation_confidence", "correlation_id",
                        flat(F.col("related_lines")).alias("related_lines"))


@check("correlation_group", query("SELECT source, line_number, correlation_group FROM correlated", "correlated"))
def _(spark, sf):
    return correlated(spark, sf).select("source", "line_number", "correlation_group")


@check("error_signature", query("SELECT source, line_number, esig error_signature FROM signed", "signed"))
def _(spark, sf):
    fields = [F.col(c) for c in ("exception_type", "http_status", "api_path", "raw_content", "message")]
    return correlated(spark, sf).select("source", "line_number", sg.error_signature(*fields).alias("error_signature"))


@check("error_summaries", query("""SELECT signature, message, exception_type, http_status, occurrence_count,
  score priority_score, priority, likely_cause, impact, checks FROM summary_groups""", "summary_groups"))
def _(spark, sf):
    return inc.error_summaries(correlated(spark, sf)).select(
        "signature", "message", "exception_type", "http_status", "occurrence_count",
        "intelligence.priority_score", "intelligence.priority", "intelligence.likely_cause",
        "intelligence.impact", flat(F.col("intelligence.recommended_checks")).alias("checks"))


@check("analysis_summary", query(f"""SELECT count(*) FILTER (WHERE severity IN ('Error','Critical')) error_count,
  count(*) FILTER (WHERE severity='Warning') warning_count, {ts_sql('min(ts)')} first_ts, {ts_sql('max(ts)')} last_ts,
  (SELECT sum(m) FROM (SELECT max(end_line) m FROM raw_events GROUP BY source)) total_lines FROM correlated""", "correlated raw_events"))
def _(spark, sf):
    total = asm.total_lines_plain(asm.multiline_events(fx.log_lines(spark, sf)))
    return inc.analysis_summary(correlated(spark, sf), total).withColumns(
        {"first_ts": stamp("first_ts"), "last_ts": stamp("last_ts")})


@check("incident_signature", query("SELECT source, line_number, signature FROM keyed", "keyed"))
def _(spark, sf):
    return inc.with_incident_signature(correlated(spark, sf)).select("source", "line_number", "signature")


@check("incident_sessions", query("SELECT source, line_number, signature, session FROM sessioned", "sessioned"))
def _(spark, sf):
    return inc.incident_sessions(correlated(spark, sf)).select("source", "line_number", "signature", "session")


@check("incidents", query(f"""SELECT signature, session, title, {ts_sql('started_at')} started_at, {ts_sql('ended_at')} ended_at,
  (epoch_us(ended_at)-epoch_us(started_at))/1000000 AS duration_seconds, severity, entry_count, exception_type, http_status, api_path, server_name,
  environment, correlation_id FROM incident_groups""", "incident_groups"))
def _(spark, sf):
    return inc.incidents(sessions(spark, sf)).select(
        "signature", "session", "title", stamp("started_at").alias("started_at"), stamp("ended_at").alias("ended_at"),
        ((F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1_000_000).alias("duration_seconds"),
        "severity", "entry_count", "exception_type", "http_status", "api_path", "server_name",
        "environment", "correlation_id")


@check("representative_entry", query(
    "SELECT signature, session, rep_source, rep_line, rep_message FROM incident_groups", "incident_groups"))
def _(spark, sf):
    r = F.col("representative")
    return inc.incidents(sessions(spark, sf)).select(
        "signature", "session", r["source"].alias("rep_source"), r["line_number"].alias("rep_line"),
        r["message"].alias("rep_message"))


@check("correlation_value", query(
    "SELECT correlation_id, count(*) incidents FROM incident_groups GROUP BY 1", "incident_groups"))
def _(spark, sf):
    return inc.incidents(sessions(spark, sf)).groupBy("correlation_id").agg(F.count(F.lit(1)).alias("incidents"))


@check("incident_intelligence", query("""SELECT signature, session, score priority_score, priority, likely_cause, impact, checks
  FROM incident_groups""", "incident_groups"))
def _(spark, sf):
    i = F.col("intelligence")
    return inc.incidents(sessions(spark, sf)).select(
        "signature", "session", i["priority_score"].alias("priority_score"), i["priority"].alias("priority"),
        i["likely_cause"].alias("likely_cause"), i["impact"].alias("impact"), flat(i["recommended_checks"]).alias("checks"))


@check("priority", query("SELECT priority, count(*) incidents, min(score) lowest, max(score) highest FROM incident_groups GROUP BY 1", "incident_groups"))
def _(spark, sf):
    return ranked(spark, sf).groupBy(F.col("intelligence.priority").alias("priority")).agg(
        F.count(F.lit(1)).alias("incidents"), F.min("intelligence.priority_score").alias("lowest"),
        F.max("intelligence.priority_score").alias("highest"))


@check("incident_ranking", query(
    "SELECT incident_id, incident_no, signature, session, score, entry_count FROM incidents", "incidents"))
def _(spark, sf):
    return inc.incident_ranking(inc.incidents(sessions(spark, sf))).select(
        "incident_id", "incident_no", "signature", "session", F.col("intelligence.priority_score").alias("score"), "entry_count")


mode_sql = lambda c: f"coalesce((SELECT {c} FROM incidents WHERE {c}<>'' GROUP BY 1 ORDER BY count(*) DESC, min(incident_no) LIMIT 1), '-')"
HEALTH_SQL = query(f"""SELECT *, CASE WHEN health_score>=90 THEN 'Healthy' WHEN health_score>=70 THEN 'Degraded' WHEN health_score>=40 THEN 'Poor' ELSE 'Critical' END status,
  {mode_sql('server_name')} most_impacted_server, {mode_sql('api_path')} most_impacted_api, {mode_sql('exception_type')} most_common_exception
FROM (SELECT *, greatest(0, least(100, 100-25*critical_incidents-10*high_incidents-5*medium_incidents-low_incidents)) health_score FROM (
 SELECT count(*) active_incidents, {', '.join(f"count(*) FILTER (WHERE priority='{p}') {p.lower()}_incidents" for p in inc.HEALTH_PENALTY)},
  round(coalesce(avg((epoch_us(ended_at)-epoch_us(started_at))/1000000), 0), 6) average_duration_seconds FROM incidents))""", "incidents")


@check("application_health", HEALTH_SQL)
def _(spark, sf):
    return inc.application_health(ranked(spark, sf)).withColumn(
        "average_duration_seconds", F.round("average_duration_seconds", 6))


@check("incidents_and_health", HEALTH_SQL)
def incidents_and_health(spark, sf):
    """Flagship: raw lines to health, nothing reused from other queries."""
    return analysis.analyze_plain(fx.log_lines(spark, sf)).health.withColumn(
        "average_duration_seconds", F.round("average_duration_seconds", 6))
