"""Queries over files and Event Viewer exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.core import ENTRY_LIST, ts_sql
from checks.registry import check, shared, stamp
from checks.sql import q, query, step, strip
from faultline.functions import eventviewer as ev, plain
from faultline.operators import eventviewer as evo
from faultline.plans.staging import new_folder
from faultline.sources import logs
from checks.core_sql import pick
from checks.fixtures import TAILS, URLS

HEADER = "Level\tDate and Time\tSource\tEvent ID\tTask Category"
URL = f"'https://vs.example.com' || {pick(URLS, 'u%4')} || '?id=' || event_id"
_EXC = [t.strip().split(":")[0] for t in TAILS]
_MORE = {
    "error": [f"'Error Type: ' || {pick(_EXC, 'k%4')}",
              "'Error Status Code: ' || CASE k%3 WHEN 0 THEN '500' WHEN 1 THEN '404' ELSE '9' END",
              f"'Error Request Url: ' || {URL}", "'Host Name: APPPRIVSPR1' || (u%3)",
              "'Correlation Id: ' || u || '-' || (k%5)",
              "'   at Shop.Web.Orders.Svc' || (k%4) || '.Run() in Svc.cs:line ' || k"],
    "purchase": [f"""'{{""status"": 404, ""url"": ""https://vs.example.com/vsgateway' || {pick(URLS, 'u%4')} || '""}}'"""],
    "signup": ["'User Name: ' || u", f"'Http failure response for ' || {URL} || ': 503 Service Unavailable'",
               "'Environment: Production'"],
}
step("ev_lines", "ev_base", "\nUNION ALL ".join(
    [f"SELECT DISTINCT 'app-' || (user_id%5) || '.txt' source, 0 line_no, {q(HEADER)} AS value FROM events",
     """SELECT 'app-' || (u%5) || '.txt', event_id*8+1, concat_ws(chr(9),
 CASE WHEN e='error' THEN CASE WHEN k%10=0 THEN 'Critical' ELSE 'Error' END WHEN e='purchase' THEN 'Warning' WHEN e='signup' THEN 'Audit Failure' ELSE 'Information' END,
 strftime(t, '%m/%d/%Y %H:%M:%S'), 'ShopApp' || (u%2), CASE WHEN k%11=0 THEN 'n/a' ELSE cast(k+100 as varchar) END, 'None',
 CASE WHEN k%10=3 THEN '' WHEN e='click' THEN '"isSkipReviewEnabled: true' ELSE '"Operation ""op' || (k%4) || '"" failed' || chr(9) || 'for user ' || u END) FROM ev_base""",
     "SELECT 'app-' || (u%5) || '.txt', event_id*8+8, '\"' FROM ev_base WHERE k%10<>3"]
    + [f"SELECT 'app-' || (u%5) || '.txt', event_id*8+{2 + i}, {t} FROM ev_base WHERE e='{kind}' AND k%10<>3"
       for kind, texts in _MORE.items() for i, t in enumerate(texts)]))

is_header = " AND ".join(f"contains(lower(value), {q(w.lower())})" for w in ev.HEADER_WORDS)
is_record = (f"len(string_split(value, chr(9))) >= 5 AND lower(trim(string_split(value, chr(9))[1])) IN ({', '.join(q(x.lower()) for x in ev.LEVELS)})"
             " AND try_strptime(trim(string_split(value, chr(9))[2]), '%m/%d/%Y %H:%M:%S') IS NOT NULL")
step("ev_marked", "ev_lines", f"""
SELECT *, sum(is_rec) OVER (PARTITION BY source ORDER BY line_no) rec FROM (
 SELECT *, CASE WHEN {is_record} THEN 1 ELSE 0 END is_rec, string_split(value, chr(9)) p FROM ev_lines WHERE NOT ({is_header}))""")
step("ev_records", "ev_marked", f"""
SELECT source, line_number, level, ts, event_source, event_id, task_category,
  {strip("replace(CASE WHEN len(d)>=2 AND d[1]='\"' AND d[-1]='\"' THEN d[2:len(d)-1] ELSE d END, '\"\"', '\"')")} description
FROM (SELECT source, min(line_no) line_number, arg_min(trim(p[1]), line_no) level,
  strptime(trim(arg_min(p[2], line_no)), '%m/%d/%Y %H:%M:%S') ts, arg_min(trim(p[3]), line_no) event_source,
  coalesce(try_cast(arg_min(trim(p[4]), line_no) as int), 0) event_id, arg_min(trim(p[5]), line_no) task_category,
  {strip("string_agg(CASE WHEN is_rec=1 THEN trim(array_to_string(p[6:], chr(9))) ELSE value END, chr(10) ORDER BY line_no)")} d
 FROM ev_marked WHERE rec > 0 GROUP BY source, rec)""")
x = lambda p, g=1: f"regexp_extract(description, {q(p)}, {g})"
all_x = lambda p, g=1: f"regexp_extract_all(description, {q(p)}, {g})"
clean = lambda u: f"regexp_replace(regexp_replace(trim({u}), {q('^' + ev.URL_EDGE)}, ''), {q(ev.URL_EDGE + '$')}, '')"
prefer = lambda urls: f"coalesce(list_filter(list_transform({urls}, lambda u: {clean('u')}), lambda u: contains(lower(u), '/vsgateway/'))[1], {clean(f'{urls}[1]')})"
lines = lambda t: f"list_filter(list_transform(regexp_split_to_array({t}, '[\\r\\n]'), lambda z: {strip('z')}), lambda z: z<>'')"
stack_line = "(starts_with(z, 'at ') OR starts_with(lower(z), '--- end of'))"
meta = "(" + " OR ".join(f"starts_with(lower(z), {q(p.lower())})" for p in ev.METADATA_PREFIXES) + ")"
step("ev_named", "ev_records", f"""
SELECT *, coalesce(nullif({x(ev.EXPLICIT_TYPE)}, ''),
   list_filter({all_x(plain.EXCEPTION, 0)}, lambda z: lower(z) NOT IN ({', '.join(q(w) for w in ev.WRAPPERS)}))[1], {all_x(plain.EXCEPTION, 0)}[1], '') exception_type,
  coalesce(CASE WHEN try_cast({x(ev.EXPLICIT_STATUS)} as int) BETWEEN 100 AND 599 THEN try_cast({x(ev.EXPLICIT_STATUS)} as int) END,
   try_cast({x(ev.JSON_STATUS)} as int), try_cast({x(ev.FAILURE_STATUS)} as int)) http_status,
  coalesce({clean(f"nullif({x(ev.EXPLICIT_URL)}, '')")}, {prefer(all_x(ev.JSON_URL))}, {prefer(all_x(ev.ANY_URL, 0))}, '') request_url,
  {x(ev.CORRELATION_ID)} correlation_id, {x(ev.SERVER_NAME)} server_name,
  coalesce(nullif({x(ev.MACHINE_NAME)}, ''), {x(ev.SERVER_NAME)}) machine_name, {x(ev.USER_NAME)} user_name,
  upper({x(ev.ENVIRONMENT)}) env_key,
  concat_ws(chr(9), level, {ts_sql('ts')}, event_source, event_id, task_category, description) raw_content,
  array_to_string(list_filter({lines('description')}, lambda z: {stack_line}), chr(10)) stack_trace,
  CASE WHEN regexp_matches(description, '(?is)^.+?\\n(?:{'|'.join(ev.METADATA_MARKERS)})')
    THEN regexp_extract(description, '(?is)^(.+?)\\r?\\n(?:{'|'.join(ev.METADATA_MARKERS)})', 1) ELSE description END body
FROM ev_records WHERE regexp_matches(description, '\\S')""")
host = "lower(coalesce(nullif(server_name,''), machine_name))"
envs = " ".join(f"WHEN contains({host}, {q(f.lower())}) THEN {q(e)}" for f, e in plain.ENVIRONMENT_BY_HOST)
path = f"CASE WHEN regexp_matches(request_url, {q(plain.URL_SHAPE)}) THEN coalesce(nullif(regexp_extract(request_url, {q(plain.URL_PATH)}, 1), ''), '/') ELSE '' END"
step("ev_entries", "ev_named", f"""
SELECT *, line_number AS ln,
  CASE WHEN starts_with(lower(description),'outputvalue.value') OR starts_with(lower(description),'isskipreviewenabled:') THEN 'Information'
   WHEN level='Critical' THEN 'Critical' WHEN level='Warning' THEN 'Warning' WHEN level IN ('Error','Audit Failure') OR http_status>=400 THEN 'Error' ELSE 'Information' END severity,
  CASE WHEN contains(lower({path}), '/vsgateway/') THEN substr({path}, strpos(lower({path}), '/vsgateway/')) ELSE {path} END api_path,
  CASE WHEN env_key='PRODUCTION' THEN 'PROD' WHEN env_key<>'' THEN env_key {envs} ELSE '' END environment,
  coalesce(substr(regexp_replace(list_filter({lines('body')}, lambda z: NOT {stack_line} AND NOT {meta})[1], '^"+|"+$', '', 'g'), 1, 600),
    nullif(exception_type, ''), 'Windows Event Viewer event') message
FROM ev_named""")


@shared("ev_entries")
def ev_entries(spark, sf):
    return evo.normalize_eventviewer(fx.ev_lines(spark, sf))


@check("eventviewer_records", query(
    f"SELECT source, line_number, level, {ts_sql('ts')} ts, event_source, event_id, task_category, description FROM ev_records", "ev_records"))
def _(spark, sf):
    return evo.eventviewer_records(fx.ev_lines(spark, sf)).withColumn("ts", stamp("ts"))


@check("normalize_entries_eventviewer", query(f"SELECT {ENTRY_LIST} FROM ev_entries", "ev_entries"))
def _(spark, sf):
    return evo.normalize_eventviewer(fx.ev_lines(spark, sf)).withColumn("ts", stamp("ts"))


for _name, _col in {
    "severity_eventviewer": "severity", "exception_type_eventviewer": "exception_type",
    "http_status_eventviewer": "http_status", "request_url_eventviewer": "request_url",
    "api_path_eventviewer": "api_path", "environment_eventviewer": "environment",
    "display_message_eventviewer": "message", "stack_trace_eventviewer": "stack_trace",
    "rebuild_raw": "raw_content",
}.items():
    @check(_name, query(f"SELECT source, line_number, {_col} FROM ev_entries", "ev_entries"))
    def _(spark, sf, col=_col):
        return ev_entries(spark, sf).select("source", "line_number", col)


def file_name(path):
    return F.concat(F.regexp_extract(path, "source=([^/]+)/", 1), F.lit("/"), F.regexp_extract(path, r"chunk=(\d+)", 1))


NUMBERED = "row_number() OVER (PARTITION BY source, line_no // 200000 ORDER BY line_no)"


@check("log_line_scan", query(
    f"SELECT source || '/' || (line_no // 200000) source, {NUMBERED} line_no, value FROM log_lines", "log_lines"))
def _(spark, sf):
    folder = fx.write_log_files(fx.log_lines(spark, sf), new_folder(spark, "logs"))
    return logs.log_line_scan(spark, folder, file_name)


@check("format_detect", query(f"""SELECT source, CASE WHEN source LIKE '%.log' THEN 'plain' WHEN bool_or({is_header} OR ({is_record})) THEN 'eventviewer' ELSE 'plain' END format
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY line_no) n FROM
    (SELECT * FROM ev_lines UNION ALL SELECT * FROM log_lines UNION ALL SELECT 'txt-' || replace(source, '.log', '.txt'), line_no, value FROM log_lines))
  WHERE n <= 50 GROUP BY source""", "ev_lines log_lines"))
def _(spark, sf):
    plain_lines = fx.log_lines(spark, sf)
    as_txt = plain_lines.withColumn("source", F.concat(F.lit("txt-"), F.replace("source", F.lit(".log"), F.lit(".txt"))))
    lines = fx.ev_lines(spark, sf).unionByName(plain_lines).unionByName(as_txt)
    folder = fx.write_log_files(lines, new_folder(spark, "mixed"), 2_000_000_000)
    return logs.format_detect(logs.log_line_scan(
        spark, folder, lambda p: F.regexp_extract(p, "source=([^/]+)/", 1)))


@check("normalize_entries", query(f"SELECT source, severity, count(*) n FROM (SELECT source, severity FROM ev_entries UNION ALL SELECT source, severity FROM entries) GROUP BY 1, 2", "ev_entries entries"))
def _(spark, sf):
    lines = fx.ev_lines(spark, sf).unionByName(fx.log_lines(spark, sf))
    return logs.normalize_entries(lines).groupBy("source", "severity").agg(F.count(F.lit(1)).alias("n"))
