"""Queries over investigations: evidence, timeline, reports, facts, guarded reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import core, knowledge as kb
from checks.core import ts_sql
from checks.registry import check, flat, shared, stamp
from checks.sql import norm, q, query, step, strip
from faultline.functions import signatures as sg
from faultline.operators import distill, evidence as ev, incidents as inc, investigation_text as it, report as rp
from faultline.operators.timeline import timeline_events, timeline_groups

APP = "Order Services"

# ---- SQL ------------------------------------------------------------------------------
nb = lambda c: f"coalesce(regexp_matches({c}, '\\S'), false)"
U = lambda c: f"CASE WHEN {nb(c)} THEN {strip(c)} ELSE 'Unknown' END"
unk = lambda c: f"(NOT {nb(c)} OR lower({c}) = 'unknown')"
ignored = lambda c: f"(NOT {nb(c)} OR lower({c}) IN ('unknown', 'none matched', 'not detected'))"
RT = lambda c: f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00'"
clamp = lambda e, lo, hi: f"greatest({lo}, least({hi}, {e}))"


def dl(lst: str) -> str:
    """Distinct trimmed non-blank values of a list."""
    c = f"list_transform(list_filter({lst}, lambda z: {nb('z')}), lambda z: {strip('z')})"
    return f"list_filter({c}, lambda z, i: list_position(list_transform({c}, lambda y: lower(y)), lower(z)) = i)"


step("ie", "sessioned incidents", "SELECT s.*, i.incident_id FROM sessioned s JOIN incidents i USING (signature, session)")
O = "ts NULLS FIRST, line_number, source"
ESIG = f"concat_ws('|', {norm('exception_type')}, coalesce(cast(http_status as varchar),''), {norm('api_path')}, {norm('message')})"
step("ie_ord", "ie", f"""SELECT *, {ESIG} esig, row_number() OVER w o, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC NULLS LAST, line_number DESC, source DESC) ro,
  count(*) OVER (PARTITION BY incident_id, {ESIG}) freq, row_number() OVER (PARTITION BY incident_id, {ESIG} ORDER BY {O}) go
  FROM ie WINDOW w AS (PARTITION BY incident_id ORDER BY {O})""")
slot = lambda cond: f"CASE WHEN {cond} AND o = min(CASE WHEN {cond} THEN o END) OVER (PARTITION BY incident_id) THEN 1 ELSE 0 END"
step("ie_slots", "ie_ord", f"""SELECT *, CASE WHEN o=1 OR ro=1 OR s3=1 OR s4=1 OR s5=1 OR s6=1 THEN 1 ELSE 0 END slotted FROM (
  SELECT *, {slot("stack_trace <> ''")} s3, {slot("coalesce(http_status,0) >= 500")} s4, {slot("severity = 'Critical'")} s5, {slot("correlation_id <> ''")} s6 FROM ie_ord)""")


def evidence_step(name, limit):
    step(name, "ie_slots", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY {O}) evidence_no FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY 1-slotted, CASE WHEN go=1 THEN 0 ELSE 1 END, CASE WHEN go=1 THEN -freq ELSE 0 END, o) pick,
    sum(slotted) OVER (PARTITION BY incident_id) slots FROM ie_slots) WHERE pick <= greatest({limit}, slots)) WHERE evidence_no <= {limit}""")


evidence_step("evidence", 10)
evidence_step("evidence3", 3)
step("patterns", "incidents summary_groups", """SELECT * FROM (
 SELECT i.incident_id, p.signature pattern, p.message, p.exception_type, p.http_status, p.occurrence_count,
  row_number() OVER (PARTITION BY incident_id ORDER BY p.occurrence_count DESC, p.score DESC, p.first_ts NULLS FIRST, p.first_line, p.first_source) pattern_no
 FROM incidents i JOIN summary_groups p ON (p.exception_type = '' OR lower(p.exception_type) = lower(i.exception_type))
  AND (p.http_status IS NULL OR i.http_status IS NULL OR p.http_status = i.http_status)) WHERE pattern_no <= 10""")
step("env", "incidents evidence", """SELECT incident_id, coalesce(nullif(i.environment,''), e.environment, '') environment FROM incidents i LEFT JOIN
 (SELECT incident_id, first(environment ORDER BY evidence_no) environment FROM evidence WHERE environment<>'' GROUP BY 1) e USING (incident_id)""")
nest = lambda label, lst: f"CASE WHEN len({dl(lst)}) > 0 THEN '  {label}:' || chr(10) || '    - ' || array_to_string({dl(lst)}, chr(10) || '    - ') END"


def match_text(name, src, label, kind, nested):
    head = f"'- ' || {strip(label)} || " + (f"' (' || {strip(kind)} || ')' || " if kind else "") + "', Match Score: ' || match_score || '%'"
    parts = ", ".join(nest(n, c) for n, c in nested.items())
    step(name, src, f"SELECT incident_id, string_agg(concat_ws(chr(10), {head}, '  Description: ' || {U('description')}, {parts}), chr(10) ORDER BY rank) t FROM {src} GROUP BY 1")


match_text("t_components", "m_components", "name", "type", {"Match Reasons": "match_reasons", "Dependencies": "dependencies", "Database Objects": "database_objects"})
match_text("t_workflows", "m_workflows", "name", None, {"Match Reasons": "match_reasons", "Workflow Steps": "steps", "Dependencies": "dependencies"})
match_text("t_issues", "m_issues", "title", None, {
    "Match Reasons": "match_reasons", "Likely Causes": "likely_causes", "Investigation Steps": "investigation_steps",
    "Resolution Steps": "resolution_steps", "Suggested Queries": "suggested_queries"})
EV = [("Line", "cast(line_number as varchar)"), ("Timestamp", RT("ts")), ("Severity", "severity"), ("Exception", "exception_type"), ("Message", "message"),
      ("HTTP Status", "cast(http_status as varchar)"), ("API Path", "api_path"), ("Request URL", "request_url"), ("Server", "server_name"),
      ("Machine", "machine_name"), ("Environment", "environment"), ("Correlation ID", "correlation_id"), ("Stack Trace", "stack_trace"), ("Raw Content", "raw_content")]
step("t_evidence", "evidence", f"""SELECT incident_id, count(*) n, string_agg(concat_ws(chr(10), 'Evidence ' || evidence_no || ':',
  {', '.join(f"'  {n}: ' || {U(c)}" for n, c in EV)}, ''), chr(10) ORDER BY evidence_no) t FROM evidence GROUP BY 1""")
step("t_patterns", "patterns", f"""SELECT incident_id, count(*) n, string_agg(concat_ws(chr(10), '- Exception: ' || {U('exception_type')},
  '  HTTP Status: ' || coalesce(cast(http_status as varchar), 'Unknown'), '  Occurrences: ' || occurrence_count, '  Message: ' || {U('message')}), chr(10) ORDER BY pattern_no) t FROM patterns GROUP BY 1""")
R = q(it.RULER)
head = lambda t: f"{R}, {q(t)}, {R}"
INC = [("Incident ID", "i.incident_id"), ("Title", "title"), ("Severity", "severity"), ("Exception", "exception_type"), ("HTTP Status", "cast(http_status as varchar)"),
       ("API Path", "api_path"), ("Server", "server_name"), ("Environment", "i.environment"), ("Correlation ID", "correlation_id"), ("Occurrence Count", "cast(entry_count as varchar)"),
       ("Started At", RT("started_at")), ("Ended At", RT("ended_at"))]
sect = lambda label, c: f"'{label}:' || chr(10) || CASE WHEN coalesce({c},'') = '' THEN '- Unknown' ELSE '- ' || replace({c}, ';', chr(10) || '- ') END"
step("texts", "incidents env rollup t_components t_workflows t_issues t_evidence t_patterns", f"""
SELECT i.incident_id, v.environment, r.confidence_score, coalesce(e.n, 0) evidence_count, coalesce(p.n, 0) pattern_count,
 concat_ws(chr(10), {head('INVESTIGATION REQUEST')}, 'Application: {APP}', 'Environment: ' || {U('v.environment')}, 'Mode: Deep', 'Engineer Question: Unknown', '',
  {head('INCIDENT SUMMARY')}, {', '.join(f"'{n}: ' || {U(c)}" for n, c in INC)}, '',
  {head('APPLICATION CONTEXT')}, 'Application: {APP}', 'Context Confidence: ' || r.confidence_score || '%',
  {sect('Dependencies', 'r.dependencies')}, {sect('Database Objects', 'r.database_objects')}, {sect('Investigation Hints', 'r.hints')},
  'Matched Components:' || chr(10) || coalesce(tc.t, '- Unknown'), 'Matched Workflows:' || chr(10) || coalesce(tw.t, '- Unknown'),
  'Matched Known Issues:' || chr(10) || coalesce(ti.t, '- None matched'), '', {head('REPRESENTATIVE EVIDENCE')}, e.t,
  {head('RELATED ERROR PATTERNS')}, coalesce(p.t || chr(10), 'No related error patterns were available.' || chr(10)),
  {head('INVESTIGATION OBJECTIVES')}, {q(chr(10).join(it.OBJECTIVES['Deep']))}) investigation_text
FROM incidents i JOIN env v USING (incident_id) JOIN rollup r USING (incident_id) LEFT JOIN t_components tc USING (incident_id) LEFT JOIN t_workflows tw USING (incident_id)
 LEFT JOIN t_issues ti USING (incident_id) LEFT JOIN t_evidence e USING (incident_id) LEFT JOIN t_patterns p USING (incident_id)""")
split = lambda c: f"list_filter(string_split(coalesce({c}, ''), ';'), lambda z: z <> '')"
VU = lambda c: f"CASE WHEN {unk(c)} THEN 'Unknown' ELSE {strip(c)} END"
flow = " ".join("WHEN " + " OR ".join(f"contains(lower(t.investigation_text), {q(w)})" for w in ws) + f" THEN {q(v)}" for ws, v in rp.WORKFLOW_WORDS)
step("items", "m_components", f"""SELECT incident_id, flatten(list(list_concat([name || ' (' || type || '), Match Score: ' || match_score || '%'], list_concat({dl('match_reasons')}, list_concat({dl('dependencies')}, {dl('database_objects')}))) ORDER BY rank)) items
  FROM m_components GROUP BY 1""")
step("cases", "incidents texts rollup items m_workflows", f"""
SELECT i.incident_id, i.incident_no, '{APP}' application_name, {VU('t.environment')} environment, {VU('i.exception_type')} exception_type, {VU('i.api_path')} api_path,
 {VU('i.server_name')} server, {VU('i.correlation_id')} correlation_id, i.entry_count occurrence_count, r.confidence_score context_confidence, t.evidence_count, t.pattern_count,
 coalesce(m.items, []) component_items, {split('r.dependencies')} dependencies, {split('r.database_objects')} database_objects, {split('r.hints')} hints,
 CASE WHEN w.name IS NOT NULL THEN w.name {flow} ELSE 'Unknown' END workflow,
 greatest(20, least(90, 25 + least(r.confidence_score // 2, 40) + least(3*t.evidence_count, 20) + least(2*t.pattern_count, 15))) confidence, t.investigation_text
FROM incidents i JOIN texts t USING (incident_id) JOIN rollup r USING (incident_id) LEFT JOIN items m USING (incident_id)
 LEFT JOIN (SELECT incident_id, name FROM m_workflows WHERE rank=1) w USING (incident_id)""")


def labelled(text: str, label: str, limit: int, skip=ignored) -> str:
    low = label.lower()
    ls = f"list_transform(string_split({text}, chr(10)), lambda x: {strip('x')})"
    vs = f"list_transform(list_filter({ls}, lambda x: starts_with(lower(x), {q(low)})), lambda x: {strip(f'substr(x, {len(label) + 1})')})"
    return f"({dl(f'list_filter({vs}, lambda v: NOT {skip(chr(118))})')})[1:{limit}]"


# ---- queries --------------------------------------------------------------------------
@shared("summaries")
def summaries(spark, sf):
    return inc.error_summaries(core.correlated(spark, sf))


@shared("evidence")
def evidence(spark, sf):
    return ev.representative_evidence(kb.incident_entries(spark, sf))


@shared("patterns")
def patterns(spark, sf):
    return ev.error_pattern_match(core.ranked(spark, sf), summaries(spark, sf))


@shared("texts")
def texts(spark, sf):
    found = core.ranked(spark, sf)
    return it.investigation_text(
        found, ev.evidence_environment(found, evidence(spark, sf)), kb.rollup(spark, sf), kb.components(spark, sf),
        kb.workflows(spark, sf), kb.issues(spark, sf), evidence(spark, sf), patterns(spark, sf), APP)


@shared("cases")
def cases(spark, sf):
    return rp.cases(core.ranked(spark, sf), texts(spark, sf), kb.rollup(spark, sf), kb.components(spark, sf), kb.workflows(spark, sf), APP)


for _name, _limit, _step in (("representative_evidence", 10, "evidence"), ("representative_evidence_3", 3, "evidence3")):
    @check(_name, query(f"SELECT incident_id, evidence_no, source, line_number FROM {_step}", _step))
    def _(spark, sf, limit=_limit):
        return ev.representative_evidence(kb.incident_entries(spark, sf), limit).select("incident_id", "evidence_no", "source", "line_number")


@check("evidence_signature", query("SELECT incident_id, esig, count(*) n FROM ie_ord GROUP BY 1, 2", "ie_ord"))
def _(spark, sf):
    sig = sg.evidence_signature(*[F.col(c) for c in ("exception_type", "http_status", "api_path", "message")])
    return kb.incident_entries(spark, sf).groupBy("incident_id", sig.alias("esig")).agg(F.count(F.lit(1)).alias("n"))


@check("evidence_environment", query("SELECT * FROM env", "env"))
def _(spark, sf):
    return ev.evidence_environment(core.ranked(spark, sf), evidence(spark, sf))


@check("error_pattern_match", query("SELECT incident_id, pattern_no, pattern, occurrence_count FROM patterns", "patterns"))
def _(spark, sf):
    return ev.error_pattern_match(core.ranked(spark, sf), summaries(spark, sf)).select("incident_id", "pattern_no", "pattern", "occurrence_count")


@check("matches_incident", query("SELECT incident_id, count(*) patterns, sum(occurrence_count) occurrences FROM patterns GROUP BY 1", "patterns"))
def _(spark, sf):
    return patterns(spark, sf).groupBy("incident_id").agg(F.count(F.lit(1)).alias("patterns"), F.sum("occurrence_count").alias("occurrences"))


@check("top_k_per_group", query("SELECT incident_id, max(evidence_no) evidence, max(pattern_no) patterns FROM evidence JOIN (SELECT incident_id, max(pattern_no) pattern_no FROM patterns GROUP BY 1) USING (incident_id) GROUP BY 1", "evidence patterns"))
def _(spark, sf):
    p = patterns(spark, sf).groupBy("incident_id").agg(F.max("pattern_no").alias("patterns"))
    return evidence(spark, sf).groupBy("incident_id").agg(F.max("evidence_no").alias("evidence")).join(p, "incident_id")


MARKED = ["exception_type", "message", "api_path"]
changed = " OR ".join(f"{norm(c)} <> lag({norm(c)}) OVER w" for c in MARKED)
TO = "PARTITION BY incident_id ORDER BY ts NULLS LAST, line_number, source"
step("tl_groups", "evidence", f"""SELECT *, 1 + sum(is_new) OVER ({TO} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) event_no, row_number() OVER ({TO}) place FROM (
 SELECT * REPLACE ({', '.join(f'{VU(c)} AS {c}' for c in ('severity', 'exception_type', 'message', 'api_path', 'server_name', 'correlation_id'))}),
  CASE WHEN {changed} OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 600000000 THEN 1 ELSE 0 END is_new FROM evidence WINDOW w AS ({TO}))""")


@check("timeline_groups", query("SELECT incident_id, source, line_number, event_no FROM tl_groups", "tl_groups"))
def _(spark, sf):
    return timeline_groups(evidence(spark, sf)).select("incident_id", "source", "line_number", "event_no")


step("tl_events", "tl_groups", f"""SELECT *, CASE event_type WHEN 'FirstFailure' THEN 'First detected failure' WHEN 'LastObserved' THEN 'Last observed failure'
  WHEN 'CriticalFailure' THEN 'Critical failure detected' ELSE CASE WHEN exception_type <> 'Unknown' THEN exception_type ELSE 'Repeated application failure' END END title,
  message || CASE WHEN n > 1 THEN ' This pattern occurred ' || n || ' times within the same timeline window.' ELSE '' END description,
  30 + CASE WHEN ts IS NOT NULL THEN 20 ELSE 0 END + {' + '.join(f"CASE WHEN {c} <> 'Unknown' THEN {p} ELSE 0 END" for c, p in (("exception_type", 20), ("message", 10), ("correlation_id", 15), ("api_path", 5)))} confidence_score
FROM (SELECT *, CASE WHEN event_no=1 THEN 'FirstFailure' WHEN event_no = max(event_no) OVER (PARTITION BY incident_id) THEN 'LastObserved' WHEN lower(severity)='critical' THEN 'CriticalFailure' ELSE 'RepeatedFailure' END event_type
 FROM (SELECT incident_id, event_no, count(*) n, {', '.join(f'arg_min({c}, place) {c}' for c in ('severity', 'exception_type', 'message', 'api_path', 'server_name', 'correlation_id', 'line_number'))},
   first(ts ORDER BY place) ts FROM tl_groups GROUP BY 1, 2))""")


@check("timeline_events", query(f"""SELECT incident_id, event_no AS sequence, n occurrence_count, {ts_sql('ts')} ts, event_type, title, description, severity, exception_type, api_path,
  server_name, correlation_id, line_number, confidence_score FROM tl_events""", "tl_events"))
def _(spark, sf):
    return timeline_events(timeline_groups(evidence(spark, sf))).withColumn("ts", stamp("ts")).drop("message")


@check("investigation_text", query("SELECT incident_id, investigation_text, evidence_count, pattern_count, greatest(1, cast(ceil(length(investigation_text)/4.0) as int)) token_estimate FROM texts", "texts"))
def _(spark, sf):
    return texts(spark, sf).select("incident_id", "investigation_text", "evidence_count", "pattern_count", "token_estimate")


@check("overall_confidence", query("SELECT incident_id, context_confidence, evidence_count, pattern_count, confidence FROM cases", "cases"))
def _(spark, sf):
    return cases(spark, sf).select("incident_id", "context_confidence", "evidence_count", "pattern_count", "confidence")


@check("workflow_inference", query(f"SELECT incident_id, CASE {flow} ELSE 'Unknown' END inferred, workflow FROM cases t", "cases"))
def _(spark, sf):
    return cases(spark, sf).select("incident_id", rp.workflow_inference(F.col("investigation_text")).alias("inferred"), "workflow")


dep_type = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(name), {q(w)})" for w in ws) + f" THEN {q(v)}" for ws, v in rp.DEPENDENCY_TYPES) + " ELSE 'Application Dependency' END"
step("dep_rows", "cases", "SELECT incident_id, generate_subscripts(dependencies[1:10], 1) position, unnest(dependencies[1:10]) AS name FROM cases")
DEP_SQL = query(f"SELECT incident_id, position, name, {dep_type} AS type, 70 confidence_score FROM dep_rows", "dep_rows")


def all_reports(spark, sf):
    return rp.reports(cases(spark, sf))


@check("dependency_findings", DEP_SQL)
def _(spark, sf):
    return rp.child(all_reports(spark, sf), "dependency_findings").select("incident_id", "position", "name", "type", "confidence_score")


@check("dependency_type", query(f"SELECT name, {dep_type} AS type, count(*) n FROM dep_rows GROUP BY 1, 2", "dep_rows"))
def _(spark, sf):
    d = cases(spark, sf).select(F.explode(F.slice("dependencies", 1, 10)).alias("name"))
    return d.groupBy("name", rp.dependency_type(F.col("name")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


prod = "upper(environment) IN ('PROD','PRODUCTION')"


@check("business_impact", query(f"""SELECT incident_id, CASE WHEN {prod} AND occurrence_count>=100 THEN 'High' WHEN {prod} AND occurrence_count>0 THEN 'Medium' WHEN occurrence_count>=100 THEN 'Medium' ELSE 'Low' END severity,
  CASE WHEN workflow='Unknown' THEN 'Unknown. The affected customer journey has not been fully identified.' ELSE 'Users of the ' || workflow || ' workflow may experience failed or incomplete requests.' END customer_impact,
  occurrence_count || ' failed or error-producing occurrences were identified.' operational_impact,
  CASE WHEN {prod} THEN 'Production environment impact detected.' ELSE 'Impact detected in ' || environment || '.' END AS scope, {clamp('confidence-10', 20, 85)} confidence_score FROM cases""", "cases"))
def _(spark, sf):
    return all_reports(spark, sf).select("incident_id", "business_impact.*").drop("financial_impact")


segs = f"list_filter(list_transform(string_split(api_path, '/'), lambda z: {strip('z')}), lambda z: z<>'')"
at = f"list_position(list_transform({segs}, lambda z: lower(z)), 'api')"
controller = f"CASE WHEN {unk('api_path')} THEN 'Unknown' WHEN {at} > 0 AND {at} < len({segs}) THEN ({segs})[{at}+1] ELSE coalesce(({segs})[-2], 'Unknown') END"
method = f"CASE WHEN {unk('api_path')} THEN 'Unknown' ELSE coalesce(({segs})[-1], 'Unknown') END"


@check("controller_method", query(f"SELECT incident_id, {controller} controller, {method} AS method FROM cases", "cases"))
def _(spark, sf):
    return cases(spark, sf).select("incident_id", rp.controller_name(F.col("api_path")).alias("controller"), rp.method_name(F.col("api_path")).alias("method"))


summary_sql = f"""application_name || ' experienced an incident in ' || environment || '. ' || occurrence_count || ' occurrences were detected ' ||
  CASE WHEN {unk('api_path')} THEN CASE WHEN {unk('workflow')} THEN 'within the application' ELSE 'within the ' || workflow || ' workflow' END ELSE 'for ' || api_path END || '. ' ||
  CASE WHEN {unk('exception_type')} THEN 'The exact exception type could not be determined.' ELSE 'The failures produced ' || exception_type || '.' END ||
  ' Additional evidence validation is required before confirming the final root cause.'"""


@check("report_summary", query(f"SELECT incident_id, {summary_sql} executive_summary, workflow affected_workflow, array_to_string(component_items, ';') affected_components, confidence overall_confidence FROM cases", "cases"))
def _(spark, sf):
    return all_reports(spark, sf).select("incident_id", "executive_summary", "affected_workflow", flat(F.col("affected_components")).alias("affected_components"), "overall_confidence")


action_sql = f"""CASE WHEN NOT {unk('correlation_id')} THEN 'Search application, dependency, and database logs using correlation ID ' || correlation_id || '.'
  WHEN NOT {unk('api_path')} THEN 'Compare a successful request with a failed request for ' || api_path || ', including input, headers, response, and stack trace.'
  ELSE 'Locate the earliest complete stack trace for ' || exception_type || ' within the ' || workflow || ' workflow.' END"""
title_sql = f"CASE WHEN NOT {unk('correlation_id')} THEN 'Trace the failed request' WHEN NOT {unk('api_path')} THEN 'Compare successful and failed API requests' ELSE 'Inspect the earliest complete stack trace' END"
action_score = f"CASE WHEN NOT {unk('correlation_id')} THEN {clamp('confidence+5', 50, 95)} WHEN NOT {unk('api_path')} THEN {clamp('confidence', 45, 90)} ELSE {clamp('confidence-5', 35, 85)} END"


@check("next_action", query(f"SELECT incident_id, {title_sql} title, {action_sql} AS action, {action_score} confidence_score FROM cases", "cases"))
def _(spark, sf):
    return all_reports(spark, sf).select("incident_id", "next_action.title", "next_action.action", "next_action.confidence_score")


ev_score = "CASE WHEN evidence_count>=8 THEN 100 WHEN evidence_count>=5 THEN 80 WHEN evidence_count>=3 THEN 60 WHEN evidence_count>=1 THEN 40 ELSE 0 END"
dep_score = "CASE WHEN len(dependencies)>=3 THEN 100 WHEN len(dependencies)=2 THEN 80 WHEN len(dependencies)=1 THEN 60 ELSE 0 END"
wf = unk("workflow")
dbl = lambda e, w: f"cast({e} as double) * cast({w} as double)"
parts = [(ev_score, .25), ("context_confidence", .20), (f"CASE WHEN {wf} THEN 0 ELSE 100 END", .15), (dep_score, .10), ("confidence", .15), (f"CASE WHEN {wf} THEN 30 ELSE 70 END", .10)]
state = lambda s: f"CASE WHEN {s}>=80 THEN 'Complete' WHEN {s}>=50 THEN 'Partial' WHEN {s}>0 THEN 'Limited' ELSE 'Missing' END"


@check("completeness", query(f"""SELECT incident_id, {clamp(f"cast(round_even({' + '.join(dbl(e, w) for e, w in parts)}, 0) as int)", 0, 100)} overall_score,
  concat_ws(';', {', '.join(f"({e}) || ' ' || ({state('(' + e + ')')})" for e, _ in parts)}, '0 Missing') states,
  concat_ws(';', CASE WHEN {unk('api_path')} THEN 'Affected API or operation is not available.' END, CASE WHEN {unk('correlation_id')} THEN 'Correlation ID is unavailable.' END,
   'Deployment and configuration change history is unavailable.', CASE WHEN len(dependencies)=0 THEN 'No dependency mapping was identified.' END) missing FROM cases""", "cases"))
def _(spark, sf):
    items = F.transform("completeness.items", lambda x: F.concat_ws(" ", x["score"].cast("string"), x["status"]))
    return all_reports(spark, sf).select("incident_id", F.col("completeness.overall_score").alias("overall_score"), flat(items).alias("states"),
                                         flat(F.col("completeness.missing_information")).alias("missing"))


cause_title = f"CASE WHEN NOT {unk('exception_type')} THEN exception_type || ' in the affected application workflow' WHEN NOT {unk('api_path')} THEN 'Failure while processing ' || api_path ELSE 'Application processing failure' END"
support = f"""concat_ws(';', CASE WHEN NOT {unk('exception_type')} THEN 'The incident consistently reports ' || exception_type || '.' END, CASE WHEN NOT {unk('api_path')} THEN 'The failure is associated with API path ' || api_path || '.' END,
  CASE WHEN NOT {unk('server')} THEN 'The failure was observed on server ' || server || '.' END, CASE WHEN occurrence_count>0 THEN 'The failure occurred ' || occurrence_count || ' times.' END)"""
CAUSES = f"""SELECT incident_id, 1 position, {cause_title} title, {clamp('confidence', 35, 90)} confidence_score, {support} support FROM cases
 UNION ALL SELECT incident_id, 2, 'Downstream dependency or invalid response', {clamp('confidence-15', 20, 75)},
  CASE WHEN {unk('api_path')} THEN 'The application context contains dependency information.' ELSE 'The error is associated with endpoint ' || api_path || '.;Application context may include downstream dependencies.' END FROM cases
 UNION ALL SELECT incident_id, 3, 'Application validation or error-handling gap', {clamp('confidence-25', 15, 65)},
  CASE WHEN {unk('exception_type')} THEN 'The failure produced an application-level error.' ELSE 'The observed exception is ' || exception_type || '.;Validation and controlled error handling should be reviewed near the failure point.' END FROM cases"""


@check("root_causes", query(CAUSES, "cases"))
def _(spark, sf):
    return rp.child(all_reports(spark, sf), "root_causes").select(
        "incident_id", "position", "title", "confidence_score", flat(F.col("supporting_evidence")).alias("support"))


STEPS_SQL = f"""SELECT incident_id, 1 AS sequence, 'Validate whether the issue is still occurring in ' || workflow || ' and determine whether all requests or only specific requests are affected.' AS action, 95 confidence_score FROM cases
 UNION ALL SELECT incident_id, 2, CASE WHEN {unk('correlation_id')} THEN 'Identify a failed request and capture its correlation ID, request ID, or timestamp.' ELSE 'Search all application and dependency logs using correlation ID ' || correlation_id || '.' END, CASE WHEN {unk('correlation_id')} THEN 75 ELSE 95 END FROM cases
 UNION ALL SELECT incident_id, 3, 'Review the earliest stack trace and error associated with ' || api_path || ' and ' || exception_type || '.', 90 FROM cases
 UNION ALL SELECT incident_id, 4, 'Compare a successful request with a failed request on ' || server || ', including payload, headers, dependency responses, and processing time.', 85 FROM cases
 UNION ALL SELECT incident_id, 5, 'Check the health and response details of mapped dependencies and validate related database reads or writes.', 80 FROM cases"""


@check("investigation_steps", query(STEPS_SQL, "cases"))
def _(spark, sf):
    return rp.child(all_reports(spark, sf), "investigation_steps").select("incident_id", "sequence", "action", "confidence_score")


SQLQ = """SELECT incident_id, generate_subscripts(objs, 1) position, unnest(objs) AS object, correlation_id FROM (SELECT incident_id, correlation_id,
  list_filter(database_objects[1:3], lambda z: regexp_matches(z, '^[A-Za-z0-9_.\\[\\]]+$')) objs FROM cases)"""
step("sql_rows", "cases", f"""SELECT incident_id, position, 'Review recent records in ' || object title, CASE WHEN {unk('correlation_id')} THEN 'SELECT TOP (100) *' || chr(10) || 'FROM ' || object || ';'
  ELSE 'SELECT TOP (100) *' || chr(10) || 'FROM ' || object || chr(10) || 'WHERE CorrelationId = ''' || replace(correlation_id, '''', '''''') || '''' || chr(10) || 'ORDER BY 1 DESC;' END query,
  CASE WHEN {unk('correlation_id')} THEN 55 ELSE 75 END confidence_score FROM ({SQLQ})""")


@check("suggested_sql", query("SELECT * FROM sql_rows", "sql_rows"))
def _(spark, sf):
    return rp.child(all_reports(spark, sf), "suggested_sql").select("incident_id", "position", "title", "query", "confidence_score")


label_of = lambda i: strip(f"CASE WHEN strpos(regexp_replace({i}, ', Match Score:.*$', '', 'i'), '(') > 1 THEN split_part(regexp_replace({i}, ', Match Score:.*$', '', 'i'), '(', 1) ELSE regexp_replace({i}, ', Match Score:.*$', '', 'i') END")
step("code_rows", "cases", f"""SELECT incident_id, position, {label_of('item')} class_name, {method} method_name, 70 confidence_score FROM
  (SELECT incident_id, api_path, generate_subscripts(component_items[1:3], 1) position, unnest(component_items[1:3]) item FROM cases)
 UNION ALL SELECT incident_id, 1, {controller}, {method}, 60 FROM cases WHERE len(component_items)=0 AND NOT {unk('api_path')}""")


@check("code_locations", query("SELECT * FROM code_rows", "code_rows"))
def _(spark, sf):
    return rp.child(all_reports(spark, sf), "code_locations").select("incident_id", "position", "class_name", "method_name", "confidence_score")


@check("recommendations", query(f"""SELECT incident_id, 1 position, 'Validate all required inputs and downstream responses before processing them in ' || api_path || '.' description, {clamp('confidence', 40, 85)} confidence_score FROM cases
 UNION ALL SELECT incident_id, 2, 'Log the correlation ID, sanitized request identifiers, dependency status, response content type, and the exact component producing ' || exception_type || '.', 90 FROM cases
 UNION ALL SELECT incident_id, 3, 'Create alerts for repeated failures on the affected API and dependency, using occurrence thresholds and a defined incident window.', 85 FROM cases""", "cases"))
def _(spark, sf):
    return rp.child(all_reports(spark, sf), "recommendations").select("incident_id", "position", "description", "confidence_score")


step("refs", "cases", f"SELECT incident_id, correlation_id, {labelled('investigation_text', 'Message:', 10, unk)} m FROM cases")


@check("evidence_references", query(f"""SELECT incident_id, position, description, 'Prepared Evidence ' || position AS source, CASE WHEN {unk('correlation_id')} THEN '' ELSE correlation_id END correlation_id
  FROM (SELECT incident_id, correlation_id, generate_subscripts(m, 1) position, unnest(m) description FROM refs)""", "refs"))
def _(spark, sf):
    return rp.child(all_reports(spark, sf), "evidence_references").select("incident_id", "position", "description", "source", "correlation_id")


unknown_sql = f"""list_filter([{', '.join(q(x) for x in rp.FIXED_UNKNOWNS)}, CASE WHEN {wf} THEN 'The affected business workflow could not be determined.' END,
  CASE WHEN {unk('api_path')} THEN 'The affected API or operation could not be determined.' END,
  CASE WHEN {unk('correlation_id')} THEN 'No correlation ID was available to reconstruct the complete request flow.' END], lambda z: z IS NOT NULL)"""


@check("unknowns_assumptions", query(f"SELECT incident_id, array_to_string({unknown_sql}, ';') unknowns, {q(';'.join(rp.ASSUMPTIONS))} assumptions FROM cases", "cases"))
def _(spark, sf):
    return all_reports(spark, sf).select("incident_id", flat(F.col("unknowns")).alias("unknowns"), flat(F.col("assumptions")).alias("assumptions"))


# ---- distilled facts -------------------------------------------------------------------
_facts: list[str] = []


def fact_source(sql_list: str, category: str, label: str, priority: int, authority: str, source: str, frm: str = "cases") -> None:
    n = len(_facts)
    _facts.append(f"SELECT incident_id, {n} AS src, generate_subscripts(v, 1) AS idx, {q(category)} AS category, {q(label)} AS label, unnest(v) AS raw, {priority} AS priority, {q(authority)} AS authority, {q(source)} AS source FROM (SELECT incident_id, {sql_list} v FROM {frm} c)")


_meta = {"IncidentId": "incident_id", "Application": "application_name", "Environment": "environment", "EvidenceCount": "cast(evidence_count as varchar)",
         "ErrorPatternCount": "cast(pattern_count as varchar)", "ContextConfidence": "cast(context_confidence as varchar)"}
for _k, *_rest in distill.METADATA_FACTS:
    fact_source(f"list_filter([{_meta[_k]}], lambda v: NOT {ignored('v')})", *_rest)
for _p, _c, _l, _n in distill.LABEL_FACTS:
    fact_source(labelled("investigation_text", _p, 5), _c, _l, _n, "RawLog", "Incident log")
_heads = {"Matched Components:": "component_items[1:1]", "Matched Workflows:": "(SELECT list(name || ', Match Score: ' || match_score || '%') FROM m_workflows w WHERE w.rank=1 AND w.incident_id=c.incident_id)",
          "Dependencies:": "dependencies", "Database Objects:": "database_objects",
          "Matched Known Issues:": "(SELECT list(title || ', Match Score: ' || match_score || '%') FROM m_issues w WHERE w.rank=1 AND w.incident_id=c.incident_id)", "Investigation Hints:": "hints"}
for _h, *_rest in distill.SECTION_FACTS:
    fact_source(f"coalesce({_heads[_h]}, [])", *_rest)
for _c, _l, _n, _s, _p in distill.PATTERN_FACTS:
    _v = f"regexp_extract_all(investigation_text, {q(_p)}, 1)"
    if _l == "Database operation":
        _v = f"list_filter({_v}, lambda v: lower(v) NOT IN ('select','where','from','order'))"
    if _l == "Stack frame":
        _v = f"({dl('list_filter(' + _v + ', lambda v: NOT starts_with(lower(v), ' + q('system.threading') + '))')})[1:8]"
    fact_source(_v, _c, _l, _n, "RawLog", _s)
for _p, _n in distill.PHRASES:
    fact_source(f"CASE WHEN contains(lower(investigation_text), {q(_p.lower())}) THEN [{q(_p)}] ELSE [] END", "Failure", "Failure pattern", _n, "RawLog", "Incident log")
fact_source(labelled("investigation_text", "Message:", 5), "Failure", "Representative message", 95, "RawLog", "Incident log")
cut = f"CASE WHEN length({strip('raw')}) <= 500 THEN {strip('raw')} ELSE substr({strip('raw')}, 1, 500) || '...' END"
auth = lambda c, i: f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {v[i]}" for k, v in distill.AUTHORITIES.items()) + " END"
step("facts", "cases m_workflows m_issues", f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY {auth('authority', 0)} DESC, priority DESC, fs, fi) fact_no FROM (
 SELECT *, row_number() OVER (PARTITION BY incident_id, authority, lower(category), lower(label), lower(value) ORDER BY priority DESC, src, idx) rn,
  first(src) OVER f fs, first(idx) OVER f fi
 FROM (SELECT * EXCLUDE (raw), {cut} AS value FROM ({' UNION ALL '.join(_facts)})) WHERE {nb('value')}
 WINDOW f AS (PARTITION BY incident_id, authority, lower(category), lower(label), lower(value) ORDER BY src, idx)) WHERE rn=1) WHERE fact_no <= 24""")


@shared("facts")
def facts(spark, sf):
    return distill.distilled_facts(texts(spark, sf))


@check("distilled_facts", query("SELECT incident_id, fact_no, category, label, value, priority, authority, source FROM facts", "facts"))
def _(spark, sf):
    return distill.distilled_facts(texts(spark, sf))


step("claims", "facts", f"""SELECT incident_id, fact_no claim_no, category, label, value, authority, {auth('authority', 1)} confidence_score, source,
 authority IN ('RawLog','ExplicitIdentifier','RepositoryMatch','OpenApiMatch') OR (authority='ExactKnowledgeMatch' AND {auth('authority', 1)}>=80) is_confirmed, authority IN ('Unknown','FuzzyContext') is_weak FROM facts""")


@check("evidence_claims", query("SELECT * FROM claims", "claims"))
def _(spark, sf):
    return distill.evidence_claims(facts(spark, sf))


# Claims that also confirm identities, objects and code, so that every check has both outcomes.
EXTRA = [
    ("incident_no % 3 = 0", "Application", "Application", "upper(application_name)", "ExplicitIdentifier", 90),
    ("incident_no % 2 = 0", "Application", "Workflow name", "lower(workflow)", "RepositoryMatch", 85),
    ("len(dependencies) > 0 AND incident_no % 2 = 1", "Dependency", "Dependency", "upper(dependencies[1])", "OpenApiMatch", 85),
    ("len(component_items) > 0 AND incident_no % 5 = 0", "Application", "Component", "component_items[1]", "RepositoryMatch", 85),
    ("len(database_objects) > 0 AND incident_no % 3 = 1", "Database", "Database object", "lower(database_objects[1])", "ExactKnowledgeMatch", 80),
    ("len(database_objects) > 0 AND incident_no % 3 = 2", "Database", "Database object", "database_objects[1]", "ExactKnowledgeMatch", 79),
    ("incident_no % 4 = 0", "Code", "Class", "'src/' || upper(api_path) || '.cs'", "RepositoryMatch", 85),
    ("incident_no % 3 = 2", "Other", "Hint", "'maybe ' || incident_id", "FuzzyContext", 35),
]
step("all_claims", "claims cases", "SELECT * FROM claims UNION ALL " + " UNION ALL ".join(
    f"SELECT incident_id, {100 + i}, {q(c)}, {q(l)}, {v}, {q(a)}, {s}, 'made', {str(a in distill.CONFIRMED or (a == 'ExactKnowledgeMatch' and s >= 80)).lower()}, {str(a == 'FuzzyContext').lower()} FROM cases WHERE {w}"
    for i, (w, c, l, v, a, s) in enumerate(EXTRA)))


@shared("all_claims")
def all_claims(spark, sf):
    base = cases(spark, sf).join(core.ranked(spark, sf).select("incident_id", "incident_no"), "incident_id")
    made = None
    for i, (w, c, l, v, a, s) in enumerate(EXTRA):
        w2 = w.replace("len(", "size(")
        v2 = v.replace("[1]", "[0]")
        part = base.filter(w2).selectExpr("incident_id", f"{100 + i} AS claim_no", f"{q(c)} AS category", f"{q(l)} AS label", f"{v2} AS value", f"{q(a)} AS authority", f"{s} AS confidence_score", "'made' AS source")
        made = part if made is None else made.unionByName(part)
    return distill.evidence_claims(facts(spark, sf)).unionByName(distill.with_flags(made))


step("split", "all_claims", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, is_confirmed ORDER BY confidence_score DESC, claim_no) place
 FROM all_claims WHERE is_confirmed OR NOT is_weak OR authority='FuzzyContext') WHERE place <= CASE WHEN is_confirmed THEN 12 ELSE 5 END""")


@check("authority_split", query("SELECT incident_id, CASE WHEN is_confirmed THEN 'confirmed' ELSE 'candidate' END part, place, label, value, confidence_score FROM split", "split"))
def _(spark, sf):
    return distill.authority_split(all_claims(spark, sf)).select("incident_id", "part", "place", "label", "value", "confidence_score")


step("open_points", "cases split", """SELECT i.incident_id, list_filter([CASE WHEN NOT coalesce(app, false) THEN 'Application identity is not confirmed.' END, CASE WHEN NOT coalesce(fl, false) THEN 'Affected workflow is not confirmed.' END,
 CASE WHEN op THEN 'The physical database containing the observed database operation is not confirmed unless explicitly present in confirmed evidence.' END,
 CASE WHEN cand THEN 'Candidate application knowledge exists but is not authoritative.' END], lambda z: z IS NOT NULL) u FROM cases i LEFT JOIN
 (SELECT incident_id, bool_or(is_confirmed AND lower(category)='application' AND contains(lower(label),'application')) app, bool_or(is_confirmed AND contains(lower(label),'workflow')) fl,
  bool_or(is_confirmed AND lower(label)='database operation') op, bool_or(NOT is_confirmed) cand FROM split GROUP BY 1) s USING (incident_id)""")


@check("authority_text", query("""SELECT o.incident_id, concat_ws(chr(10), 'CONFIRMED EVIDENCE', coalesce(c, '- None'), '', 'CANDIDATE CONTEXT', 'These items are NOT confirmed facts.', 'Do not use them to establish application, workflow,',
  'database, dependency, or root cause unless independently', 'supported by confirmed evidence.', '', coalesce(k, '- None'), '', 'UNKNOWNS', CASE WHEN len(u)=0 THEN '- None' ELSE '- ' || array_to_string(u, chr(10) || '- ') END) authority_text
 FROM open_points o LEFT JOIN (SELECT incident_id, string_agg('- ' || label || ': ' || value, chr(10) ORDER BY place) FILTER (WHERE is_confirmed) c,
  string_agg('- ' || label || ': ' || value || ' (' || confidence_score || '% confidence)', chr(10) ORDER BY place) FILTER (WHERE NOT is_confirmed) k FROM split GROUP BY 1) s USING (incident_id)""", "open_points"))
def _(spark, sf):
    split_ = distill.authority_split(all_claims(spark, sf))
    return distill.authority_text(split_, distill.authority_unknowns(core.ranked(spark, sf), split_))
