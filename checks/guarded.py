"""Queries over guarded reports and model responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import investigation as iv
from checks.investigation import clamp, dl, nb, unk
from checks.registry import check, flat, shared
from checks.sql import q, query, step, strip
from faultline.operators import guardrail as gr, report as rp, responses as rs

has = lambda col, words: "(" + " OR ".join(f"contains(lower({col}), {q(w)})" for w in words) + ")"
step("strong", "all_claims", "SELECT * FROM all_claims WHERE is_confirmed")
step("guard_base", "cases strong", f"""SELECT c.*,
  CASE WHEN {unk('application_name')} OR NOT EXISTS (SELECT 1 FROM strong s WHERE s.incident_id=c.incident_id AND lower(s.category)='application' AND lower(s.value)=lower(c.application_name)) THEN 'Unknown' ELSE application_name END g_app,
  CASE WHEN {unk('workflow')} OR NOT EXISTS (SELECT 1 FROM strong s WHERE s.incident_id=c.incident_id AND contains(lower(s.label),'workflow') AND lower(s.value)=lower(c.workflow)) THEN 'Unknown' ELSE workflow END g_flow,
  EXISTS (SELECT 1 FROM strong s WHERE s.incident_id=c.incident_id AND s.authority='RawLog' AND ({has('s.value', gr.TIMEOUT_PHRASES)} OR (contains(lower(s.label),'sql error number') AND trim(s.value)='-2'))) g_timeout,
  (SELECT avg(confidence_score) FROM strong s WHERE s.incident_id=c.incident_id) g_mean
FROM cases c""")


@shared("guarded")
def guarded(spark, sf):
    return gr.guarded_reports(iv.all_reports(spark, sf), iv.all_claims(spark, sf))


@check("guard_identity", query("SELECT incident_id, g_app application_name, g_flow affected_workflow FROM guard_base", "guard_base"))
def _(spark, sf):
    return guarded(spark, sf).select("incident_id", "application_name", "affected_workflow")


@check("timeout_evidence", query("SELECT incident_id, g_timeout AS timeout FROM guard_base", "guard_base"))
def _(spark, sf):
    return gr.claims_by_incident(iv.all_claims(spark, sf)).select("incident_id", gr.timeout_evidence().alias("timeout"))


@check("guard_confidence", query(f"""SELECT incident_id, {clamp("(confidence + coalesce(cast(round_even(g_mean, 0) as int), 25)) // 2", 20, 90)} overall_confidence FROM guard_base""", "guard_base"))
def _(spark, sf):
    return guarded(spark, sf).select("incident_id", "overall_confidence")


known = "(g_app <> 'Unknown' AND g_flow <> 'Unknown')"


@check("guard_impact", query(f"""SELECT incident_id, CASE WHEN {known} THEN 'Users of the ' || workflow || ' workflow may experience failed or incomplete requests.' ELSE 'Customer impact has not been confirmed from the available evidence.' END customer_impact,
  CASE WHEN {known} THEN CASE WHEN environment='PROD' THEN 'Production environment impact detected.' ELSE 'Impact detected in ' || environment || '.' END ELSE 'The affected application/workflow scope has not been confirmed.' END AS scope,
  CASE WHEN {known} THEN {clamp('confidence-10', 20, 85)} ELSE least(50, {clamp('confidence-10', 20, 85)}) END confidence_score FROM guard_base""", "guard_base"))
def _(spark, sf):
    b = F.col("business_impact")
    return guarded(spark, sf).select("incident_id", b["customer_impact"].alias("customer_impact"), b["scope"].alias("scope"), b["confidence_score"].alias("confidence_score"))


@check("guard_steps", query(f"""SELECT incident_id, CASE WHEN g_flow='Unknown' THEN 'Validate whether the issue is still occurring and {gr.SCOPE_SENTENCE}.' ELSE 'Validate whether the issue is still occurring in ' || workflow || ' and {gr.SCOPE_SENTENCE}.' END AS action FROM guard_base""", "guard_base"))
def _(spark, sf):
    return rp.child(guarded(spark, sf), "investigation_steps").filter("sequence = 1").select("incident_id", "action")


@check("guard_all_steps", query(f"""SELECT s.incident_id, sequence, CASE WHEN g_flow='Unknown' AND contains(lower(action), '{gr.SCOPE_SENTENCE}')
  THEN 'Validate whether the issue is still occurring and {gr.SCOPE_SENTENCE}.' ELSE action END AS action, confidence_score
  FROM ({iv.STEPS_SQL}) s JOIN (SELECT incident_id, g_flow FROM guard_base) g ON s.incident_id=g.incident_id""", "guard_base cases"))
def _(spark, sf):
    return rp.child(guarded(spark, sf), "investigation_steps").select("incident_id", "sequence", "action", "confidence_score")


step("gj", "cases strong", """SELECT c.incident_id, component_items, dependencies, coalesce(v, []) vals, coalesce(d, []) deps FROM cases c LEFT JOIN
 (SELECT incident_id, list(lower(value)) v, list(lower(value)) FILTER (WHERE lower(category)='dependency') d FROM strong GROUP BY 1) s USING (incident_id)""")


DC = dl("list_filter(component_items, lambda c: list_contains(vals, lower(c)))")


@check("grounding_semi_joins", query(f"""
SELECT incident_id, 'component' part, array_to_string({DC}, ';') kept FROM gj
UNION ALL SELECT incident_id, 'dependency', array_to_string(list_filter(dependencies[1:10], lambda z: list_contains(deps, lower(z))), ';') FROM gj
UNION ALL SELECT g.incident_id, 'sql', coalesce((SELECT string_agg(title, ';' ORDER BY position) FROM sql_rows r WHERE r.incident_id=g.incident_id AND EXISTS (SELECT 1 FROM strong s WHERE s.incident_id=g.incident_id
   AND lower(s.category)='database' AND ((contains(lower(s.label),'database name') AND lower(s.value)='unknown') OR ((contains(lower(s.label),'database object') OR contains(lower(s.label),'database operation')) AND contains(lower(r.query), lower(s.value)))))), '') FROM gj g
UNION ALL SELECT g.incident_id, 'code', coalesce((SELECT string_agg(class_name, ';' ORDER BY position) FROM code_rows r WHERE r.incident_id=g.incident_id AND EXISTS (SELECT 1 FROM strong s WHERE s.incident_id=g.incident_id
   AND ((s.authority='RepositoryMatch' AND (contains(lower(s.value), 'unknown') OR contains(lower(s.value), lower(r.class_name)) OR contains(lower(s.value), lower(r.method_name))))
     OR (s.authority='RawLog' AND lower(s.category)='stack' AND (contains(lower(s.value), lower(r.class_name)) OR contains(lower(s.value), lower(r.method_name))))))), '') FROM gj g""", "gj sql_rows code_rows strong"))
def _(spark, sf):
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ";")
    return guarded(spark, sf).select("incident_id", F.inline(F.array(
        F.struct(F.lit("component").alias("part"), flat(F.col("affected_components")).alias("kept")),
        F.struct(F.lit("dependency").alias("part"), names("dependency_findings", "name").alias("kept")),
        F.struct(F.lit("sql").alias("part"), names("suggested_sql", "title").alias("kept")),
        F.struct(F.lit("code").alias("part"), names("code_locations", "class_name").alias("kept")))))


# Every statement of the fixture belongs to at most one kind, so a key per statement is enough.
key = lambda z: f"CASE WHEN contains(lower({z}), 'application identity') THEN 'app' WHEN contains(lower({z}), 'affected workflow') THEN 'flow' WHEN contains(lower({z}), 'physical database') THEN 'db' ELSE lower(regexp_replace({strip(z)}, '\\.+$', '')) END"
step("guard_unknown_rows", "guard_base all_claims", f"""
SELECT incident_id, 0 part, generate_subscripts(u, 1) place, unnest(u) AS v FROM (SELECT incident_id, {iv.unknown_sql} u FROM guard_base)
UNION ALL SELECT incident_id, 1, 1, 'Application identity has not been confirmed by authoritative evidence.' FROM guard_base WHERE g_app='Unknown'
UNION ALL SELECT incident_id, 1, 2, 'Affected workflow has not been confirmed by authoritative evidence.' FROM guard_base WHERE g_flow='Unknown'
UNION ALL SELECT incident_id, 1, 3, 'The reason the database operation exceeded the execution timeout has not been confirmed.' FROM guard_base WHERE g_timeout
UNION ALL SELECT incident_id, 2, n, 'Candidate context not treated as fact: ' || label || ' = ' || value FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY claim_no) n FROM all_claims WHERE authority='FuzzyContext') WHERE n <= 5""")
UNKNOWN_SQL = query(f"""SELECT incident_id, string_agg(v, ';' ORDER BY part, place) unknowns FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, {key('v')} ORDER BY part, place) rn FROM guard_unknown_rows) WHERE rn=1 GROUP BY 1""", "guard_unknown_rows")


@check("guard_unknowns", UNKNOWN_SQL)
def _(spark, sf):
    return guarded(spark, sf).select("incident_id", flat(F.col("unknowns")).alias("unknowns"))


@check("equivalent_unknowns", query(f"""SELECT incident_id, string_agg(v, ';' ORDER BY part, place, twice) unknowns FROM (SELECT *, row_number() OVER (PARTITION BY incident_id, {key('v')} ORDER BY part, place, twice) rn
  FROM (SELECT *, 0 twice FROM guard_unknown_rows UNION ALL SELECT incident_id, part + 10, place, ' ' || upper(v) || '. ', 1 FROM guard_unknown_rows)) WHERE rn=1 GROUP BY 1""", "guard_unknown_rows"))
def _(spark, sf):
    u = F.col("unknowns")
    doubled = F.concat(u, F.transform(u, lambda v: F.concat(F.lit(" "), F.upper(v), F.lit(". "))))
    return guarded(spark, sf).select("incident_id", flat(gr.equivalent_unknowns(doubled)).alias("unknowns"))


# ---- model responses --------------------------------------------------------------------
FENCE = "'```'"
# The same expressions are valid in both engines.
GOOD = """'{"Summary": "Seen ' || incident_id || {extra} || '", "hypotheses": [{"cause": "Connection failure of ' || incident_id || '", "evidence": ["e1", "", "E1", "e2", null, "e3", "e4", "e5"], "confidence": 130},
 {"Cause": "Slow query", "evidence": "only one", "confidence": 0}, {"cause": "third", "evidence": null, "confidence": 50}], "nextAction": " Increase the timeout of ' || incident_id || ' "}'"""
CONTENT = f"""CASE incident_no % 7 WHEN 0 THEN {GOOD.replace('{extra}', "''")}
 WHEN 1 THEN {FENCE} || 'json' || chr(10) || {GOOD.replace('{extra}', "' after a connection issue'")} || chr(10) || {FENCE}
 WHEN 2 THEN '{{"summary": "  ", "hypotheses": [], "nextAction": "Check database connection"}}'
 WHEN 3 THEN '{{"summary": "broken", '
 WHEN 4 THEN '   '
 WHEN 5 THEN 'null'
 ELSE {GOOD.replace('{extra}', "''")} END"""
step("responses", "incidents", f"SELECT incident_id, incident_no, incident_no % 7 k, incident_no % 7 <> 6 is_successful, {CONTENT} AS content FROM incidents")


def responses(spark, sf):
    return iv.core.ranked(spark, sf).selectExpr("incident_id", "incident_no % 7 <> 6 AS is_successful", f"{CONTENT} AS content")


step("parsed", "responses", """SELECT incident_id, k, CASE k WHEN 3 THEN 'Invalid model JSON.' WHEN 4 THEN 'The model returned an empty response.' WHEN 5 THEN 'The model response could not be deserialized.' WHEN 6 THEN 'The model call was not successful.' ELSE '' END error,
 CASE k WHEN 0 THEN 'Seen ' || incident_id WHEN 1 THEN 'Seen ' || incident_id || ' after a connection issue' WHEN 2 THEN '  ' WHEN 6 THEN 'Seen ' || incident_id ELSE '' END summary,
 CASE WHEN k IN (0, 1, 6) THEN ' Increase the timeout of ' || incident_id || ' ' WHEN k=2 THEN 'Check database connection' ELSE '' END next_action,
 CASE WHEN k IN (0, 1, 6) THEN 'Connection failure of ' || incident_id || ' e1,E1,e2,e3,e4,e5 130;Slow query only one 0;third  50' ELSE '' END hypotheses FROM responses""")


@check("parse_responses", query("SELECT incident_id, error, summary, next_action, hypotheses FROM parsed", "parsed"))
def _(spark, sf):
    one = lambda h: F.concat_ws(" ", h["cause"], F.array_join(h["evidence"], ","), h["confidence"].cast("string"))
    return rs.parse_responses(responses(spark, sf)).withColumn("hypotheses", F.array_join(F.transform("hypotheses", one), ";"))


@shared("merged")
def merged(spark, sf):
    return rs.merge_responses(iv.all_reports(spark, sf), rs.parse_responses(responses(spark, sf)), iv.all_claims(spark, sf))


SAFE = "The incident contains confirmed database command execution-timeout evidence. The available evidence does not establish a database connection failure."
conn = lambda e: has(e, gr.CONNECTION_WORDS)
step("merged_rows", "guard_base parsed", f"""SELECT *, CASE WHEN g_timeout AND {conn('m_summary')} THEN {q(SAFE)} ELSE m_summary END f_summary,
  CASE WHEN g_timeout AND {conn("m_title || ' ' || m_action")} THEN 'Investigate the timed-out database operation' ELSE m_title END f_title,
  CASE WHEN g_timeout AND {conn("m_title || ' ' || m_action")} THEN greatest(85, m_score) ELSE m_score END f_score FROM (
 SELECT g.*, p.k, p.error, CASE WHEN p.error='' AND {nb('p.summary')} THEN {strip('p.summary')} ELSE {iv.summary_sql} END m_summary,
  CASE WHEN p.error='' AND {nb('p.next_action')} THEN 'Recommended next action' ELSE {iv.title_sql} END m_title,
  CASE WHEN p.error='' AND {nb('p.next_action')} THEN {strip('p.next_action')} ELSE {iv.action_sql} END m_action,
  CASE WHEN p.error='' AND {nb('p.next_action')} THEN greatest(80, {iv.action_score}) ELSE {iv.action_score} END m_score
 FROM guard_base g JOIN parsed p USING (incident_id))""")


@check("merge_responses", query("SELECT incident_id, f_summary executive_summary, f_title action_title, f_score action_score FROM merged_rows", "merged_rows"))
def _(spark, sf):
    a = F.col("next_action")
    return merged(spark, sf).select("incident_id", "executive_summary", a["title"].alias("action_title"), a["confidence_score"].alias("action_score"))


@check("guard_connection_claims", query(f"""
SELECT incident_id, 1 position, CASE WHEN g_timeout THEN 'Database operation exceeded execution timeout' ELSE 'Connection failure of ' || incident_id END title, 95 confidence_score, 'e1;e2;e3;e4' support,
  CASE WHEN g_timeout THEN 'No authoritative evidence currently confirms a database connection failure.' ELSE '' END against FROM merged_rows WHERE k IN (0, 1)
UNION ALL SELECT incident_id, 2, 'Slow query', 40, 'only one', '' FROM merged_rows WHERE k IN (0, 1)
UNION ALL SELECT c.incident_id, position, title, {clamp('c.confidence_score', 10, 95)}, support, CASE position WHEN 1 THEN 'The mock decision engine cannot inspect source code, deployment history, database state, or downstream responses.'
   WHEN 2 THEN 'No downstream response payload or availability evidence was provided.' ELSE 'The exact method and failing statement have not yet been confirmed.' END FROM ({iv.CAUSES}) c JOIN merged_rows m USING (incident_id) WHERE m.k NOT IN (0, 1)""", "merged_rows cases"))
def _(spark, sf):
    return rp.child(merged(spark, sf), "root_causes").select(
        "incident_id", "position", "title", "confidence_score", flat(F.col("supporting_evidence")).alias("support"), flat(F.col("contradicting_evidence")).alias("against"))


# A recommendation that is not safe when the timeout is proven.
@check("guard_recommendations", query("""SELECT incident_id, CASE WHEN g_timeout AND length(incident_id) = 8 THEN 'Review timeout only after confirming root cause' ELSE CASE WHEN length(incident_id) = 8 THEN 'Increase the timeout' ELSE 'Keep the timeout' END END title,
  CASE WHEN g_timeout AND length(incident_id) = 8 THEN 90 ELSE 50 END confidence_score FROM guard_base""", "guard_base"))
def _(spark, sf):
    title = F.when(F.length("incident_id") == 8, "Increase the timeout").otherwise("Keep the timeout")
    made = F.array(rp.row(title=title, description="Now", recommendation_type="Permanent", risk="None", confidence_score=50))
    rows = gr.claims_by_incident(iv.all_claims(spark, sf)).select("incident_id", gr.timeout_evidence().alias("timeout"))
    out = rows.select("incident_id", F.inline(gr.guarded_recommendations(made, F.col("timeout"))))
    return out.select("incident_id", "title", "confidence_score")


@check("guarded_reports", query(f"""SELECT count(*) reports, count(*) FILTER (WHERE g_app<>'Unknown') identified, count(*) FILTER (WHERE g_flow<>'Unknown') with_workflow,
  sum(len({DC})) components FROM guard_base JOIN gj USING (incident_id, component_items, dependencies)""", "guard_base gj"))
def _(spark, sf):
    return gr.guarded_reports(iv.all_reports(spark, sf), iv.all_claims(spark, sf)).agg(
        F.count(F.lit(1)).alias("reports"), F.count_if(F.col("application_name") != "Unknown").alias("identified"),
        F.count_if(F.col("affected_workflow") != "Unknown").alias("with_workflow"), F.sum(F.size("affected_components")).alias("components"))


step("plain_guard", "cases claims", f"""SELECT c.*, coalesce(cast(round_even((SELECT avg(confidence_score) FROM claims s WHERE s.incident_id=c.incident_id AND is_confirmed), 0) as int), 25) g_mean FROM cases c""")


@check("investigate", query(f"""SELECT incident_id, 'Unknown' application_name, 'Unknown' affected_workflow, {clamp("(confidence + g_mean) // 2", 20, 90)} overall_confidence,
  {iv.title_sql} action_title FROM plain_guard""", "plain_guard"))
def investigate(spark, sf):
    """All incidents to guarded reports; nothing reused from other queries but the entries."""
    from faultline.plans.investigation import investigate as run
    done = run(iv.core.ranked(spark, sf), iv.kb.incident_entries(spark, sf), iv.inc.error_summaries(iv.core.correlated(spark, sf)),
               iv.kb.kb_tables(spark), iv.APP)
    return done.guarded.select("incident_id", "application_name", "affected_workflow", "overall_confidence", F.col("next_action.title").alias("action_title"))


@check("facts_text", query("""SELECT incident_id, string_agg('- [' || authority || '] [' || category || '] ' || label || ': ' || value || ' (source: ' || source || ')', chr(10) ORDER BY fact_no) facts_text FROM facts GROUP BY 1""", "facts"))
def _(spark, sf):
    return iv.distill.facts_text(iv.facts(spark, sf))
