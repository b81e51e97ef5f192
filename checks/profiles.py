"""Queries over facts, fingerprints, contributions and application profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import core, fixtures as fx, knowledge as kb
from checks.registry import check, shared
from checks.sql import q, query, step, strip
from faultline.operators import contributions as cn, facts as fa, profile as pf
from faultline.plans.staging import new_folder
from faultline.sources import openapi as oa

EVIDENCE_SQL = "SELECT source || ':' || line_number AS id, raw_content AS text FROM entries"
step("log_evidence", "entries", EVIDENCE_SQL)
# Lines with database wording that the log fixture does not have, one per order.
WORDS = """'Alert Rule : Orders ' || (o_orderkey % 5) || chr(10) || 'Source: srv-' || (o_orderkey % 3) || chr(10) || 'OrderDbContext failed; EXEC dbo.GetOrder' || (o_orderkey % 7) || ' @id=1; spSaveOrder @p; select @x' || chr(10)
 || 'ClientConnectionId: 00000000-0000-0000-0000-00000000000' || (o_orderkey % 4) || ' CommandTimeout=''' || (o_orderkey % 6) || ''' Failed executing DbCommand ("1,' || (200 + o_orderkey % 3) || '"ms)' || chr(10)
 || 'Correlation ID: c' || (o_orderkey % 9) || ' uses Microsoft.EntityFrameworkCore and SignalR via https://cdn.firstcdn.com/a.b.c(x) HTTP Status: 503'"""
step("word_evidence", "", f"SELECT cast(o_orderkey as varchar) id, {WORDS} AS text FROM orders")
step("evidence_rows", "log_evidence word_evidence", "SELECT * FROM log_evidence UNION ALL SELECT * FROM word_evidence")


def evidence_rows(spark, sf):
    logs = core.entries(spark, sf).select(F.concat_ws(":", "source", "line_number").alias("id"), F.col("raw_content").alias("text"))
    return logs.unionByName(fx.table(spark, sf, "orders").selectExpr("cast(o_orderkey as string) AS id", f"{WORDS} AS text"))


value = lambda key, v: {
    "DatabaseOperation": f"CASE WHEN lower({strip(v)}) NOT IN ('select','from','where','exec','execute') THEN {strip(v)} END",
    "Namespace": f"CASE WHEN NOT starts_with(lower({strip(v)}), 'system.') AND NOT starts_with(lower({strip(v)}), 'microsoft.') AND NOT contains(lower({v}), 'firstcdn.com') THEN {strip(v)} END",
    "DbCommandDurationMs": f"cast(try_cast(replace({strip(v)}, ',', '') as bigint) as varchar)",
}.get(key, strip(v))


def facts_sql(source: str) -> str:
    parts = [
        f"SELECT id, {n} pattern_no, {q(t)} AS type, {q(k)} AS key, {value(k, 'v')} AS value, {s} confidence_score FROM (SELECT id, unnest(regexp_extract_all(text, {q(p)}, {g})) v FROM {source})"
        for n, (t, k, s, _h, _t, p, g) in enumerate(fa.FACT_PATTERNS)]
    parts += [
        f"SELECT id, {len(fa.FACT_PATTERNS) + n}, {q(t)}, {q(k)}, {q(v)}, {s} FROM {source} WHERE regexp_matches(text, {q(p)})"
        for n, (t, k, s, _t, p, v, _e) in enumerate(fa.FACT_PROBES)]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE regexp_matches(value, '\\S')"


step("raw_facts", "evidence_rows", facts_sql("evidence_rows"))


@check("log_facts", query("SELECT id, type, key, value, confidence_score, count(*) n FROM raw_facts GROUP BY ALL", "raw_facts"))
def _(spark, sf):
    return fa.log_facts(evidence_rows(spark, sf)).groupBy("id", "type", "key", "value", "confidence_score").agg(F.count(F.lit(1)).alias("n"))


@check("log_facts_documents", "SELECT type, key, count(*) n FROM (" + facts_sql("(SELECT doc_id AS id, text FROM documents)") + ") GROUP BY 1, 2")
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return fa.log_facts(docs).groupBy("type", "key").agg(F.count(F.lit(1)).alias("n"))


@check("database_operations", query("SELECT lower(value) AS value, count(*) n FROM raw_facts WHERE key='DatabaseOperation' GROUP BY 1", "raw_facts"))
def _(spark, sf):
    return fa.database_operations(evidence_rows(spark, sf)).groupBy(F.lower("value").alias("value")).agg(F.count(F.lit(1)).alias("n"))


@check("dedupe_keep_best", query("SELECT type, key, lower(value) AS value, max(confidence_score) confidence_score FROM raw_facts GROUP BY 1, 2, 3", "raw_facts"))
def _(spark, sf):
    found = fa.dedupe_keep_best(fa.log_facts(evidence_rows(spark, sf)), ["type", "key", "value"], [F.col("pattern_no"), F.col("id"), F.col("match_no")])
    return found.select("type", "key", F.lower("value").alias("value"), "confidence_score")


@check("distinct_ignore_case", query("SELECT type, min(value) AS value FROM raw_facts GROUP BY type, lower(value)", "raw_facts"))
def _(spark, sf):
    found = fa.log_facts(evidence_rows(spark, sf)).select("type", "value")
    return fa.distinct_ignore_case(found, ["type"], "value", [F.col("value")])


@check("sql_keyword_filter", query("SELECT count(*) n, count(distinct lower(value)) names FROM raw_facts WHERE key='DatabaseOperation' AND lower(value) NOT IN ('select','from','where','exec','execute')", "raw_facts"))
def _(spark, sf):
    return fa.database_operations(evidence_rows(spark, sf)).filter(~fa.is_sql_keyword(F.col("value"))).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(F.lower("value")).alias("names"))


@check("namespace_filter", query("SELECT value, count(*) n FROM raw_facts WHERE key='Namespace' GROUP BY 1", "raw_facts"))
def _(spark, sf):
    return fa.log_facts(evidence_rows(spark, sf)).filter((F.col("key") == "Namespace") & fa.is_application_namespace(F.col("value"))).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@check("evidence_nonblank", "SELECT count(*) n FROM conversations WHERE regexp_matches(text, '\\S')")
def _(spark, sf):
    return fa.evidence_nonblank(fx.table(spark, sf, "conversations"), "text").agg(F.count(F.lit(1)).alias("n"))


@check("ignored_value", query("""SELECT v, n FROM (SELECT correlation_id v, count(*) n FROM incidents GROUP BY 1 UNION ALL SELECT CASE WHEN api_path='' THEN 'None Matched' ELSE 'UNKNOWN' END, count(*) FROM incidents GROUP BY 1)
  WHERE regexp_matches(v, '\\S') AND lower(v) NOT IN ('unknown','none matched','not detected')""", "incidents"))
def _(spark, sf):
    from faultline.operators.report import is_ignored_value
    found = core.ranked(spark, sf)
    other = F.when(F.col("api_path") == "", "None Matched").otherwise("UNKNOWN")
    values = found.select(F.col("correlation_id").alias("v")).unionByName(found.select(other.alias("v")))
    return values.filter(~is_ignored_value(F.col("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))


# ---- fingerprints: one application per customer segment or supplier ----------------------
step("prints", "", f"""
SELECT * FROM (SELECT 'SUP-' || (s_suppkey % 40) application_id, 'F' || s_suppkey id,
 CASE s_suppkey % 6 WHEN 0 THEN 'GetOrder' || (s_suppkey % 10) WHEN 1 THEN 'srv-' || (s_suppkey % 5) WHEN 2 THEN 'SVC' || (s_suppkey % 6) || '\\.run' WHEN 3 THEN 'appprivspr1' || (s_suppkey % 4) WHEN 4 THEN '(bad[' ELSE 'Spsave' END AS value,
 CASE s_suppkey % 6 WHEN 0 THEN 'Contains' WHEN 1 THEN 'exact' WHEN 2 THEN 'Regex' WHEN 3 THEN 'Contains' WHEN 4 THEN 'Regex' ELSE 'StartsWith' END match_mode,
 s_suppkey % 130 weight, s_suppkey % 12 = 3 is_case_sensitive FROM supplier)""")


def prints(spark, sf):
    return fx.table(spark, sf, "supplier").selectExpr(
        "'SUP-' || (s_suppkey % 40) AS application_id", "'Supplier ' || (s_suppkey % 40) AS application_name", "'F' || s_suppkey AS id",
        r"""CASE s_suppkey % 6 WHEN 0 THEN 'GetOrder' || (s_suppkey % 10) WHEN 1 THEN 'srv-' || (s_suppkey % 5) WHEN 2 THEN 'SVC' || (s_suppkey % 6) || '\\.run' WHEN 3 THEN 'appprivspr1' || (s_suppkey % 4) WHEN 4 THEN '(bad[' ELSE 'Spsave' END AS value""",
        "CASE s_suppkey % 6 WHEN 0 THEN 'Contains' WHEN 1 THEN 'exact' WHEN 2 THEN 'Regex' WHEN 3 THEN 'Contains' WHEN 4 THEN 'Regex' ELSE 'StartsWith' END AS match_mode",
        "cast(s_suppkey % 130 as int) AS weight", "s_suppkey % 12 = 3 AS is_case_sensitive", "'ServerName' AS type", "array('t') AS tags")


step("print_hits", "prints evidence_rows raw_facts", """
SELECT p.* FROM prints p WHERE
 (lower(match_mode)='contains' AND EXISTS (SELECT 1 FROM evidence_rows e WHERE CASE WHEN is_case_sensitive THEN contains(e.text, p.value) ELSE contains(lower(e.text), lower(p.value)) END))
 OR (lower(match_mode)='regex' AND p.value <> '(bad[' AND EXISTS (SELECT 1 FROM evidence_rows e WHERE regexp_matches(e.text, CASE WHEN p.value = '(bad[' THEN 'x' ELSE '(?i)' || p.value END)))
 OR (lower(match_mode)='exact' AND EXISTS (SELECT 1 FROM raw_facts f WHERE lower(f.value)=lower(p.value)))
 OR (lower(match_mode)='startswith' AND EXISTS (SELECT 1 FROM raw_facts f WHERE starts_with(lower(f.value), lower(p.value))))""")


@check("fingerprint_match", query("SELECT application_id, id AS key, greatest(1, least(100, weight)) confidence_score FROM print_hits", "print_hits"))
def _(spark, sf):
    return fa.fingerprint_match(evidence_rows(spark, sf), fact_table(spark, sf), prints(spark, sf)).select("application_id", "key", "confidence_score")


# As many fingerprints as there are parts.
step("part_prints", "", r"""SELECT 'P-' || (p_partkey % 50) application_id, 'F' || p_partkey id, p_partkey % 9 = 4 is_case_sensitive,
  CASE p_partkey % 4 WHEN 0 THEN 'Contains' WHEN 1 THEN 'Regex' WHEN 2 THEN 'Exact' ELSE 'StartsWith' END match_mode,
  CASE p_partkey % 4 WHEN 0 THEN 'USER=' || p_partkey WHEN 1 THEN 'user=' || p_partkey || '\s+(corr|http)' WHEN 2 THEN 'Svc' || p_partkey ELSE 'svc' || (p_partkey % 700) END AS value FROM part""")


# The numbers that the expressions look for, read once from all texts instead of trying every expression.
step("part_users", "evidence_rows", r"""SELECT DISTINCT true cased, unnest(regexp_extract_all(text, 'user=(\d+)\s+(?:corr|http)', 1)) k FROM evidence_rows
  UNION SELECT DISTINCT false, unnest(regexp_extract_all(lower(text), 'user=(\d+)\s+(?:corr|http)', 1)) FROM evidence_rows""")


@check("fingerprints_of_parts", query(r"""SELECT application_id, count(*) n FROM part_prints p WHERE
 (match_mode = 'Contains' AND EXISTS (SELECT 1 FROM evidence_rows e WHERE CASE WHEN is_case_sensitive THEN contains(e.text, p.value) ELSE contains(lower(e.text), lower(p.value)) END))
 OR (match_mode = 'Regex' AND EXISTS (SELECT 1 FROM part_users u WHERE u.cased = is_case_sensitive AND 'F' || u.k = p.id))
 OR (match_mode = 'Exact' AND EXISTS (SELECT 1 FROM raw_facts f WHERE CASE WHEN is_case_sensitive THEN f.value = p.value ELSE lower(f.value) = lower(p.value) END))
 OR (match_mode = 'StartsWith' AND EXISTS (SELECT 1 FROM raw_facts f WHERE CASE WHEN is_case_sensitive THEN starts_with(f.value, p.value) ELSE starts_with(lower(f.value), lower(p.value)) END))
 GROUP BY 1""", "part_prints part_users evidence_rows raw_facts"))
def _(spark, sf):
    rows = fx.table(spark, sf, "part").selectExpr(
        "'P-' || (p_partkey % 50) AS application_id", "'Part ' || (p_partkey % 50) AS application_name", "'F' || p_partkey AS id",
        r"""CASE p_partkey % 4 WHEN 0 THEN 'USER=' || p_partkey WHEN 1 THEN 'user=' || p_partkey || '\\s+(corr|http)' WHEN 2 THEN 'Svc' || p_partkey ELSE 'svc' || (p_partkey % 700) END AS value""",
        "CASE p_partkey % 4 WHEN 0 THEN 'Contains' WHEN 1 THEN 'Regex' WHEN 2 THEN 'Exact' ELSE 'StartsWith' END AS match_mode",
        "1 AS weight", "p_partkey % 9 = 4 AS is_case_sensitive", "'ServerName' AS type", "array('t') AS tags")
    found = fa.fingerprint_match(evidence_rows(spark, sf), fact_table(spark, sf), rows)
    return found.groupBy("application_id").agg(F.count(F.lit(1)).alias("n"))


@shared("fact_table")
def fact_table(spark, sf):
    return cn.log_fact_table(evidence_rows(spark, sf), [F.col("id")])


@shared("log_contributions")
def log_contributions(spark, sf):
    return cn.log_contributions(evidence_rows(spark, sf), fact_table(spark, sf), prints(spark, sf))


@check("union_contributions", query("""SELECT source_name, type, count(*) n FROM (SELECT 'Log Evidence' source_name, type FROM (SELECT DISTINCT type, key, lower(value) FROM raw_facts)
  UNION ALL SELECT 'Log Evidence', 'ApplicationIdentity' FROM print_hits UNION ALL SELECT 'Application Catalog', type FROM catalog_rows) GROUP BY 1, 2""", "raw_facts print_hits catalog_rows"))
def _(spark, sf):
    both = cn.union_contributions(log_contributions(spark, sf), cn.catalog_contributions(kb.packages(spark, sf)))
    return both.groupBy("source_name", "type").agg(F.count(F.lit(1)).alias("n"))


step("candidates", "print_hits", """SELECT lower(application_id) k, min(application_id) application_id, cast(round_even((1 - product(1 - greatest(1, least(100, weight))/100.0::double))*100, 0) as int) confidence_score, count(*) evidence_count
 FROM print_hits GROUP BY 1""")


@check("profile_candidates", query("SELECT application_id, 'Supplier ' || substr(application_id, 5) application_name, confidence_score, evidence_count FROM candidates", "candidates"))
def _(spark, sf):
    return pf.profile_candidates(log_contributions(spark, sf))


# One selection per group of evidence, decided like the single one.
@check("select_candidate", query("""SELECT application_id, confidence_score FROM (SELECT *, row_number() OVER (ORDER BY confidence_score DESC, lower('Supplier ' || substr(application_id, 5)), application_id) rn,
  lead(confidence_score) OVER (ORDER BY confidence_score DESC, lower('Supplier ' || substr(application_id, 5)), application_id) nxt FROM candidates) WHERE rn=1 AND confidence_score>=60 AND confidence_score-coalesce(nxt,-1000)>=10""", "candidates"))
def _(spark, sf):
    return pf.select_candidate(pf.profile_candidates(log_contributions(spark, sf))).select("application_id", "confidence_score")


def one_clear(spark, sf):
    """Evidence in which only the application SUP-3 is recognised clearly."""
    return log_contributions(spark, sf).filter("NOT is_identity_evidence OR application_id = 'SUP-3'")


@check("application_profile", query("""SELECT CASE WHEN s >= 60 THEN 'SUP-3' ELSE 'APP-1' END application_id,
  CASE WHEN s >= 60 THEN s WHEN EXISTS (SELECT 1 FROM supplier WHERE floor(s_suppkey / 20) = 1) THEN 100 ELSE 0 END identification_confidence_score
  FROM (SELECT coalesce(max(confidence_score), 0) s FROM candidates WHERE application_id = 'SUP-3')""", "candidates"))
def _(spark, sf):
    found = kb.packages(spark, sf)
    p = pf.application_profile(one_clear(spark, sf), cn.catalog_contributions(found), found.metadata, [], "APP-1")
    return p.profile.select("application_id", "identification_confidence_score")


@check("profile_contributions", query("""SELECT type, count(*) n FROM (SELECT type FROM (SELECT DISTINCT type, key, lower(value) FROM raw_facts)
  UNION ALL SELECT type FROM catalog_rows WHERE application_id='APP-1') GROUP BY 1""", "raw_facts catalog_rows"))
def _(spark, sf):
    found = kb.packages(spark, sf)
    nobody = log_contributions(spark, sf).filter("NOT is_identity_evidence")
    p = pf.application_profile(nobody, cn.catalog_contributions(found), found.metadata, [], "app-1")
    return p.contributions.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# All evidence, with applications that compete.
step("winner", "candidates", """SELECT application_id, confidence_score FROM (SELECT *, row_number() OVER (ORDER BY confidence_score DESC, lower('Supplier ' || substr(application_id, 5)), application_id) rn,
  lead(confidence_score) OVER (ORDER BY confidence_score DESC, lower('Supplier ' || substr(application_id, 5)), application_id) nxt FROM candidates) WHERE rn=1 AND confidence_score>=60 AND confidence_score-coalesce(nxt,-1000)>=10""")


def whole_profile(spark, sf):
    found = kb.packages(spark, sf)
    return pf.application_profile(log_contributions(spark, sf), cn.catalog_contributions(found), found.metadata, [], "APP-1")


@check("application_profile_whole", query("""SELECT coalesce((SELECT application_id FROM winner), 'APP-1') application_id, coalesce((SELECT confidence_score FROM winner),
  CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE floor(s_suppkey / 20) = 1) AND 100 - coalesce((SELECT max(confidence_score) FROM candidates), -1000) >= 10 THEN 100 ELSE 0 END) identification_confidence_score""", "candidates winner"))
def _(spark, sf):
    return whole_profile(spark, sf).profile.select("application_id", "identification_confidence_score")


@check("profile_candidates_whole", query("""SELECT application_id, confidence_score, evidence_count FROM candidates
  UNION ALL SELECT 'APP-1', 100, 2 WHERE NOT EXISTS (SELECT 1 FROM winner) AND EXISTS (SELECT 1 FROM supplier WHERE floor(s_suppkey / 20) = 1)""", "candidates winner"))
def _(spark, sf):
    return whole_profile(spark, sf).candidates.select("application_id", "confidence_score", "evidence_count")


@check("profile_contributions_whole", query("""SELECT type, count(*) n FROM (SELECT type FROM (SELECT DISTINCT type, key, lower(value) FROM raw_facts)
  UNION ALL SELECT 'ApplicationIdentity' FROM print_hits WHERE application_id = (SELECT application_id FROM winner)
  UNION ALL SELECT type FROM catalog_rows WHERE application_id='APP-1' AND NOT EXISTS (SELECT 1 FROM winner)) GROUP BY 1""", "raw_facts print_hits winner catalog_rows"))
def _(spark, sf):
    return whole_profile(spark, sf).contributions.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


# One profile for each nation, all in one job: most customers say little about their application, a few say much.
CASES = """SELECT c_nationkey, c_custkey, 'APP-' || (c_custkey % 5) application_id, CASE WHEN c_custkey % 61 = 0 THEN 85 WHEN c_custkey % 7 = 3 THEN 0 ELSE 3 END score,
  'k' || c_custkey k, c_custkey % 11 <> 0 AS identity FROM customer"""
CASE_HINTS = "SELECT DISTINCT c_nationkey, CASE WHEN c_nationkey % 3 = 0 THEN 'app-' || (c_nationkey % 8) WHEN c_nationkey % 3 = 1 THEN '' END hint FROM customer"


def combined(name, rows):
    """Candidates and the clear winner of each nation."""
    step(f"{name}_candidates", rows, f"""SELECT c_nationkey, min(application_id) application_id, cast(round_even((1 - product(1 - greatest(0, least(100, score))/100.0::double))*100, 0) as int) score,
      count(*) evidence_count FROM {rows} WHERE identity GROUP BY c_nationkey, lower(application_id)""")
    step(f"{name}_winner", f"{name}_candidates", f"""SELECT * FROM (SELECT *, row_number() OVER w rn, lead(score) OVER w nxt FROM {name}_candidates
      WINDOW w AS (PARTITION BY c_nationkey ORDER BY score DESC, application_id)) WHERE rn = 1 AND score >= 60 AND score - coalesce(nxt, -1000) >= 10""")


step("case_rows", "", CASES)
combined("first", "case_rows")
step("identified", "first_winner", f"SELECT h.c_nationkey, coalesce(w.application_id, h.hint, '') id FROM ({CASE_HINTS}) h LEFT JOIN first_winner w USING (c_nationkey)")
step("all_case_rows", "case_rows identified catalog_rows", f"""SELECT c_nationkey, application_id, score, identity, k FROM case_rows
  UNION ALL SELECT c_nationkey, application_id, 100, is_identity_evidence, key FROM identified JOIN catalog_rows ON lower(id) = lower(application_id) WHERE value <> ''
  UNION ALL SELECT c_nationkey, id, 45, id <> '', 'Service' FROM identified""")
combined("final", "all_case_rows")


@shared("case_profiles")
def case_profiles(spark, sf):
    found = kb.packages(spark, sf)
    row = lambda df, kind: df.selectExpr(
        "c_nationkey", "application_id", "application_id AS application_name", "'Other' AS type", "k AS key", "k AS value", "score AS confidence_score",
        f"'{kind}' AS source_kind", f"'{kind}' AS source_name", "'' AS evidence", "identity AS is_identity_evidence", "array('t') AS tags")
    customers = fx.table(spark, sf, "customer")
    customers.createOrReplaceTempView("profile_customer")
    rows = row(spark.sql(CASES.replace("FROM customer", "FROM profile_customer")), "Log")
    hints = spark.sql(CASE_HINTS.replace("FROM customer", "FROM profile_customer"))
    service = lambda first: row(first.selectExpr("c_nationkey", "application_id", "'Service' AS k", "45 AS score", "application_id <> '' AS identity"), "Service")
    done = pf.application_profiles(rows, cn.catalog_contributions(found), found.metadata, [service], hints, "c_nationkey")
    texts = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    parts = {"profile": done.profile, "candidates": done.candidates, "contributions": done.contributions.drop("tags")}
    out = None
    for name, df in parts.items():
        part = texts(df).withColumn("part", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


@check("application_profiles", query("""SELECT c_nationkey, coalesce(w.application_id, id) application_id, coalesce(w.score, 0) score
  FROM identified LEFT JOIN final_winner w USING (c_nationkey)""", "identified final_winner"))
def _(spark, sf):
    return case_profiles(spark, sf).filter("part = 'profile'").selectExpr(
        "cast(c_nationkey AS long) c_nationkey", "application_id", "cast(identification_confidence_score AS int) score")


@check("application_profiles_candidates", query("SELECT c_nationkey, application_id, score, evidence_count FROM final_candidates", "final_candidates"))
def _(spark, sf):
    return case_profiles(spark, sf).filter("part = 'candidates'").selectExpr(
        "cast(c_nationkey AS long) c_nationkey", "application_id", "cast(confidence_score AS int) score", "cast(evidence_count AS long) evidence_count")


@check("application_profiles_contributions", query("""SELECT a.c_nationkey, count(*) n, cast(sum(a.score) as bigint) score FROM all_case_rows a JOIN identified i USING (c_nationkey)
  LEFT JOIN final_winner w USING (c_nationkey) WHERE a.application_id = '' OR lower(a.application_id) = lower(coalesce(w.application_id, i.id)) GROUP BY 1""",
  "all_case_rows identified final_winner"))
def _(spark, sf):
    return case_profiles(spark, sf).filter("part = 'contributions'").groupBy(F.col("c_nationkey").cast("long").alias("c_nationkey")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("confidence_score").cast("long")).alias("score"))


@check("select_candidates", query("SELECT c_nationkey, application_id, score FROM first_winner", "first_winner"))
def _(spark, sf):
    rows = fx.table(spark, sf, "customer")
    rows.createOrReplaceTempView("profile_customer")
    found = spark.sql(CASES.replace("FROM customer", "FROM profile_customer")).selectExpr(
        "c_nationkey", "application_id", "application_id AS application_name", "k AS key", "k AS value", "'Log' AS source_name", "score AS confidence_score",
        "identity AS is_identity_evidence")
    return pf.select_candidates(pf.profile_candidates(found, keys=("c_nationkey",)), ("c_nationkey",)).selectExpr(
        "c_nationkey", "application_id", "confidence_score AS score")


@check("get_values", query("SELECT min(value) AS value FROM raw_facts WHERE type='Exception' GROUP BY lower(value)", "raw_facts"))
def _(spark, sf):
    found = fa.log_facts(evidence_rows(spark, sf))
    return pf.get_values(found, "Exception")


# ---- OpenAPI documents derived from the pages table ---------------------------------------
HOST, PATH = "regexp_extract(url, '://([^/]+)', 1)", "regexp_extract(url, '://[^/]+(/[^?#]*)', 1)"
DOC = f"""CASE WHEN page_id % 10 = 9 THEN '{{"info": {{"title": "broken"' ELSE '{{"openapi": "3.0", "info": {{"title": "' || {HOST} || '", "version": "' || (page_id % 4) || '", "description": "Page ' || page_id || '"}},
 "servers": [{{"url": "https://' || {HOST} || '"}}, {{"description": "no url"}}], "paths": {{"' || {PATH} || '": {{"get": {{"operationId": "read' || page_id || '", "tags": ["pages", ""], "summary": "Read"}},
 "POST": {{"tags": ["Pages"]}}, "parameters": []}}}}, "components": {{"schemas": {{"Page' || (page_id % 7) || '": {{}}}}}}}}' END"""
step("docs", "", f"SELECT page_id, '/api/doc' || page_id || '.' || CASE WHEN page_id % 10 = 8 THEN 'yaml' ELSE 'json' END path, {HOST} host, {PATH} route FROM pages")
row_ = lambda t, k, v, s, w="page_id % 10 < 8": f"SELECT '{t}' AS type, {k} AS key, {v} AS value, {s} confidence_score FROM docs WHERE {w}"
step("api_rows", "docs", " UNION ALL ".join([
    row_("Other", "'OpenApiTitle'", "host", 100), row_("Version", "'ApiVersion'", "cast(page_id % 4 as varchar)", 100), row_("Other", "'ApiDescription'", "'Page ' || page_id", 100),
    row_("Technology", "'Specification'", "'OpenAPI'", 100), row_("Dependency", "'ApiServer'", "'https://' || host", 95), row_("ApiEndpoint", "'Route'", "route", 100, "page_id % 10 < 8 AND route <> ''"),
    row_("ApiEndpoint", "'Operation'", "'GET ' || route", 100, "page_id % 10 < 8 AND route <> ''"), row_("ApiEndpoint", "'Operation'", "'POST ' || route", 100, "page_id % 10 < 8 AND route <> ''"),
    row_("Component", "'OperationId'", "'read' || page_id", 95, "page_id % 10 < 8 AND route <> ''"), row_("Component", "'ApiTag:GET ' || route", "'pages'", 85, "page_id % 10 < 8 AND route <> ''"),
    row_("Component", "'ApiTag:POST ' || route", "'Pages'", 85, "page_id % 10 < 8 AND route <> ''"), row_("Other", "'Summary:GET ' || route", "'Read'", 100, "page_id % 10 < 8 AND route <> ''"),
    row_("Other", "'ApiSchema'", "'Page' || (page_id % 7)", 90)]))


def documents(spark, sf):
    return oa.openapi_documents(fx.table(spark, sf, "pages").selectExpr(
        "'/api/doc' || page_id || '.' || CASE WHEN page_id % 10 = 8 THEN 'yaml' ELSE 'json' END AS path", f"{DOC} AS content"))


@check("openapi_contributions", query("SELECT type, lower(key) AS key, lower(value) AS value, max(confidence_score) confidence_score FROM api_rows GROUP BY 1, 2, 3", "api_rows"))
def _(spark, sf):
    return oa.openapi_contributions(documents(spark, sf), "API").select("type", F.lower("key").alias("key"), F.lower("value").alias("value"), "confidence_score")


@check("openapi_scan", query("""SELECT CASE WHEN page_id % 10 = 9 THEN 'invalid' ELSE 'parsed' END state, count(*) n FROM docs GROUP BY 1""", "docs"))
def _(spark, sf):
    folder = new_folder(spark, "openapi")
    fx.table(spark, sf, "pages").selectExpr("page_id AS doc", f"{DOC} AS value").repartition("doc").write.partitionBy("doc").text(folder)
    found = oa.openapi_scan(spark, folder).withColumn("path", F.lit("x.json"))
    return oa.openapi_documents(found.select("path", "content")).groupBy(
        F.when(F.col("warning").isNotNull(), "invalid").otherwise("parsed").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@check("union_warnings", query("""SELECT 'OpenAPI Intelligence: OpenAPI YAML document ''' || path || ''' was detected. JSON OpenAPI documents are supported in the current implementation.' warning FROM docs WHERE page_id % 10 = 8
  UNION ALL SELECT 'OpenAPI Intelligence: OpenAPI document ''' || path || ''' could not be analyzed: invalid JSON.' FROM docs WHERE page_id % 10 = 9""", "docs"))
def _(spark, sf):
    return cn.union_warnings((oa.SOURCE, oa.openapi_warnings(documents(spark, sf))))


@check("openapi_locations", """SELECT '/docs/' || p_partkey || '.json' AS location FROM part WHERE p_partkey % 3 = 0""")
def _(spark, sf):
    meta = fx.table(spark, sf, "part").selectExpr(
        "stack(2, 'Source:' || p_partkey || ':Location', '/docs/' || p_partkey || '.json', 'source:' || p_partkey || ':TYPE', CASE WHEN p_partkey % 3 = 0 THEN 'openapi' ELSE 'Repository' END) AS (key, value)")
    return oa.openapi_locations(meta)


@check("build_profile", """SELECT CASE WHEN n > 0 THEN 'APP-2' ELSE 'app-2' END application_id, CASE WHEN n > 0 THEN 'Supplier // Group 2' ELSE 'app-2' END application_name
  FROM (SELECT count(*) n FROM supplier WHERE floor(s_suppkey / 20) = 2)""")
def build(spark, sf):
    """The whole plan from evidence to profile; the hint decides, as no fingerprint of these packages fits."""
    from faultline.plans.profile import build_profile
    api = oa.openapi_contributions(documents(spark, sf))
    done = build_profile(evidence_rows(spark, sf), [F.col("id")], kb.packages(spark, sf), [api], "app-2")
    return done.profile.select("application_id", "application_name")
