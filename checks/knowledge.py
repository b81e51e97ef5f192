"""Queries over application knowledge: files, packages, matches with incidents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.core import ranked, sessions
from checks.registry import check, flat, shared
from checks.sql import q, query, step
from faultline.operators import context as ctx
from faultline.operators.contributions import catalog_contributions
from faultline.plans.staging import new_folder
from faultline.sources import knowledge as kn

# A small knowledge base about the services of the log fixture.
COMPONENTS = [
    dict(name="Image Service", type="Controller", description="Images", api_paths=["/api/CommonServiceApi"],
         exception_types=["ArgumentException", "SqlException"], servers=["PRIVSPR11"], dependencies=["Image Store", "Order Database"],
         database_objects=["ImageLog"], keywords=["getmpacimages", "Parameter is not valid", "GETMPACIMAGES"], investigation_hints=["Check the image id.", "Check the store."]),
    dict(name="Submit Service", type="Controller", description="Submit", api_paths=["/api/AciApi/"], exception_types=["SqlException"],
         servers=["PRIVSPR12", ""], dependencies=["order database", "Queue"], database_objects=["AuditLog", "imagelog"],
         keywords=["AciApi", "Execution Timeout", "timeout expired", "Error Number"], investigation_hints=["Check blocking."]),
    dict(name="Sign-in Service", type="Controller", description="Sign-in", api_paths=["/api/accountapi/authenticateuser"], exception_types=[],
         servers=[], dependencies=["Directory"], database_objects=["spSignIn"], keywords=["authenticateuser"], investigation_hints=["check the STORE."]),
    dict(name="Template Service", type="Library", description="Documents", api_paths=[], exception_types=["TemplateExecutionException"],
         servers=["PRIVSPR10"], dependencies=["Template Engine"], database_objects=[], keywords=["Xpertdoc", "template failed", "no such word"], investigation_hints=[]),
    dict(name="Everything", type="Host", description="Host", api_paths=["/api/"], exception_types=["Exception"], servers=["APPPRIV"],
         dependencies=["Network"], database_objects=["AllTables"], keywords=["Svc.cs"], investigation_hints=["Check the host."]),
    dict(name="Order Runner", type="Job", description="Orders", api_paths=[], exception_types=[], servers=[], dependencies=["Order Database"],
         database_objects=["Orders"], keywords=["Web.Orders", "Svc2.Run"], investigation_hints=[]),
]
WORKFLOWS = [
    dict(name="Order intake", description="Intake", api_paths=["/api/AciApi/Submit"], components=["submit service", "Order Runner", "Everything"],
         steps=["Receive", "Store"], dependencies=["Queue", "Mail"], keywords=["Submit"], investigation_hints=["Compare orders."]),
    dict(name="Image retrieval", description="Images", api_paths=["getMpacImages"], components=["Image Service"], steps=["Read"],
         dependencies=["Image Store"], keywords=["Parameter is not valid", "Object reference"], investigation_hints=["Check the image id."]),
    dict(name="Documents", description="Documents", api_paths=[], components=["TEMPLATE SERVICE"], steps=[], dependencies=[],
         keywords=["template failed", "Xpertdoc"], investigation_hints=["Check the template."]),
    dict(name="Sign-in", description="Sign-in", api_paths=["/api/AccountApi"], components=["Sign-in Service"], steps=[], dependencies=["Directory"],
         keywords=[], investigation_hints=[]),
]
ISSUES = [
    dict(title="Blocked audit table", description="Blocking", api_paths=["/api/AciApi/AuditLog"], exception_types=["SqlException"], http_status_codes=[500],
         message_patterns=["Execution Timeout Expired", "Error Number: -2", "execution timeout EXPIRED"], likely_causes=["Blocking"], investigation_steps=["Look at locks."],
         resolution_steps=["Release"], suggested_queries=[]),
    dict(title="Missing image", description="Image", api_paths=["/api/CommonServiceApi"], exception_types=["ArgumentException"], http_status_codes=[404, 500],
         message_patterns=["Parameter is not valid"], likely_causes=["Null image"], investigation_steps=["Check the image id."], resolution_steps=[], suggested_queries=[]),
    dict(title="Null reference", description="Null", api_paths=[], exception_types=["NullReferenceException"], http_status_codes=[],
         message_patterns=["Object reference not set"], likely_causes=["Null"], investigation_steps=["Read the stack."], resolution_steps=[], suggested_queries=[]),
]


def _schema(row: dict) -> str:
    kinds = lambda k, v: "array<int>" if k == "http_status_codes" else "array<string>" if isinstance(v, list) else "string"
    return "pos int, " + ", ".join(f"{k} {kinds(k, v)}" for k, v in row.items())


def kb_tables(spark) -> kn.KnowledgeBase:
    make = lambda rows: spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], _schema(rows[0]))
    return kn.KnowledgeBase(make(COMPONENTS), make(WORKFLOWS), make(ISSUES), "Order Services")


def _values(name: str, rows: list[dict]) -> None:
    lit = lambda v: ("[" + ",".join(lit(x) for x in v) + "]::" + ("INT[]" if v and isinstance(v[0], int) else "VARCHAR[]")) if isinstance(v, list) else q(v) if isinstance(v, str) else str(v)
    step(name, "", "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join([str(i)] + [lit(v) if not (k == "http_status_codes" and not v) else "[]::INT[]" for k, v in r.items()]) + ")" for i, r in enumerate(rows))
         + f") t(pos, {', '.join(rows[0])})")


_values("kb_components", COMPONENTS)
_values("kb_workflows", WORKFLOWS)
_values("kb_issues", ISSUES)
step("incident_text", "incidents sessioned", """
SELECT i.*, concat_ws(chr(10), i.title, i.exception_type, i.api_path, i.server_name, i.environment, t.body) search_text
FROM incidents i JOIN (SELECT signature, session, string_agg(concat_ws(chr(10), message, exception_type, stack_trace, raw_content), chr(10)) body
  FROM sessioned GROUP BY 1, 2) t USING (signature, session)""")
inside = lambda value, lst: f"({value} <> '' AND len(list_filter({lst}, lambda z: regexp_matches(z, '\\S') AND contains(lower({value}), lower(z)))) > 0)"
words = lambda lst: f"list_filter({lst}, lambda z, i: regexp_matches(z, '\\S') AND contains(lower(search_text), lower(z)) AND list_position(list_transform({lst}, lambda y: lower(y)), lower(z)) = i)"
rsn = lambda cond, text: f"CASE WHEN {cond} THEN {text} || '.' END"


def match_step(name, kb, points, word_list, word_points, word_cap, labels, word_label, least, top, extra_score="", extra_reason="NULL", deps="", source="x"):
    conds = {"api": inside("i.api_path", "k.api_paths"), "exc": inside("i.exception_type", "k.exception_types"),
             "srv": inside("i.server_name", "k.servers"), "status": "coalesce(list_contains(k.http_status_codes, i.http_status), false)"}
    vals = {"api": "i.api_path", "exc": "i.exception_type", "srv": "i.server_name", "status": "i.http_status"}
    score = " + ".join(f"CASE WHEN {conds[f]} THEN {p} ELSE 0 END" for f, p in points.items())
    reasons = ", ".join(rsn(conds[f], f"'{labels[f]} matched ' || {vals[f]}") for f in points)
    step(name, f"incident_text {kb} {deps}", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY match_score DESC, pos) AS rank FROM (
 SELECT incident_id, k.*, least(100, {score} + least({word_cap}, {word_points}*len({words('k.' + word_list)})){extra_score}) match_score,
  list_filter([{reasons}, {extra_reason}, {rsn(f"len({words('k.' + word_list)}) > 0", f"'Matched {word_label}: ' || array_to_string({words('k.' + word_list)}, ', ')")}], lambda z: z IS NOT NULL) match_reasons
 FROM incident_text i CROSS JOIN {kb} k {source if source != 'x' else ''}) WHERE match_score >= {least}) WHERE rank <= {top}""")


LABELS = {"api": "API", "exc": "Exception", "srv": "Server", "status": "HTTP status"}
match_step("m_components", "kb_components", {"api": 50, "exc": 25, "srv": 15}, "keywords", 10, 30, LABELS, "keywords", 20, 5)
match_step("m_issues", "kb_issues", {"api": 35, "exc": 30, "status": 15}, "message_patterns", 20, 40, LABELS, "message patterns", 30, 3)
step("matched_names", "m_components", "SELECT incident_id, list(name ORDER BY rank) names FROM m_components GROUP BY 1")
named = "list_filter(coalesce(n.names, []::VARCHAR[]), lambda z: list_contains(list_transform(k.components, lambda y: lower(y)), lower(z)))"
match_step("m_workflows", "kb_workflows", {"api": 50}, "keywords", 10, 30, LABELS, "workflow keywords", 20, 3,
           f" + least(30, 15*len({named}))", rsn(f"len({named}) > 0", f"'Matched components: ' || array_to_string({named}, ', ')"),
           "matched_names", "LEFT JOIN matched_names n USING (incident_id)")


@shared("incident_entries")
def incident_entries(spark, sf):
    """Entries with the id of their incident."""
    ids = ranked(spark, sf).select("signature", "session", "incident_id")
    return sessions(spark, sf).join(ids, ["signature", "session"])


@shared("context_hits")
def hits(spark, sf):
    return ctx.context_hits(ranked(spark, sf), incident_entries(spark, sf), ctx.all_terms(kb_tables(spark)))


@shared("matched_components")
def components(spark, sf):
    return ctx.component_match(ranked(spark, sf), incident_entries(spark, sf), kb_tables(spark), hits(spark, sf))


@shared("matched_workflows")
def workflows(spark, sf):
    return ctx.workflow_match(ranked(spark, sf), incident_entries(spark, sf), kb_tables(spark), components(spark, sf), hits(spark, sf))


@shared("matched_issues")
def issues(spark, sf):
    return ctx.known_issue_match(ranked(spark, sf), incident_entries(spark, sf), kb_tables(spark), hits(spark, sf))


@shared("context_rollup")
def rollup(spark, sf):
    return ctx.context_rollup(ranked(spark, sf), components(spark, sf), workflows(spark, sf), issues(spark, sf))


for _name, _fn, _step, _label in (
    ("component_match", components, "m_components", "name"), ("workflow_match", workflows, "m_workflows", "name"),
    ("known_issue_match", issues, "m_issues", "title"),
):
    @check(_name, query(f"SELECT incident_id, rank, {_label} AS label, match_score, array_to_string(match_reasons, ' ') reasons FROM {_step}", _step))
    def _(spark, sf, fn=_fn, label=_label):
        return fn(spark, sf).select("incident_id", "rank", F.col(label).alias("label"), "match_score", flat(F.col("match_reasons"), " ").alias("reasons"))


@check("incident_search_text", query("""SELECT i.incident_id, lower(w) word FROM incident_text i, (SELECT DISTINCT lower(unnest(keywords)) w FROM kb_components) k
  WHERE contains(lower(i.search_text), w)""", "incident_text kb_components"))
def _(spark, sf):
    terms = ctx.terms_of(kb_tables(spark).components, {"word": "keywords"})
    return ctx.incident_search_words(ranked(spark, sf), incident_entries(spark, sf), terms).withColumnRenamed("term_key", "word")


# Words derived from a table: as many keywords as there are parts, one component for each hundred.
step("part_words", "", "SELECT DISTINCT cast(floor(p_partkey / 100) as int) pos, lower('?ID=' || p_partkey) word FROM part")


@check("context_words_of_parts", query("""SELECT i.incident_id, k.pos, least(30, 10 * count(*)) match_score, count(*) words FROM incident_text i, part_words k
  WHERE contains(lower(i.search_text), k.word) GROUP BY 1, 2""", "incident_text part_words"))
def _(spark, sf):
    parts = fx.table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 100).cast("int").alias("pos")).agg(
        F.collect_list(F.concat(F.lit("?ID="), F.col("p_partkey").cast("string"))).alias("keywords"))
    terms = ctx.terms_of(parts, {"word": "keywords"})
    found = ctx.incident_search_words(ranked(spark, sf), incident_entries(spark, sf), terms)
    return found.join(terms, "term_key").groupBy("incident_id", "pos").agg(
        F.least(F.lit(30), 10 * F.count(F.lit(1))).alias("match_score"), F.count(F.lit(1)).alias("words"))


def union_sql(out, parts):
    rows = " UNION ALL ".join(
        f"SELECT incident_id, {i} part, rank, generate_subscripts({c}, 1) place, unnest({c}) v FROM {s}" for i, (s, c) in enumerate(parts))
    return f"""(SELECT incident_id, string_agg(v, ';' ORDER BY part, rank, place) {out} FROM (
  SELECT *, row_number() OVER (PARTITION BY incident_id, lower(v) ORDER BY part, rank, place) rn FROM ({rows})) WHERE rn = 1 GROUP BY 1)"""


step("rollup", "incidents m_components m_workflows m_issues", f"""
SELECT i.incident_id, coalesce(cast(round_even(s.score, 0) as int), 0) confidence_score, coalesce(a.dependencies, '') dependencies,
  coalesce(b.database_objects, '') database_objects, coalesce(c.hints, '') hints
FROM incidents i LEFT JOIN (SELECT incident_id, avg(match_score) score FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY match_score DESC) rn
   FROM (SELECT incident_id, match_score FROM m_components UNION ALL SELECT incident_id, match_score FROM m_workflows UNION ALL SELECT incident_id, match_score FROM m_issues))
   WHERE rn <= 3 GROUP BY 1) s USING (incident_id)
 LEFT JOIN {union_sql('dependencies', [('m_components', 'dependencies'), ('m_workflows', 'dependencies')])} a USING (incident_id)
 LEFT JOIN {union_sql('database_objects', [('m_components', 'database_objects')])} b USING (incident_id)
 LEFT JOIN {union_sql('hints', [('m_components', 'investigation_hints'), ('m_workflows', 'investigation_hints'), ('m_issues', 'investigation_steps')])} c USING (incident_id)""")


@check("context_rollup", query("SELECT * FROM rollup", "rollup"))
def _(spark, sf):
    return rollup(spark, sf).select(
        "incident_id", "confidence_score", flat(F.col("dependencies")).alias("dependencies"),
        flat(F.col("database_objects")).alias("database_objects"), flat(F.col("investigation_hints")).alias("hints"))


# ---- knowledge files derived from the supplier table ---------------------------------

DOC = "floor(s_suppkey / 25)"


def _kb_files(spark, sf):
    s = fx.table(spark, sf, "supplier")
    odd = F.expr(f"cast({DOC} as int) % 2 = 1")
    key = lambda name: F.when(odd, name[0].upper() + name[1:]).otherwise(name)
    item = F.concat(F.lit('{"'), key("name"), F.lit('": "'), F.col("s_name"), F.lit('", "'), key("apiPaths"), F.lit('": ["/api/'),
                    F.col("s_suppkey").cast("string"), F.lit('", "/v2"], "keywords": ["'), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")), F.lit('"]}'))
    return s.groupBy(F.expr(f"cast({DOC} as int)").alias("doc")).agg(
        F.array_sort(F.collect_list(F.struct("s_suppkey", item.alias("item")))).alias("items")).select(
        "doc", F.concat(F.lit('{"applicationName": "App '), F.col("doc").cast("string"), F.lit('", "components": ['),
                        F.array_join("items.item", ","), F.lit("]}")).alias("value"))


@check("knowledge_base_scan", f"""SELECT 'App ' || cast({DOC} as int) application_name, s_suppkey % 25 pos, s_name AS name,
  '/api/' || s_suppkey || ';/v2' api_paths, 'nation ' || s_nationkey keywords, '' servers FROM supplier""")
def _(spark, sf):
    folder = new_folder(spark, "kb")
    _kb_files(spark, sf).write.partitionBy("doc").text(folder)
    kb = kn.knowledge_base_scan(spark, folder)
    return kb.components.select(
        "application_name", "pos", "name", flat(F.col("api_paths")).alias("api_paths"),
        flat(F.col("keywords")).alias("keywords"), flat(F.col("servers")).alias("servers"))


PACK = "cast(floor(s_suppkey / 20) as int)"
# The same text expressions are valid in both engines.
PACK_FILES = {
    "application.json": None,
    "dependencies.json": """'{"id": "D' || s_suppkey || '", "Name": "' || s_name || '", "tags": ["x",],}'""",
    "fingerprints.json": """'{"id": "FP' || (s_suppkey % 15) || '", "type": "ServerName", "value": "' || CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE s_name END || '", "weight": ' || (s_suppkey % 110) || ', "tags": ["a", "b"]}'""",
    "runbooks.json": """'{"id": "' || CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'R' || s_suppkey END || '", "title": "Call ' || s_nationkey || '"}'""",
}
APPLICATION = """'{ // who it is
 "applicationId": "APP-' || p || '", "applicationName": "Supplier // Group ' || p || '", /* version */ "ownerTeam": "' || CASE WHEN p % 2 = 0 THEN 'Team' ELSE '' END
 || '", "packageVersion": "' || CASE WHEN p % 5 = 3 THEN '' ELSE '2.0' END || '", "technologies": ["Spark", "SQL",], "environments": ["PROD"], "isActive": true,
}'"""


def package_files(spark, sf):
    s = fx.table(spark, sf, "supplier")
    parts = [s.selectExpr(f"{PACK} AS p").distinct().selectExpr("p", "'application.json' AS file", f"{APPLICATION} AS value")]
    for file, item in PACK_FILES.items():
        if item:
            rows = s.selectExpr(f"{PACK} AS p", "s_suppkey AS k", f"{item} AS item").groupBy("p").agg(
                F.array_sort(F.collect_list(F.struct("k", "item"))).alias("i"))
            parts.append(rows.select("p", F.lit(file).alias("file"), F.concat(F.lit("["), F.array_join("i.item", ",\n"), F.lit("\n,]")).alias("value")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.withColumnRenamed("p", "package")


def locate(path):
    return F.regexp_extract(path, "package=([^/]+)/", 1), F.regexp_extract(path, "file=([^/]+)/", 1)


def packages(spark, sf) -> kn.Packages:
    folder = new_folder(spark, "packages")
    package_files(spark, sf).write.partitionBy("package", "file").text(folder)
    return kn.knowledge_package_scan(spark, folder, locate)


step("pack_files", "", " UNION ALL ".join(
    [f"SELECT p, 'application.json' file, {APPLICATION} || chr(10) AS content FROM (SELECT DISTINCT {PACK} p FROM supplier)"]
    + [f"SELECT {PACK} p, {q(f)} file, '[' || string_agg({i}, ',' || chr(10) ORDER BY s_suppkey) || chr(10) || ',]' || chr(10) FROM supplier GROUP BY 1" for f, i in PACK_FILES.items() if i]))


@check("knowledge_package_scan", query("""SELECT cast(p as varchar) package, string_agg(file, ';' ORDER BY file) source_files,
  upper(sha256(string_agg(file || content, '' ORDER BY file))) content_hash, 'APP-' || p application_id, CASE WHEN p % 5 = 3 THEN '' ELSE '2.0' END package_version,
  'Spark;SQL' technologies, 'Supplier // Group ' || p application_name FROM pack_files GROUP BY p""", "pack_files"))
def _(spark, sf):
    found = packages(spark, sf)
    return found.files.join(found.metadata, "package").select(
        "package", flat(F.col("source_files")).alias("source_files"), "content_hash", "application_id", "package_version",
        flat(F.col("technologies")).alias("technologies"), "application_name")


SUP = f"(SELECT *, {PACK} p, s_suppkey k FROM supplier)"
step("fps", "", f"SELECT p, k, 'FP' || (k % 15) id, CASE WHEN k % 9 = 0 THEN '' ELSE s_name END v, k % 110 w FROM {SUP}")


@check("package_validation", query(f"""
SELECT cast(p as varchar) package, 'PackageVersion is required.' error FROM (SELECT DISTINCT p FROM fps) WHERE p % 5 = 3
UNION ALL SELECT cast(p as varchar), 'A runbook is missing its ID.' FROM {SUP} WHERE k % 7 = 0
UNION ALL SELECT cast(p as varchar), 'Duplicate fingerprint ID ''' || id || ''' was found.' FROM (SELECT *, row_number() OVER (PARTITION BY p, id ORDER BY k) rn FROM fps) WHERE rn > 1
UNION ALL SELECT cast(p as varchar), 'Fingerprint ''' || id || ''' has weight ' || w || '. Weight must be between 1 and 100.' FROM fps WHERE w NOT BETWEEN 1 AND 100
UNION ALL SELECT cast(p as varchar), 'Fingerprint ''' || id || ''' Value is required.' FROM fps WHERE v = ''""", "fps"))
def _(spark, sf):
    return kn.package_validation(packages(spark, sf))


@check("catalog_lookup", f"""SELECT hint, 'APP-' || p application_id FROM (SELECT DISTINCT {PACK} p,
  CASE WHEN {PACK} % 2 = 0 THEN 'app-' || {PACK} ELSE 'SUPPLIER // group ' || {PACK} END hint FROM supplier)""")
def _(spark, sf):
    hints = fx.table(spark, sf, "supplier").selectExpr(
        f"CASE WHEN {PACK} % 2 = 0 THEN 'app-' || {PACK} ELSE 'SUPPLIER // group ' || {PACK} END AS hint")
    found = packages(spark, sf)
    unknown = hints.selectExpr("'nobody ' || hint AS hint")
    return kn.find_package(found.metadata, hints.unionByName(unknown)).select("hint", "application_id")


CONTRIB = "SELECT 'APP-' || p application_id, '{t}' AS type, {k} AS key, {v} AS value, {i} AS is_identity_evidence FROM {f}"
PS = f"(SELECT DISTINCT {PACK} p FROM supplier)"
step("catalog_rows", "", " UNION ALL ".join([
    CONTRIB.format(t="ApplicationIdentity", k="'ApplicationId'", v="'APP-' || p", i="true", f=PS),
    CONTRIB.format(t="ApplicationIdentity", k="'ApplicationName'", v="'Supplier // Group ' || p", i="true", f=PS),
    CONTRIB.format(t="Owner", k="'OwnerTeam'", v="'Team'", i="false", f=PS + " WHERE p % 2 = 0"),
    CONTRIB.format(t="Version", k="'Version'", v="'1.0'", i="false", f=PS),
    CONTRIB.format(t="Technology", k="'Technology'", v="'Spark'", i="false", f=PS),
    CONTRIB.format(t="Technology", k="'Technology'", v="'SQL'", i="false", f=PS),
    CONTRIB.format(t="Environment", k="'Environment'", v="'PROD'", i="false", f=PS),
    CONTRIB.format(t="Dependency", k="'D' || k", v="s_name", i="false", f=SUP),
    CONTRIB.format(t="Runbook", k="CASE WHEN k % 7 = 0 THEN ' ' ELSE 'R' || k END", v="'Call ' || s_nationkey", i="false", f=SUP)]))


@check("catalog_contributions", query("SELECT * FROM catalog_rows", "catalog_rows"))
def _(spark, sf):
    return catalog_contributions(packages(spark, sf)).select("application_id", "type", "key", "value", "is_identity_evidence")


@check("catalog_violations", f"""SELECT application_key, count(*) packages FROM (SELECT lower(CASE WHEN {PACK} % 4 = 3 THEN '' ELSE 'App-' || ({PACK} % 3) END) application_key FROM (SELECT DISTINCT floor(s_suppkey / 20) * 20 s_suppkey FROM supplier))
  GROUP BY 1 HAVING count(*) > 1 OR application_key = ''""")
def _(spark, sf):
    rows = fx.table(spark, sf, "supplier").selectExpr(f"{PACK} AS p").distinct().selectExpr(
        "CASE WHEN p % 4 = 3 THEN '' WHEN p % 2 = 0 THEN 'APP-' || (p % 3) ELSE 'app-' || (p % 3) END AS application_id")
    return kn.catalog_violations(rows)
