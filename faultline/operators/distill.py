"""Graded facts of an incident and the claims they support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import distinct_ci, nonblank, strip
from faultline.operators.report import is_ignored_value, labelled_values, text_lines

MAX_FACTS, MAX_VALUE = 24, 500
CONFIRMED_TOP, CANDIDATE_TOP = 12, 5
# Authority, order among facts, confidence of a claim.
AUTHORITIES = {
    "RawLog": (100, 95), "ExplicitIdentifier": (90, 90), "OpenApiMatch": (80, 85), "RepositoryMatch": (80, 85),
    "ExactKnowledgeMatch": (70, 80), "KnowledgeMatch": (50, 65), "FuzzyContext": (20, 35), "Unknown": (0, 20),
}
CONFIRMED = ["RawLog", "ExplicitIdentifier", "RepositoryMatch", "OpenApiMatch"]
# Fixed values: (metadata key, category, label, priority, authority, source).
METADATA_FACTS = [
    ("IncidentId", "Incident", "Incident ID", 100, "ExplicitIdentifier", "Investigation platform"),
    ("EvidenceCount", "Scope", "Evidence count", 80, "ExplicitIdentifier", "Investigation platform"),
    ("ErrorPatternCount", "Scope", "Error pattern count", 80, "ExplicitIdentifier", "Investigation platform"),
    ("Application", "Application", "Application candidate", 60, "FuzzyContext", "Application context resolver"),
    ("ContextConfidence", "Application", "Context confidence", 50, "FuzzyContext", "Application context resolver"),
    ("Environment", "Environment", "Environment", 60, "KnowledgeMatch", "Investigation request"),
]
# Fixed values: (line label, category, label, priority); at most five values each.
LABEL_FACTS = [
    ("Exception:", "Failure", "Exception", 100), ("Message:", "Failure", "Message", 100),
    ("Occurrence Count:", "Scope", "Occurrences", 90), ("API Path:", "Request", "API path", 90),
    ("Server:", "Infrastructure", "Server", 90), ("Correlation ID:", "Request", "Correlation ID", 95),
    ("Timestamp:", "Timeline", "Timestamp", 80),
]
# Fixed values: (section heading, category, label, priority, authority, source).
SECTION_FACTS = [
    ("Matched Components:", "Application", "Component candidate", 60, "FuzzyContext", "Application context resolver"),
    ("Matched Workflows:", "Application", "Workflow candidate", 60, "FuzzyContext", "Application context resolver"),
    ("Dependencies:", "Dependency", "Dependency candidate", 55, "FuzzyContext", "Application knowledge"),
    ("Database Objects:", "Database", "Database object candidate", 65, "KnowledgeMatch", "Application knowledge"),
    ("Matched Known Issues:", "Knowledge", "Known issue", 65, "KnowledgeMatch", "Application knowledge"),
    ("Investigation Hints:", "Knowledge", "Investigation hint", 50, "KnowledgeMatch", "Application knowledge"),
]
# Fixed values: (category, label, priority, source, pattern).
PATTERN_FACTS = [
    ("Failure", "Observed exception", 100, "Incident log", r"(?i)\b([A-Za-z_][A-Za-z0-9_.]*Exception)\b"),
    ("Database", "DbContext", 100, "Incident log", r"(?i)\b([A-Za-z_][A-Za-z0-9_.]*DbContext)\b"),
    ("Database", "Command timeout seconds", 100, "Incident log", r"""(?i)CommandTimeout\s*=\s*['"]?(\d+)"""),
    ("Database", "SQL error number", 100, "Incident log", r"(?i)Error Number\s*:\s*(-?\d+)"),
    ("Database", "Database operation", 100, "Incident log", r"(?i)\b((?:dbo\.)?[A-Za-z_][A-Za-z0-9_]{3,})\s+@"),
    ("Stack", "Stack frame", 90, "Incident stack trace",
     r"(?i)\bat\s+([A-Za-z_][A-Za-z0-9_.`<>]+\.[A-Za-z_][A-Za-z0-9_<>]+(?:\([^)]*\))?)"),
    ("Timing", "Observed database duration", 100, "Incident log", r'(?i)Failed executing DbCommand\s*\("([\d,]+ms)"\)'),
]
# A text without this word cannot match the pattern of that label.
NEEDLES = {
    "Observed exception": "exception", "DbContext": "dbcontext", "Command timeout seconds": "commandtimeout",
    "SQL error number": "error number", "Database operation": "@", "Observed database duration": "dbcommand",
}
SQL_NOISE = ["select", "where", "from", "order"]
FRAME_LIMIT, LABEL_LIMIT = 8, 5
# Phrases that are a failure pattern, with priority.
PHRASES = [("Execution Timeout Expired", 100), ("The wait operation timed out", 95)]
FACT = "struct<category:string,label:string,value:string,priority:int,authority:string,source:string>"


def _facts(values: Column, category: str, label: str, priority: int, authority: str, source: str) -> Column:
    return F.transform(values, lambda v: F.struct(
        F.lit(category).alias("category"), F.lit(label).alias("label"), truncated(v).alias("value"),
        F.lit(priority).alias("priority"), F.lit(authority).alias("authority"), F.lit(source).alias("source"))).cast(f"array<{FACT}>")


def truncated(c: Column) -> Column:
    flat = strip(F.regexp_replace(c, r"[\r\n]", " "))
    return F.when(F.length(flat) <= MAX_VALUE, flat).otherwise(F.concat(F.substring(flat, 1, MAX_VALUE), F.lit("...")))


def _looks_like_heading(line: Column) -> Column:
    return F.endswith(line, F.lit(":")) | ~line.rlike(r"\p{Ll}|[\p{L}&&[^\p{Lu}]]")


def section_bullets(lines: Column, heading: str) -> Column:
    """Bullets after the first line equal to the heading, up to the next heading."""
    low, open_, closed = heading.lower(), F.lit(1), F.lit(2)
    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("found"))

    def walk(acc: Column, line: Column) -> Column:
        here = F.lower(line) == low
        ends = (line != "") & ~F.startswith(line, F.lit("- ")) & ~here & _looks_like_heading(line)
        state = F.when(acc["state"] == closed, closed).when(here, open_).when(
            (acc["state"] == open_) & ends, closed).otherwise(acc["state"])
        bullet = (acc["state"] == open_) & F.startswith(line, F.lit("- "))
        value = strip(F.substr(line, F.lit(3)))
        found = F.when(bullet & ~is_ignored_value(value), F.concat(acc["found"], F.array(value))).otherwise(acc["found"])
        return F.when(acc["state"] == closed, acc).otherwise(F.struct(state.alias("state"), found.alias("found")))

    return F.aggregate(lines, start, walk, lambda acc: acc["found"])


def fact_list(text: Column, lines: Column, metadata: Column) -> Column:
    """All graded facts of one investigation text, in order of discovery."""
    found = []
    for key, *rest in METADATA_FACTS:
        v = F.try_element_at(metadata, F.lit(key))
        found.append(_facts(F.filter(F.array(v), lambda x: ~is_ignored_value(x)), *rest))
    for prefix, category, label, priority in LABEL_FACTS:
        found.append(_facts(labelled_values(lines, prefix, LABEL_LIMIT), category, label, priority, "RawLog", "Incident log"))
    for heading, *rest in SECTION_FACTS:
        found.append(_facts(section_bullets(lines, heading), *rest))
    for category, label, priority, source, pattern in PATTERN_FACTS:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        if label in NEEDLES:
            values = F.when(F.contains(F.lower(text), F.lit(NEEDLES[label])), values).otherwise(F.array().cast("array<string>"))
        if label == "Database operation":
            values = F.filter(values, lambda v: ~F.lower(v).isin(SQL_NOISE))
        elif label == "Stack frame":
            values = distinct_ci(F.filter(F.transform(values, strip), lambda v: ~F.startswith(F.lower(v), F.lit("system.threading"))), FRAME_LIMIT)
        found.append(_facts(values, category, label, priority, "RawLog", source))
    for phrase, priority in PHRASES:
        hit = F.when(F.contains(F.lower(text), F.lit(phrase.lower())), F.array(F.lit(phrase))).otherwise(F.array().cast("array<string>"))
        found.append(_facts(hit, "Failure", "Failure pattern", priority, "RawLog", "Incident log"))
    found.append(_facts(labelled_values(lines, "Message:", LABEL_LIMIT), "Failure", "Representative message", 95, "RawLog", "Incident log"))
    return F.filter(F.flatten(F.array(*found)), lambda f: nonblank(f["value"]))


def authority_order(c: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (o, _) in AUTHORITIES.items() for x in (k, o)]), c)


def distilled_facts(texts: DataFrame, max_facts: int | None = MAX_FACTS) -> DataFrame:
    """The strongest facts per incident, 24 unless told otherwise, all with None: ``incident_id, fact_no`` and the fact."""
    split = texts.select("incident_id", "investigation_text", "metadata", text_lines(F.col("investigation_text")).alias("_lines"))
    found = fact_list(F.col("investigation_text"), F.col("_lines"), F.col("metadata"))
    rows = split.select("incident_id", F.posexplode(found).alias("pos", "f")).select("incident_id", "pos", "f.*")
    best = rows.groupBy("incident_id", "authority", *[F.lower(c).alias(f"_{c}") for c in ("category", "label", "value")]).agg(
        F.min("pos").alias("first_pos"),
        F.min_by(F.struct("category", "label", "value", "priority", "source"), F.struct((-F.col("priority")).alias("p"), "pos")).alias("f"))
    order = Window.partitionBy("incident_id").orderBy(F.desc(authority_order(F.col("authority"))), F.desc("f.priority"), "first_pos")
    ranked = best.withColumn("fact_no", F.row_number().over(order))
    return (
        (ranked if max_facts is None else ranked.filter(F.col("fact_no") <= max_facts))
        .select("incident_id", "fact_no", "f.category", "f.label", "f.value", "f.priority", "authority", "f.source"))


def evidence_claims(facts: DataFrame) -> DataFrame:
    """Facts with the confidence their authority gives, confirmed or weak."""
    score = F.element_at(F.create_map(*[F.lit(x) for k, (_, s) in AUTHORITIES.items() for x in (k, s)]), F.col("authority"))
    return with_flags(facts.select(
        "incident_id", F.col("fact_no").alias("claim_no"), "category", "label", "value", "authority", score.alias("confidence_score"), "source"))


def with_flags(claims: DataFrame) -> DataFrame:
    a = F.col("authority")
    return claims.withColumns({
        "is_confirmed": a.isin(CONFIRMED) | ((a == "ExactKnowledgeMatch") & (F.col("confidence_score") >= 80)),
        "is_weak": a.isin("Unknown", "FuzzyContext")})


def authority_split(claims: DataFrame) -> DataFrame:
    """Confirmed (12) and candidate (5) claims: ``part, place`` and the claim."""
    usable = claims.filter(F.col("is_confirmed") | ~F.col("is_weak") | (F.col("authority") == "FuzzyContext")).withColumn(
        "part", F.when(F.col("is_confirmed"), "confirmed").otherwise("candidate"))
    order = Window.partitionBy("incident_id", "part").orderBy(F.desc("confidence_score"), "claim_no")
    return usable.withColumn("place", F.row_number().over(order)).filter(
        F.col("place") <= F.when(F.col("is_confirmed"), CONFIRMED_TOP).otherwise(CANDIDATE_TOP))


def authority_unknowns(incidents: DataFrame, split: DataFrame) -> DataFrame:
    """Statements about what the confirmed claims leave open."""
    label = F.lower("label")
    conf = F.col("part") == "confirmed"
    flags = split.groupBy("incident_id").agg(
        F.bool_or(conf & (F.lower("category") == "application") & F.contains(label, F.lit("application"))).alias("app"),
        F.bool_or(conf & F.contains(label, F.lit("workflow"))).alias("flow"),
        F.bool_or(conf & (label == "database operation")).alias("op"),
        F.bool_or(~conf).alias("cand"))
    f = lambda c: F.coalesce(c, F.lit(False))
    return incidents.select("incident_id").join(flags, "incident_id", "left").select(
        "incident_id", F.array_compact(F.array(
            F.when(~f("app"), "Application identity is not confirmed."),
            F.when(~f("flow"), "Affected workflow is not confirmed."),
            F.when(f("op"), "The physical database containing the observed database operation is not confirmed unless explicitly present in confirmed evidence."),
            F.when(f("cand"), "Candidate application knowledge exists but is not authoritative."))).alias("unknowns"))


def authority_text(split: DataFrame, open_points: DataFrame) -> DataFrame:
    """Text block of confirmed, candidate and unknown statements per incident."""
    said = F.concat(F.lit("- "), F.col("label"), F.lit(": "), F.col("value"))
    part = lambda name, text: F.array_join(F.array_sort(F.collect_list(F.when(
        F.col("part") == name, F.struct("place", text.alias("t")))))["t"], "\n")
    texts = split.groupBy("incident_id").agg(
        part("confirmed", said).alias("c"),
        part("candidate", F.concat(said, F.lit(" ("), F.col("confidence_score").cast("string"), F.lit("% confidence)"))).alias("k"))
    none = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "- None").otherwise(c)
    bullets = F.array_join(F.transform("unknowns", lambda u: F.concat(F.lit("- "), u)), "\n")
    return open_points.join(texts, "incident_id", "left").select("incident_id", F.concat_ws(
        "\n", F.lit("CONFIRMED EVIDENCE"), none(F.col("c")), F.lit(""), F.lit("CANDIDATE CONTEXT"),
        F.lit("These items are NOT confirmed facts."), F.lit("Do not use them to establish application, workflow,"),
        F.lit("database, dependency, or root cause unless independently"), F.lit("supported by confirmed evidence."),
        F.lit(""), none(F.col("k")), F.lit(""), F.lit("UNKNOWNS"), none(bullets)).alias("authority_text"))


def facts_text(facts: DataFrame) -> DataFrame:
    """Facts of an incident as text lines."""
    said = F.concat(F.lit("- ["), F.col("authority"), F.lit("] ["), F.col("category"), F.lit("] "), F.col("label"),
                    F.lit(": "), F.col("value"), F.lit(" (source: "), F.col("source"), F.lit(")"))
    return facts.groupBy("incident_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("fact_no", said.alias("t"))))["t"], "\n").alias("facts_text"))
