"""Facts found in evidence text, and fingerprints of applications."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import contains_ci, nonblank, strip
from faultline.operators.word_index import filed, found_in, required_literals
from faultline.plans.staging import staged

# Fact patterns as (type, key, score, identity hint, tags, pattern, group).
FACT_PATTERNS = [
    ("Other", "AlertRule", 95, True, ["alert"], r"(?im)^\s*(?:Alert Rule|Alert Description)\s*:\s*(.+?)\s*$", 1),
    ("Server", "Server", 100, False, ["server"], r"(?im)^\s*Source\s*:\s*([A-Za-z0-9._-]+)\s*$", 1),
    ("DatabaseContext", "DbContext", 100, False, ["database", "ef"], r"\b([A-Za-z_][A-Za-z0-9_]*DbContext)\b", 1),
    ("DatabaseObject", "DatabaseOperation", 95, False, ["database", "sql", "operation"],
     r"(?im)\b((?:sp|usp|eo|dbo)[A-Za-z0-9_]+)\b", 1),
    ("DatabaseObject", "DatabaseOperation", 95, False, ["database", "sql", "operation"],
     r"(?im)\b(?:EXEC(?:UTE)?\s+)?([A-Za-z_][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*|[A-Za-z_][A-Za-z0-9_]{3,})\s+@", 1),
    ("Exception", "Exception", 95, False, ["exception"], r"(?im)\b([A-Za-z0-9_.]+Exception)\b", 1),
    ("Other", "ClientConnectionId", 100, False, ["sql", "connection"],
     r"(?im)\bClientConnectionId\s*:\s*([0-9a-fA-F-]{36})", 1),
    ("Other", "CorrelationId", 100, False, ["correlation"],
     r"(?im)\b(?:CorrelationId|Correlation ID|Correlation-ID)\s*[:=]\s*([A-Za-z0-9._:-]+)", 1),
    ("Other", "SqlErrorNumber", 100, False, ["sql"], r"(?im)\bError Number\s*:\s*(-?\d+)", 1),
    ("Configuration", "CommandTimeoutSeconds", 100, False, ["timeout", "database"],
     r"(?im)\bCommandTimeout\s*=\s*'?(\d+)'?", 1),
    ("Other", "DbCommandDurationMs", 100, False, ["database", "duration", "performance"],
     r'(?im)\bFailed executing DbCommand\s*\("([\d,]+)"ms\)', 1),
    ("Dependency", "Url", 80, False, ["url", "dependency"], r"""(?im)\bhttps?://[^\s"'<>()]+""", 0),
    ("ApiEndpoint", "ApiPath", 90, False, ["api"], r"(?im)(/api/[A-Za-z0-9_./{}-]+)", 1),
    ("Other", "HttpStatus", 100, False, ["http"], r"(?im)\bHTTP\s*(?:Status)?\s*[:=]?\s*([1-5]\d{2})\b", 1),
    ("Namespace", "Namespace", 80, True, ["namespace", "code"],
     r"\b([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*){2,})\b", 1),
]
# Lower-cased text without any of these words cannot match the pattern of the same place, so the
# far cheaper search for the words comes first.
FACT_NEEDLES = [
    ["alert"], ["source"], ["dbcontext"], ["sp", "eo", "dbo"], ["@"], ["exception"], ["clientconnectionid"], ["correlation"],
    ["error number"], ["commandtimeout"], ["dbcommand"], ["http"], ["/api/"], ["http"], ["."],
]
# Probes that give one named fact when they match anywhere.
FACT_PROBES = [
    ("Technology", "Technology", 95, ["technology"], r"(?im)\bMicrosoft\.EntityFrameworkCore\b", "Entity Framework Core", "Entity Framework Core"),
    ("Technology", "Technology", 95, ["technology"], r"(?im)\bMicrosoft\.Data\.SqlClient\b", "Microsoft.Data.SqlClient", "Microsoft.Data.SqlClient"),
    ("Technology", "Technology", 95, ["technology"], r"(?im)\bSystem\.Data\.SqlClient\b", "System.Data.SqlClient", "System.Data.SqlClient"),
    ("Technology", "Technology", 95, ["technology"], r"(?im)\bSignalR\b", "SignalR", "SignalR"),
    ("Technology", "Technology", 95, ["technology"], r"(?im)\bXpertdoc\b", "Xpertdoc", "Xpertdoc"),
    ("Other", "FailurePattern", 100, ["sql", "timeout", "failure"], r"(?im)\bExecution Timeout Expired\b",
     "SQL execution timeout", "Execution Timeout Expired"),
]
PROBE_NEEDLES = [
    ["microsoft.entityframeworkcore"], ["microsoft.data.sqlclient"], ["system.data.sqlclient"], ["signalr"], ["xpertdoc"],
    ["execution timeout expired"],
]
# Words that are not database objects; namespaces that are not the application's.
SQL_KEYWORDS = ["select", "from", "where", "exec", "execute"]
FOREIGN_NAMESPACES = ["system.", "microsoft."]
FOREIGN_HOST = "firstcdn.com"


def evidence_nonblank(df: DataFrame, column: str) -> DataFrame:
    return df.filter(nonblank(F.col(column)))


def is_sql_keyword(value: Column) -> Column:
    return F.lower(value).isin(SQL_KEYWORDS)


def is_application_namespace(value: Column) -> Column:
    v = F.lower(value)
    foreign = contains_ci(value, FOREIGN_HOST)
    for prefix in FOREIGN_NAMESPACES:
        foreign = foreign | F.startswith(v, F.lit(prefix))
    return ~foreign


# Patterns with the same matches as those of the same place, which are found with less work: \w for its ranges, the first letter
# before the look back for a word's begin, and nothing is given back where a shorter run cannot match either.
FACT_SEARCH = {
    2: r"\b((?!\d)\w+DbContext)\b",
    3: r"(?i)([sued](?<=\b.)(?:(?<=s)p|(?<=u)sp|(?<=e)o|(?<=d)bo)\w+)\b",
    4: r"(?i)\b(?:EXEC(?:UTE)?\s+)?((?!\d)\w++\.(?!\d)\w++|(?!\d)\w{4,}+)\s++@",
    5: r"(?i)\b([\w.]+Exception)\b",
    6: r"(?i)C(?<=\b.)lientConnectionId\s*:\s*([0-9a-fA-F-]{36})",
    7: r"(?i)C(?<=\b.)orrelation(?:Id|[ -]ID)\s*[:=]\s*([\w.:-]+)",
    8: r"(?i)E(?<=\b.)rror Number\s*:\s*(-?\d+)",
    9: r"(?i)C(?<=\b.)ommandTimeout\s*=\s*'?(\d+)'?",
    10: r"""(?i)F(?<=\b.)ailed executing DbCommand\s*\("([\d,]+)"ms\)""",
    11: r"""(?i)h(?<=\b.)ttps?://[^\s"'<>()]+""",
    12: r"(?i)(/api/[\w./{}-]+)",
    13: r"(?i)H(?<=\b.)TTP\s*(?:Status)?\s*[:=]?\s*([1-5]\d{2})\b",
    14: r"\b((?!\d)\w++(?:\.(?!\d)\w++){2,})\b",
}
# Keys whose value is all that is quoted as evidence, and never holds white space.
BARE_KEYS = ["DbContext", "DatabaseOperation", "Exception", "Url", "ApiPath", "Namespace"]


def _bare_value(key: str, value: Column) -> Column:
    """Value as stored; null drops the match."""
    if key == "DatabaseOperation":
        return F.when(~is_sql_keyword(value), value)
    if key == "Namespace":
        return F.when(is_application_namespace(value), value)
    return value


def _found(evidence: DataFrame, text: str) -> DataFrame:
    """Input columns other than the text, and ``pattern_no, match_no, value, evidence`` of every fact.

    All patterns run in one projection; nothing is shuffled. What a pattern fixes is not carried along.
    """
    t, low = F.col("_text"), F.col("_low")

    def holds(words: list[str]) -> Column:
        return reduce(or_, [F.contains(low, F.lit(w)) for w in words])

    def fact(no: int, place: Column, value: Column, said: Column) -> Column:
        return F.struct(F.lit(no).alias("pattern_no"), place.alias("match_no"), value.alias("value"), said.alias("evidence"))

    def matches(no: int, entry: tuple) -> Column:
        _, key, _, _, _, pattern, group = entry
        pattern = FACT_SEARCH.get(no, pattern)
        if key in BARE_KEYS:
            found = F.transform(
                F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda v, i: fact(no, i, _bare_value(key, v), v))
            return F.filter(found, lambda f: f["value"].isNotNull()) if key in ("DatabaseOperation", "Namespace") else found

        def read(match: Column, i: Column) -> Column:
            # One scan of the text: the captured part is read from the match itself.
            value = strip(F.regexp_extract(match, pattern, group))
            if key == "DbCommandDurationMs":
                value = F.replace(value, F.lit(","), F.lit("")).try_cast("bigint").cast("string")
            return fact(no, i, value, strip(match))

        return F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), read), lambda f: nonblank(f["value"]))

    none = F.array().cast(FOUND_ARRAY)
    arrays = [F.when(holds(words), matches(no, entry).cast(FOUND_ARRAY)).otherwise(none)
              for no, (entry, words) in enumerate(zip(FACT_PATTERNS, FACT_NEEDLES, strict=True))]
    for no, ((_, _, _, _, pattern, value, said), words) in enumerate(zip(FACT_PROBES, PROBE_NEEDLES, strict=True), len(FACT_PATTERNS)):
        one = F.array(fact(no, F.lit(0), F.lit(value), F.lit(said))).cast(FOUND_ARRAY)
        arrays.append(F.when(holds(words) & t.rlike(pattern), one).otherwise(none))
    keep = [c for c in evidence.columns if c != text]
    prepared = evidence.filter(nonblank(F.col(text))).select(
        *keep, F.col(text).alias("_text"), F.lower(text).alias("_low"))
    return prepared.select(*keep, F.inline(F.flatten(F.array(*arrays))))


FOUND_ARRAY = "array<struct<pattern_no:int,match_no:int,value:string,evidence:string>>"
# What each pattern and probe fixes: type, key, score, identity hint, tags.
_FIXED = [(kind, key, score, hint, tags) for kind, key, score, hint, tags, *_ in FACT_PATTERNS]
_FIXED += [(kind, key, score, False, tags) for kind, key, score, tags, *_ in FACT_PROBES]


def _by_pattern(values: list[Column]) -> Column:
    return F.element_at(F.array(*values), F.col("pattern_no") + 1)


def _named(found: DataFrame) -> DataFrame:
    """Rows of ``_found`` with all columns of a fact."""
    kind, key, score, hint, tags = (
        _by_pattern([F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for v in column]) for column in zip(*_FIXED, strict=True))
    keep = found.columns[:-4]
    return found.select(
        *keep, "pattern_no", "match_no", kind.alias("type"), key.alias("key"), "value", score.alias("confidence_score"), "evidence",
        hint.alias("is_identity_hint"), tags.alias("tags"))


def log_facts(evidence: DataFrame, text: str = "text") -> DataFrame:
    """Every fact of every text: input columns other than the text, plus the fact."""
    return _named(_found(evidence, text))


#: So many groups of a task are kept in memory before the rest of its rows is sorted; some 50 MB.
GROUPS_IN_MEMORY = 65_536


def distinct_facts(evidence: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """``dedupe_keep_best`` of ``log_facts`` by type, key and value, ordered by pattern, ``order`` and match; a written table.

    There are far more facts than distinct ones. Each task keeps the best of a group in a hash map, and sorts by hash and only
    beyond ``GROUPS_IN_MEMORY`` groups; rows carry no columns that their pattern fixes.
    """
    names = [(kind.lower(), key.lower()) for kind, key, *_ in _FIXED]
    group = _by_pattern([F.lit(names.index(n)) for n in names])
    score = _by_pattern([F.lit(s) for _, _, s, _, _ in _FIXED])
    rows = _found(evidence, text)
    low = F.lower("value")
    first = F.struct((-score).alias("s"), F.col("pattern_no"), *order, F.col("match_no"))
    # With min_by alone Spark would always sort; an aggregate of objects that is used lets it hash.
    best = rows.groupBy(F.xxhash64(group, low).alias("_h"), group.alias("_g"), low.alias("_k")).agg(
        F.min_by(F.struct(*rows.columns), first).alias("_best"), F.collect_set(F.lit(True)).alias("_any")).where(
        F.size("_any") > 0).select("_best.*")
    spark, setting = evidence.sparkSession, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, GROUPS_IN_MEMORY)
    try:
        return staged(_named(best), "distinct_facts")
    finally:
        spark.conf.set(setting, before)


def dedupe_keep_best(rows: DataFrame, keys: list[str], order: list[Column], score: str = "confidence_score") -> DataFrame:
    """One row per key ignoring case: highest score, then first in ``order``."""
    lowered = [F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(f"_k{i}") for i, k in enumerate(keys)]
    return (
        rows.groupBy(*lowered)
        .agg(F.min_by(F.struct(*rows.columns), F.struct((-F.col(score)).alias("s"), *order)).alias("_best"))
        .select("_best.*")
    )


def distinct_ignore_case(rows: DataFrame, group: list[str], value: str, order: list[Column]) -> DataFrame:
    """First spelling of every value ignoring case."""
    return (
        rows.filter(nonblank(F.col(value)))
        .groupBy(*group, F.lower(value).alias("_k"))
        .agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first"))
        .select("_first.*")
    )


def database_operations(evidence: DataFrame, text: str = "text") -> DataFrame:
    return log_facts(evidence, text).filter(F.col("key") == "DatabaseOperation")


def is_valid_pattern(pattern: Column) -> Column:
    """True when the regex engine accepts the pattern."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def fingerprint_match(evidence: DataFrame, facts: DataFrame, prints: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints that fit the evidence, as identity contributions.

    ``Exact`` and ``StartsWith`` look at fact values: equality joins, with the prefixes of those lengths that prints have.
    ``Regex`` and everything else look at the text: each print is filed in a gram index under its text, or under a
    literal that every match of the expression holds, and verified on the texts that hold the gram. Expressions without such
    a literal are tried on every text. Equal prints are looked up once, however many applications share them.
    """
    mode = F.lower("match_mode")
    exact_case = F.col("is_case_sensitive")
    usable = prints.filter(nonblank(F.col("value"))).withColumn("mode", F.when(
        mode.isin("exact", "startswith", "regex"), mode).otherwise("contains"))
    usable = usable.filter((F.col("mode") != "regex") | is_valid_pattern(F.col("value"))).withColumn(
        "needle", F.when(F.col("mode") == "regex", F.when(exact_case, F.col("value")).otherwise(F.concat(F.lit("(?i)"), F.col("value"))))
        .when(exact_case, F.col("value")).otherwise(F.lower("value")))
    probes = staged(usable.select("mode", "is_case_sensitive", "needle").distinct(), "probes")

    certain = F.when(F.col("mode") == "regex", required_literals("needle")).otherwise(F.lower("needle"))
    literals = probes.filter(F.col("mode").isin("regex", "contains")).withColumn("literal", F.coalesce(certain, F.lit("")))
    index = staged(filed(staged(literals, "literals"), "literal"), "print_index")
    cased = F.when(F.col("is_case_sensitive"), F.col("_text")).otherwise(F.lower("_text"))
    in_text = F.when(F.col("mode") == "regex", F.rlike(F.col("_text"), F.col("needle"))).otherwise(F.contains(cased, F.col("needle")))
    texts = evidence.select(F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    by_text = found_in(texts, "_text", index, "literal", in_text).select("mode", "is_case_sensitive", "needle")

    short = probes.filter(F.col("mode").isin("exact", "startswith"))
    lengths = [r["n"] for r in short.filter("mode = 'startswith'").select(F.length("needle").alias("n")).distinct().collect()]
    values = facts.filter(F.col("value").isNotNull()).select("value").distinct().select(F.inline(F.array(
        F.struct(F.lit(True).alias("is_case_sensitive"), F.col("value").alias("v")), F.struct(F.lit(False).alias("is_case_sensitive"), F.lower("value").alias("v")))))
    cut = F.transform(F.array(*map(F.lit, sorted(lengths))), lambda n: F.when(F.length("v") >= n, F.substring("v", F.lit(1), n)))
    whole = F.struct(F.lit("exact").alias("mode"), F.col("v").alias("needle"))
    heads = F.transform(F.array_compact(cut), lambda x: F.struct(F.lit("startswith").alias("mode"), x.alias("needle"))) if lengths else F.array()
    kind = "array<struct<mode:string,needle:string>>"
    by_value = values.select("is_case_sensitive", F.inline(F.concat(F.array(whole).cast(kind), heads.cast(kind)))).join(
        short, ["mode", "is_case_sensitive", "needle"], "left_semi")
    met = by_text.unionByName(by_value).distinct()
    found = usable.join(met, ["mode", "is_case_sensitive", "needle"], "left_semi").select("application_id", "id").distinct()
    named = F.concat(F.lit("Matched fingerprint '"), F.col("value"), F.lit("' ("), F.col("type"), F.lit(")."))
    described = prints.select(
        "application_id", "id", F.col("application_name").alias("_name"), F.col("tags").alias("_tags"), named.alias("_said"),
        F.least(F.greatest("weight", F.lit(1)), F.lit(100)).alias("_score"))
    return found.join(described, ["application_id", "id"]).select(
        "application_id", F.col("_name").alias("application_name"), F.lit("ApplicationIdentity").alias("type"), F.col("id").alias("key"),
        F.col("_name").alias("value"), F.col("_score").alias("confidence_score"),
        F.lit("Log").alias("source_kind"), F.lit("Log Evidence").alias("source_name"), F.col("_said").alias("evidence"),
        F.lit(True).alias("is_identity_evidence"), F.col("_tags").alias("tags"))
