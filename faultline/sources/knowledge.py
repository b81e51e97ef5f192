"""Application knowledge: the knowledge base, knowledge packages, the catalog."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions.text import blank, nonblank
from faultline.sources.json_text import (
    clean_json, get_bool, get_int, get_ints, get_list, get_text, json_object, required_objects, whole_files,
)

TEXT, LIST, INTS = "text", "list", "ints"
COMPONENT_FIELDS = {
    "name": TEXT, "type": TEXT, "description": TEXT, "apiPaths": LIST, "exceptionTypes": LIST,
    "servers": LIST, "dependencies": LIST, "databaseObjects": LIST, "keywords": LIST, "investigationHints": LIST,
}
WORKFLOW_FIELDS = {
    "name": TEXT, "description": TEXT, "apiPaths": LIST, "components": LIST, "steps": LIST,
    "dependencies": LIST, "keywords": LIST, "investigationHints": LIST,
}
ISSUE_FIELDS = {
    "title": TEXT, "description": TEXT, "apiPaths": LIST, "exceptionTypes": LIST, "httpStatusCodes": INTS,
    "messagePatterns": LIST, "likelyCauses": LIST, "investigationSteps": LIST, "resolutionSteps": LIST,
    "suggestedQueries": LIST,
}
_GET = {TEXT: get_text, LIST: get_list, INTS: get_ints}


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() else c for c in name)


@dataclass
class KnowledgeBase:
    """``components``, ``workflows``, ``issues``; ``pos`` is the place in the file."""

    components: DataFrame
    workflows: DataFrame
    issues: DataFrame
    application_name: str | None = None


def parse_knowledge_base(files: DataFrame) -> KnowledgeBase:
    """``path, content`` of knowledge base files to three tables.

    A list that is no list, or holds an element of another kind, fails the job with its name.
    """
    docs = files.select("path", json_object(clean_json(F.col("content"))).alias("doc"))

    def items(name: str, fields: dict[str, str]) -> DataFrame:
        rows = docs.select(
            "path",
            get_text(F.col("doc"), "applicationName").alias("application_name"),
            F.posexplode(required_objects(get_text(F.col("doc"), name), name)).alias("pos", "m"),
        )
        return rows.select(
            "path", "application_name", "pos",
            *[_GET[kind](F.col("m"), f).alias(snake(f)) for f, kind in fields.items()])

    return KnowledgeBase(
        items("components", COMPONENT_FIELDS), items("workflows", WORKFLOW_FIELDS),
        items("knownIssues", ISSUE_FIELDS))


def knowledge_base_scan(spark: SparkSession, path: str) -> KnowledgeBase:
    return parse_knowledge_base(whole_files(spark, path))


# Files of a package, what they hold, and the field that names an item.
PACKAGE_FILES = {
    "repositories": ("repository", "name"),
    "architecture": ("architecture component", "name"),
    "workflows": ("workflow", "name"),
    "dependencies": ("dependency", "name"),
    "apis": ("API endpoint", "route"),
    "database": ("database object", "name"),
    "runbooks": ("runbook", "title"),
    "knownissues": ("known issue", "title"),
    "configuration": ("configuration item", "key"),
    "fingerprints": ("fingerprint", "value"),
}


@dataclass
class Packages:
    """``metadata``: one row per package. ``items``: all entity lists, fields as a map."""

    metadata: DataFrame
    items: DataFrame
    files: DataFrame


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def parse_packages(files: DataFrame) -> Packages:
    """``package, file, content`` to package tables."""
    kind = F.regexp_extract(F.lower("file"), r"^(.*)\.json$", 1)
    typed = files.withColumns({"kind": kind, "json": clean_json(F.col("content"))})
    m = F.col("m")
    lists = ("technologies", "environments", "supportTeams")
    metadata = (
        typed.filter(F.col("kind") == "application")
        .select("package", json_object(F.col("json")).alias("m"))
        .select(
            "package",
            *[get_text(m, n).alias(snake(n)) for n in (
                "applicationId", "applicationName", "description", "ownerTeam", "businessOwner", "technicalOwner")],
            get_text(m, "version", "1.0").alias("version"),
            get_text(m, "packageVersion", "1.0").alias("package_version"),
            get_bool(m, "isActive", True).alias("is_active"),
            *[get_list(m, n).alias(snake(n)) for n in lists],
            F.from_json(get_text(m, "attributes", "{}"), "map<string,string>").alias("attributes"),
        )
    )
    items = (
        typed.filter(F.col("kind").isin(*PACKAGE_FILES))
        .select("package", "kind", F.posexplode(required_objects(F.col("json"), "package list")).alias("pos", "fields"))
        .withColumn("id", get_text(F.col("fields"), "id"))
    )
    # A package is one small directory; its files are hashed in name order.
    hashed = (
        files.groupBy("package")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.lower("file").alias("k"), "file", F.concat(F.hex("file"), F.hex("content")).alias("h")))).alias("f"))
        .select(
            "package", F.col("f.file").alias("source_files"),
            F.upper(F.sha2(F.unhex(F.array_join(F.col("f.h"), "")), 256)).alias("content_hash"))
    )
    return Packages(metadata, items, hashed)


def knowledge_package_scan(
    spark: SparkSession, path: str,
    locate: Callable[[Column], tuple[Column, Column]] = lambda p: (directory_of(p), file_name_of(p)),
) -> Packages:
    """One directory per application with ``application.json`` and optional lists.

    A package without its required file fails the job.
    """
    raw = whole_files(spark, path)
    package, file = locate(F.col("path"))
    files = raw.select(package.alias("package"), file.alias("file"), "content")
    found = parse_packages(files)
    required = (
        found.files.withColumn(
            "content_hash",
            F.when(
                F.exists("source_files", lambda f: F.lower(f) == "application.json"), F.col("content_hash"))
            .otherwise(F.raise_error(F.concat(
                F.lit("Required application knowledge file 'application.json' was not found in "), F.col("package")))),
        )
    )
    return Packages(found.metadata, found.items, required)


def fingerprints(packages: Packages) -> DataFrame:
    """Typed fingerprint rows with the application they belong to."""
    m = F.col("fields")
    rows = packages.items.filter(F.col("kind") == "fingerprints").select(
        "package", "pos", "id",
        get_text(m, "type", "Unknown").alias("type"), get_text(m, "value").alias("value"),
        get_text(m, "matchMode", "Contains").alias("match_mode"), get_int(m, "weight", 50).alias("weight"),
        get_bool(m, "isCaseSensitive").alias("is_case_sensitive"), get_list(m, "tags").alias("tags"))
    return rows.join(packages.metadata.select("package", "application_id", "application_name"), "package")


def package_validation(packages: Packages) -> DataFrame:
    """``package, error`` for every broken rule; empty when all packages are valid."""
    required = packages.metadata.select(
        "package",
        F.explode(F.array_compact(F.array(*[
            F.when(blank(F.col(c)), F.lit(f"{label} is required.")) for c, label in (
                ("application_id", "ApplicationId"), ("application_name", "ApplicationName"),
                ("package_version", "PackageVersion"))]))).alias("error"))
    labels = F.create_map(*[F.lit(x) for k, (label, _) in PACKAGE_FILES.items() for x in (k, label)])
    label = F.element_at(labels, F.col("kind"))
    missing = packages.items.filter(blank(F.col("id"))).select(
        "package", F.concat(F.lit("A "), label, F.lit(" is missing its ID.")).alias("error"))
    named = packages.items.filter(nonblank(F.col("id"))).select("package", "kind", "pos", "id", F.lower("id").alias("k"))
    first = named.groupBy("package", "kind", "k").agg(F.min("pos").alias("first_pos"))
    repeated = (
        named.join(first, ["package", "kind", "k"])
        .filter(F.col("pos") > F.col("first_pos"))
        .select("package", F.concat(F.lit("Duplicate "), label, F.lit(" ID '"), F.col("id"), F.lit("' was found.")).alias("error"))
    )
    fp = fingerprints(packages)
    who = F.concat(F.lit("Fingerprint '"), F.col("id"), F.lit("'"))
    weights = fp.filter(~F.col("weight").between(1, 100)).select("package", F.concat(
        who, F.lit(" has weight "), F.col("weight").cast("string"), F.lit(". Weight must be between 1 and 100.")).alias("error"))
    values = fp.filter(blank(F.col("value"))).select("package", F.concat(who, F.lit(" Value is required.")).alias("error"))
    return required.unionByName(missing).unionByName(repeated).unionByName(weights).unionByName(values)


def catalog_violations(metadata: DataFrame) -> DataFrame:
    """Blank or repeated application ids; the catalog accepts neither."""
    key = F.lower("application_id")
    return (
        metadata.groupBy(key.alias("application_key"))
        .agg(F.count(F.lit(1)).alias("packages"))
        .filter((F.col("packages") > 1) | blank(F.col("application_key")))
    )


def find_package(metadata: DataFrame, hints: DataFrame) -> DataFrame:
    """Package of each ``hint``: the id (ignoring case), otherwise the name."""
    wanted = hints.filter(nonblank(F.col("hint"))).select("hint", F.lower("hint").alias("_k")).distinct()
    first = lambda key: metadata.groupBy(F.lower(key).alias("_k")).agg(
        F.min_by("package", F.struct(F.lower("application_name"), "application_id", "package")).alias(f"_{key}"))
    return (
        wanted.join(first("application_id"), "_k", "left")
        .join(first("application_name"), "_k", "left")
        .select("hint", F.coalesce("_application_id", "_application_name").alias("package"))
        .filter(F.col("package").isNotNull())
        .join(metadata, "package")
    )
