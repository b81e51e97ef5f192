"""Knowledge contributions: one narrow row per statement about an application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import nonblank
from faultline.operators.facts import distinct_facts, fingerprint_match
from faultline.sources.json_text import get_text
from faultline.sources.knowledge import PACKAGE_FILES, Packages

COLUMNS = [
    "application_id", "application_name", "type", "key", "value", "confidence_score", "source_kind",
    "source_name", "evidence", "is_identity_evidence", "tags",
]
# Contribution type of each package list.
PACKAGE_TYPES = {
    "repositories": "Repository", "architecture": "Component", "workflows": "Workflow",
    "dependencies": "Dependency", "apis": "ApiEndpoint", "database": "DatabaseObject",
    "runbooks": "Runbook", "knownissues": "KnownIssue", "configuration": "Configuration",
}


def log_fact_table(evidence: DataFrame, order: list[Column], text: str = "text") -> DataFrame:
    """Distinct facts of all evidence, the best spelling of each; a written table."""
    return distinct_facts(evidence, order, text)


def log_contributions(evidence: DataFrame, facts: DataFrame, prints: DataFrame, text: str = "text") -> DataFrame:
    """Identity contributions from fingerprints plus all technical facts."""
    technical = facts.select(
        F.lit("").alias("application_id"), F.lit("").alias("application_name"), "type", "key", "value",
        "confidence_score", F.lit("Log").alias("source_kind"), F.lit("Log Evidence").alias("source_name"),
        "evidence", F.lit(False).alias("is_identity_evidence"), "tags")
    return valid(fingerprint_match(evidence, facts, prints, text).unionByName(technical))


def catalog_contributions(packages: Packages) -> DataFrame:
    """Flatten packages: metadata, then every list with its id and name."""
    def row(kind, key, value, identity=False):
        return F.struct(
            F.lit(kind).alias("type"), key.alias("key"), value.alias("value"), F.lit(identity).alias("identity"))

    def each(kind, column):
        return F.transform(F.col(column), lambda v: row(kind, F.lit(kind), v))

    m = packages.metadata
    own = m.select("application_id", "application_name", F.inline(F.concat(
        F.array(
            row("ApplicationIdentity", F.lit("ApplicationId"), F.col("application_id"), True),
            row("ApplicationIdentity", F.lit("ApplicationName"), F.col("application_name"), True),
            row("Owner", F.lit("OwnerTeam"), F.col("owner_team")),
            row("Version", F.lit("Version"), F.col("version"))),
        each("Technology", "technologies"), each("Environment", "environments"))))
    name = None
    for kind, (_, field) in PACKAGE_FILES.items():
        hit, value = F.col("kind") == kind, get_text(F.col("fields"), field)
        name = F.when(hit, value) if name is None else name.when(hit, value)
    types = F.create_map(*[F.lit(x) for kv in PACKAGE_TYPES.items() for x in kv])
    listed = (
        packages.items.filter(F.col("kind").isin(*PACKAGE_TYPES))
        .join(m.select("package", "application_id", "application_name"), "package")
        .select("application_id", "application_name", F.element_at(types, F.col("kind")).alias("type"),
                F.col("id").alias("key"), name.alias("value"), F.lit(False).alias("identity"))
    )
    return (
        own.unionByName(listed)
        .filter(nonblank(F.col("value")) | F.col("identity"))
        .select(
            "application_id", "application_name", "type", "key", "value", F.lit(100).alias("confidence_score"),
            F.lit("KnowledgePackage").alias("source_kind"), F.lit("Application Catalog").alias("source_name"),
            F.lit("Declared in the application knowledge package.").alias("evidence"),
            F.col("identity").alias("is_identity_evidence"), F.array().cast("array<string>").alias("tags"))
    )


def valid(contributions: DataFrame) -> DataFrame:
    return contributions.filter(nonblank(F.col("value")))


def union_contributions(*sources: DataFrame) -> DataFrame:
    """All valid contributions of all sources."""
    out = sources[0].select(*COLUMNS)
    for s in sources[1:]:
        out = out.unionByName(s.select(*COLUMNS))
    return valid(out)


def union_warnings(*sources: tuple[str, DataFrame]) -> DataFrame:
    """``warning`` rows of each source, prefixed by the source name."""
    out = None
    for name, df in sources:
        part = df.select(F.concat(F.lit(f"{name}: "), F.col("warning")).alias("warning"))
        out = part if out is None else out.unionByName(part)
    return out
