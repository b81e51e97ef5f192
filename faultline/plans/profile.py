"""Evidence and sources to an application profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from faultline.operators.contributions import catalog_contributions, log_contributions, log_fact_table
from faultline.operators.profile import Enrichment, Profile, application_profile
from faultline.plans.staging import staged
from faultline.sources.knowledge import Packages, fingerprints


def build_profile(
    evidence: DataFrame, order: list[Column], packages: Packages, enrichment: list[Enrichment],
    hint: str = "", text: str = "text",
) -> Profile:
    """Facts are extracted once and shared by identity and technical statements."""
    facts = log_fact_table(evidence, order, text)
    discovery = staged(log_contributions(evidence, facts, fingerprints(packages), text), "log_contributions")
    return application_profile(discovery, catalog_contributions(packages), packages.metadata, enrichment, hint)
