"""Which application does the evidence belong to, and what is known about it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import blank, clamp, nonblank
from faultline.operators.contributions import COLUMNS, valid
from faultline.plans.staging import staged
from faultline.sources.knowledge import find_package

# Least score, and least lead over the second candidate.
MINIMUM_SCORE = 60
MINIMUM_LEAD = 10


def noisy_or(scores: Column) -> Column:
    """Combined confidence of ``array<struct<score, n>>``: 100 * (1 - prod(1 - s/100)).

    A product over the at most 101 distinct scores; a score of 100 gives exactly 100.
    """
    missed = F.aggregate(
        F.sort_array(scores, False), F.lit(1.0),
        lambda a, x: a * F.power(F.lit(1.0) - x["score"] / F.lit(100.0), x["n"]))
    return clamp(F.bround((F.lit(1.0) - missed) * 100.0, 0).cast("int"), 0, 100)


def profile_candidates(contributions: DataFrame, order: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Identity evidence per application, combined; apart for each value of ``keys``."""
    order_key = [F.col(c) for c in (order or ["source_name", "key", "value"])]
    found = contributions.filter(F.col("is_identity_evidence") & nonblank(F.col("application_id"))).withColumn(
        "score", clamp(F.col("confidence_score"), 0, 100))
    per_score = found.groupBy(*keys, F.lower("application_id").alias("app_key"), "score").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(*order_key, "application_id")).alias("first_id"),
        F.min(F.when(nonblank(F.col("application_name")), F.struct(*order_key, "application_name"))).alias("first_name"))
    return per_score.groupBy(*keys, "app_key").agg(
        F.min("first_id")["application_id"].alias("application_id"),
        F.min_by("first_name", F.when(F.col("first_name").isNotNull(), -F.col("score")))["application_name"].alias("_name"),
        noisy_or(F.collect_list(F.struct("score", "n"))).alias("confidence_score"),
        F.sum("n").alias("evidence_count"),
    ).select(*keys, "application_id", F.coalesce("_name", "application_id").alias("application_name"), "confidence_score", "evidence_count")


def select_candidate(candidates: DataFrame) -> DataFrame:
    """The best candidate when it is good enough and clearly ahead; otherwise no row."""
    top = candidates.orderBy(F.desc("confidence_score"), F.lower("application_name"), "application_id").limit(2)
    both = top.agg(F.sort_array(F.collect_list(F.struct(
        F.col("confidence_score").alias("score"), F.struct("application_id", "application_name").alias("who"))), False).alias("c"))
    best = F.try_element_at("c", F.lit(1))
    second = F.coalesce(F.try_element_at("c", F.lit(2))["score"], F.lit(-1000))
    return both.filter((best["score"] >= MINIMUM_SCORE) & (best["score"] - second >= MINIMUM_LEAD)).select(
        best["who"]["application_id"].alias("application_id"), best["who"]["application_name"].alias("application_name"),
        best["score"].alias("confidence_score"))


def select_candidates(candidates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``select_candidate`` for each value of ``keys``; values without a clear winner have no row.

    Only the two best of a value travel: ranks above two are cut before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("confidence_score"), F.lower("application_name"), "application_id")
    at = lambda n, value: F.max(F.when(F.col("_place") == n, value))
    both = candidates.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= 2).groupBy(*keys).agg(
        at(1, F.struct("application_id", "application_name", "confidence_score")).alias("best"),
        F.coalesce(at(2, F.col("confidence_score")), F.lit(-1000)).alias("second"))
    score = F.col("best.confidence_score")
    return both.filter((score >= MINIMUM_SCORE) & (score - F.col("second") >= MINIMUM_LEAD)).select(*keys, "best.*")


@dataclass
class Profile:
    profile: DataFrame
    candidates: DataFrame
    contributions: DataFrame


#: Contributions, or what makes them from the identities found first: one row of ``case, application_id`` for each case.
Enrichment = DataFrame | Callable[[DataFrame], DataFrame]


def application_profiles(
    discovery: DataFrame, catalog: DataFrame, metadata: DataFrame, enrichment: list[Enrichment], hints: DataFrame, case: str = "case"
) -> Profile:
    """One profile for each row of ``hints`` (``case, hint``), all in one job; every table has the column ``case`` names.

    ``discovery`` are log contributions and ``enrichment`` those of other sources, both with their case; ``catalog`` the
    contributions of all packages. Each case is identified, gets the catalog knowledge of what was found (or else of its hint) and
    the enrichment, which may depend on what was found, and is identified again. Cases share nothing but the catalog.
    """
    columns = [case, *COLUMNS]
    first = select_candidates(profile_candidates(valid(discovery.select(*columns)), keys=(case,)), (case,))
    found = staged(hints.select(case, "hint").join(first, case, "left").select(
        case, F.coalesce("application_id", "hint", F.lit("")).alias("application_id")), "identified")
    packages = find_package(metadata, found.select(F.col("application_id").alias("hint"))).select("hint", F.col("application_id").alias("_package"))
    known = found.select(case, F.col("application_id").alias("hint")).join(packages, "hint").join(
        catalog, F.col("_package") == F.col("application_id")).select(*columns)
    everything = discovery.select(*columns).unionByName(known)
    named = found.select(case, F.col("application_id").alias("_found"))
    for e in enrichment:
        rows = (e(found) if callable(e) else e).select(*columns).join(named, case, "left")
        own = lambda c: F.when(blank(F.col(c)), F.coalesce("_found", c)).otherwise(F.col(c)).alias(c)
        everything = everything.unionByName(rows.select(
            case, own("application_id"), own("application_name"), *[c for c in COLUMNS if c not in ("application_id", "application_name")]))
    everything = staged(valid(everything), "contributions")
    candidates = staged(profile_candidates(everything, keys=(case,)), "candidates")
    final = select_candidates(candidates, (case,)).select(
        case, F.col("application_id").alias("_id"), F.col("application_name").alias("_name"), "confidence_score")
    profile = staged(found.join(final, case, "left").select(
        case, F.coalesce("_id", "application_id").alias("application_id"),
        F.coalesce("_name", "_id", "application_id").alias("application_name"),
        F.coalesce("confidence_score", F.lit(0)).alias("identification_confidence_score")), "profile")
    relevant = everything.join(profile.select(case, F.col("application_id").alias("_chosen")), case).filter(
        blank(F.col("application_id")) | (F.lower("application_id") == F.lower("_chosen")))
    return Profile(profile, candidates, relevant.select(*columns))


def application_profile(
    discovery: DataFrame, catalog: DataFrame, metadata: DataFrame, enrichment: list[Enrichment], hint: str = ""
) -> Profile:
    """Identify the application, add its catalog knowledge, identify again: ``application_profiles`` of one case.

    ``enrichment`` are contributions of sources that need no identity, or functions of the identity that was found.
    """
    one = lambda rows: rows.withColumn("case", F.lit(0))
    each = [(lambda found, e=e: one(e(found.drop("case")))) if callable(e) else one(e) for e in enrichment]
    hints = one(discovery.sparkSession.range(1).select(F.lit(hint).alias("hint")))
    done = application_profiles(one(discovery), catalog, metadata, each, hints)
    return Profile(done.profile.drop("case"), done.candidates.drop("case"), done.contributions.drop("case"))


def get_values(contributions: DataFrame, kind: str) -> DataFrame:
    """Distinct values of one type, first spelling kept."""
    return (
        contributions.filter((F.col("type") == kind) & nonblank(F.col("value")))
        .groupBy(F.lower("value").alias("_k")).agg(F.min("value").alias("value")).select("value"))
