"""Log lines to entries, error summaries, incidents and health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from faultline.operators import assemble, correlate as corr, incidents as inc
from faultline.plans.staging import staged


@dataclass
class Analysis:
    entries: DataFrame
    summaries: DataFrame
    summary: DataFrame
    sessions: DataFrame
    incidents: DataFrame
    health: DataFrame


def correlated_entries(entries: DataFrame) -> DataFrame:
    """Parse once, correlate once; both results are shared by later branches."""
    return staged(corr.correlate(staged(entries, "entries")), "correlated")


def ranked_incidents(correlated: DataFrame) -> DataFrame:
    return inc.incident_ranking(inc.incidents(inc.incident_sessions(correlated)))


def analyze_entries(entries: DataFrame, total_lines: DataFrame) -> Analysis:
    correlated = correlated_entries(entries)
    sessions = inc.incident_sessions(correlated)
    ranked = staged(inc.incident_ranking(inc.incidents(sessions)), "incidents")
    return Analysis(
        entries=correlated,
        summaries=inc.error_summaries(correlated),
        summary=inc.analysis_summary(correlated, total_lines),
        sessions=sessions,
        incidents=ranked,
        health=inc.application_health(ranked),
    )


def analyze_plain(lines: DataFrame) -> Analysis:
    events = assemble.multiline_events(lines, stamps=True)
    return analyze_entries(assemble.entries_of(events), assemble.total_lines_plain(events))
