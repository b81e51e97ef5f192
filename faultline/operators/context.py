"""Incidents against application knowledge.

Configured words are looked for inside incident texts through an index of character
grams (``word_index``), so a text meets only the words it may hold. The words found are
then joined by equality to the knowledge that names them. No incident is paired with
knowledge it does not share a word with, and one pass over the entry texts serves
components, workflows and known issues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import nonblank
from faultline.operators.word_index import filed, found_in
from faultline.plans.staging import staged
from faultline.sources.knowledge import KnowledgeBase

# Points per agreeing field, points and cap per word, threshold, rows kept.
COMPONENT_RULE = {"api": 50, "exc": 25, "srv": 15, "word": (10, 30), "min": 20, "top": 5}
WORKFLOW_RULE = {"api": 50, "component": (15, 30), "word": (10, 30), "min": 20, "top": 3}
ISSUE_RULE = {"api": 35, "exc": 30, "status": 15, "word": (20, 40), "min": 30, "top": 3}


def terms_of(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """``pos, field, term, term_pos``: configured words, each once per item and field."""
    lists = F.array(*[
        F.struct(F.lit(field).alias("field"), F.col(column).cast("array<string>").alias("values"))
        for field, column in fields.items()])
    rows = (
        items.select("pos", F.explode(lists).alias("f"))
        .select("pos", "f.field", F.posexplode("f.values").alias("term_pos", "term"))
        .filter(nonblank(F.col("term")))
        .withColumn("term_key", F.lower("term"))
    )
    return rows.groupBy("pos", "field", "term_key").agg(
        F.min_by("term", "term_pos").alias("term"), F.min("term_pos").alias("term_pos"))


def component_terms(kb: KnowledgeBase) -> DataFrame:
    return terms_of(kb.components, {"api": "api_paths", "exc": "exception_types", "srv": "servers", "word": "keywords"})


def workflow_terms(kb: KnowledgeBase) -> DataFrame:
    return terms_of(kb.workflows, {"api": "api_paths", "word": "keywords"})


def issue_terms(kb: KnowledgeBase) -> DataFrame:
    return terms_of(kb.issues, {
        "api": "api_paths", "exc": "exception_types", "status": "http_status_codes", "word": "message_patterns"})


def all_terms(kb: KnowledgeBase) -> DataFrame:
    """``field, term_key`` of components, workflows and known issues."""
    return component_terms(kb).unionByName(workflow_terms(kb)).unionByName(issue_terms(kb)).select("field", "term_key").distinct()


def context_hits(incidents: DataFrame, entries: DataFrame, terms: DataFrame) -> DataFrame:
    """``incident_id, field, term_key, value``: the configured words in the fields of incidents, and in any of their entries.

    Paths, exceptions, servers and statuses come with the value that holds the word. Words are looked for in the incident's own
    fields and in its entries one by one; only the distinct words travel, so the text of a large incident is never put together.
    """
    part = lambda field, value: F.struct(F.lit(field).alias("field"), value.alias("text"))
    own = incidents.select("incident_id", F.inline(F.array(
        part("api", F.col("api_path")), part("exc", F.col("exception_type")), part("srv", F.col("server_name")),
        part("word", F.concat_ws("\n", "title", "exception_type", "api_path", "server_name", "environment")))))
    each = entries.select("incident_id", F.lit("word").alias("field"), F.concat_ws(
        "\n", "message", "exception_type", "stack_trace", "raw_content").alias("text"))
    terms = staged(terms.select("field", "term_key").distinct(), "terms")
    index = staged(filed(terms.filter(F.col("field") != "status"), "term_key"), "word_index")
    found = found_in(own.unionByName(each), "text", index, "term_key", F.contains(F.lower("text"), F.col("term_key")), ("field",))
    value = F.when(F.col("field") != "word", F.col("text")).alias("value")
    status = incidents.select("incident_id", F.lit("status").alias("field"), F.col("http_status").cast("string").alias("term_key"))
    known = terms.filter(F.col("field") == "status").select("term_key")
    return found.select("incident_id", "field", "term_key", value).distinct().unionByName(
        status.join(known, "term_key").select("incident_id", "field", "term_key", F.col("term_key").alias("value")))


def incident_search_words(incidents: DataFrame, entries: DataFrame, terms: DataFrame) -> DataFrame:
    """``incident_id, term_key``: words inside the incident's own fields or any of its entries."""
    return context_hits(incidents, entries, terms.filter(F.col("field") == "word")).filter(F.col("field") == "word").select("incident_id", "term_key")


def _matches(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Per incident and item: agreeing fields, and the words in configured order."""
    joined = hits.join(terms, ["field", "term_key"])
    value_of = lambda f: F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"{f}_value")
    return joined.groupBy("incident_id", "pos").agg(
        *[value_of(f) for f in ("api", "exc", "srv", "status")],
        F.array_sort(F.collect_list(F.when(F.col("field") == "word", F.struct("term_pos", "term"))))["term"].alias("words"))


def _counted(n: Column, rule: tuple[int, int]) -> Column:
    return F.least(n * rule[0], F.lit(rule[1]))


def _points(rule: dict) -> Column:
    score = _counted(F.size("words"), rule["word"])
    for f in ("api", "exc", "srv", "status"):
        if f in rule:
            score = score + F.when(F.col(f"{f}_value").isNotNull(), rule[f]).otherwise(0)
    return score


def _reason(condition: Column, *parts) -> Column:
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(".")))


def _reasons(labels: dict[str, str], word_label: str, extra: Column | None = None) -> Column:
    out = [_reason(F.col(f"{f}_value").isNotNull(), f"{label} matched ", F.col(f"{f}_value")) for f, label in labels.items()]
    if extra is not None:
        out.append(extra)
    out.append(_reason(F.size("words") > 0, f"Matched {word_label}: ", F.array_join("words", ", ")))
    return F.array_compact(F.array(*out))


def _top(scored: DataFrame, rule: dict) -> DataFrame:
    order = Window.partitionBy("incident_id").orderBy(F.desc("match_score"), F.asc("pos"))
    return (
        scored.filter(F.col("match_score") >= rule["min"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= rule["top"])
    )


def component_match(incidents: DataFrame, entries: DataFrame, kb: KnowledgeBase, hits: DataFrame | None = None) -> DataFrame:
    """Best components of each incident. ``hits`` are those of ``all_terms``, if they were looked up already."""
    terms = component_terms(kb)
    hits = context_hits(incidents, entries, terms) if hits is None else hits
    scored = _matches(hits, terms).select(
        "incident_id", "pos", F.least(_points(COMPONENT_RULE), F.lit(100)).alias("match_score"),
        _reasons({"api": "API", "exc": "Exception", "srv": "Server"}, "keywords").alias("match_reasons"))
    return _top(scored, COMPONENT_RULE).join(kb.components, "pos")


def workflow_match(incidents: DataFrame, entries: DataFrame, kb: KnowledgeBase, components: DataFrame,
                   hits: DataFrame | None = None) -> DataFrame:
    """Best workflows; matched components count as evidence."""
    terms = workflow_terms(kb)
    hits = context_hits(incidents, entries, terms) if hits is None else hits
    named = terms_of(kb.workflows, {"component": "components"}).select("pos", "term_key")
    by_component = (
        components.select("incident_id", "rank", "name", F.lower("name").alias("term_key"))
        .join(named, "term_key")
        .groupBy("incident_id", "pos")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "name")))["name"].alias("component_names"))
    )
    none = F.array().cast("array<string>")
    both = _matches(hits, terms).join(by_component, ["incident_id", "pos"], "full").withColumns({
        "words": F.coalesce("words", none), "component_names": F.coalesce("component_names", none)})
    named_reason = _reason(F.size("component_names") > 0, "Matched components: ", F.array_join("component_names", ", "))
    score = _points(WORKFLOW_RULE) + _counted(F.size("component_names"), WORKFLOW_RULE["component"])
    scored = both.select(
        "incident_id", "pos", F.least(score, F.lit(100)).alias("match_score"),
        _reasons({"api": "API"}, "workflow keywords", named_reason).alias("match_reasons"))
    return _top(scored, WORKFLOW_RULE).join(kb.workflows, "pos")


def known_issue_match(incidents: DataFrame, entries: DataFrame, kb: KnowledgeBase, hits: DataFrame | None = None) -> DataFrame:
    """Best known issues of each incident."""
    terms = issue_terms(kb)
    hits = context_hits(incidents, entries, terms) if hits is None else hits
    scored = _matches(hits, terms).select(
        "incident_id", "pos", F.least(_points(ISSUE_RULE), F.lit(100)).alias("match_score"),
        _reasons({"api": "API", "exc": "Exception", "status": "HTTP status"}, "message patterns").alias("match_reasons"))
    return _top(scored, ISSUE_RULE).join(kb.issues, "pos")


def _ordered_union(parts: list[tuple[DataFrame, str]], out: str) -> DataFrame:
    """Distinct values ignoring case, first spelling kept, in (part, rank, place) order."""
    rows = None
    for i, (df, column) in enumerate(parts):
        part = df.select("incident_id", F.lit(i).alias("part"), "rank", F.posexplode(column).alias("place", "v"))
        rows = part if rows is None else rows.unionByName(part)
    order = F.struct("part", "rank", "place")
    return (
        rows.groupBy("incident_id", F.lower("v").alias("k"))
        .agg(F.min(order).alias("o"), F.min_by("v", order).alias("v"))
        .groupBy("incident_id")
        .agg(F.array_sort(F.collect_list(F.struct("o", "v")))["v"].alias(out))
    )


def context_rollup(incidents: DataFrame, components: DataFrame, workflows: DataFrame, issues: DataFrame) -> DataFrame:
    """Confidence (mean of the best three scores) and merged lists per incident."""
    scores = (
        components.select("incident_id", "match_score")
        .unionByName(workflows.select("incident_id", "match_score"))
        .unionByName(issues.select("incident_id", "match_score"))
        .groupBy("incident_id")
        .agg(F.slice(F.sort_array(F.collect_list("match_score"), False), 1, 3).alias("best"))
        .select("incident_id", F.bround(
            F.aggregate("best", F.lit(0.0), lambda a, x: a + x) / F.size("best")).cast("int").alias("confidence_score"))
    )
    merged = [
        _ordered_union([(components, "dependencies"), (workflows, "dependencies")], "dependencies"),
        _ordered_union([(components, "database_objects")], "database_objects"),
        _ordered_union([(components, "investigation_hints"), (workflows, "investigation_hints"),
                        (issues, "investigation_steps")], "investigation_hints"),
    ]
    out = incidents.select("incident_id").join(scores, "incident_id", "left")
    for df in merged:
        out = out.join(df, "incident_id", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({
        "confidence_score": F.coalesce("confidence_score", F.lit(0)),
        **{c: F.coalesce(c, none) for c in ("dependencies", "database_objects", "investigation_hints")}})
