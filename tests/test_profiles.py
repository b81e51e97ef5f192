"""Profiles of many cases in one job."""

from pyspark.sql import functions as F

from faultline.operators import profile as pf

ROW = ("case string, application_id string, application_name string, type string, key string, value string, confidence_score int, source_kind string, "
       "source_name string, evidence string, is_identity_evidence boolean, tags array<string>")
META = "package string, application_id string, application_name string"


def row(case, app, score, identity=True, value="v", source="Log"):
    return (case, app, app.title(), "Other", "k", value, score, source, source, "", identity, ["t"])


def build(spark, rows, hints, enrichment=(), catalog=()):
    make = lambda r: spark.createDataFrame(list(r), ROW)
    known = make([row("", app, 100, source="Catalog") for app in catalog]).drop("case")
    metadata = spark.createDataFrame([(a, a, a) for a in catalog], META)
    return pf.application_profiles(make(rows), known, metadata, list(enrichment), spark.createDataFrame(hints, "case string, hint string"))


def chosen(p):
    return {r.case: (r.application_id, r.identification_confidence_score) for r in p.profile.collect()}


def test_winner_tie_and_nobody(spark):
    rows = [row("won", "a", 90), row("won", "b", 50), row("tie", "a", 90), row("tie", "b", 85), row("weak", "a", 20), row("technical", "a", 100, False)]
    p = build(spark, rows, [("won", "z"), ("tie", "z"), ("weak", ""), ("technical", "A"), ("silent", None)], catalog=["a", "q"])
    assert chosen(p) == {"won": ("a", 100), "tie": ("z", 0), "weak": ("", 0), "technical": ("a", 100), "silent": ("", 0)}
    kept = {(r.case, r.application_id, r.source_kind) for r in p.contributions.collect()}
    assert ("won", "a", "Catalog") in kept and ("won", "b", "Log") not in kept and not any(c == "weak" for c, *_ in kept)


def test_enrichment_knows_the_identity_found_first(spark):
    rows = [row("x", "a", 70), row("y", "b", 30), row("y", "c", 30)]

    def service(found):
        assert found.columns == ["case", "application_id"]
        return found.selectExpr("`case`", "'' AS application_id", "'' AS application_name", "'Other' AS type", "'url' AS key", "concat('https://', application_id) AS value",
                                "40 AS confidence_score", "'Api' AS source_kind", "'Api' AS source_name", "'' AS evidence", "true AS is_identity_evidence", "array('t') AS tags")

    p = build(spark, rows, [("x", ""), ("y", "c")], [service])
    assert chosen(p) == {"x": ("a", 82), "y": ("c", 0)}  # c reaches 58 of 60
    assert {r.value for r in p.contributions.filter(F.col("source_kind") == "Api").collect()} == {"https://a", "https://c"}


def test_one_case_as_before(spark):
    rows = spark.createDataFrame([row("x", "a", 70)], ROW).drop("case")
    none = rows.limit(0)
    p = pf.application_profile(rows, none, spark.createDataFrame([], META), [], "h")
    assert [tuple(r) for r in p.profile.collect()] == [("a", "A", 70)]
    assert "case" not in p.contributions.columns + p.candidates.columns
    p = pf.application_profile(none, none, spark.createDataFrame([], META), [], "h")
    assert [tuple(r) for r in p.profile.collect()] == [("h", "h", 0)]


def test_no_scalar_and_hot_case(spark):
    """A case with most rows is reduced before it is shuffled."""
    rows = [row("hot", f"a{i % 3}", 1) for i in range(300)] + [row("hot", "a1", 60)] * 3 + [row("cold", "a2", 65)]
    p = build(spark, rows, [("hot", ""), ("cold", "")])
    assert chosen(p)["cold"] == ("a2", 65) and chosen(p)["hot"][0] == "a1"
    assert all("Subquery" not in t._jdf.queryExecution().toString() for t in (p.profile, p.candidates, p.contributions))
