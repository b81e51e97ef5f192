"""Knowledge, profiles, guardrail, responses: hand-worked cases."""

from pyspark.sql import functions as F

from faultline.functions.rules import intelligence
from faultline.operators import distill, facts as fa, guardrail as gr, profile as pf, report as rp, responses as rs, source_code as sc
from faultline.sources import json_text as jt, repository as rep


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("r")).collect()[0].r


def test_rules_and_frequency(spark):
    score = lambda m, e, s, n: one(spark, intelligence(F.lit(m), F.lit(e), F.lit(s).cast("int"), F.lit(n)))
    assert score("Command Timeout", "X", 500, 1).priority_score == 80
    assert score("x", "", 403, 5).priority_score == 74
    assert score("x", "", 500, 100).priority_score == 100
    assert score("x", "", 404, 20).priority == "Medium"
    assert score("SignalR disconnected", "", None, 1).priority_score == 50
    assert score("a warning", "", None, 1).priority == "Low"
    assert score("x", "", None, 49).priority_score == 43


def test_lenient_json(spark):
    text = '{ // c\n "A": "x // no, ]", /* y */ "L": ["1", "2",], }'
    m = one(spark, jt.json_object(jt.clean_json(F.col("t"))), t=text)
    assert m["a"] == "x // no, ]" and m["l"] == '["1","2"]'


def test_noisy_or(spark):
    comb = lambda *s: one(spark, pf.noisy_or(F.array(*[F.struct(F.lit(x).alias("score"), F.lit(n).alias("n")) for x, n in s])))
    assert [comb((100, 1), (3, 2)), comb((50, 1), (65, 1)), comb((50, 2)), comb((0, 1))] == [100, 82, 75, 0]


def candidates(spark, *scores):
    return spark.createDataFrame([(f"A{i}", f"n{i}", s) for i, s in enumerate(scores)], "application_id string, application_name string, confidence_score int")


def test_candidate_margin(spark):
    pick = lambda *s: [r.application_id for r in pf.select_candidate(candidates(spark, *s)).collect()]
    assert [pick(60), pick(59), pick(70, 60), pick(70, 61), pick(50, 90), pick()] == [["A0"], [], ["A0"], [], ["A1"], []]


def test_fingerprint_modes(spark):
    prints = spark.createDataFrame([
        ("A", "app", "1", "MessagePattern", "Needle", "Contains", 300, False, ["t"]), ("A", "app", "2", "MessagePattern", "Needle", "Contains", 5, True, ["t"]),
        ("A", "app", "3", "Exception", "my.ownException", "Exact", 5, False, ["t"]), ("A", "app", "4", "Exception", "My.Own", "StartsWith", 5, True, ["t"]),
        ("A", "app", "5", "MessagePattern", "(bad[", "Regex", 5, False, ["t"]), ("A", "app", "6", "MessagePattern", r"NEED.e\b", "regex", 0, False, ["t"]),
        ("A", "app", "7", "MessagePattern", " ", "Contains", 5, False, ["t"])],
        "application_id string, application_name string, id string, type string, value string, match_mode string, weight int, is_case_sensitive boolean, tags array<string>")
    text = spark.createDataFrame([(1, "a needle My.OwnException")], "id int, text string")
    got = fa.fingerprint_match(text, fa.log_facts(text), prints).collect()
    assert {(r.key, r.confidence_score) for r in got} == {("1", 100), ("3", 5), ("4", 5), ("6", 1)}
    long = spark.createDataFrame([(1, "needXe")], "id int, text string")
    assert {(r.key, r.confidence_score) for r in fa.fingerprint_match(long, fa.log_facts(long), prints).collect()} == {("6", 1)}


def test_facts(spark):
    text = spark.createDataFrame([(1, 'EXEC dbo.Get @x; select @y\nFailed executing DbCommand ("1,234"ms) CommandTimeout=\'30\' System.A.B My.App.Name http://h/a(b)')], "id int, text string")
    got = {(r.key, r.value) for r in fa.log_facts(text).collect()}
    assert {("DatabaseOperation", "dbo.Get"), ("DbCommandDurationMs", "1234"), ("CommandTimeoutSeconds", "30"), ("Namespace", "My.App.Name"), ("Url", "http://h/a")} <= got
    assert not any(v.lower() == "select" or v.startswith("System") for _, v in got)


CLAIM = "incident_id string, claim_no int, category string, label string, value string, authority string, confidence_score int"


def strong(spark, *claims):
    rows = [("I", i, *c) for i, c in enumerate(claims)]
    return gr.claims_by_incident(distill.with_flags(spark.createDataFrame(rows, CLAIM)))


def test_identity_and_timeout_need_confirmed_claims(spark):
    df = strong(spark, ("Application", "x", "shop", "ExactKnowledgeMatch", 80), ("App", "Workflow name", "Pay", "FuzzyContext", 35), ("Database", "SQL error number", " -2 ", "RawLog", 95))
    r = df.select(gr.guarded_application(F.lit("Shop")).alias("a"), gr.guarded_workflow(F.lit("Pay")).alias("w"), gr.timeout_evidence().alias("t"), gr.guarded_confidence(F.lit(60)).alias("c")).collect()[0]
    assert (r.a, r.w, r.t, r.c) == ("Shop", "Unknown", True, 74)
    weak = strong(spark, ("Application", "x", "shop", "ExactKnowledgeMatch", 79), ("F", "m", "Execution Timeout Expired", "KnowledgeMatch", 65))
    r = weak.select(gr.guarded_application(F.lit("Shop")).alias("a"), gr.timeout_evidence().alias("t"), gr.guarded_confidence(F.lit(0)).alias("c")).collect()[0]
    assert (r.a, r.t, r.c) == ("Unknown", False, 25)


def test_equivalent_unknowns(spark):
    got = one(spark, gr.equivalent_unknowns(F.array(*[F.lit(x) for x in (
        " Workflow.", "affected workflow is open", "Application identity x", "The APPLICATION IDENTITY y.", "Other", "other..", " ", "physical database a", "database object relationship b")])))
    assert got == ["Workflow.", "Application identity x", "Other", "physical database a"]


def test_hypothesis_confidence(spark):
    c = lambda s, n: one(spark, gr.hypothesis_confidence(F.lit(s), F.array(*[F.lit("x")] * n) if n else F.array().cast("array<string>")))
    assert [c(0, 1), c(0, 0), c(5, 0), c(99, 0)] == [40, 20, 10, 95]


def test_advice_words(spark):
    assert one(spark, gr.unsafe_timeout_advice(F.lit("The Timeout is TOO LOW")))
    assert not one(spark, gr.unsafe_timeout_advice(F.lit("increase memory")))
    assert one(spark, gr.concludes_connection(F.lit("Check database connection now")))


def test_responses(spark):
    fence = "```"
    rows = [("a", True, f'{fence}json\n{{"summary":"s","hypotheses":[{{"cause":"c","evidence":"e","confidence":7}}],"nextAction":null}}\n{fence}'),
            ("b", True, '{"SUMMARY": "s"'), ("c", True, "[]"), ("d", False, "{}"), ("e", True, None), ("f", True, '{"hypotheses":[{"evidence":["x", null, " "]}]}')]
    got = {r.incident_id: r for r in rs.parse_responses(spark.createDataFrame(rows, "incident_id string, is_successful boolean, content string")).collect()}
    assert got["a"].error == "" and got["a"].hypotheses[0].evidence == ["e"] and got["a"].next_action == ""
    assert got["b"].error and got["c"].error and got["d"].error and got["e"].error
    assert got["f"].hypotheses[0].evidence == ["x"] and got["f"].hypotheses[0].confidence == 0


def test_report_helpers(spark):
    assert one(spark, rp.controller_name(F.lit("/v1/api/Orders/get"))) == "Orders"
    assert one(spark, rp.controller_name(F.lit("/a/b"))) == "a" and one(spark, rp.controller_name(F.lit("/a"))) == "Unknown"
    assert one(spark, rp.method_name(F.lit("/"))) == "Unknown"
    assert one(spark, rp.component_label(F.lit("Big (Api), Match Score: 5%"))) == "Big"
    assert one(spark, rp.overall_confidence(F.lit(85), F.lit(10), F.lit(10))) == 90
    assert one(spark, rp.overall_confidence(F.lit(3), F.lit(1), F.lit(0))) == 29
    assert one(spark, distill.section_bullets(F.array(*[F.lit(x) for x in ("Deps:", "- a", "", "note", "- Unknown", "- b", "NEXT", "- c")]), "deps:")) == ["a", "b"]


def test_code_positions(spark):
    src = "namespace N { public class A { public void M() { if (x) { Run(); } exec(\"EXEC Foo\"); }\n internal int K(int a) { return 1; } }\n struct B : IX { } "
    files = spark.createDataFrame([("r", "p", "f.cs", src)], "repository string, project_name string, relative_path string, content string")
    types = sc.source_types(files)
    assert {(r.full_name, r.kind, tuple(r.base_types)) for r in types.collect()} == {("N.A", "Class", ()), ("N.B", "Struct", ("IX",))}
    got = {r.name: r for r in sc.source_methods(types, files).collect()}
    assert set(got) == {"M", "K"}
    assert got["M"].database_operations == ["Foo"] and got["K"].database_operations == [] and got["K"].line_number == 2


def test_project_prefix_and_paths(spark):
    files = spark.createDataFrame([("r", p, "x", 1) for p in ("a/b/c.cs", "a/x.cs", "top.cs", "ab/z.cs")], "repository string, relative_path string, content string, size_bytes int")
    projects = spark.createDataFrame([("r", "A/a.csproj", "A", None), ("r", "a/b/b.csproj", "B", None)], "repository string, relative_path string, name string, warning string")
    got = {r.relative_path: r.project_name for r in rep.attach_project(rep.repository_files(files), projects).collect()}
    assert got == {"a/b/c.cs": "B", "a/x.cs": "A", "top.cs": None, "ab/z.cs": None}
    keep = lambda p, **k: one(spark, rep.repository_path_filter(F.lit(p), **k))
    assert keep("src/a.cs") and not keep("x/Tests/a.cs") and keep("x/Tests/a.cs", include_tests=True) and not keep("a.g.cs") and not keep("Bin/a.cs")


def test_source_text_is_scanned_once_for_declarations(spark):
    files = spark.createDataFrame([("r", "p", "a.cs", "namespace N;\npublic class A : B, C { public int M(int a) { return a; } }\ninterface I { }")],
                                  "repository string, project_name string, relative_path string, content string")
    types = sc.source_types(files)
    assert {(r.name, r.kind, tuple(r.base_types)) for r in types.collect()} == {("A", "Class", ("B", "C")), ("I", "Interface", ())}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "interface|record" not in plan(types)
    methods = sc.source_methods(types, files)
    assert [(r.name, r.line_number) for r in methods.collect()] == [("M", 2)]
    assert "override|abstract" not in plan(methods)


def test_large_files_of_a_small_table_go_to_several_tasks(spark):
    from faultline.plans import staging
    staging.tune(spark)
    text = F.concat(*[F.sha2((F.col("id") * 8 + i).cast("string"), 512) for i in range(4)]).alias("text")
    large, empty = spark.range(0, 8000, 1, 8).select(text), spark.range(0, 80, 1, 80).select(F.lit("x").alias("text"))
    read = staging.staged(large.unionByName(empty), "mixed")
    tasks = [r["count"] for r in read.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert max(tasks) <= 0.75 * sum(tasks)
