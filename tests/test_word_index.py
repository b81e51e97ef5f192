"""Words and expressions found through the gram index, against trying each of them on each text."""

import random
import re

import pytest
from pyspark.sql import functions as F

from faultline.operators import context as ctx
from faultline.operators import facts as fa
from faultline.operators import word_index as wi
from faultline.plans.staging import staged


def found(spark, texts, words):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    index = staged(wi.filed(spark.createDataFrame([(w,) for w in words], "word string"), "word"), "words")
    got = wi.found_in(rows, "text", index, "word", F.contains(F.lower("text"), F.col("word")))
    return sorted((r.id, r.word) for r in got.collect()), got


@pytest.mark.parametrize("slice_", [200_000, 7])
def test_equals_brute_force(spark, monkeypatch, slice_):
    monkeypatch.setattr(wi, "SLICE", slice_)
    rng = random.Random(3)
    piece = lambda n: "".join(rng.choice("abAB \n.é😀") for _ in range(n))
    texts = [piece(rng.randrange(0, 60)) for _ in range(200)] + ["", "a", None, "ab" * 5000]
    words = {piece(rng.randrange(1, 9)).lower() for _ in range(150)} | {"", "a", "é", "😀a", "abab" * 20}
    want = sorted((i, w) for i, t in enumerate(texts) if t is not None for w in words if w in t.lower())
    assert found(spark, texts, words)[0] == want


def test_no_words_and_no_texts(spark):
    assert found(spark, ["abc"], [])[0] == []
    assert found(spark, [], ["abc"])[0] == []


def test_fifty_thousand_words(spark):
    """No list of words in the plan, and nothing but the words of a text is compared with it."""
    words = [f"order {i:06d} failed" for i in range(50_000)]
    texts = [f"Error: ORDER {i:06d} Failed, then order {i + 1:06d} failed" for i in range(0, 50_000, 500)]
    got, df = found(spark, texts, words)
    assert got == sorted((n, words[i + k]) for n, i in enumerate(range(0, 50_000, 500)) for k in (0, 1))
    plan = df._jdf.queryExecution().toString()
    assert "Subquery" not in plan and "BroadcastHashJoin" in plan and "NestedLoop" not in plan


def test_words_of_digits_do_not_meet_each_other(spark):
    """Texts hold many runs that words are made of; what is joined are the words they hold."""
    words = [f"?id={i}" for i in range(20_000, 50_000)]
    texts = [f"20240101 {i * 7} {i * 3} ?id={20_000 + i * 11} 30000 40000" for i in range(1000)]
    got = found(spark, texts, words)[0]
    assert got == [(i, f"?id={20_000 + i * 11}") for i in range(1000)]
    index = staged(wi.filed(spark.createDataFrame([(w,) for w in words], "word string"), "word"), "words")
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    assert wi.found_in(rows, "text", index, "word", F.lit(True)).count() <= 1100


PATTERNS = {
    "abc": "abc", "abc?": "ab", "ab+c": "ab", "a(bc)d": "a", "(abc)?def": "def", "foo|bar": "", "(foo|bar)baz": "baz", r"x\.y\d+z": "x.y",
    r"(?i)Hello\s+World": "hello", "a{0,3}bcd": "bcd", "a{2}bcd": "bcd", r"\bServer\d{3}\b": "server", "": "", "^abc$": "abc", r"\x41bc": "",
    "é+abc": "abc", "ab*?cd": "cd", "a|": "", "[a&&[b]]cd": "", "foo(?!bar)": "foo", "(?:abc)+": "", "x(a[)]b)yz": "yz", r"x(a\)b)yz*": "x",
    "[^]abc]d": "", "[|]ab": "ab", r"(?x) a b c": "", r"\Qa|b\E": "", "(?iu)strasse": "", "(a(b)c)?quux": "quux", r"a\|bcd": "a|bcd"}


def test_required_literals():
    assert {p: wi.required_literal(p) for p in PATTERNS} == PATTERNS


def test_required_literals_are_in_every_match():
    rng = random.Random(5)
    atoms = ["a", "b", "cd", r"\.", r"\d", ".", "[ab]", "(a|b)", "(?:cd)", "(a)?", "x*", "b?", "a+", "c{0,2}", "d{1,2}", "(b(c)?)+", r"\s"]
    text = "".join(rng.choice("aabbccdd..x1 ") for _ in range(3000))
    for _ in range(500):
        pattern = "".join(rng.choice(atoms) for _ in range(rng.randrange(1, 7)))
        literal = wi.required_literal(pattern)
        assert all(literal in m.group().lower() for m in re.finditer(pattern, text)), pattern


PRINTS = "application_id string, application_name string, id string, value string, match_mode string, weight int, is_case_sensitive boolean, type string, tags array<string>"


def test_fingerprints_of_all_kinds(spark):
    """Fifty thousand prints, and expressions without a certain literal, equal trying each on each text."""
    texts = ["User=123 signed in at HOST-7", "nothing here", "order 77 failed\nuser=9", None, ""]
    values = ["Alpha/Beta", "alphabet", "Gamma"]
    kinds = [("Contains", "USER=123", False), ("Contains", "USER=123", True), ("regex", r"host-\d", False), ("Regex", r"host-\d", True), ("REGEX", "fail|missing", False),
             ("Regex", r"\d{3}", True), ("Regex", "(bad[", False), ("Exact", "GAMMA", False), ("Exact", "GAMMA", True), ("StartsWith", "alpha", False),
             ("StartsWith", "alpha", True), ("startswith", "Alpha/Beta and more", False), ("other", "nothing", True), ("Contains", " ", False)]
    rows = [("A", "App", str(i), v, m, 1, c, "T", ["t"]) for i, (m, v, c) in enumerate(kinds)]
    many = spark.range(50_000).select(
        F.lit("B"), F.lit("Many"), F.concat(F.lit("m"), F.col("id").cast("string")), F.concat(F.lit("user="), F.col("id").cast("string"), F.lit(" ")),
        F.when(F.col("id") % 2 == 0, "Contains").otherwise("Regex"), F.lit(1), F.lit(False), F.lit("T"), F.array(F.lit("t")))
    prints = spark.createDataFrame(rows, PRINTS).unionAll(many)
    got = fa.fingerprint_match(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(v,) for v in values], "value string"), prints)
    assert sorted(r.key for r in got.collect()) == sorted(["0", "2", "4", "5", "7", "9", "10", "12", "m123"])
    assert "Subquery" not in got._jdf.queryExecution().toString()


def test_context_hits_in_one_pass(spark):
    """Fields and entry texts of all lists; entry texts are scanned once."""
    incidents = spark.createDataFrame([("I1", "Boom", "A.SqlException", "/api/Orders", "SRV1", "PROD", 500), ("I2", "Other", "", "", "", "", None)],
                                      "incident_id string, title string, exception_type string, api_path string, server_name string, environment string, http_status int")
    entries = staged(spark.createDataFrame([("I1", "Lock TIMEOUT", "", "at X", "raw"), ("I2", "timeout", None, "", "")],
                                           "incident_id string, message string, exception_type string, stack_trace string, raw_content string"), "entries")
    terms = spark.createDataFrame([("api", "/api/"), ("exc", "sqlexception"), ("srv", "srv"), ("status", "500"), ("word", "timeout"), ("word", "prod"), ("word", "x")],
                                  "field string, term_key string")
    got = ctx.context_hits(incidents, entries, terms)
    assert sorted((r.incident_id, r.field, r.term_key, r.value) for r in got.collect()) == [
        ("I1", "api", "/api/", "/api/Orders"), ("I1", "exc", "sqlexception", "A.SqlException"), ("I1", "srv", "srv", "SRV1"), ("I1", "status", "500", "500"),
        ("I1", "word", "prod", None), ("I1", "word", "timeout", None), ("I1", "word", "x", None), ("I2", "word", "timeout", None)]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[incident_id#\d+,message#", plan)) == 1
