"""Correlation, sessions, incidents, health: edges and invariants."""

import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import correlate as co, incidents as inc
from faultline.operators.assemble import ENTRY_COLUMNS
from faultline.operators.band_search import walk
from faultline.plans import analysis

BASE = dt.datetime(2024, 1, 1)
SCHEMA = ("source string, line_number long, ts timestamp, severity string, exception_type string, message string, http_status int, "
          "request_url string, api_path string, correlation_id string, server_name string, machine_name string, environment string, "
          "user_name string, stack_trace string, raw_content string")


def entry(line, seconds, source="a", **kw):
    row = dict(source=source, line_number=line, ts=None if seconds is None else BASE + dt.timedelta(seconds=seconds), severity="Error", exception_type="",
               message="m", http_status=None, request_url="", api_path="", correlation_id="", server_name="", machine_name="",
               environment="", user_name="", stack_trace="", raw_content="m")
    row.update(kw)
    return tuple(row[c] for c in ENTRY_COLUMNS)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def pairs(df):
    return {(r.line, r.other): r.score for r in df.collect()}


def test_band_is_inclusive_and_needs_points(spark):
    got = pairs(co.candidates(frame(spark, [entry(1, 0, api_path="/A"), entry(100, 120, api_path="/a"), entry(200, 121, api_path="/A"), entry(300, 60)])))
    assert got == {(1, 100): 35, (100, 1): 35, (100, 200): 35, (200, 100): 35}


def test_line_distance_points(spark):
    rows = [entry(1, 0), entry(6, 0), entry(21, 0), entry(42, 0)]
    got = pairs(co.candidates(frame(spark, rows)))
    assert got == {(1, 6): 20, (6, 1): 20, (1, 21): 10, (21, 1): 10, (6, 21): 10, (21, 6): 10}


def test_missing_stamp_uses_line_distance(spark):
    rows = [entry(1, None, user_name="u"), entry(21, 999_999, user_name="U"), entry(22, None, user_name="u")]
    assert pairs(co.candidates(frame(spark, rows))) == {(1, 21): 25, (21, 1): 25, (21, 22): 35, (22, 21): 35}


def test_score_cap_and_fill_from_single_best(spark):
    rows = [entry(1, 0, correlation_id="c", api_path="/a", server_name="s"), entry(2, 1, correlation_id="C"), entry(3, 2, server_name="s", user_name="u")]
    got = {r.line_number: r for r in co.correlate(frame(spark, rows)).collect()}
    assert got[2].correlation_confidence == 100 and got[2].api_path == "/a" and got[2].user_name == ""
    assert got[3].correlation_id == "c" and got[3].related_lines == [1]
    assert got[2].correlation_group == "C"


def brute(rows):
    keys = ["correlation_id", "api_path", "exception_type", "user_name", "environment"]
    points = dict(correlation_id=100, api_path=35, exception_type=25, user_name=15, environment=10)
    recs = [dict(zip(ENTRY_COLUMNS, r)) for r in rows]
    out = {}
    for a in recs:
        found = []
        for b in recs:
            d = abs(a["line_number"] - b["line_number"])
            if a["source"] != b["source"] or d == 0:
                continue
            near = abs((a["ts"] - b["ts"]).total_seconds()) <= 120 if a["ts"] and b["ts"] else d <= 20
            s = sum(p for k, p in points.items() if a[k] and a[k].lower() == b[k].lower())
            s += 20 if a["server_name"] and a["server_name"] == b["server_name"] else 0
            s += 20 if a["http_status"] and a["http_status"] == b["http_status"] else 0
            s = min(100, s + (20 if d <= 5 else 10 if d <= 20 else 0))
            if near and s > 0:
                found.append((-s, d, b["ts"] is not None, b["ts"] or BASE, b["line_number"]))
        out[a["source"], a["line_number"]] = [(f[4], -f[0]) for f in sorted(found)[:20]]
    return out


def random_rows(n, spread, shuffle):
    rnd = random.Random(7)
    rows, line = [], 0
    times = sorted(rnd.uniform(0, spread) for _ in range(n))
    if shuffle:
        for _ in range(n):
            i, j = rnd.randrange(n), rnd.randrange(n)
            times[i], times[j] = times[j], times[i]
    for t in times:
        line += rnd.choice([1, 2, 7, 30])
        pick = lambda *v: rnd.choice(v)
        rows.append(entry(line, None if rnd.random() < 0.05 else int(t), source=pick("a", "b", "b"), correlation_id=pick("", "", f"c{rnd.randrange(9)}"),
                          api_path=pick("", "/a", "/B", "/b"), exception_type=pick("", "E1", "E2"), server_name=pick("s1", "s2", ""),
                          http_status=pick(None, 500, 404), user_name=f"u{rnd.randrange(12)}", environment=pick("PROD", "")))
    return rows


def check_against_brute(spark, rows, **kw):
    got = {}
    for r in co.candidates(frame(spark, rows), **kw).orderBy("source", "line", "position").collect():
        got.setdefault((r.source, r.line), []).append((r.other, r.score))
    want = {k: v for k, v in brute(rows).items() if v}
    assert got == want


def test_candidates_equal_brute_force_with_few_in_a_bin(spark):
    check_against_brute(spark, random_rows(300, 3000, False))


def test_candidates_equal_brute_force_in_line_order(spark):
    check_against_brute(spark, random_rows(300, 600, False), block=64)


def test_candidates_equal_brute_force_against_line_order(spark):
    check_against_brute(spark, random_rows(300, 900, True), block=64)


def test_candidates_with_equal_stamps(spark):
    check_against_brute(spark, random_rows(200, 1, False), block=16)


def test_candidates_of_shuffled_stamps_over_many_blocks(spark):
    """Most blocks hold fewer than 20 lines of the band, so entries go from block to block."""
    check_against_brute(spark, random_rows(400, 3000, True), block=100)


def test_candidates_of_two_logs_laid_together(spark):
    """The second log runs through the same times again, newest first; values of both agree."""
    rows = random_rows(150, 500, False)
    recs = [dict(zip(ENTRY_COLUMNS, r)) for r in rows]
    top = max(r["line_number"] for r in recs)
    stamps = [r["ts"] for r in recs][::-1]
    second = [tuple({**r, "line_number": top + r["line_number"], "ts": t}[c] for c in ENTRY_COLUMNS) for r, t in zip(recs, stamps)]
    check_against_brute(spark, rows + second, block=64)


def test_rare_values_of_a_crowded_bin_are_asked_for_once(spark, monkeypatch):
    """Users with a row in each third block: nothing goes from block to block for them, and all of their rows are found."""
    from faultline.operators import band_search
    steps = []
    monkeypatch.setattr(band_search, "staged", lambda df, name, real=band_search.staged: steps.append(name) or real(df, name))
    rows = [entry(30 * i, i * 37 % 100, api_path="/a", user_name=f"u{i % 97}", correlation_id="" if i % 3 else f"c{i % 211}") for i in range(700)]
    check_against_brute(spark, rows, block=32)
    assert steps.count("band_waiting") <= 3 and steps.count("band_rare") == 1


def test_sets_that_no_pair_can_differ_on_are_left_out(spark, monkeypatch):
    """All of a crowded log agree on the environment: sets without it are not walked, listed or asked for."""
    from faultline.operators import band_search
    listed = []

    def seen(df, name, real=band_search.staged):
        out = real(df, name)
        if name == "band_found":
            listed.append(out.where("kind = 'key'").count())
        return out

    monkeypatch.setattr(band_search, "staged", seen)
    rows = [entry(7 * i, i * 37 % 100, api_path=f"/{i % 2}", server_name=f"s{i % 3}", environment="PROD") for i in range(400)]
    check_against_brute(spark, rows, block=40)
    agreed = listed[0]
    listed.clear()
    check_against_brute(spark, [*rows[:-1], entry(2793, 63, api_path="/1", server_name="s0", environment="")], block=40)
    assert 0 < agreed < listed[0]


def test_few_rows_of_a_bin_in_many_places_are_one_unit(spark, monkeypatch):
    """Twelve logs of the same seconds laid together: blocks count rows, so nothing goes from block to block."""
    from faultline.operators import band_search
    steps = []
    monkeypatch.setattr(band_search, "staged", lambda df, name, real=band_search.staged: steps.append(name) or real(df, name))
    rows = [dict(zip(ENTRY_COLUMNS, r)) for r in random_rows(12, 60, False)]
    copies = [tuple({**r, "line_number": r["line_number"] + 5000 * i}[c] for c in ENTRY_COLUMNS) for i in range(12) for r in rows]
    check_against_brute(spark, copies, block=500)
    assert steps.count("band_waiting") == 1


def test_one_value_for_all_fields_in_a_crowded_bin(spark):
    """20,000 entries that agree on everything: each has its ten nearest lines on both sides, in the file's middle."""
    n = 20_000
    base = spark.range(n).select(
        F.lit("a").alias("source"), (F.col("id") * 30).alias("line_number"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 100).alias("ts"),
        F.lit("Error").alias("severity"), F.lit("E").alias("exception_type"), F.lit("m").alias("message"), F.lit(500).alias("http_status"),
        F.lit("/u").alias("request_url"), F.lit("/a").alias("api_path"), F.lit("c").alias("correlation_id"), F.lit("s").alias("server_name"),
        F.lit("").alias("machine_name"), F.lit("PROD").alias("environment"), F.lit("u").alias("user_name"), F.lit("").alias("stack_trace"),
        F.lit("m").alias("raw_content"))
    got = co.candidates(base).groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("line") - F.col("other"))).alias("far"), F.min("score").alias("score"))
    inner = got.where(F.col("line").between(300, 30 * (n - 11)))
    row = inner.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.min("far"), F.max("far"), F.min("score")).first()
    assert tuple(row) == (n - 20, 20, 20, 300, 300, 100)
    assert got.count() == n and got.agg(F.min("n")).first()[0] == 20


def test_candidates_of_nothing_and_of_entries_without_stamps(spark):
    assert co.candidates(frame(spark, [])).collect() == []
    assert pairs(co.candidates(frame(spark, [entry(1, None, user_name="u"), entry(500, None, user_name="u")]))) == {}


def test_walk_steps_over_stretches_outside_the_band():
    """Places found equal a plain scan, with stretches of 64 and 4,096 places to step over."""
    rng = np.random.default_rng(5)
    times = np.sort(rng.integers(0, 10_000, 30_000))
    times[20_000:20_050] = 3
    asking = rng.integers(0, 30_000, 200)
    t = rng.integers(0, 10_000, 200)
    for step in (-1, 1):
        last = np.where(np.full(200, step) < 0, 0, 29_999)
        whom, where, got = walk(times, asking, last, step, t, np.full(200, 20), 5)
        for q in range(200):
            way = np.arange(asking[q], last[q] + step, step)
            want = way[np.abs(times[way] - t[q]) <= 5][:20]
            assert list(where[whom == q]) == list(want) and got[q] == len(want)


def test_correlation_plans_no_nested_loop(spark):
    df = co.candidates(frame(spark, random_rows(60, 600, False)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "WindowGroupLimit" in plan


def test_thirty_minutes_exactly_stay_together(spark):
    rows = [entry(1, 0), entry(2, 1800), entry(3, 3601), entry(4, None)]
    got = {r.line_number: r.session for r in inc.incident_sessions(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_sessions_equal_a_plain_scan(spark):
    rnd = random.Random(3)
    rows = [entry(i, rnd.randrange(0, 200_000)) for i in range(1, 120)]
    got = {r.line_number: r.session for r in inc.incident_sessions(frame(spark, rows)).collect()}
    session, last = 0, None
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if last is not None and (r[2] - last).total_seconds() > 1800:
            session += 1
        last = r[2]
        assert got[r[1]] == session


def test_incident_takes_first_values_and_worst_entry(spark):
    rows = [entry(1, 0, severity="Warning", message="x", api_path="/a"), entry(2, 5, severity="Critical", message="x", api_path="/a", correlation_id="q"),
            entry(3, 6, message="x", api_path="/a", correlation_id="Q")]
    (r,) = inc.incidents(inc.incident_sessions(frame(spark, rows))).collect()
    assert (r.severity, r.entry_count, r.correlation_id, r.title) == ("Critical", 3, "q", "/a failure")
    assert r.representative.line_number == 2 and r.duration.total_seconds() == 6


def test_counts_and_health(spark):
    rows = [entry(i, i * 4000, http_status=500) for i in range(1, 4)] + [entry(9, 10, message="authentication failed")]
    a = analysis.analyze_entries(frame(spark, rows), spark.createDataFrame([("a", 9)], "source string, total_lines long"))
    assert a.incidents.agg(F.sum("entry_count")).collect()[0][0] == a.entries.count() == 4
    h = a.health.collect()[0]
    assert (h.health_score, h.status, h.critical_incidents, h.high_incidents) == (15, "Critical", 3, 1)
    assert h.most_impacted_server == "-"
    assert [r.incident_id for r in a.incidents.orderBy("incident_no").collect()] == ["INC-0001", "INC-0002", "INC-0003", "INC-0004"]
    assert a.summary.collect()[0].total_lines == 9


def test_no_incidents_is_healthy(spark):
    h = inc.application_health(inc.incident_ranking(inc.incidents(inc.incident_sessions(frame(spark, []))))).collect()[0]
    assert (h.health_score, h.status, h.active_incidents, h.average_duration_seconds) == (100, "Healthy", 0, 0.0)
