"""Lines to events to entries: hand-worked cases."""

from pyspark.sql import functions as F

from faultline.functions import eventviewer as ev, plain, signatures as sg
from faultline.operators import assemble as asm, eventviewer as evo
from faultline.sources import logs


def lines(spark, *texts, source="a.log"):
    return spark.createDataFrame([(source, i + 1, t) for i, t in enumerate(texts)], "source string, line_no long, value string")


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(expr.alias("r")).collect()[0].r


LOG = ["", "  ", "leading text", "more", "2024-01-01 10:00:00 INFO ok", "  at X", "", "ERROR no stamp", "[2024/01/01 10:00:05] WARN w", "tail", ""]


def test_events_keep_leading_text_and_skip_leading_blanks(spark):
    got = asm.multiline_events(lines(spark, *LOG)).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line) for r in got] == [(3, 4), (5, 7), (8, 8), (9, 11)]
    assert got[0].raw_content == "leading text\nmore"
    assert got[1].raw_content == "2024-01-01 10:00:00 INFO ok\n  at X"
    assert asm.total_lines_plain(asm.multiline_events(lines(spark, *LOG))).collect()[0].total_lines == 11


def test_only_blank_lines_give_no_event(spark):
    assert asm.multiline_events(lines(spark, "", " \t")).count() == 0


def test_small_blocks_change_nothing(spark):
    whole = asm.normalize_plain(lines(spark, *LOG)).collect()
    for block in (1, 2, 3):
        assert asm.normalize_plain(lines(spark, *LOG), block).collect() == whole


def test_stamp_is_carried_over_irrelevant_events(spark):
    got = {r.line_number: r for r in asm.normalize_plain(lines(spark, *LOG)).collect()}
    assert str(got[8].ts) == "2024-01-01 10:00:00"
    assert str(got[9].ts) == "2024-01-01 10:00:05"
    assert set(got) == {8, 9}


def test_severity_order(spark):
    p, c, s, e = F.col("p"), F.col("c"), F.col("s"), F.col("e")
    sev = lambda p_, c_, s_, e_: one(spark, plain.severity(p, c, s.cast("int"), e), p=p_, c=c_, s=s_, e=e_)
    assert sev("FATAL x", "FATAL x", None, "") == "Critical"
    assert sev("WARN x", "WARN x", 404, "") == "Error"
    assert sev("INFO x", "INFO x", None, "A.BException") == "Error"
    assert sev("INFO x", "INFO x\nCRITICAL", None, "") == "Critical"
    assert sev("INFO x", "INFO x\nwarning y", None, "") == "Warning"
    assert sev("INFO x", "INFO x\nerror y", None, "") == "Information"


def test_fields(spark):
    status = lambda t: one(spark, plain.http_status(F.col("t")), t=t)
    assert [status(t) for t in ("HTTP/1.1 500", "statusCode=404", "503 Service Unavailable", "HTTP 200", "status: 302 HTTP 404")] == [500, 404, 503, None, 404]
    path = lambda u: one(spark, plain.api_path(F.col("u")), u=u)
    assert [path(u) for u in ("https://h/a/b?x=1", "https://h", "http://h:80#f", "ftp://h/a", "", "https:///x")] == ["/a/b", "/", "/", "", "", ""]
    assert one(spark, plain.request_url(F.col("t")), t="see (https://h/a).") == "https://h/a"
    env = lambda named, host: one(spark, plain.environment(F.col("n"), F.col("h"), F.lit("")), n=named, h=host)
    assert [env("production", ""), env("rqa3", ""), env("", "xPREPRODx"), env("", "appdev1"), env("", "APPPRIV"), env("", "zz")] == ["PROD", "RQA3", "PREPROD", "DEV", "PROD", ""]


def test_hex_rule_looks_at_the_rest_of_the_line(spark):
    n = lambda t: one(spark, sg.normalize_message(F.col("t")), t=t)
    assert n("id 1234567890123 feed") == "id {hex} feed"
    assert n("id 1234567890123 xyz") == "id {number} xyz"
    assert n("id deadbeef00") == "id {hex}"
    assert one(spark, sg.normalize_path(F.col("t")), t="//a/12345/B/?q=1") == "/a/{id}/b"


def test_summary_key_treats_versions_as_stamps(spark):
    s = one(spark, sg.error_signature(F.lit("E"), F.lit(None).cast("int"), F.lit("/P"), F.col("t"), F.lit("m")), t=" A 1.2.3 [7] x:line  9 123456 ")
    assert s == "E||/P|a {timestamp} {id} x:line {line} {number}"


def test_eventviewer_record(spark):
    head = "Level\tDate and Time\tSource\tEvent ID\tTask Category"
    got = evo.normalize_eventviewer(lines(
        spark, "junk", head, 'Error\t1/2/2024 3:04:05 PM\tApp\tx7\tNone\t"Say ""hi""', "Error Status Code: 700", 'Http failure response for u: 503 x', head, "   at A.B()", '"',
        "Information\t02.01.2024 15.04.05\tApp\t7\tNone\t", "Bogus\t1/2/2024 3:04:05 PM\tApp\t7\tNone\tx", source="a.txt")).collect()
    assert len(got) == 2
    a, b = sorted(got, key=lambda r: r.line_number)
    assert (a.line_number, str(a.ts), a.severity, a.http_status, a.stack_trace) == (3, "2024-01-02 15:04:05", "Error", 503, "at A.B()")
    assert a.message == 'Say "hi'  # quotes at the ends of the line are cut
    assert a.raw_content.split("\t")[3] == "0"
    assert b.message.startswith("Bogus")


def test_exception_preference_and_gateway(spark):
    assert one(spark, ev.exception_type(F.col("t")), t="System.Web.HttpUnhandledException then My.OwnException") == "My.OwnException"
    assert one(spark, ev.exception_type(F.col("t")), t="System.Web.HttpUnhandledException") == "System.Web.HttpUnhandledException"
    url = '{"url": "https://h/a"} {"url": "https://h/x/vsGateway/b."}'
    assert one(spark, ev.request_url(F.col("t")), t=url) == "https://h/x/vsGateway/b"
    assert one(spark, ev.api_path(F.col("t")), t="https://h/x/vsGateway/b") == "/vsGateway/b"


def test_format_detection(spark):
    head = "Level,Date and Time,Source,Event ID,Task Category"
    rows = [("a.txt", 1, head), ("b.txt", 51, head), ("b.txt", 1, "x"), ("c.LOG", 1, head), ("d.csv", 1, "x"), ("e.txt", 50, "error\t2024-01-02 03:04:05\tS\t1\tC")]
    got = logs.format_detect(spark.createDataFrame(rows, "source string, line_no long, value string"))
    assert dict(map(tuple, got.collect())) == {"a.txt": "eventviewer", "b.txt": "plain", "c.LOG": "plain", "d.csv": "unsupported", "e.txt": "eventviewer"}


def test_line_scan_numbers_lines_and_drops_bom(spark, tmp_path):
    (tmp_path / "x.log").write_bytes(b"\xef\xbb\xbfa\r\n\r\nb\n" + b"c\n" * 5000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = [tuple(r) for r in logs.log_line_scan(spark, str(tmp_path)).orderBy("line_no").select("line_no", "value").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got[:3] == [(1, "a"), (2, ""), (3, "b")] and got[-1] == (5003, "c") and len(got) == 5003


def plain_events_of(rows):
    """Straight from the definition: (start, end, raw, ts) of one source's (line_no, text) rows in order."""
    import re
    stamp = re.compile(r"^\[?(\d{4}[-/]\d\d[-/]\d\d \d\d:\d\d:\d\d)")
    out, ts = [], None
    for n, text in rows:
        starts = bool(stamp.match(text)) or bool(re.match(r"^(ERROR|WARN|INFO)\b", text))
        if starts or (not out and text.strip()):
            ts = stamp.match(text).group(1).replace("/", "-") if stamp.match(text) else ts
            out.append([n, n, [text], ts])
        elif out:
            out[-1][1] = n
            out[-1][2].append(text)
    return [(a, b, "\n".join(t).rstrip(), ts) for a, b, t, ts in out]


def test_events_over_blocks_equal_plain_loop(spark):
    """Random logs, gaps in line numbers, events over many blocks, blank lines at every border."""
    import random
    rng = random.Random(11)
    kinds = ["", "  ", "text", "   at X.Y()", "2024-01-01 10:00:{:02d} INFO ok", "ERROR plain", "[2024/01/01 11:00:{:02d}] WARN w"]
    rows = []
    for k in range(12):
        weights = [rng.random() ** 2 + (i < 2) * (k % 3) for i in range(len(kinds))]
        n = 0
        for _ in range(rng.randrange(0, 60)):
            n += rng.choice([1, 1, 1, 2, 9])
            rows.append((f"{k}.log", n, rng.choices(kinds, weights)[0].format(rng.randrange(60))))
    df = spark.createDataFrame(rows, "source string, line_no long, value string")
    want = sorted((s, *e) for s in {r[0] for r in rows} for e in plain_events_of([(n, t) for x, n, t in rows if x == s]))
    for block in (1, 2, 3, 7, 1000):
        got = asm.multiline_events(df, block, stamps=True).collect()
        assert sorted((r.source, r.start_line, r.end_line, r.raw_content, r.ts and str(r.ts)) for r in got) == want, block


def test_event_of_three_million_lines_is_a_chain_of_bounded_parts(spark):
    long = spark.range(1, 3_000_001).select(
        F.lit("a.log").alias("source"), F.col("id").alias("line_no"),
        F.when(F.col("id") == 5, "ERROR start").when(F.col("id") == 3_000_000, "INFO end").otherwise("  at X").alias("value"))
    parts = asm.event_parts(asm.plain_marks(long), stamps=True)
    sizes = parts.select("start_line", "part_no", (F.col("end_line") - F.col("first_line") + 1).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 65536
    got = {r.start_line: (r.parts, r.n) for r in sizes.groupBy("start_line").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n")).collect()}
    assert got == {1: (1, 4), 5: (46, 2_999_995), 3_000_000: (1, 1)}
    events = asm.plain_events(parts).select("start_line", "end_line", F.length("raw_content").alias("n")).orderBy("start_line").collect()
    assert [tuple(r) for r in events] == [(1, 4, 4 * 7 - 1), (5, 2_999_999, 11 + 2_999_994 * 7), (3_000_000, 3_000_000, 8)]


def test_normalize_entries_scans_lines_twice(spark, tmp_path):
    """Once for the formats and once for the events; the text of lines is exchanged once."""
    rows = [("a.log", 1, "ERROR x"), ("b.txt", 1, "Error\t1/2/2024 3:04:05 PM\tApp\t7\tNone\tboom"), ("b.txt", 2, "more"), ("c.txt", 1, "ERROR y")]
    spark.createDataFrame(rows, "source string, line_no long, value string").write.parquet(f"{tmp_path}/lines")
    got = logs.normalize_entries(spark.read.parquet(f"{tmp_path}/lines"))
    assert sorted((r.source, r.raw_content.split("\t")[-1]) for r in got.collect()) == [("a.log", "ERROR x"), ("b.txt", "boom\nmore"), ("c.txt", "ERROR y")]
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "/lines" not in plan  # entries come from the written parts


def test_message_limit(spark):
    df = lines(spark, "Error\t1/2/2024 3:04:05 PM\tApp\t7\tNone\t" + "m" * 1000, source="a.txt")
    for limit, n in ((600, 600), (10, 10), (None, 1000)):
        assert [len(r.message) for r in evo.normalize_eventviewer(df, message_limit=limit).collect()] == [n]
    assert [len(r.message) for r in evo.normalize_eventviewer(df).collect()] == [600]
    head = lines(spark, "Level\tDate and Time\tSource\tEvent ID\tTask Category", "Error\t1/2/2024 3:04:05 PM\tApp\t7\tNone\t" + "m" * 1000, source="a.txt")
    assert [len(r.message) for r in logs.normalize_entries(head, None).collect()] == [1000]


def test_patterns_are_not_repeated_in_the_condition_of_relevant_events(spark):
    """Each text of a named status is matched where its column is made; the condition reads the columns."""
    found = asm.normalize_plain(lines(spark, "2024-01-01 00:00:00 ERROR x", "2024-01-01 00:00:01 INFO status: 404", "2024-01-01 00:00:02 INFO y"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(plain.STATUS_WITH_REASON) <= 2 and plan.count(plain.LEVEL_CRITICAL) <= 2
    assert [(r.line_number, r.severity) for r in found.orderBy("line_number").collect()] == [(1, "Error"), (2, "Error")]
