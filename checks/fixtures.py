"""Log lines that Spark derives from the ``events`` table, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.plans.staging import tune

URLS = [
    "/api/CommonServiceApi/getMpacImages", "/api/AciApi/Submit", "/api/AciApi/AuditLog",
    "/api/AccountApi/authenticateuser",
]
TAILS = [
    " System.NullReferenceException: Object reference not set",
    " Microsoft.Data.SqlClient.SqlException: Execution Timeout Expired. Error Number: -2",
    " Xpertdoc.TemplateManager.Handler.TemplateExecutionException: template failed",
    " System.ArgumentException: Parameter is not valid",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(spark.sparkContext.defaultParallelism)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "event_type",
        F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"),
        F.timestamp_seconds(F.expr("1704067200") + F.floor((seconds - 1704067200) / 60)).alias("t"),
    )


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, line_no, value``: plain-text log lines."""
    e, k, u = F.col("event_type"), F.col("k"), F.col("user_id")
    level = (
        F.when(e == "error", F.when(k % 10 == 0, "CRITICAL").otherwise("ERROR"))
        .when(e == "purchase", "WARN").otherwise("INFO")
    )
    status = F.when((e == "error") & (k % 3 == 0), " HTTP 500").when(
        (e == "error") & (k % 3 == 1), " status: 404").otherwise("")
    head = F.concat(
        F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level,
        F.lit(" server=APPPRIVSPR1"), (u % 3).cast("string"), F.lit(" user="), u.cast("string"),
        F.when(k % 2 == 0, F.concat(F.lit(" correlationId="), u.cast("string"), F.lit("-"), (k % 5).cast("string"))).otherwise(""),
        status,
        F.lit(" https://vs.example.com"), _pick(URLS, u % 4), F.lit("?id="), F.col("event_id").cast("string"),
        F.when(e == "error", _pick(TAILS, k % 4)).otherwise(" ok"),
    )
    stack = F.concat(
        F.lit("   at Shop.Web.Orders.Svc"), (k % 4).cast("string"), F.lit(".Run() in Svc.cs:line "), k.cast("string"))
    n = F.col("event_id") * 3
    is_error = e == "error"
    lines = F.array(
        F.struct((n + 1).alias("line_no"), head.alias("value")),
        F.struct((n + 2).alias("line_no"), F.when(is_error, stack).alias("value")),
        F.struct((n + 3).alias("line_no"), F.when(is_error & (k % 7 == 0), "").alias("value")),
    )
    return (
        _events(spark, sf_dir)
        .select(F.concat(F.lit("app-"), (u % 5).cast("string"), F.lit(".log")).alias("source"),
                F.inline(F.filter(lines, lambda x: x["value"].isNotNull())))
    )


def log_lines_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines without the stamp on every fourth head line."""
    v = F.col("value")
    drop = (F.floor((F.col("line_no") - 1) / 3) % 4 == 0) & ((F.col("line_no") - 1) % 3 == 0)
    return log_lines(spark, sf_dir).withColumn(
        "value", F.when(drop, F.expr("substring(value, 21)")).otherwise(v))


def ev_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events as Event Viewer exports, one header line per file."""
    e, k, u = F.col("event_type"), F.col("k"), F.col("user_id")
    txt = lambda c: c.cast("string")
    level = (
        F.when(e == "error", F.when(k % 10 == 0, "Critical").otherwise("Error"))
        .when(e == "purchase", "Warning").when(e == "signup", "Audit Failure").otherwise("Information"))
    empty = k % 10 == 3
    said = F.when(empty, "").when(e == "click", '"isSkipReviewEnabled: true').otherwise(
        F.concat(F.lit('"Operation ""op'), txt(k % 4), F.lit('"" failed\tfor user '), txt(u)))
    head = F.concat_ws(
        "\t", level, F.date_format("t", "MM/dd/yyyy HH:mm:ss"), F.concat(F.lit("ShopApp"), txt(u % 2)),
        F.when(k % 11 == 0, "n/a").otherwise(txt(k + 100)), F.lit("None"), said)
    n = F.col("event_id") * 8
    url = F.concat(F.lit("https://vs.example.com"), _pick(URLS, u % 4), F.lit("?id="), txt(F.col("event_id")))
    error = [
        F.concat(F.lit("Error Type: "), F.regexp_extract(_pick(TAILS, k % 4), r" ([A-Za-z.]+Exception)", 1)),
        F.concat(F.lit("Error Status Code: "), F.when(k % 3 == 0, "500").when(k % 3 == 1, "404").otherwise("9")),
        F.concat(F.lit("Error Request Url: "), url),
        F.concat(F.lit("Host Name: APPPRIVSPR1"), txt(u % 3)),
        F.concat(F.lit("Correlation Id: "), txt(u), F.lit("-"), txt(k % 5)),
        F.concat(F.lit("   at Shop.Web.Orders.Svc"), txt(k % 4), F.lit(".Run() in Svc.cs:line "), txt(k)),
    ]
    warned = [F.concat(F.lit('{""status"": 404, ""url"": ""https://vs.example.com/vsgateway'), _pick(URLS, u % 4), F.lit('""}'))]
    signed = [
        F.concat(F.lit("User Name: "), txt(u)),
        F.concat(F.lit("Http failure response for "), url, F.lit(": 503 Service Unavailable")),
        F.lit("Environment: Production"),
    ]
    def more(kind, texts):
        return [F.struct((n + 2 + i).alias("line_no"), F.when((e == kind) & ~empty, t).alias("value"))
                for i, t in enumerate(texts)]

    lines = F.array(
        F.struct((n + 1).alias("line_no"), head.alias("value")),
        *more("error", error), *more("purchase", warned), *more("signup", signed),
        F.struct((n + 8).alias("line_no"), F.when(~empty, '"').alias("value")))
    source = F.concat(F.lit("app-"), txt(u % 5), F.lit(".txt")).alias("source")
    body = _events(spark, sf_dir).select(source, F.inline(F.filter(lines, lambda x: x["value"].isNotNull())))
    header = table(spark, sf_dir, "events").select(F.concat(
        F.lit("app-"), txt(F.col("user_id") % 5), F.lit(".txt")).alias("source")).distinct().select(
        "source", F.lit(0).cast("long").alias("line_no"), F.lit("\t".join(
            ["Level", "Date and Time", "Source", "Event ID", "Task Category"])).alias("value"))
    return header.unionByName(body)


def write_log_files(lines: DataFrame, folder: str, rows_per_file: int = 200_000) -> str:
    """Write lines as text files, in order; a long log becomes several files."""
    chunk = F.floor(F.col("line_no") / F.lit(rows_per_file))
    (
        lines.withColumn("chunk", chunk)
        .repartition("source", "chunk")
        .sortWithinPartitions("source", "chunk", "line_no")
        .select("source", "chunk", "value")
        .write.partitionBy("source", "chunk").text(folder)
    )
    return folder
