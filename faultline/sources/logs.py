"""Text logs as numbered lines, and the choice of parser per file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions import eventviewer as ev, plain
from faultline.functions.text import nonblank
from faultline.operators.assemble import entries_of, event_parts, plain_events
from faultline.operators.eventviewer import entries_from_records, record_fields_of_heads, records_of
from faultline.operators.ordered import with_last_value
from faultline.plans.staging import staged

DETECTION_LINES = 50
#: Bytes of a block of UTF-16 text.
WIDE_BLOCK = 1 << 22
PLAIN, EVENT_VIEWER, UNSUPPORTED = "plain", "eventviewer", "unsupported"


def log_line_scan(spark: SparkSession, path: str | list[str], name: Callable[[Column], Column] | None = None) -> DataFrame:
    """``source, line_no, value`` with dense 1-based line numbers per file.

    Each file is read by its own byte order mark: UTF-16 of either order, or UTF-8. All files are read in splits, as records that end at
    line feed bytes. One summary row per split (records, lines, bytes, mark) is written first and summed up along the file,
    so a huge file is never ordered in one task, whatever its encoding. Lines end with CR LF, LF or CR.
    """
    raw = spark.read.option("lineSep", "\n").text(path, recursiveFileLookup=True).select(
        F.col("value").cast("binary").alias("bytes"),
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("_id"),
    )
    summary = staged(raw.groupBy("path", "split").agg(
        F.sum(F.size(_lines(F.col("bytes").cast("string")))).alias("lines"), F.sum(F.length("bytes") + 1).alias("size"),
        F.min_by(F.hex(F.substring("bytes", 1, 2)), "_id").alias("head"), F.max_by(F.hex(F.substring("bytes", -1, 1)), "_id").alias("tail")), "splits")
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = summary.select(
        "path", "split", before("lines").alias("_lines"), before("size").alias("_bytes"), F.last("tail").over(earlier).alias("_tail"),
        F.sum("size").over(Window.partitionBy("path")).alias("_total"))
    marks = summary.filter((F.col("split") == 0) & F.col("head").isin("FFFE", "FEFF")).select("path", (F.col("head") == "FFFE").alias("little"))
    wide = not marks.isEmpty()
    narrow = raw.join(marks, "path", "left_anti") if wide else raw
    inside = Window.partitionBy("path", "split").orderBy("_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    numbered = narrow.withColumn("_own", _lines(F.col("bytes").cast("string"))).withColumn(
        "_pos", F.coalesce(F.sum(F.size("_own")).over(so_far), F.lit(0))).join(offsets, ["path", "split"])
    out = numbered.select("path", F.col("_lines").alias("_before"), "_pos", F.posexplode("_own").alias("_at", "value"))
    line_no = (F.col("_before") + F.col("_pos") + F.col("_at") + 1).cast("long")
    out = out.select("path", line_no.alias("line_no"), F.when(line_no == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")).alias("value"))
    if wide:
        out = out.unionByName(_wide_lines(raw.join(marks, "path"), offsets))
    return out.select((name(F.col("path")) if name else F.col("path")).alias("source"), "line_no", "value")


def _lines(record: Column) -> Column:
    """Lines of a record that ended at a line feed."""
    return F.when(F.contains(record, F.lit("\r")), F.split(F.regexp_replace(record, r"\r\z", ""), "\r")).otherwise(F.array(record))


def _wide_lines(raw: DataFrame, offsets: DataFrame) -> DataFrame:
    """``path, line_no, value`` of files in UTF-16.

    A byte 10 ends a line only if it is one half of a line feed: the first half in little order, so that the other one begins the next
    record, or the second half in big order, after the one that ends its own record. Which half a byte is follows from its
    offset in the file. Records that no line feed parts are put together again.
    """
    order = Window.partitionBy("path", "split").orderBy("_id")
    size, last_byte = F.length("bytes"), F.hex(F.substring("bytes", -1, 1))
    rows = raw.withColumns({
        "_local": F.coalesce(F.sum(size + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_prior": F.lag(last_byte).over(order)}).join(offsets, ["path", "split"]).withColumn("at", F.col("_bytes") + F.col("_local"))
    odd = F.col("at") % 2 == 1
    starts = (F.col("at") == 0) | F.when(F.col("little"), odd & (F.hex(F.substring("bytes", 1, 1)) == "00")).otherwise(
        ~odd & (F.coalesce("_prior", "_tail") == "00"))
    behind = F.col("little") & (F.col("at") + size + 1 == F.col("_total")) & (F.hex("bytes") == "00") & starts  # half of the last line feed
    marked = rows.withColumn("_start", F.when(starts, F.col("at"))).filter(~behind).select("path", "little", "bytes", "at", "_start")
    whole = with_last_value(marked, "path", "at", {"_begin": "_start"}, WIDE_BLOCK).groupBy("path", "_begin").agg(
        F.first("little").alias("little"), F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("r"))
    others = F.slice(F.col("r")["bytes"], F.lit(2), F.greatest(F.size("r") - 1, F.lit(1)))
    joined = F.aggregate(others, F.col("r")[0]["bytes"], lambda a, x: F.concat(a, F.lit(b"\n"), x))
    cut = (F.when(F.col("_begin") == 0, F.expr("substring(b, 3)")).when(F.col("little"), F.expr("substring(b, 2)")).otherwise(F.col("b")))
    # an odd byte is the first half of a line feed in big order; otherwise a byte 10 at the very end ended a record, but no line
    half = (F.length("b") % 2 == 1)
    ended = ~F.col("little") & (F.hex(F.substring("b", -1, 1)) == "00")
    full = F.when(half & ended, F.expr("substring(b, 1, length(b) - 1)")).when(half, F.concat("b", F.lit(b"\n"))).otherwise(F.col("b"))
    text = F.when(F.col("little"), F.decode("f", "UTF-16LE")).otherwise(F.decode("f", "UTF-16BE"))
    lines = staged(whole.withColumn("b", joined).withColumn("b", cut).withColumn("f", full).select("path", "_begin", _lines(text).alias("_own")).withColumn(
        "_blk", F.floor(F.col("_begin") / F.lit(WIDE_BLOCK))), "wide_lines")
    earlier = Window.partitionBy("path").orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("path", "_blk").agg(F.sum(F.size("_own")).alias("n")).select(
        "path", "_blk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy("path", "_blk").orderBy("_begin").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("_pos", F.coalesce(F.sum(F.size("_own")).over(so_far), F.lit(0))).join(blocks, ["path", "_blk"])
    return placed.select("path", "_before", "_pos", F.posexplode("_own").alias("_at", "value")).select(
        "path", (F.col("_before") + F.col("_pos") + F.col("_at") + 1).cast("long").alias("line_no"), "value")


def format_detect(lines: DataFrame, detection_lines: int = DETECTION_LINES) -> DataFrame:
    """``source, format`` from the file extension and the first lines, 50 unless told otherwise."""
    extension = F.lower(F.regexp_extract("source", r"(\.[^./\\]*)$", 1))
    looks = ev.is_header(F.col("value")) | ev.record_fields(F.col("value")).isNotNull()
    return (
        lines.filter(F.col("line_no") <= detection_lines)
        .groupBy("source")
        .agg(F.bool_or(looks).alias("_ev"))
        .select(
            "source",
            F.when(extension == ".log", PLAIN)
            .when(extension == ".txt", F.when(F.coalesce("_ev", F.lit(False)), EVENT_VIEWER).otherwise(PLAIN))
            .otherwise(UNSUPPORTED)
            .alias("format"),
        )
    )


def normalize_entries(lines: DataFrame, message_limit: int | None = ev.MESSAGE_LIMIT) -> DataFrame:
    """Entries of every file, each read by the parser its format asks for, in one assembly of all lines.

    A file of an unsupported kind fails the job, as no parser can read it.
    """
    checked = format_detect(lines).withColumn(
        "format",
        F.when(
            F.col("format") == UNSUPPORTED,
            F.raise_error(F.concat(F.lit("No parser is available for "), F.col("source"))).cast("string"),
        ).otherwise(F.col("format")),
    )
    plain_file = F.col("format") == PLAIN
    value = F.col("value")
    marked = lines.select("source", "line_no", "value").join(checked, "source").filter(plain_file | ~ev.is_header(value)).withColumns({
        "starts": F.when(plain_file, plain.starts_event(value)).otherwise(ev.record_fields(value).isNotNull()),
        "opens": plain_file & nonblank(value)})
    fields = {c: F.when(~plain_file, v) for c, v in record_fields_of_heads().items()}
    parts = event_parts(marked, stamps=True, heads=fields)
    return entries_of(plain_events(parts.filter(plain_file))).unionByName(
        entries_from_records(records_of(parts.filter(F.col("format") == EVENT_VIEWER).drop("ts")), message_limit))
