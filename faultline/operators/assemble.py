"""Record assembly: lines to events, events to normalized entries (plain text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import plain
from faultline.functions.text import nonblank, strip_end
from faultline.operators.ordered import BLOCK, with_last_value
from faultline.plans.staging import staged

ENTRY_COLUMNS = [
    "source", "line_number", "ts", "severity", "exception_type", "message", "http_status",
    "request_url", "api_path", "correlation_id", "server_name", "machine_name", "environment",
    "user_name", "stack_trace", "raw_content",
]


def event_parts(marked: DataFrame, block: int = BLOCK, stamps: bool = False, heads: dict[str, Column] | None = None) -> DataFrame:
    """Events as chains of bounded parts, in one exchange of the text.

    ``marked`` has ``source, line_no, value, starts, opens``: lines that start an event, and lines that open one if nothing in their
    source has done so before; other columns are kept and must be equal within a source. Lines before the first event are dropped.

    Lines meet in blocks of ``block`` line numbers. Each block cuts itself into parts without knowing the others, and the parts are
    written. One summary row for each block (its last start, and its last stamp) then says what the leading parts of
    later blocks belong to. So no part has more lines than a block, however long its event is.

    Returns ``source, start_line, part_no, first_line, end_line, head, primary_line, rest``: ``head`` is true for the part that has the
    start line, ``primary_line`` is a part's first line and ``rest`` the others, null if there are none. With ``stamps``, ``ts`` is the last
    stamp on any start line up to the event's own. ``heads`` are further columns made from ``primary_line`` and kept ones.
    """
    kept = [c for c in marked.columns if c not in ("source", "line_no", "value", "starts", "opens")]
    own_block = Window.partitionBy("source", "part_no")
    first = F.min(F.when(F.col("opens"), F.col("line_no"))).over(own_block)
    upto = own_block.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumn("part_no", F.floor(F.col("line_no") / F.lit(block))).withColumn("_first", first).withColumn(
        "_own", F.last(F.when(F.col("starts") | (F.col("line_no") == F.col("_first")), F.col("line_no")), True).over(upto))
    cut = rows.groupBy("source", "part_no", "_own").agg(
        F.min("line_no").alias("first_line"), F.max("line_no").alias("end_line"), F.bool_or("starts").alias("_starts"),
        F.array_sort(F.collect_list(F.struct("line_no", "value"))).alias("_lines"), *[F.first(c).alias(c) for c in kept])
    others = F.slice(F.col("_lines")["value"], F.lit(2), F.greatest(F.size("_lines") - 1, F.lit(1)))
    parts = cut.select(
        "source", "part_no", "_own", "first_line", "end_line", "_starts", F.col("_lines")[0]["value"].alias("primary_line"),
        F.when(F.size("_lines") > 1, F.array_join(others, "\n")).alias("rest"), *kept)
    parts = parts.withColumns(heads or {})
    kept += list(heads or {})
    if stamps:
        seen = own_block.orderBy("first_line").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("_stamp", F.when(F.col("_own").isNotNull(), plain.timestamp(F.col("primary_line")))).withColumn(
            "_seen", F.last(F.when(F.col("_starts"), F.col("_stamp")), True).over(seen))
    parts = staged(parts, "parts")

    tentative = F.col("_own").isNotNull() & ~F.col("_starts")
    summary = parts.groupBy("source", "part_no").agg(
        F.max("_own").isNotNull().alias("_any"), F.max(F.when(F.col("_starts"), F.col("_own"))).alias("_last"),
        F.min(F.when(tentative, F.col("_own"))).alias("_tentative"),
        *([F.max_by("_seen", F.when(F.col("_seen").isNotNull(), F.col("first_line"))).alias("_last_stamp"),
           F.max(F.when(tentative, F.col("_stamp"))).alias("_early_stamp")] if stamps else []))
    earlier = Window.partitionBy("source").orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(F.max("_any").over(earlier), F.lit(False))
    known = summary.withColumn("_opened", opened)
    early = lambda c: F.when(~F.col("_opened"), F.col(c))
    carried = known.select(
        "source", "part_no", early("_tentative").alias("_opening"),
        F.last(F.coalesce("_last", early("_tentative")), True).over(earlier).alias("_carried"),
        *([early("_early_stamp").alias("_early"), F.last(F.coalesce("_last_stamp", early("_early_stamp")), True).over(earlier).alias("_before")]
          if stamps else []))
    head = F.coalesce(F.col("_starts") & F.col("_own").isNotNull(), F.lit(False)) | F.coalesce(F.col("_own") == F.col("_opening"), F.lit(False))
    found = parts.join(carried, ["source", "part_no"]).withColumn("head", head).withColumn(
        "start_line", F.when(F.col("head"), F.col("_own")).otherwise(F.coalesce("_carried", "_opening")))
    ts = [F.coalesce("_seen", "_early", "_before").alias("ts")] if stamps else []
    return found.filter(F.col("_own").isNotNull() | F.col("_carried").isNotNull()).select(
        "source", "start_line", "part_no", "first_line", "end_line", "head", "primary_line", "rest", *ts, *kept)


def joined_parts(parts: DataFrame) -> DataFrame:
    """One row for each event: its head, with the ``rest`` and ``end_line`` of all its parts.

    Only parts that continue an event of an earlier block are shuffled; there is one of them in a block at most, or two if blank lines lead.
    """
    text = F.when(F.col("rest").isNull(), F.col("primary_line")).otherwise(F.concat_ws("\n", "primary_line", "rest"))
    tails = parts.filter(~F.col("head")).select("source", "start_line", "first_line", "end_line", text.alias("text")).groupBy("source", "start_line").agg(
        F.max("end_line").alias("_end"), F.array_join(F.array_sort(F.collect_list(F.struct("first_line", "text")))["text"], "\n").alias("_tail"))
    heads = parts.filter("head").drop("head", "part_no", "first_line")
    both = F.when(F.col("_tail").isNull(), F.col("rest")).when(F.col("rest").isNull(), F.col("_tail")).otherwise(F.concat_ws("\n", "rest", "_tail"))
    return heads.join(tails, ["source", "start_line"], "left").withColumns(
        {"rest": both, "end_line": F.coalesce("_end", "end_line")}).drop("_end", "_tail")


def plain_marks(lines: DataFrame) -> DataFrame:
    """Where events start. The first non-blank line of a source always opens one, so leading text before the first stamped
    line is kept and leading blank lines are not."""
    value = F.col("value")
    return lines.withColumns({"starts": plain.starts_event(value), "opens": nonblank(value)})


def plain_events(parts: DataFrame) -> DataFrame:
    whole = F.when(F.col("rest").isNull(), F.col("primary_line")).otherwise(F.concat_ws("\n", "primary_line", "rest"))
    return joined_parts(parts).withColumn("raw_content", strip_end(whole)).drop("rest")


def multiline_events(lines: DataFrame, block: int = BLOCK, stamps: bool = False) -> DataFrame:
    """``lines(source, line_no, value)`` to events with their continuation lines.

    With ``stamps`` each event also gets ``ts``: the last stamp on any start line up to its own, found in the same pass over the lines.
    """
    marked = plain_marks(lines.select("source", "line_no", "value"))
    return plain_events(event_parts(marked, block, stamps)).select(
        "source", "start_line", "end_line", "primary_line", "raw_content", *(["ts"] if stamps else []))


def total_lines_plain(events: DataFrame) -> DataFrame:
    """Last line any event of the source reaches."""
    return events.groupBy("source").agg(F.max("end_line").alias("total_lines"))


def total_lines_read(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source").agg(F.count(F.lit(1)).alias("total_lines"))


def classify_plain(events: DataFrame) -> DataFrame:
    """Columns that decide relevance: exception, status, severity."""
    content = F.col("raw_content")
    return (
        events.withColumns(
            {
                "exception_type": plain.exception_type(content),
                "http_status": plain.http_status(content),
            }
        )
        .withColumn(
            "severity",
            plain.severity(
                F.col("primary_line"), content, F.col("http_status"), F.col("exception_type")
            ),
        )
    )


def detect_timestamps(events: DataFrame) -> DataFrame:
    return events.withColumn("detected_ts", plain.timestamp(F.col("primary_line")))


def carry_timestamps(events: DataFrame, block: int = BLOCK) -> DataFrame:
    """Events without a stamp (``detected_ts``) take the last one seen in their source."""
    return with_last_value(events, "source", "start_line", {"ts": "detected_ts"}, block)


def relevant(events: DataFrame) -> DataFrame:
    """Events that matter. A condition on a generated column stays behind it, so the patterns of the three columns run once
    for each event instead of again in the condition, in every place that names them."""
    found = events.withColumn("_severity", F.explode(F.array("severity")))
    return found.filter(
        plain.is_relevant(F.col("_severity"), F.col("exception_type"), F.col("http_status"))
    ).drop("_severity")


def extract_fields(events: DataFrame) -> DataFrame:
    """The remaining fields, computed only for events that were kept."""
    content, primary = F.col("raw_content"), F.col("primary_line")
    return (
        events.withColumns(
            {
                "request_url": plain.request_url(content),
                "correlation_id": plain.correlation_id(content),
                "server_name": plain.server_name(content),
                "machine_name": plain.machine_name(content),
                "user_name": plain.user_name(content),
                "message": plain.display_message(primary, content),
                "stack_trace": plain.stack_trace(content),
            }
        )
        .withColumns(
            {
                "api_path": plain.api_path(F.col("request_url")),
                "environment": plain.environment(
                    F.regexp_extract(content, plain.ENVIRONMENT, 1),
                    F.col("server_name"),
                    F.col("machine_name"),
                ),
                "line_number": F.col("start_line"),
            }
        )
        .select(*ENTRY_COLUMNS)
    )


def normalize_plain(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Plain-text lines to relevant entries.

    Stamps are carried over all events first; only then are irrelevant ones cut.
    """
    return entries_of(multiline_events(lines, block, stamps=True))


def entries_of(events: DataFrame) -> DataFrame:
    """Relevant entries of stamped events."""
    return extract_fields(relevant(classify_plain(events)))
