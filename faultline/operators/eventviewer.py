"""Event Viewer exports: lines to records, records to entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import eventviewer as ev
from faultline.functions.text import nonblank
from faultline.operators.assemble import ENTRY_COLUMNS, event_parts, joined_parts
from faultline.operators.ordered import BLOCK


def record_marks(lines: DataFrame) -> DataFrame:
    """Tab records start; headers are no lines of a record."""
    value = F.col("value")
    return lines.filter(~ev.is_header(value)).withColumns({"starts": ev.record_fields(value).isNotNull(), "opens": F.lit(False)})


def record_fields_of_heads() -> dict:
    """What ``event_parts`` has to make of a record's first line."""
    return {"_f": ev.record_fields(F.col("primary_line"))}


def records_of(parts: DataFrame) -> DataFrame:
    """One row per tab record, from parts with ``record_fields_of_heads``; later lines extend its description."""
    found = joined_parts(parts)
    text = F.when(F.col("rest").isNull(), F.col("_f.first_text")).otherwise(F.concat_ws("\n", "_f.first_text", "rest"))
    return found.select(
        "source", F.col("start_line").alias("line_number"), "_f.level", "_f.ts", "_f.event_source", "_f.event_id", "_f.task_category",
        ev.clean_description(text).alias("description"))


def eventviewer_records(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """``lines(source, line_no, value)`` to one row per tab record."""
    return records_of(event_parts(record_marks(lines.select("source", "line_no", "value")), block, heads=record_fields_of_heads()))


def entries_from_records(records: DataFrame, message_limit: int | None = ev.MESSAGE_LIMIT) -> DataFrame:
    """Every level is kept; only blank descriptions are dropped. Messages are whole with a ``message_limit`` of None."""
    text = F.col("description")
    return (
        records.filter(nonblank(text))
        .withColumns({
            "exception_type": ev.exception_type(text),
            "http_status": ev.http_status(text),
            "request_url": ev.request_url(text),
            "correlation_id": ev.correlation_id(text),
            "server_name": ev.server_name(text),
            "machine_name": ev.machine_name(text),
            "user_name": ev.user_name(text),
            "stack_trace": ev.stack_trace(text),
            "raw_content": ev.raw_content(
                F.col("level"), F.col("ts"), F.col("event_source"), F.col("event_id"),
                F.col("task_category"), text),
        })
        .withColumns({
            "api_path": ev.api_path(F.col("request_url")),
            "environment": ev.environment(text, F.col("server_name"), F.col("machine_name")),
            "severity": ev.severity(F.col("level"), text, F.col("http_status")),
            "message": ev.primary_message(text, F.col("exception_type"), message_limit),
        })
        .select(*ENTRY_COLUMNS)
    )


def normalize_eventviewer(lines: DataFrame, block: int = BLOCK, message_limit: int | None = ev.MESSAGE_LIMIT) -> DataFrame:
    return entries_from_records(eventviewer_records(lines, block), message_limit)
