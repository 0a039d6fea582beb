"""Records as structs and as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: record layouts ----------------------------------------------------------
PAGE_FIELDS = ["url", "title", "text"]
EVENT_FIELDS = ["url", "title", "event_type", "start_time", "end_time", "day", "location", "speaker", "body"]
TALK_SCHEMA = (
    "url STRING, title STRING, start_time STRING, end_time STRING, location STRING, "
    "speaker STRUCT<name: STRING, `from`: STRING>, body STRING"
)
# -------------------------------------------------------------------------------------------


def page_record(url: Column, title: Column, text: Column) -> Column:
    return F.struct(url.alias("url"), title.alias("title"), text.alias("text"))


def talk_record(url: Column, fields: Column | dict[str, Column]) -> Column:
    """Talk record with its nested speaker, from a struct (or mapping) of fields."""
    return F.struct(
        url.alias("url"),
        fields["title"].alias("title"),
        fields["start_time"].alias("start_time"),
        fields["end_time"].alias("end_time"),
        fields["location"].alias("location"),
        F.struct(fields["speaker_name"].alias("name"), fields["speaker_from"].alias("from")).alias("speaker"),
        fields["body"].alias("body"),
    )


def record_json(record: Column) -> Column:
    """Compact JSON; NULL fields stay visible."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def record_bytes(json: Column) -> Column:
    """UTF-8 bytes of the JSON line, its newline included."""
    return (F.octet_length(json) + 1).cast("bigint")
