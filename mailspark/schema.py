"""Table layouts. All instants are TIMESTAMP_NTZ in UTC, so that results do
not depend on the session time zone."""

from pyspark.sql import types as T

S, L, TS = T.StringType(), T.LongType(), T.TimestampNTZType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


#: One row per stored message. A row is identified by (archive_file,
#: mbox_offset); rfc_message_id may repeat until a dedup removes the copies.
MESSAGES = _struct(
    ("gmail_id", S, True),
    ("rfc_message_id", S, False),
    ("thread_id", S, True),
    ("subject", S, True),
    ("from_addr", S, True),
    ("to_addr", S, True),
    ("cc_addr", S, True),
    ("date", TS, True),
    ("date_raw", S, True),
    ("archived_timestamp", TS, False),
    ("archive_file", S, False),
    ("mbox_offset", L, False),
    ("mbox_length", L, False),
    ("body_preview", S, True),
    ("checksum", S, True),
    ("size_bytes", L, True),
    ("labels", T.ArrayType(S), True),
    ("account_id", S, True),
)

#: Row identity inside the catalogue.
LOCATION = ("archive_file", "mbox_offset")

#: Raw messages as read from an archive.
RAW_MESSAGES = _struct(
    ("archive_file", S, False),
    ("mbox_offset", L, False),
    ("mbox_length", L, False),
    ("raw", T.BinaryType(), False),
)

#: Version 1.0 catalogue.
LEGACY_MESSAGES = _struct(
    ("gmail_id", S, False),
    ("archived_timestamp", S, True),
    ("archive_file", S, True),
    ("subject", S, True),
    ("from_addr", S, True),
    ("message_date", S, True),
    ("checksum", S, True),
)

ARCHIVE_RUNS = _struct(
    ("run_timestamp", TS, False),
    ("query", S, True),
    ("messages_archived", L, False),
    ("archive_file", S, True),
    ("account_id", S, True),
    ("operation_type", S, True),
)

SESSION_EVENTS = _struct(
    ("session_id", S, False),
    ("event", S, False),  # create / progress / complete / abort / delete
    ("event_time", TS, False),
    ("target_file", S, True),
    ("query", S, True),
    ("message_ids", T.ArrayType(S), True),
    ("compression", S, True),
    ("processed_count", L, True),
    ("account_id", S, True),
)

#: Remote message resource as landed JSON.
API_MESSAGE = _struct(
    ("id", S, True),
    ("threadId", S, True),
    ("labelIds", T.ArrayType(S), True),
    ("raw", S, True),
)

ACCOUNTS = _struct(("account_id", S, False), ("email", S, True), ("display_name", S, True))

# Catalogue versions in order.
VERSIONS = ("none", "1.0", "1.1", "1.2", "1.3", "unknown")
CURRENT_VERSION = "1.3"


class SchemaError(ValueError):
    """A table lacks columns an operator needs, or has a version it refuses."""


def schema_version(df, declared=None):
    """Version of a catalogue: the declared one if it is known, else read off
    the columns. Current catalogues keep the raw date header next to the
    parsed one."""
    if declared is not None:
        return declared if declared in VERSIONS else "unknown"
    columns = set(df.columns)
    if set(MESSAGES.names) <= columns:
        return CURRENT_VERSION
    if {"rfc_message_id", "mbox_offset", "mbox_length"} <= columns:
        return "1.1"
    if {"gmail_id", "archive_file", "message_date"} <= columns:
        return "1.0"
    return "unknown" if columns else "none"


def require(df, columns):
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df
