"""Messages from raw bytes. Parsing is one narrow pass; raw bytes are dropped
before anything is shuffled."""

import hashlib
from email.parser import BytesHeaderParser, BytesParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark import schema
from mailspark.functions import columns as C

# The headers that become columns.
HEADERS = {"message-id": "message_id", "subject": "subject", "from": "from_addr",
           "to": "to_addr", "cc": "cc_addr", "date": "date_raw", "x-gm-thrid": "gm_thread",
           "references": "refs"}
PREVIEW_CHARS = C.PREVIEW_CHARS
ENCODED = ("quoted-printable", "base64", "x-uuencode", "uuencode", "uue", "x-uue")


def _text(value):
    return value.encode("ascii", "surrogateescape").decode("utf-8", "replace")


def _split(raw):
    """Header block and body."""
    cuts = [(raw.find(gap), len(gap)) for gap in (b"\n\n", b"\r\n\r\n")]
    cuts = [(at + size, size) for at, size in cuts if at >= 0]
    if raw[:1] == b"\n":
        return b"", raw[1:]
    if not cuts:
        return raw, b""
    end, _ = min(cuts)
    return raw[:end], raw[end:]


def _headers(message):
    out = {}
    for name, value in message.raw_items():
        column = HEADERS.get(name.lower())
        if column and column not in out:
            out[column] = _text(value)
    return out


def _plain_body(raw, head, body):
    """Decoded first text/plain part, or the payload of a single-part message."""
    kind, payload = head.get_content_maintype(), body
    encoding = str(head.get("content-transfer-encoding", "")).strip().lower()
    if kind == "multipart":
        payload = b""
        for part in BytesParser().parsebytes(raw).walk():
            if part.get_content_type() == "text/plain" and not part.is_multipart():
                payload = part.get_payload(decode=True) or b""
                if payload:
                    break
    elif encoding in ENCODED:
        head.set_payload(body.decode("ascii", "surrogateescape"))
        payload = head.get_payload(decode=True) or b""
    return payload


def parse_one(raw, whole_body=False):
    """Headers, preview, checksum and size of one message."""
    block, body = _split(raw)
    head = BytesHeaderParser().parsebytes(block)
    left_over = head.get_payload()
    if left_over:
        # A line that is no header ended the headers early.
        body = left_over.encode("ascii", "surrogateescape") + body
    out = _headers(head)
    payload = _plain_body(raw, head, body)
    if not whole_body:
        payload = payload[: 4 * PREVIEW_CHARS]
    text = payload.decode("utf-8", "ignore")
    out["body_preview"] = text[:PREVIEW_CHARS]
    if whole_body:
        out["body"] = text
    out["checksum"] = hashlib.sha256(raw).hexdigest()
    out["size_bytes"] = len(raw)
    return out


def generated_id(parsed):
    """Id of a parsed message without Message-ID, as ``columns.rfc_message_id``
    makes it."""
    given = [parsed.get("subject"), parsed.get("date_raw")]
    text = "".join(x if x is not None else d for x, d in zip(given, ("no-subject", "no-date")))
    return f"<{hashlib.sha256(text.encode()).hexdigest()}@generated>"


FIELDS = [*HEADERS.values(), "body_preview", "checksum"]


def _parser(passed, names, types):
    def parse(batches):
        for batch in batches:
            rows = []
            for raw in batch.column("raw").to_pylist():
                try:
                    rows.append(parse_one(raw, "body" in names))
                except Exception as problem:  # noqa: BLE001 - reported per row
                    rows.append({"parse_error": f"{type(problem).__name__}: {problem}"})
            made = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed] + made, names=passed + names)

    return parse


def parse_raw(df, whole_body=False):
    """Header columns, preview, checksum and size instead of ``raw``; all other
    columns are passed on. A message that cannot be parsed has parse_error."""
    passed = [f for f in df.schema if f.name != "raw"]
    names = FIELDS + ["size_bytes", "parse_error"] + (["body"] if whole_body else [])
    made = [T.StructField(n, T.LongType() if n == "size_bytes" else T.StringType()) for n in names]
    types = [pa.int64() if n == "size_bytes" else pa.string() for n in names]
    run = _parser([f.name for f in passed], names, types)
    return df.mapInArrow(run, T.StructType(passed + made))


def parse_messages(df, account_id="default", archived_at=None, whole_body=False):
    """Raw messages as catalogue rows. ``archived_at`` is a Column, by default
    the current time."""
    has = set(df.columns)
    parsed = parse_raw(df, whole_body)
    at = F.localtimestamp() if archived_at is None else archived_at
    own_thread = C.thread_id(F.col("gm_thread"), F.col("refs"))
    threads = [F.col("remote_thread_id")] if "remote_thread_id" in has else []
    given = {
        "gmail_id": F.lit(None).cast("string"),
        "labels": F.lit(None).cast("array<string>"),
        "archive_file": F.lit(None).cast("string"),
        "mbox_offset": F.lit(None).cast("long"),
        "mbox_length": F.lit(None).cast("long"),
    }
    columns = {name: F.col(name) if name in has else value for name, value in given.items()}
    columns.update({
        "rfc_message_id": C.rfc_message_id(
            F.col("message_id"), F.col("subject"), F.col("date_raw")),
        "thread_id": F.coalesce(*threads, own_thread),
        "date": C.parse_mail_date(F.col("date_raw")),
        "archived_timestamp": at.cast("timestamp_ntz"),
        "account_id": F.lit(account_id),
    })
    failed = F.col("parse_error").isNotNull()
    columns["rfc_message_id"] = F.when(~failed, columns["rfc_message_id"])
    selected = [columns.get(n, F.col(n)).alias(n) for n in schema.MESSAGES.names]
    body = [F.col("body")] if whole_body else []
    return parsed.select(*selected, *body, "parse_error")


def scan_message_ids(df):
    """Only id and location of raw messages."""
    return parse_messages(df).select(
        "rfc_message_id", "archive_file", "mbox_offset", "mbox_length")
