"""Scalar expressions on message columns. Everything here is a plain Column."""

import datetime as dt
import re

from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\x0b\x0c"


def strip(c):
    return F.btrim(c, F.lit(WHITESPACE))


def rfc_message_id(message_id, subject, date):
    """Trimmed Message-ID header; mail without one gets an id made from its
    subject and date."""
    made = F.concat(
        F.lit("<"),
        F.sha2(
            F.concat(
                F.coalesce(subject, F.lit("no-subject")), F.coalesce(date, F.lit("no-date"))
            ),
            256,
        ),
        F.lit("@generated>"),
    )
    return F.coalesce(F.nullif(strip(message_id), F.lit("")), made)


def thread_id(gm_thread, references):
    """Thread header, else the first token of References, else NULL."""
    first = F.get(F.split(strip(references), r"\s+"), F.lit(0))
    return F.coalesce(F.nullif(strip(gm_thread), F.lit("")), F.nullif(first, F.lit("")))


PREVIEW_CHARS = 1000


def body_preview(body):
    return F.left(body, F.lit(PREVIEW_CHARS))


def checksum(raw):
    return F.sha2(raw, 256)


def size_bytes(raw):
    return F.octet_length(raw).cast("long")


def effective_size(size="size_bytes", length="mbox_length"):
    """Stored size, or the stored record length where the size is NULL."""
    return F.coalesce(F.col(size), F.col(length))


# Month names and the obsolete zone names of RFC 2822 (hours).
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun",
          "jul", "aug", "sep", "oct", "nov", "dec")
ZONES = {"UT": 0, "UTC": 0, "GMT": 0, "Z": 0, "AST": -4, "ADT": -3, "EST": -5, "EDT": -4,
         "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}

_DATE = (
    r"^\s*(?:[A-Za-z]+\s*,?\s+)?(\d{1,2})[\s-]+([A-Za-z]{3})[A-Za-z]*[\s-]+(\d{2,4})"
    r"\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?\s*([+-]\d{4}|[A-Za-z]+)?"
)


def mail_wall_clock(raw):
    """Date and time as written in an RFC 2822 date, its zone left out."""

    def part(i):
        return F.nullif(F.regexp_extract(raw, _DATE, i), F.lit(""))

    month = F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.lower(part(2))
    ).cast("int")
    year = part(3).cast("int")
    year = (
        F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    )
    second = F.coalesce(part(6), F.lit("0")).cast("decimal(8,6)")
    return F.when(
        month > 0,
        F.call_function(
            "try_make_timestamp_ntz", year, month, part(1).cast("int"),
            part(4).cast("int"), part(5).cast("int"), second,
        ),
    )


def mail_zone_minutes(raw):
    """Offset from UTC of an RFC 2822 date; 0 if it names none we know."""
    zone = F.upper(F.regexp_extract(raw, _DATE, 7))
    digits = F.abs(F.substring(zone, 2, 4).try_cast("int"))
    minutes = (F.floor(digits / 100) * 60 + digits % 100).cast("int")
    named = F.lit(0)
    for name, hours in ZONES.items():
        named = F.when(zone == name, F.lit(hours * 60)).otherwise(named)
    return (
        F.when(zone.startswith("-"), -minutes).when(zone.startswith("+"), minutes).otherwise(named)
    )


def parse_mail_date(raw):
    """Instant of a date header in UTC; ISO text is accepted too. NULL if the
    text is no date."""
    rfc = mail_wall_clock(raw) - F.make_dt_interval(mins=mail_zone_minutes(raw))
    return F.coalesce(rfc, raw.try_cast("timestamp_ntz"))


def sort_date(date):
    """Sort key of a date: rows without a valid date come first."""
    return F.coalesce(date, F.lit("1970-01-01").cast("timestamp_ntz"))


def labels(json_text):
    return F.from_json(json_text, "array<string>")


# Archive suffixes and the codec each stands for.
CODECS = {".gz": "gzip", ".xz": "lzma", ".lzma": "lzma", ".zst": "zstd"}
EXTENSIONS = {"gzip": ".gz", "lzma": ".xz", "zstd": ".zst"}


def compression_of(path):
    """Codec by path suffix; NULL for a plain file."""
    lowered, out = F.lower(path), F.lit(None).cast("string")
    for suffix, codec in CODECS.items():
        out = F.when(lowered.endswith(suffix), F.lit(codec)).otherwise(out)
    return out


def validate_compression(codec):
    if codec is None:
        return None
    codec = codec.strip().lower()
    if codec not in EXTENSIONS:
        raise ValueError(f"unsupported compression {codec!r}, use one of {', '.join(EXTENSIONS)}")
    return codec


_AGE = re.compile(r"(\d+)([ymwd])", re.ASCII)
_ISO_DAY = re.compile(r"\d{4}-\d{2}-\d{2}", re.ASCII)


def age_cutoff(age, as_of=None):
    """Cutoff instant for ``3y`` / ``6m`` / ``2w`` / ``30d`` / ``YYYY-MM-DD``,
    counted back from ``as_of`` (a Column, default: now)."""
    text = (age or "").strip().lower()
    if _ISO_DAY.fullmatch(text):
        dt.date.fromisoformat(text)
        return F.lit(text).cast("timestamp_ntz")
    found = _AGE.fullmatch(text)
    if not found:
        raise ValueError(f"not an age or an ISO date: {age!r}")
    count, unit = int(found[1]), found[2]
    if not 0 < count <= 9999:
        raise ValueError(f"age must lie between 1 and 9999: {age!r}")
    start = F.localtimestamp() if as_of is None else as_of
    start = start.cast("timestamp_ntz")
    if unit == "y":
        return start - F.make_ym_interval(F.lit(count), F.lit(0))
    if unit == "m":
        return start - F.make_ym_interval(F.lit(0), F.lit(count))
    return start - F.make_dt_interval(F.lit(count * (7 if unit == "w" else 1)))


def format_query_date(date):
    return F.date_format(date, "yyyy/MM/dd")


def format_bytes(size):
    """Human size in steps of 1024 with one decimal, half to even."""

    def shown(power, unit):
        scaled = F.bround(size.cast("double") / F.lit(1024.0**power), 1)
        return F.format_string("%.1f " + unit, scaled)

    out = shown(5, "PB")
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        out = F.when(size < F.lit(1024 ** (power + 1)), shown(power, unit)).otherwise(out)
    return F.when(size.isNotNull(), out)


def truncate_preview(preview, limit=200):
    """Stripped preview, shortened with an ellipsis."""
    text = strip(preview)
    return (
        F.when(F.coalesce(preview, F.lit("")) == "", F.lit("(no preview)"))
        .when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("...")))
        .otherwise(text)
    )


def short_date(raw):
    """``yyyy-MM-dd HH:mm`` as written in the header; other text is cut to 16
    characters, NULL becomes empty."""
    return F.coalesce(
        F.date_format(mail_wall_clock(raw), "yyyy-MM-dd HH:mm"), F.left(raw, F.lit(16)), F.lit("")
    )


def safe_filename(name, limit=255):
    """File name without path and unusual characters, capped with its
    extension kept; NULL if nothing is left."""
    base = F.element_at(F.split(F.regexp_replace(name, r"/+$", ""), "/"), -1)
    clean = F.btrim(F.regexp_replace(base, r"[^\p{L}\p{N}_.\-]", "_"), F.lit(". "))
    stem = F.regexp_extract(clean, r"(?s)^(.*)\.[^.]*$", 1)
    ext = F.regexp_extract(clean, r"(?s)\.([^.]*)$", 1)
    kept = F.concat(F.left(stem, F.greatest(F.lit(limit - 1) - F.length(ext), F.lit(0))),
                    F.lit("."), ext)
    cut = F.when(F.length(ext) > 0, kept).otherwise(F.left(clean, F.lit(limit)))
    return F.nullif(F.when(F.length(clean) > limit, cut).otherwise(clean), F.lit(""))


def default_nulls(df):
    """Result projection: the four columns shown to a reader are never NULL."""
    shown = ("rfc_message_id", "subject", "from_addr", "date_raw")
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in shown if c in df.columns})
