"""Archive files: messages rendered from the documents, written, read, checked
and merged. Every query writes its archives to a new folder of the shared
scratch space, from the whole table."""

import re

from pyspark.sql import functions as F

from checks import KNOWN_SQL, TS, kept, known, labelled, msgs, query, unstored, with_msgs
from mailspark import views
from mailspark.functions import columns as C
from mailspark.operators import joins as J
from mailspark.operators import parse as P
from mailspark.operators import search as S
from mailspark.plans import workflows as WF
from mailspark.session import scratch, written
from mailspark.sources import archives as IO
from mailspark.sources import mbox
from mailspark.sources import tables as T
from mailspark.streaming import imports

def at():
    return F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")


def rendered(messages):
    """Messages with ``raw``: headers, blank line, whole text."""
    text = F.concat(
        F.lit("From: "), "from_addr", F.lit("\nTo: "), "to_addr", F.lit("\nSubject: "), "subject",
        F.lit("\nMessage-ID: "), "rfc_message_id", F.lit("\nDate: "), "date_raw",
        F.lit("\nX-GM-THRID: "), "thread_id", F.lit("\n\n"), "body")
    return messages.withColumn("raw", F.encode(text, "utf-8"))


def posts(spark, sf_dir):
    return rendered(msgs(spark, sf_dir)).drop("labels")


#: What is in the archive: separator-like lines quoted, a closing line break.
RAW_SQL = """posts AS (SELECT *, CASE WHEN right(r, 1) = chr(10) THEN r ELSE r || chr(10) END AS raw,
    'From ' || from_addr || ' ' || strftime(date, '%a %b %d %H:%M:%S %Y') AS from_line
  FROM (SELECT *, regexp_replace('From: ' || from_addr || chr(10) || 'To: ' || to_addr || chr(10)
      || 'Subject: ' || subject || chr(10) || 'Message-ID: ' || rfc_message_id || chr(10)
      || 'Date: ' || date_raw || chr(10) || 'X-GM-THRID: ' || thread_id || chr(10) || chr(10)
      || body, '(^|\\n)From ', '\\1>From ', 'g') AS r FROM msgs)), stored AS (
  SELECT *, sha256(raw) AS stored_checksum,
    CAST(octet_length(encode(raw)) AS BIGINT) AS stored_size,
    CAST(octet_length(encode(from_line)) + octet_length(encode(raw)) + 2 AS BIGINT)
      AS stored_length, substr(raw, strpos(raw, chr(10) || chr(10)) + 2) AS stored_body
  FROM posts)"""


def shard_bytes(messages):
    """A sixteenth of the data, so that small tables too give several archives;
    between 1 MiB and the library's own size."""
    total = messages.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    return min(IO.SHARD_BYTES, max(1 << 20, total // 16))


def write_archive(messages, compression=None):
    """Writes messages to a new folder; gives (folder, locations)."""
    folder = scratch(messages.sparkSession, "mail")
    placed = IO.write_mbox(messages.drop("body"), folder, ("date", "rfc_message_id"),
                           compression, shard_bytes=shard_bytes(messages))
    return re.sub("^file:/*", "/", folder), placed


@kept
def archive(spark, sf_dir, compression=None):
    """The archive of all messages."""
    return write_archive(rendered(unstored(spark, sf_dir)).drop("labels"), compression)


@kept
def by_source(spark, sf_dir):
    """The messages in three folders, by the language group of the source."""
    folders = []
    for langs in (("en",), ("fr", "de"), ("es",)):
        part = posts(spark, sf_dir).filter(F.split("from_addr", "@")[0].isin(*langs))
        folders.append(write_archive(part))
    return folders


@query(with_msgs("""SELECT gmail_id, rfc_message_id, stored_length AS mbox_length,
    stored_size AS raw_size, stored_checksum AS checksum FROM stored""", RAW_SQL))
def write_read_mbox(spark, sf_dir):
    folder, placed = write_archive(posts(spark, sf_dir))
    raw = mbox.read_mbox(spark, folder, split_bytes=1 << 20)
    read = raw.select("archive_file", "mbox_offset", F.col("mbox_length").alias("read_length"),
                      F.octet_length("raw").cast("long").alias("raw_size"),
                      C.checksum(F.col("raw")).alias("checksum"))
    both = placed.select("gmail_id", "rfc_message_id", "archive_file", "mbox_offset",
                         "mbox_length").join(read, ["archive_file", "mbox_offset"])
    return both.filter("mbox_length = read_length").select(
        "gmail_id", "rfc_message_id", "mbox_length", "raw_size", "checksum")


def codec_sql():
    return with_msgs("""SELECT rfc_message_id, count(*) AS copies,
        CAST(sum(stored_length) AS BIGINT) AS bytes, min(stored_checksum) AS checksum
      FROM stored GROUP BY 1""", RAW_SQL)


def read_back(spark, sf_dir, codec):
    folder, _ = archive(spark, sf_dir, codec)
    parsed = P.parse_messages(mbox.read_mbox(spark, folder))
    return parsed.groupBy("rfc_message_id").agg(
        F.count("*").alias("copies"), F.sum("mbox_length").alias("bytes"),
        F.min("checksum").alias("checksum"))


@query(codec_sql())
def read_gzip(spark, sf_dir):
    return read_back(spark, sf_dir, "gzip")


@query(codec_sql())
def read_lzma(spark, sf_dir):
    return read_back(spark, sf_dir, "lzma")


@query(codec_sql())
def read_zstd(spark, sf_dir):
    return read_back(spark, sf_dir, "zstd")


@query(with_msgs(f"""SELECT rfc_message_id, thread_id, subject, from_addr, to_addr,
    strftime(date, {TS}) AS date, date_raw, stored_length AS mbox_length,
    left(stored_body, 1000) AS body_preview, stored_body AS body, stored_checksum AS checksum,
    stored_size AS size_bytes FROM stored""", RAW_SQL))
def parse_messages(spark, sf_dir):
    folder, _ = archive(spark, sf_dir)
    rows = P.parse_messages(mbox.read_mbox(spark, folder), archived_at=at(), whole_body=True)
    return rows.filter("parse_error IS NULL").select(
        "rfc_message_id", "thread_id", "subject", "from_addr", "to_addr", "date", "date_raw",
        "mbox_length", "body_preview", "body", "checksum", "size_bytes")


@query(with_msgs("SELECT rfc_message_id, stored_length AS mbox_length FROM stored", RAW_SQL))
def scan_message_ids(spark, sf_dir):
    folder, _ = archive(spark, sf_dir)
    return P.scan_message_ids(mbox.read_mbox(spark, folder)).select(
        "rfc_message_id", "mbox_length")


@query(with_msgs("""SELECT gmail_id, true AS inside, CAST(NULL AS VARCHAR) AS compression, 0 AS missing,
    (SELECT CAST(sum(stored_length) AS BIGINT) FROM stored) AS bytes FROM stored""", RAW_SQL))
def discover_files(spark, sf_dir):
    """Each message, whether the file listed under its archive's name holds its
    place, and the size of all files."""
    folder, placed = archive(spark, sf_dir)
    listing = T.discover(spark, folder, "*.mbox")
    wanted = placed.select(F.col("archive_file").alias("path")).distinct()
    missing = T.missing_sources(wanted, listing).agg(F.count("*")).scalar()
    total = listing.agg(F.sum("size_bytes")).scalar()
    end = F.col("mbox_offset") + F.col("mbox_length")
    places = placed.select("gmail_id", "archive_file", "mbox_offset", "mbox_length")
    return places.join(listing, F.col("archive_file") == F.col("path"), "left").select(
        "gmail_id", (end <= F.col("size_bytes")).alias("inside"), "compression",
        missing.alias("missing"), total.alias("bytes"))


@kept
def landed(spark, sf_dir):
    """Remote messages landed as JSON files."""
    folder = scratch(spark, "landed")
    encoded = F.translate(F.base64("raw"), "+/\r\n", "-_")
    posts(spark, sf_dir).select(
        F.col("gmail_id").alias("id"), F.col("thread_id").alias("threadId"),
        F.array(F.lit("INBOX"), F.split("from_addr", "@")[0]).alias("labelIds"),
        encoded.alias("raw")).write.json(folder)
    return folder


@query(with_msgs("""SELECT gmail_id, thread_id, 'INBOX,' || lang AS labels, rfc_message_id, subject,
    sha256('From: ' || from_addr || chr(10) || 'To: ' || to_addr || chr(10) || 'Subject: '
      || subject || chr(10) || 'Message-ID: ' || rfc_message_id || chr(10) || 'Date: ' || date_raw
      || chr(10) || 'X-GM-THRID: ' || thread_id || chr(10) || chr(10) || body) AS checksum
  FROM msgs"""))
def read_api_messages(spark, sf_dir):
    rows = P.parse_messages(T.read_api_messages(spark, landed(spark, sf_dir)))
    return rows.select("gmail_id", "thread_id", "labels", "rfc_message_id", "subject", "checksum")


@query(with_msgs(f"""SELECT gmail_id, rfc_message_id, archive_file, mbox_offset,
    strftime(date, {TS}) AS date FROM msgs
  WHERE date >= TIMESTAMP '2024-01-10' AND date < TIMESTAMP '2024-02-10'"""))
def write_read_catalogue(spark, sf_dir):
    path = scratch(spark, "catalogue")
    T.write_catalogue(msgs(spark, sf_dir), path)
    rows = S.filter_messages(T.read_catalogue(spark, path), date_start="2024-01-10")
    return rows.filter(F.col("date") < F.lit("2024-02-10").cast("timestamp_ntz")).select(
        "gmail_id", "rfc_message_id", "archive_file", "mbox_offset", "date")


@query(with_msgs("""SELECT gmail_id, 'extracted' AS status, sha256(from_line || chr(10) || raw
    || chr(10)) AS checksum FROM stored WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL SELECT 'none' || region.r_regionkey, 'failed', NULL FROM region""", RAW_SQL))
def extract_messages(spark, sf_dir):
    _, placed = archive(spark, sf_dir)
    wanted = labelled(spark, sf_dir).select(F.concat(F.lit("m"), "doc_id").alias("gmail_id"))
    unknown = views.load(spark, sf_dir, "region").select(
        F.concat(F.lit("none"), "r_regionkey").alias("gmail_id"))
    out = IO.extract_ids(placed, wanted.unionByName(unknown))
    return out.select("gmail_id", "status", C.checksum(F.col("raw")).alias("checksum"))


@query(with_msgs("""SELECT gmail_id, CASE WHEN bad THEN 'failed' ELSE 'extracted' END AS status,
    CASE WHEN NOT bad THEN sha256(from_line || chr(10) || raw || chr(10)) END AS checksum
  FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM stored)""",
                 RAW_SQL))
def extract_compressed(spark, sf_dir):
    """Toxic messages have a length beyond the end of their file."""
    _, placed = archive(spark, sf_dir, "zstd")
    bad = F.col("_bad") & F.lit(True)
    longer = placed.join(toxic(spark, sf_dir), "gmail_id", "left").withColumn(
        "mbox_length", F.when(bad, F.lit(1 << 40)).otherwise(F.col("mbox_length"))).drop("_bad")
    return IO.extract_messages(longer).select(
        "gmail_id", "status", C.checksum(F.col("raw")).alias("checksum"))


def toxic(spark, sf_dir):
    """Ids of the messages labelled toxic."""
    return views.load(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.concat(F.lit("m"), "doc_id").alias("gmail_id"), F.lit(True).alias("_bad")).distinct()


def misplaced(spark, sf_dir):
    """Stored messages with wrong offsets where labelled toxic."""
    _, placed = archive(spark, sf_dir)
    return placed.join(toxic(spark, sf_dir), "gmail_id", "left").withColumn(
        "mbox_offset", F.when(F.col("_bad"), F.col("mbox_offset") + 3)
        .otherwise(F.col("mbox_offset"))).drop("_bad")


@query(with_msgs("""SELECT gmail_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
    THEN 'bad' ELSE 'ok' END AS status FROM msgs"""))
def verify_offsets(spark, sf_dir):
    checked = IO.verify_offsets(misplaced(spark, sf_dir))
    return checked.select(
        "gmail_id", F.when(F.col("status") == "ok", "ok").otherwise("bad").alias("status"))


@query(with_msgs("""SELECT CASE lang WHEN 'en' THEN 0 WHEN 'es' THEN 2 ELSE 1 END AS source,
    count(*) AS messages, NOT bool_or(bad) AS checksums,
    NOT bool_or(bad) AND NOT bool_or(gone) AS passed
  FROM (SELECT *, lang = 'es' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad,
    lang = 'fr' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS gone FROM msgs)
  GROUP BY 1"""))
def validate_archives(spark, sf_dir):
    """Three sources: one untouched, of one the catalogue lacks toxic French
    messages, and in one toxic messages have another checksum."""
    parts = []
    for number, (folder, placed) in enumerate(by_source(spark, sf_dir)):
        archived = written(P.parse_messages(mbox.read_mbox(spark, folder)), "parsed")
        marked = placed.join(toxic(spark, sf_dir), "gmail_id", "left")
        lang = F.split("from_addr", "@")[0]
        bad, gone = F.col("_bad") & (lang == "es"), F.col("_bad") & (lang == "fr")
        catalogue = marked.filter(~F.coalesce(gone, F.lit(False))).withColumn(
            "checksum", F.when(bad, F.lit("0")).otherwise(F.col("checksum"))).drop("_bad")
        report = WF.validate_archives(archived, catalogue)
        parts.append(report.agg(
            F.lit(number).alias("source"), F.sum("actual").alias("messages"),
            F.bool_and("spot_check").alias("checksums"), F.bool_and("passed").alias("passed")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("messages > 0")


@query(with_msgs("""SELECT count(*) AS messages, count(*) FILTER (WHERE bad) AS spoiled,
    count(*) FILTER (WHERE bad) AS mismatches, true AS passed
  FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad,
    row_number() OVER (PARTITION BY rfc_message_id ORDER BY gmail_id) AS rn FROM msgs
    WHERE date < TIMESTAMP '2025-01-01' - INTERVAL 11 MONTH) WHERE rn = 1"""))
def archive_then_validate(spark, sf_dir):
    """Bodies with lines that look like separators and without a final line
    break are archived; the catalogue that comes out is checked as it is, and
    once with other checksums for toxic messages."""
    folder = scratch(spark, "landed")
    awkward = F.concat("raw", F.encode(F.lit("\nFrom here\n\nFrom  there "), "utf-8"))
    posts(spark, sf_dir).select(
        F.col("gmail_id").alias("id"), F.col("thread_id").alias("threadId"),
        F.array(F.lit("INBOX")).alias("labelIds"),
        F.translate(F.base64(awkward), "+/\r\n", "-_").alias("raw")).write.json(folder)
    target = scratch(spark, "mail")
    nothing = msgs(spark, sf_dir).limit(0)
    outcome = WF.archive_incremental(T.read_api_messages(spark, folder), nothing, "11m", target,
                                     as_of=at(), archived_at=at())
    archived = written(P.parse_messages(mbox.read_mbox(spark, target)), "parsed")
    catalogue = written(outcome.messages, "catalogue")
    passed = WF.validate_archives(archived, catalogue).agg(F.bool_and("passed")).scalar()
    marked = catalogue.join(toxic(spark, sf_dir), "gmail_id", "left")
    spoiled = marked.withColumn(
        "checksum", F.when(F.col("_bad"), F.lit("0")).otherwise(F.col("checksum")))
    found = IO.compare_checksums(archived, spoiled).agg(F.count_if(F.col("status") != "ok")).scalar()
    return marked.agg(F.count("*").alias("messages"), F.count("_bad").alias("spoiled")).select(
        "messages", "spoiled", found.alias("mismatches"), passed.alias("passed"))


IMPORT_SQL = """flags AS (SELECT *, rfc_message_id IN (SELECT rfc_message_id FROM known) AS k
  FROM stored), ids AS (SELECT rfc_message_id, any_value(k) AS k, count(*) AS copies,
    any_value(subject) AS subject FROM flags GROUP BY 1)"""


@query(with_msgs("""SELECT rfc_message_id, subject, copies - CASE WHEN k THEN 0 ELSE 1 END
    AS skipped, CASE WHEN k THEN 0 ELSE 1 END AS imported FROM ids""",
                 KNOWN_SQL, RAW_SQL, IMPORT_SQL))
def import_archives(spark, sf_dir):
    folder, _ = archive(spark, sf_dir)
    outcome = WF.import_archives(spark, folder, known(spark, sf_dir), archived_at=at())
    return outcome.reports["status"].groupBy("rfc_message_id").agg(
        F.max("subject").alias("subject"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.count_if(F.col("status") == "IMPORTED").alias("imported"))


@query(with_msgs("""SELECT gmail_id, rfc_message_id, stored_length AS mbox_length
  FROM (SELECT *, row_number() OVER (PARTITION BY rfc_message_id
      ORDER BY gmail_id) AS rn FROM stored
    WHERE date < TIMESTAMP '2025-01-01' - INTERVAL 11 MONTH
      AND gmail_id NOT IN (SELECT gmail_id FROM known))
  WHERE rn = 1 AND rfc_message_id NOT IN (SELECT rfc_message_id FROM known)""",
                 KNOWN_SQL, RAW_SQL))
def archive_incremental(spark, sf_dir):
    remote = T.read_api_messages(spark, landed(spark, sf_dir))
    outcome = WF.archive_incremental(
        remote, known(spark, sf_dir), "11m", scratch(spark, "mail"), as_of=at(),
        archived_at=at())
    deletable = outcome.reports["deletable"]
    return outcome.messages.join(deletable, "gmail_id", "left_semi").select(
        "gmail_id", "rfc_message_id", "mbox_length")


def stored_catalogue(spark, sf_dir):
    """Three archive folders and the catalogue of what is in them."""
    parts = by_source(spark, sf_dir)
    catalogue = parts[0][1]
    for _, placed in parts[1:]:
        catalogue = catalogue.unionByName(placed)
    return [folder for folder, _ in parts], catalogue


CONSOLIDATED = """picked AS (SELECT *, row_number() OVER (PARTITION BY rfc_message_id
  ORDER BY date DESC, CASE lang WHEN 'en' THEN 0 WHEN 'es' THEN 2 ELSE 1 END) AS rn FROM stored)"""


@query(with_msgs("""SELECT gmail_id, rfc_message_id, stored_length AS mbox_length,
    row_number() OVER (ORDER BY date) - 1 AS position FROM picked WHERE rn = 1""",
                 RAW_SQL, CONSOLIDATED))
def consolidate(spark, sf_dir):
    folders, catalogue = stored_catalogue(spark, sf_dir)
    outcome = WF.consolidate(spark, folders, catalogue, scratch(spark, "merged"))
    from mailspark.operators import ranges

    placed = outcome.messages.select(
        "gmail_id", "rfc_message_id", "archive_file", "mbox_offset", "mbox_length")
    order = [F.asc("archive_file"), F.asc("mbox_offset")]
    return ranges.positions(placed, [], order).select(
        "gmail_id", "rfc_message_id", "mbox_length", "position")


@query(with_msgs("""SELECT count(*) AS total_messages,
    count(*) FILTER (WHERE rn > 1) AS duplicates_removed,
    count(*) FILTER (WHERE rn = 1) AS messages_consolidated, true AS many_sources FROM picked""",
                 RAW_SQL, CONSOLIDATED))
def consolidate_summary(spark, sf_dir):
    folders, catalogue = stored_catalogue(spark, sf_dir)
    outcome = WF.consolidate(spark, folders, catalogue, scratch(spark, "merged"))
    return outcome.reports["summary"].withColumn(
        "many_sources", F.col("sources") > 1).drop("sources")


@query(with_msgs("""SELECT gmail_id, sha256(from_line || chr(10) || raw || chr(10)) AS checksum,
    true AS smaller FROM stored""", RAW_SQL))
def compress_archives(spark, sf_dir):
    folder, placed = write_archive(posts(spark, sf_dir))
    files = [p for p, _ in mbox.list_files(folder)]
    results = IO.compress_archives(spark, files, "zstd", frame_bytes=1 << 20)
    smaller = results.agg(F.bool_and(F.col("compressed_size") < F.col("original_size"))).scalar()
    out = IO.extract_messages(IO.repoint(placed, results))
    return out.select("gmail_id", C.checksum(F.col("raw")).alias("checksum"),
                      smaller.alias("smaller"))


@query(with_msgs("""SELECT CAST(sum(stored_length) AS BIGINT) AS original_size, 0 AS files_skipped,
    0 AS off FROM stored""", RAW_SQL))
def compress_dry_run(spark, sf_dir):
    """The dry run's size, and by how much the real one differs."""
    folder, placed = write_archive(posts(spark, sf_dir))
    files = [p for p, _ in mbox.list_files(folder)]
    dry = written(WF.compress(spark, files, placed, "gzip", dry_run=True).reports["summary"], "dry")
    real = WF.compress(spark, files, placed, "gzip", in_place=True).reports["summary"]
    size = real.agg(F.max("compressed_size")).scalar()
    return dry.select("original_size", "files_skipped", (F.col("compressed_size") - size).alias("off"))


@query(with_msgs("""SELECT gmail_id, rfc_message_id, stored_length AS mbox_length,
    doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS backfilled FROM stored
  WHERE rfc_message_id IN (SELECT rfc_message_id FROM stored GROUP BY 1 HAVING count(*) = 1)""",
                 RAW_SQL))
def backfill_from_archives(spark, sf_dir):
    folder, placed = archive(spark, sf_dir)
    toxic = views.load(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.concat(F.lit("m"), "doc_id").alias("gmail_id"), F.lit(True).alias("_bad")).distinct()
    spoiled = placed.join(toxic, "gmail_id", "left").withColumns({
        c: F.when(F.col("_bad"), F.lit(-1)).otherwise(F.col(c))
        for c in ("mbox_offset", "mbox_length")}).drop("_bad")
    archived = P.scan_message_ids(mbox.read_mbox(spark, folder))
    repaired = J.backfill_offsets(spoiled, archived)
    # Copies of a message share its id, so only single ones have one answer.
    single = placed.groupBy("rfc_message_id").count().filter("count = 1")
    right = placed.select("gmail_id", F.col("mbox_offset").alias("_o"))
    return (repaired.join(single, "rfc_message_id", "left_semi").join(right, "gmail_id")
            .filter("mbox_offset = _o")
            .select("gmail_id", "rfc_message_id", "mbox_length", "backfilled"))


@query(with_msgs("""SELECT n.rfc_message_id, o.gmail_id FROM
  (SELECT 'old' || doc_id AS gmail_id, row_number() OVER (ORDER BY date) AS p FROM msgs) o
  JOIN (SELECT rfc_message_id, row_number() OVER (ORDER BY date) AS p FROM msgs) n USING (p)"""))
def upgrade_catalogue(spark, sf_dir):
    folder, placed = archive(spark, sf_dir)
    legacy = placed.select(
        F.concat(F.lit("old"), F.substring("gmail_id", 2, 99)).alias("gmail_id"),
        F.date_format("date", "yyyy-MM-dd HH:mm:ss").alias("archived_timestamp"), "archive_file",
        "subject", "from_addr", F.col("date_raw").alias("message_date"), "checksum")
    outcome = WF.upgrade_catalogue(spark, legacy, paths=[folder])
    return outcome.messages.select("rfc_message_id", "gmail_id")


@query(with_msgs("""SELECT rfc_message_id, stored_length AS mbox_length,
    CASE lang WHEN 'en' THEN 0 WHEN 'es' THEN 2 ELSE 1 END AS source_number FROM stored""",
                 RAW_SQL))
def merge_archives(spark, sf_dir):
    folders = [folder for folder, _ in by_source(spark, sf_dir)]
    merged = WF.merge_archives(spark, folders)
    return P.scan_message_ids(merged.drop("source_number")).join(
        merged.select("archive_file", "mbox_offset", "source_number"),
        ["archive_file", "mbox_offset"]).select("rfc_message_id", "mbox_length", "source_number")


#: What a landed message says of itself; of several with one id any may come first.
OWN = ("gmail_id", "thread_id", "from_addr", "to_addr", "date", "date_raw", "labels", "checksum", "size_bytes")


@query(with_msgs(f"""SELECT DISTINCT rfc_message_id, subject, left(body, 1000) AS body_preview,
    '2025-01-01 00:00:00' AS archived_timestamp, 'default' AS account_id,
    {', '.join(f"CASE WHEN n = 1 THEN {c} END AS {c}" for c in OWN)}
  FROM (SELECT rfc_message_id, subject, body, gmail_id, thread_id, from_addr, to_addr, date_raw,
      strftime(date, {TS}) AS date, 'INBOX,' || lang AS labels, sha256(r) AS checksum,
      CAST(octet_length(encode(r)) AS BIGINT) AS size_bytes,
      count(*) OVER (PARTITION BY rfc_message_id) AS n
    FROM (SELECT *, 'From: ' || from_addr || chr(10) || 'To: ' || to_addr || chr(10) || 'Subject: '
        || subject || chr(10) || 'Message-ID: ' || rfc_message_id || chr(10) || 'Date: ' || date_raw
        || chr(10) || 'X-GM-THRID: ' || thread_id || chr(10) || chr(10) || body AS r FROM msgs))"""))
def import_stream(spark, sf_dir):
    source = landed(spark, sf_dir)
    target, state = scratch(spark, "stream"), scratch(spark, "state")
    stream = imports.landed_json(spark, source)
    imports.import_stream(stream, target, state, archived_at=at()).awaitTermination()
    single = msgs(spark, sf_dir).groupBy("rfc_message_id").agg((F.count("*") == 1).alias("_single"))
    own = [F.when(F.col("_single"), F.col(c)).alias(c) for c in OWN]
    return imports.read_imported(spark, target).join(single, "rfc_message_id", "left").select(
        "rfc_message_id", "subject", "body_preview", "archived_timestamp", "account_id", *own)


@query(with_msgs("""SELECT DISTINCT 'imported' AS kind, rfc_message_id AS id FROM msgs
    WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
  UNION ALL SELECT 'failed', gmail_id FROM msgs WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""))
def import_stream_failures(spark, sf_dir):
    """Messages labelled toxic have landed unreadable; every row is accounted
    for, and a second start of the job finds nothing new."""
    source, target, state = (scratch(spark, n) for n in ("landed", "stream", "state"))
    whole = spark.read.json(landed(spark, sf_dir))
    bad = toxic(spark, sf_dir).withColumnRenamed("gmail_id", "id")
    whole.join(bad, "id", "left").withColumn("raw", F.when(F.col("_bad"), F.lit("%%%")).otherwise(
        F.col("raw"))).drop("_bad").write.json(source)
    for _ in range(2):
        imports.import_stream(imports.landed_json(spark, source), target, state, archived_at=at()).awaitTermination()
    return imports.read_imported(spark, target).select(
        F.lit("imported").alias("kind"), F.col("rfc_message_id").alias("id")).unionByName(
        imports.read_failures(spark, target).select(F.lit("failed").alias("kind"), F.col("gmail_id").alias("id")))


@query(with_msgs("""SELECT gmail_id, 'extracted' AS status, stored_length AS bytes,
    sha256(from_line || chr(10) || raw || chr(10)) AS checksum, count(*) OVER () AS extracted, 0 AS failed
  FROM stored WHERE doc_id IN (SELECT doc_id FROM labels)""", RAW_SQL))
def write_eml(spark, sf_dir):
    """Each message asked for next to the file of its name."""
    _, placed = archive(spark, sf_dir)
    folder = scratch(spark, "eml")
    wanted = labelled(spark, sf_dir).select(F.concat(F.lit("m"), "doc_id").alias("gmail_id"))
    outcome = IO.write_eml(IO.extract_ids(placed, wanted), folder)
    files = spark.read.format("binaryFile").load(folder).select(
        F.regexp_extract("path", r"([^/]+)\.eml$", 1).alias("gmail_id"),
        F.col("length").alias("bytes"), F.sha2("content", 256).alias("checksum"))
    found = IO.extraction_summary(outcome).select(F.struct("extracted", "failed")).scalar()
    return outcome.join(files, "gmail_id", "full_outer").select(
        "gmail_id", "status", "bytes", "checksum",
        found["extracted"].alias("extracted"), found["failed"].alias("failed"))


@query(with_msgs("""SELECT '2025-01-01 00:00:00' AS run_timestamp, 'import' AS query, 'default' AS account_id,
    'import' AS operation_type, CAST(count(*) AS BIGINT) AS messages_archived, true AS as_counted
  FROM ids WHERE NOT k""", KNOWN_SQL, RAW_SQL, IMPORT_SQL))
def record_run(spark, sf_dir):
    """The records of an import, and whether each has the number of messages
    that came from its archive."""
    folder, _ = archive(spark, sf_dir)
    runs = scratch(spark, "runs")
    outcome = WF.import_archives(spark, folder, known(spark, sf_dir), archived_at=at(),
                                 runs_path=runs)
    counted = outcome.reports["status"].filter("status = 'IMPORTED'").groupBy("archive_file").agg(
        F.count("*").alias("_n"))
    return spark.read.parquet(runs).join(counted, "archive_file", "full_outer").groupBy(
        "run_timestamp", "query", "account_id", "operation_type").agg(
        F.sum("messages_archived").alias("messages_archived"),
        F.bool_and(F.col("messages_archived").eqNullSafe(F.col("_n"))).alias("as_counted"))
