"""Dedup, matching, table changes and reports over the message catalogue."""

from pyspark.sql import functions as F

from checks import KNOWN_SQL, TS, known, labelled, msgs, query, with_msgs
from checks.searching import TOKS_SQL, UNNEST, WHOLE, spoiled
from mailspark import views
from mailspark.operators import dedup as D
from mailspark.operators import index as I
from mailspark.operators import joins as J
from mailspark.operators import quality as QA
from mailspark.operators import reconcile as RC
from mailspark.operators import ranges as R
from mailspark.operators import reports as A
from mailspark.operators import tables as M

# ----------------------------------------------------------------------- dedup

SIZE = "coalesce(size_bytes, mbox_length)"
SCAN = "archived_timestamp DESC, archive_file, mbox_offset"
ORDERS = {"newest": SCAN, "largest": f"{SIZE} DESC, {SCAN}", "first": f"archive_file, {SCAN}"}
ROW = "gmail_id, rfc_message_id, archive_file, mbox_offset"
COLUMNS = ["gmail_id", "rfc_message_id", "archive_file", "mbox_offset"]


def ranked(strategy, source="msgs"):
    return (f"r AS (SELECT *, row_number() OVER (PARTITION BY rfc_message_id ORDER BY "
            f"{ORDERS[strategy]}) AS rn, count(*) OVER (PARTITION BY rfc_message_id) AS copies "
            f"FROM {source})")


def dedup_sql(strategy):
    return with_msgs(f"SELECT {ROW} FROM r WHERE rn = 1", ranked(strategy))


@query(dedup_sql("newest"))
def dedup_newest(spark, sf_dir):
    return D.kept(msgs(spark, sf_dir), "newest").select(*COLUMNS)


@query(dedup_sql("largest"))
def dedup_largest(spark, sf_dir):
    return D.kept(msgs(spark, sf_dir), "largest").select(*COLUMNS)


@query(dedup_sql("first"))
def dedup_first(spark, sf_dir):
    return D.kept(msgs(spark, sf_dir), "first").select(*COLUMNS)


@query(with_msgs(f"""SELECT rfc_message_id, gmail_id, archive_file, mbox_offset, mbox_length,
    {SIZE} AS size_bytes, strftime(archived_timestamp, {TS}) AS archived_timestamp, copies
  FROM r WHERE copies > 1""", ranked("newest")))
def find_duplicates(spark, sf_dir):
    return D.find_duplicates(msgs(spark, sf_dir))


@query(with_msgs("""SELECT DISTINCT rfc_message_id, gmail_id, copies FROM (SELECT *,
    count(*) OVER (PARTITION BY rfc_message_id) AS copies FROM msgs) WHERE copies > 1"""))
def duplicate_id_lists(spark, sf_dir):
    return D.duplicate_id_lists(msgs(spark, sf_dir))


REPORT = f"""SELECT (SELECT count(*) FROM msgs) AS total_messages,
    count(DISTINCT CASE WHEN copies > 1 THEN rfc_message_id END) AS duplicate_message_ids,
    count(*) FILTER (WHERE copies > 1) AS total_duplicate_messages,
    count(*) FILTER (WHERE rn > 1) AS messages_to_remove,
    CAST(coalesce(sum({SIZE}) FILTER (WHERE rn > 1), 0) AS BIGINT) AS space_recoverable FROM r"""


@query(with_msgs(REPORT, ranked("largest")))
def duplicate_report(spark, sf_dir):
    return D.duplicate_report(msgs(spark, sf_dir))


@query(with_msgs(f"""SELECT archive_file, count(*) AS messages_to_remove,
    CAST(sum({SIZE}) AS BIGINT) AS space_recoverable FROM r WHERE rn > 1 GROUP BY 1""",
                 ranked("largest")))
def duplicate_report_by_archive(spark, sf_dir):
    return D.duplicate_report_by_archive(msgs(spark, sf_dir))


@query(with_msgs(f"""SELECT count(*) FILTER (WHERE rn > 1) AS messages_removed,
    count(DISTINCT CASE WHEN copies > 1 THEN rfc_message_id END) AS messages_kept,
    CAST(coalesce(sum({SIZE}) FILTER (WHERE rn > 1), 0) AS BIGINT) AS space_saved,
    true AS dry_run FROM r""", ranked("newest")))
def dedup_summary(spark, sf_dir):
    return D.dedup_summary(msgs(spark, sf_dir), "newest")


@query(with_msgs("""SELECT rfc_message_id, gmail_id, archive_file, mbox_offset,
    CASE WHEN rn = 1 THEN 'keep' ELSE 'remove' END AS action FROM r""", ranked("first")))
def dry_run(spark, sf_dir):
    return M.dry_run(msgs(spark, sf_dir), "first")


@query(with_msgs(f"SELECT {ROW} FROM r WHERE rn = 1", ranked("largest")))
def remove_copies(spark, sf_dir):
    return M.remove_copies(msgs(spark, sf_dir), "largest").select(*COLUMNS)


def merged(spark, sf_dir):
    m = msgs(spark, sf_dir)
    number = F.regexp_extract("archive_file", r"(\d+)", 1).cast("int")
    return m.withColumns({"source_number": number, "source_archive": F.col("archive_file")})


MERGED = ("merged AS (SELECT *, CAST(regexp_extract(archive_file, '(\\d+)', 1) AS INTEGER) "
          "AS source_number FROM msgs)")


def merge_sql(order):
    return with_msgs(
        f"SELECT {ROW} FROM (SELECT *, row_number() OVER (PARTITION BY rfc_message_id ORDER BY "
        f"{order} source_number, mbox_offset) AS rn FROM merged) WHERE rn = 1", MERGED)


@query(merge_sql("date DESC,"))
def dedup_merged_newest(spark, sf_dir):
    return D.dedup_merged(merged(spark, sf_dir), "newest").select(*COLUMNS)


@query(merge_sql("size_bytes DESC,"))
def dedup_merged_largest(spark, sf_dir):
    return D.dedup_merged(merged(spark, sf_dir), "largest").select(*COLUMNS)


@query(merge_sql(""))
def dedup_merged_first(spark, sf_dir):
    return D.dedup_merged(merged(spark, sf_dir), "first").select(*COLUMNS)


@query(with_msgs("""SELECT gmail_id, archive_file, mbox_offset, row_number() OVER (
    PARTITION BY rfc_message_id ORDER BY archive_file, mbox_offset) = 1 AS first FROM msgs"""))
def drop_seen(spark, sf_dir):
    return D.flag_seen(msgs(spark, sf_dir)).select(
        "gmail_id", "archive_file", "mbox_offset", "first")


# ------------------------------------------------------------- ordered ranges

SIZES = """sizes AS (SELECT archive_file, max(mbox_offset + mbox_length) AS file_size FROM msgs
  GROUP BY 1)"""


@query(with_msgs("""SELECT archive_file, mbox_offset, CAST(coalesce(lead(mbox_offset) OVER (
    PARTITION BY archive_file ORDER BY mbox_offset), file_size) - mbox_offset AS BIGINT)
    AS mbox_length FROM msgs JOIN sizes USING (archive_file)""", SIZES))
def lengths_from_offsets(spark, sf_dir):
    m = msgs(spark, sf_dir)
    end = F.max(F.col("mbox_offset") + F.col("mbox_length")).alias("file_size")
    sizes = m.groupBy("archive_file").agg(end)
    return R.lengths_from_offsets(m.select("archive_file", "mbox_offset"), sizes).select(
        "archive_file", "mbox_offset", "mbox_length")


@query(with_msgs("""SELECT gmail_id, t AS to_addr, CAST(coalesce(sum(mbox_length) OVER (
    PARTITION BY t ORDER BY date, rfc_message_id, mbox_offset
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS new_offset
  FROM (SELECT *, nullif(to_addr, 'list-3@example.com') AS t FROM msgs)"""))
def repack_offsets(spark, sf_dir):
    m = msgs(spark, sf_dir).select(
        "gmail_id", F.nullif("to_addr", F.lit("list-3@example.com")).alias("to_addr"), "date",
        "rfc_message_id", "mbox_offset", "mbox_length")
    order = [F.asc("date"), F.asc("rfc_message_id"), F.asc("mbox_offset")]
    return R.repack_offsets(m, ["to_addr"], order).select("gmail_id", "to_addr", "new_offset")


@query(with_msgs("""SELECT gmail_id, (row_number() OVER (ORDER BY archived_timestamp, gmail_id)
    - 1) // 50 AS batch FROM msgs"""))
def assign_batches(spark, sf_dir):
    m = msgs(spark, sf_dir).select("gmail_id", "archived_timestamp")
    return R.assign_batches(m, [F.asc("archived_timestamp"), F.asc("gmail_id")], 50).select(
        "gmail_id", "batch")


@query(with_msgs(f"""SELECT gmail_id, strftime(date, {TS}) AS date, row_number() OVER (
    ORDER BY date, source_number, mbox_offset) - 1 AS position FROM merged""", MERGED))
def sort_by_date(spark, sf_dir):
    m = merged(spark, sf_dir).select("gmail_id", "date", "source_number", "mbox_offset")
    order = [F.asc("date"), F.asc("source_number"), F.asc("mbox_offset")]
    return R.positions(m, [], order).select("gmail_id", "date", "position")


# -------------------------------------------------------------------- matching


@query(with_msgs("""SELECT gmail_id FROM msgs WHERE gmail_id NOT IN
    (SELECT gmail_id FROM known)""", KNOWN_SQL))
def not_yet_archived(spark, sf_dir):
    return J.not_yet_archived(msgs(spark, sf_dir).select("gmail_id"), known(spark, sf_dir))


@query(with_msgs("""SELECT count(*) FILTER (WHERE gmail_id NOT IN (SELECT gmail_id FROM known))
    AS to_archive, count(*) FILTER (WHERE gmail_id IN (SELECT gmail_id FROM known))
    AS already_archived FROM msgs""", KNOWN_SQL))
def archived_counts(spark, sf_dir):
    return J.archived_counts(msgs(spark, sf_dir).select("gmail_id"), known(spark, sf_dir))


@query(with_msgs(f"""SELECT {ROW}, rfc_message_id NOT IN (SELECT rfc_message_id FROM known)
    AS is_new FROM msgs""", KNOWN_SQL))
def split_new_known(spark, sf_dir):
    return J.split_new_known(msgs(spark, sf_dir), known(spark, sf_dir)).select(*COLUMNS, "is_new")


@query(with_msgs("""SELECT archive_file, count(*) AS total_messages,
    count(*) FILTER (WHERE n) AS new_messages, count(*) FILTER (WHERE NOT n) AS duplicate_messages
  FROM (SELECT archive_file, rfc_message_id NOT IN (SELECT rfc_message_id FROM known) AS n
        FROM msgs) GROUP BY 1""", KNOWN_SQL))
def scan_summary(spark, sf_dir):
    return J.scan_summary(J.split_new_known(msgs(spark, sf_dir), known(spark, sf_dir)))


def remote_ids(spark, sf_dir):
    return known(spark, sf_dir).select(
        F.btrim("rfc_message_id", F.lit("<>")).alias("message_key"), "gmail_id")


MAPPING = """mapping AS (SELECT trim(rfc_message_id, '<>') AS message_key, min(gmail_id) AS g
  FROM known GROUP BY 1)"""


@query(with_msgs("""SELECT rfc_message_id, archive_file, mbox_offset, g AS gmail_id FROM msgs
    LEFT JOIN mapping ON message_key = trim(rfc_message_id, '<>')""", KNOWN_SQL, MAPPING))
def attach_remote_ids(spark, sf_dir):
    return J.attach_remote_ids(msgs(spark, sf_dir), remote_ids(spark, sf_dir)).select(
        "rfc_message_id", "archive_file", "mbox_offset", "gmail_id")


@query(with_msgs("""SELECT count(g) AS gmail_ids_found, count(*) - count(g) AS gmail_ids_not_found
  FROM (SELECT DISTINCT rfc_message_id FROM msgs)
  LEFT JOIN mapping ON message_key = trim(rfc_message_id, '<>')""", KNOWN_SQL, MAPPING))
def remote_id_counts(spark, sf_dir):
    return J.remote_id_counts(
        J.attach_remote_ids(msgs(spark, sf_dir), remote_ids(spark, sf_dir)))


@query(with_msgs("""SELECT m.rfc_message_id, m.archive_file, m.mbox_offset,
    coalesce(k.g, 'unknown') AS gmail_id FROM msgs m LEFT JOIN (
      SELECT archive_file, rfc_message_id, min(gmail_id) AS g FROM known GROUP BY 1, 2) k
    ON m.archive_file = k.archive_file AND m.rfc_message_id = k.rfc_message_id""", KNOWN_SQL))
def attach_catalogue(spark, sf_dir):
    return J.attach_catalogue(msgs(spark, sf_dir), known(spark, sf_dir)).select(
        "rfc_message_id", "archive_file", "mbox_offset", "gmail_id")


@query(with_msgs("""SELECT gmail_id, archive_file, mbox_offset, mbox_length FROM msgs
    WHERE gmail_id IN (SELECT 'm' || user_id FROM events)"""))
def lookup_messages(spark, sf_dir):
    wanted = views.load(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), "user_id").alias("gmail_id"))
    return J.locate(msgs(spark, sf_dir), wanted)


@query(with_msgs("""SELECT DISTINCT 'm' || user_id AS gmail_id,
    'm' || user_id IN (SELECT gmail_id FROM known) AS archived FROM events""", KNOWN_SQL))
def is_archived(spark, sf_dir):
    wanted = views.load(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), "user_id").alias("gmail_id")).distinct()
    return J.is_archived(wanted, known(spark, sf_dir))


def sides(spark, sf_dir):
    """Archive and catalogue that differ: the archive lacks the messages
    labelled toxic, the catalogue those labelled of no quality."""
    label = views.load(spark, sf_dir, "labels")
    m = msgs(spark, sf_dir)
    archived = m.join(label.filter("toxic = 1"), "doc_id", "left_anti")
    catalogue = m.join(label.filter("quality = 0"), "doc_id", "left_anti")
    return archived, catalogue


SIDES = ("archived AS (SELECT * FROM msgs WHERE doc_id NOT IN "
         "(SELECT doc_id FROM labels WHERE toxic = 1)), "
         "cat AS (SELECT * FROM msgs WHERE doc_id NOT IN "
         "(SELECT doc_id FROM labels WHERE quality = 0))")
COMPARED = """compared AS (SELECT archive_file, rfc_message_id,
    CASE WHEN a IS NULL THEN 'orphaned' WHEN c IS NULL THEN 'missing' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT archive_file, rfc_message_id, 1 AS a FROM archived)
  FULL JOIN (SELECT DISTINCT archive_file, rfc_message_id, 1 AS c FROM cat)
  USING (archive_file, rfc_message_id))"""


@query(with_msgs("SELECT * FROM compared", SIDES, COMPARED))
def compare_archive_catalogue(spark, sf_dir):
    return RC.compare_ids(*sides(spark, sf_dir))


@query(with_msgs("SELECT * FROM compared WHERE status <> 'ok'", SIDES, COMPARED))
def differing_archive_catalogue(spark, sf_dir):
    """The differences alone, found by digests."""
    return RC.differing_ids(*sides(spark, sf_dir))


@query(with_msgs("""SELECT rfc_message_id, 'lost' AS status FROM (
    SELECT rfc_message_id FROM cat EXCEPT SELECT rfc_message_id FROM archived)
  UNION ALL SELECT rfc_message_id, 'unexpected' FROM (
    SELECT rfc_message_id FROM archived EXCEPT SELECT rfc_message_id FROM cat)""", SIDES))
def expected_vs_written(spark, sf_dir):
    written, expected = sides(spark, sf_dir)
    return RC.expected_vs_written(expected, written)


@query(with_msgs("""SELECT archive_file, mbox_offset, 'orphaned' AS status FROM archived
    WHERE gmail_id NOT IN (SELECT gmail_id FROM cat)
  UNION ALL SELECT archive_file, mbox_offset, 'missing' FROM cat
    WHERE gmail_id NOT IN (SELECT gmail_id FROM archived)""", SIDES))
def compare_index_catalogue(spark, sf_dir):
    indexed, catalogue = sides(spark, sf_dir)
    return I.compare_index(catalogue, indexed)


@query(with_msgs("""SELECT b.gmail_id, b.archive_file, b.mbox_offset,
    coalesce(CASE WHEN bad THEN a.l END, b.mbox_length) AS mbox_length,
    bad AND a.l IS NOT NULL AS backfilled
  FROM (SELECT * EXCLUDE (mbox_offset, mbox_length), bad,
          CASE WHEN bad AND a0.o IS NOT NULL THEN a0.o ELSE mbox_offset END AS mbox_offset,
          CASE WHEN bad THEN -1 ELSE mbox_length END AS mbox_length
        FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM msgs)
        LEFT JOIN (SELECT archive_file AS f, rfc_message_id AS r, max(mbox_offset) AS o FROM msgs
                   GROUP BY 1, 2) a0 ON archive_file = f AND rfc_message_id = r) b
  LEFT JOIN (SELECT archive_file, rfc_message_id, max((mbox_offset, mbox_length))[2] AS l FROM msgs
             GROUP BY 1, 2) a USING (archive_file, rfc_message_id)""".replace(
    "max((mbox_offset, mbox_length))[2]", "max_by(mbox_length, mbox_offset)")))
def backfill_offsets(spark, sf_dir):
    return J.backfill_offsets(spoiled(spark, sf_dir), msgs(spark, sf_dir)).select(
        "gmail_id", "archive_file", "mbox_offset", "mbox_length", "backfilled")


@query(with_msgs("""SELECT gmail_id, CASE WHEN k THEN 'merged.mbox' ELSE archive_file END
    AS archive_file, CASE WHEN k THEN mbox_offset // 2 ELSE mbox_offset END AS mbox_offset,
    CASE WHEN k THEN mbox_length + 1 ELSE mbox_length END AS mbox_length
  FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels) AS k FROM msgs)
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""", KNOWN_SQL))
def update_locations(spark, sf_dir):
    moves = known(spark, sf_dir).select(
        "gmail_id", F.lit("merged.mbox").alias("archive_file"),
        (F.col("mbox_offset") / 2).cast("long").alias("mbox_offset"),
        (F.col("mbox_length") + 1).alias("mbox_length"))
    toxic = views.load(spark, sf_dir, "labels").filter("toxic = 1").select(
        F.concat(F.lit("m"), "doc_id").alias("gmail_id"))
    return J.update_locations(msgs(spark, sf_dir), moves, toxic).select(
        "gmail_id", "archive_file", "mbox_offset", "mbox_length")


def legacy(spark, sf_dir):
    """Known messages as a version 1.0 catalogue with ids of its own."""
    return known(spark, sf_dir).select(
        F.concat(F.lit("old"), "doc_id").alias("gmail_id"),
        F.date_format("archived_timestamp", "yyyy-MM-dd HH:mm:ss").alias("archived_timestamp"),
        "archive_file", "subject", "from_addr", F.col("date_raw").alias("message_date"),
        "checksum")


LEGACY = f"""legacy AS (SELECT 'old' || doc_id AS gmail_id, archive_file,
    strftime(archived_timestamp, {TS}) AS archived_timestamp FROM known)"""


@query(with_msgs("""SELECT o.archive_file, o.gmail_id, o.archived_timestamp, n.rfc_message_id,
    n.mbox_offset, n.position FROM
  (SELECT *, row_number() OVER (PARTITION BY archive_file ORDER BY archived_timestamp, gmail_id)
     - 1 AS position FROM legacy) o JOIN
  (SELECT *, row_number() OVER (PARTITION BY archive_file ORDER BY mbox_offset) - 1 AS position
   FROM msgs) n USING (archive_file, position)""", KNOWN_SQL, LEGACY))
def zip_legacy(spark, sf_dir):
    found = msgs(spark, sf_dir).select("archive_file", "mbox_offset", "rfc_message_id")
    return J.zip_legacy(legacy(spark, sf_dir), found).select(
        "archive_file", "gmail_id", "archived_timestamp", "rfc_message_id", "mbox_offset",
        "position")


# --------------------------------------------------------------- table changes

FIRSTS = """firsts AS (SELECT *, row_number() OVER (PARTITION BY rfc_message_id
    ORDER BY archive_file, mbox_offset) = 1 AS first,
  rfc_message_id IN (SELECT rfc_message_id FROM known) AS is_known FROM msgs)"""
STATUS = ("CASE WHEN first AND NOT is_known THEN 'IMPORTED' ELSE 'SKIPPED' END AS status, "
          "CASE WHEN first AND is_known THEN 'already_known' "
          "WHEN NOT first THEN 'in_batch_duplicate' END AS reason")


@query(with_msgs(f"SELECT {ROW}, {STATUS} FROM firsts", KNOWN_SQL, FIRSTS))
def append_status(spark, sf_dir):
    return M.append_status(msgs(spark, sf_dir), known(spark, sf_dir)).select(
        *COLUMNS, "status", "reason")


@query(with_msgs(f"SELECT {ROW} FROM firsts WHERE first AND NOT is_known", KNOWN_SQL, FIRSTS))
def append_messages(spark, sf_dir):
    return M.append_messages(msgs(spark, sf_dir), known(spark, sf_dir)).select(*COLUMNS)


@query(with_msgs(f"""SELECT {ROW}, 'old' AS account_id FROM msgs WHERE rfc_message_id NOT IN
    (SELECT rfc_message_id FROM known)
  UNION ALL SELECT {ROW}, 'new' FROM (SELECT *, row_number() OVER (PARTITION BY rfc_message_id
    ORDER BY archive_file DESC, mbox_offset DESC) AS rn FROM known) WHERE rn = 1""", KNOWN_SQL))
def upsert_messages(spark, sf_dir):
    old = msgs(spark, sf_dir).withColumn("account_id", F.lit("old"))
    new = known(spark, sf_dir).withColumn("account_id", F.lit("new"))
    return M.upsert_messages(old, new).select(*COLUMNS, "account_id")


@query(with_msgs(f"SELECT {ROW} FROM msgs WHERE doc_id NOT IN (SELECT doc_id FROM labels)"))
def delete_messages(spark, sf_dir):
    gone = labelled(spark, sf_dir).select(F.concat(F.lit("m"), "doc_id").alias("gmail_id"))
    return M.delete_messages(msgs(spark, sf_dir), gone).select(*COLUMNS)


@query(with_msgs("SELECT count(*) AS deleted FROM msgs WHERE archive_file = 'src1.mbox'"))
def deleted_count(spark, sf_dir):
    return M.deleted_count(msgs(spark, sf_dir), archive_file="src1.mbox")


@query(with_msgs("SELECT DISTINCT archive_file FROM msgs ORDER BY 1"))
def distinct_archives(spark, sf_dir):
    return M.distinct_archives(msgs(spark, sf_dir))


def runs(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    return e.select(
        F.col("ts").cast("timestamp_ntz").alias("run_timestamp"),
        F.col("event_type").alias("query"), F.col("event_id").alias("messages_archived"),
        F.concat(F.lit("a"), "user_id", F.lit(".mbox")).alias("archive_file"),
        F.lit("default").alias("account_id"), F.col("event_type").alias("operation_type"))


@query(f"""SELECT strftime(ts, {TS}) AS run_timestamp, event_type AS query,
    event_id AS messages_archived, 'a' || user_id || '.mbox' AS archive_file,
    'default' AS account_id, event_type AS operation_type
  FROM events ORDER BY ts DESC, event_type, 'a' || user_id || '.mbox' LIMIT 10""")
def recent_runs(spark, sf_dir):
    return M.recent_runs(runs(spark, sf_dir))


def session_events(spark, sf_dir):
    """The event table as a session log: a user and a type make a session."""
    e = views.load(spark, sf_dir, "events")
    kinds = {"signup": "create", "view": "progress", "click": "progress",
             "purchase": "complete", "error": "abort"}
    kind = F.lit(None).cast("string")
    for name, event in kinds.items():
        kind = F.when(F.col("event_type") == name, event).otherwise(kind)
    created = kind == "create"
    return e.select(
        F.concat(F.lit("s"), "user_id").alias("session_id"), kind.alias("event"),
        F.col("ts").cast("timestamp_ntz").alias("event_time"),
        F.when(created, F.concat(F.lit("a"), F.col("user_id") % 5, F.lit(".mbox")))
        .alias("target_file"),
        F.when(created, F.lit("before:2024/01/01")).alias("query"),
        F.when(created, F.array(F.concat(F.lit("u"), "user_id"))).alias("message_ids"),
        F.when(created & (F.col("user_id") % 2 == 0), F.lit("zstd")).alias("compression"),
        F.when(kind == "progress", F.col("event_id")).alias("processed_count"),
        F.lit("default").alias("account_id"))


SESSIONS = """born AS (SELECT user_id, max(ts) AS started_at FROM events
    WHERE event_type = 'signup' GROUP BY 1),
  states AS (SELECT 's' || user_id AS session_id, 'a' || (user_id % 5) || '.mbox' AS target_file,
    'before:2024/01/01' AS query, CASE WHEN user_id % 2 = 0 THEN 'zstd' END AS compression,
    started_at, max(CASE WHEN event_type <> 'signup' THEN ts END) AS updated_at,
    coalesce(arg_max(event_id, (ts, event_id)) FILTER (WHERE event_type IN ('view', 'click')), 0)
      AS processed_count,
    CASE arg_max(event_type, (ts, event_type = 'purchase'))
      FILTER (WHERE event_type IN ('purchase', 'error'))
      WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'aborted' ELSE 'in_progress' END AS status,
    CAST(1 AS BIGINT) AS total_count
  FROM born JOIN events USING (user_id) WHERE ts >= started_at GROUP BY user_id, started_at)"""
STATE = (f"session_id, target_file, query, compression, strftime(started_at, {TS}) AS started_at, "
         f"strftime(updated_at, {TS}) AS updated_at, processed_count, status, total_count")
STATE_COLUMNS = ["session_id", "target_file", "query", "compression", "started_at", "updated_at",
                 "processed_count", "status", "total_count"]


@query(f"WITH {SESSIONS} SELECT {STATE} FROM states")
def session_states(spark, sf_dir):
    return M.session_states(session_events(spark, sf_dir)).select(*STATE_COLUMNS)


@query(f"WITH {SESSIONS} SELECT {STATE} FROM states WHERE status = 'in_progress'")
def open_sessions(spark, sf_dir):
    return M.open_sessions(M.session_states(session_events(spark, sf_dir))).select(*STATE_COLUMNS)


@query(f"""WITH {SESSIONS} SELECT {STATE} FROM states WHERE status = 'in_progress'
  AND query = 'before:2024/01/01' AND compression IS NULL
  ORDER BY states.started_at DESC, session_id LIMIT 1""")
def latest_open_session(spark, sf_dir):
    states = M.session_states(session_events(spark, sf_dir))
    return M.latest_open_session(states, query="before:2024/01/01").select(*STATE_COLUMNS)


@query(f"""WITH {SESSIONS} SELECT {STATE} FROM (SELECT *, row_number() OVER (
    PARTITION BY target_file ORDER BY states.started_at DESC, session_id) AS rn FROM states
    WHERE status = 'in_progress') WHERE rn = 1""")
def latest_open_per_file(spark, sf_dir):
    states = M.session_states(session_events(spark, sf_dir))
    return M.latest_open_per(states, "target_file").select(*STATE_COLUMNS)


# --------------------------------------------------------------------- reports


@query(with_msgs("""SELECT 'gmail_id' AS key, (SELECT count(*) FROM (SELECT gmail_id FROM msgs
    GROUP BY 1 HAVING count(*) > 1)) AS violations
  UNION ALL SELECT 'rfc_message_id', (SELECT count(*) FROM (SELECT rfc_message_id FROM msgs
    GROUP BY 1 HAVING count(*) > 1))"""))
def key_violations(spark, sf_dir):
    return A.key_violations(msgs(spark, sf_dir))


IMPORTED = f"""imported AS (SELECT archive_file, {STATUS}, g AS gmail_id FROM firsts
  LEFT JOIN mapping ON message_key = trim(rfc_message_id, '<>'))"""
PER_FILE = """per_file AS (SELECT archive_file,
    count(*) FILTER (WHERE status = 'IMPORTED') AS imported,
    count(*) FILTER (WHERE status = 'SKIPPED') AS skipped,
    count(*) FILTER (WHERE status = 'FAILED') AS failed,
    count(*) FILTER (WHERE status = 'IMPORTED' AND gmail_id IS NOT NULL) AS gmail_ids_found,
    count(*) FILTER (WHERE status = 'IMPORTED' AND gmail_id IS NULL) AS gmail_ids_not_found
  FROM imported GROUP BY 1)"""


def imported(spark, sf_dir):
    rows = M.append_status(msgs(spark, sf_dir), known(spark, sf_dir))
    return A.import_summary(J.attach_remote_ids(rows, remote_ids(spark, sf_dir)))


@query(with_msgs("SELECT * FROM per_file", KNOWN_SQL, MAPPING, FIRSTS, IMPORTED, PER_FILE))
def import_summary(spark, sf_dir):
    return imported(spark, sf_dir)


@query(with_msgs("""SELECT count(*) AS total_files, """ + ", ".join(
    f"CAST(sum({c}) AS BIGINT) AS total_{c}" for c in
    ("imported", "skipped", "failed", "gmail_ids_found", "gmail_ids_not_found"))
    + " FROM per_file", KNOWN_SQL, MAPPING, FIRSTS, IMPORTED, PER_FILE))
def import_totals(spark, sf_dir):
    return A.import_totals(imported(spark, sf_dir))


@query(with_msgs("""SELECT count(*) AS total_messages,
    count(*) FILTER (WHERE rn > 1) AS duplicates_removed,
    count(*) FILTER (WHERE rn = 1) AS messages_consolidated,
    count(DISTINCT archive_file) AS sources FROM r""", ranked("newest")))
def consolidation_summary(spark, sf_dir):
    flagged = D.flag_copies(merged(spark, sf_dir), "newest")
    return A.consolidation_summary(flagged.withColumn("kept", F.col("action") == "keep"))


@query(with_msgs("""SELECT count(*) AS total_messages, count(DISTINCT archive_file)
    AS archive_count FROM msgs"""))
def archive_stats(spark, sf_dir):
    return A.archive_stats(msgs(spark, sf_dir))


COUNTED = """counted AS (SELECT archive_file, coalesce(actual, 0) AS actual,
    coalesce(expected, 0) AS expected FROM
  (SELECT archive_file, count(*) AS actual FROM archived GROUP BY 1) FULL JOIN
  (SELECT archive_file, count(*) AS expected FROM cat GROUP BY 1) USING (archive_file))"""


@query(with_msgs("""SELECT archive_file, actual, expected, actual = expected AS count_matches,
    actual > 0 AS not_empty FROM counted""", SIDES, COUNTED))
def count_messages(spark, sf_dir):
    archived, catalogue = sides(spark, sf_dir)
    expected = catalogue.groupBy("archive_file").agg(F.count("*").alias("expected"))
    return A.count_messages(archived, expected)


@query(with_msgs("""SELECT count(*) AS total_checked,
    count(*) FILTER (WHERE NOT bad) AS successful_reads,
    count(*) FILTER (WHERE bad) AS failed_reads,
    round(100.0 * count(*) FILTER (WHERE NOT bad) / count(*), 6)::DOUBLE AS accuracy_percentage
  FROM (SELECT doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS bad FROM msgs)"""))
def offset_accuracy(spark, sf_dir):
    status = F.when(F.col("mbox_length") > 0, "ok").otherwise("length mismatch")
    return A.offset_accuracy(spoiled(spark, sf_dir).withColumn("status", status))


@query(with_msgs("""SELECT 'orphaned_records' AS "check", count(*) FILTER (WHERE status =
    'orphaned') AS found, count(*) FILTER (WHERE status = 'orphaned') = 0 AS passed FROM compared
  UNION ALL SELECT 'missing_records', count(*) FILTER (WHERE status = 'missing'),
    count(*) FILTER (WHERE status = 'missing') = 0 FROM compared
  UNION ALL SELECT 'duplicate_gmail_id', 0, true
  UNION ALL SELECT 'duplicate_rfc_message_id', n, n = 0 FROM (SELECT count(*) AS n FROM (
    SELECT rfc_message_id FROM cat GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'index_orphaned', n, n = 0 FROM (SELECT count(*) AS n FROM archived
    WHERE gmail_id NOT IN (SELECT gmail_id FROM cat))
  UNION ALL SELECT 'index_missing', n, n = 0 FROM (SELECT count(*) AS n FROM cat
    WHERE gmail_id NOT IN (SELECT gmail_id FROM archived))""", SIDES, COMPARED))
def verify_consistency(spark, sf_dir):
    archived, catalogue = sides(spark, sf_dir)
    return QA.verify_consistency(catalogue, archived, archived)


def listing(spark, sf_dir):
    """Archive files at hand: those with a message labelled toxic."""
    toxic = views.load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    return msgs(spark, sf_dir).join(toxic, "doc_id", "left_semi").select(
        F.col("archive_file").alias("path")).distinct()


LISTING = """present AS (SELECT DISTINCT archive_file AS path FROM msgs WHERE doc_id IN
  (SELECT doc_id FROM labels WHERE toxic = 1))"""
ISSUES = """issues AS (
  SELECT 'orphaned_index' AS issue, count(*) AS n FROM archived
    WHERE gmail_id NOT IN (SELECT gmail_id FROM cat)
  UNION ALL SELECT 'missing_index', count(*) FROM cat
    WHERE gmail_id NOT IN (SELECT gmail_id FROM archived)
  UNION ALL SELECT 'invalid_offsets', 0
  UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT rfc_message_id FROM cat GROUP BY 1
    HAVING count(*) > 1)
  UNION ALL SELECT 'missing_archives', count(*) FROM (SELECT DISTINCT archive_file FROM cat
    WHERE archive_file NOT IN (SELECT path FROM present)))"""


@query(with_msgs("SELECT issue, n AS found FROM issues WHERE n > 0", SIDES, LISTING, ISSUES))
def check_integrity(spark, sf_dir):
    indexed, catalogue = sides(spark, sf_dir)
    return QA.check_integrity(catalogue, indexed, listing(spark, sf_dir))


@query(with_msgs("""SELECT DISTINCT archive_file FROM msgs
    WHERE archive_file NOT IN (SELECT path FROM present)""", LISTING))
def missing_archives(spark, sf_dir):
    return QA.missing_archives(msgs(spark, sf_dir), listing(spark, sf_dir))


HEALTH = """health AS (
  SELECT 'schema' AS id, 'OK' AS severity, 0 AS found, false AS fixable
  UNION ALL SELECT 'index', CASE WHEN n > 0 THEN 'WARNING' ELSE 'OK' END, n, n > 0
    FROM issues WHERE issue = 'orphaned_index'
  UNION ALL SELECT 'archive_files', CASE WHEN n > 0 THEN 'WARNING' ELSE 'OK' END, n, false
    FROM issues WHERE issue = 'missing_archives'
  UNION ALL SELECT 'offsets', 'OK', 0, false)"""


@query(with_msgs("SELECT * FROM health", SIDES, LISTING, ISSUES, HEALTH))
def health_report(spark, sf_dir):
    indexed, catalogue = sides(spark, sf_dir)
    return QA.health_report(catalogue, indexed, listing(spark, sf_dir)).select(
        "id", "severity", "found", "fixable")


@query(with_msgs("""SELECT count(*) FILTER (WHERE severity = 'OK') AS checks_passed,
    count(*) FILTER (WHERE severity = 'WARNING') AS warnings,
    count(*) FILTER (WHERE severity = 'ERROR') AS errors,
    CASE WHEN count(*) FILTER (WHERE severity = 'ERROR') > 0 THEN 'ERROR'
      WHEN count(*) FILTER (WHERE severity = 'WARNING') > 0 THEN 'WARNING' ELSE 'OK' END
      AS overall_status,
    coalesce(string_agg(CASE id WHEN 'index' THEN 'Text index' WHEN 'offsets'
      THEN 'Mbox offsets' END, ',') FILTER (WHERE fixable), '') AS fixable_issues FROM health""",
                 SIDES, LISTING, ISSUES, HEALTH))
def health_rollup(spark, sf_dir):
    indexed, catalogue = sides(spark, sf_dir)
    return A.health_rollup(QA.health_report(catalogue, indexed, listing(spark, sf_dir)))


@query(with_msgs("""SELECT (SELECT n FROM issues WHERE issue = 'orphaned_index')
    AS orphaned_removed, (SELECT n FROM issues WHERE issue = 'missing_index') AS missing_added""",
                 SIDES, LISTING, ISSUES))
def repair_counts(spark, sf_dir):
    indexed, catalogue = sides(spark, sf_dir)
    return QA.repair_counts(catalogue, indexed)


CAT_TOKS = TOKS_SQL.replace("FROM msgs", "FROM cat")


@query(with_msgs("""SELECT term, count(DISTINCT (archive_file, mbox_offset)) AS df,
    count(*) AS occurrences FROM u GROUP BY term""", SIDES, CAT_TOKS, f"u AS ({UNNEST})"))
def repair_index(spark, sf_dir):
    indexed, catalogue = sides(spark, sf_dir)
    postings = I.build_index(indexed, WHOLE, stemmed=False)
    repaired, _ = I.repair_index(
        catalogue, postings, I.doc_stats(indexed, WHOLE), WHOLE, stemmed=False)
    return I.term_stats(repaired)
