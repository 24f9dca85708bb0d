"""Changes of the catalogue and its logs, each as a new table version."""

import datetime as dt

from pyspark.sql import functions as F

from mailspark import schema
from mailspark.operators import dedup
from mailspark.operators.joins import keys_for_join, known_among, latest_per
from mailspark.schema import LOCATION

ID = "rfc_message_id"


def append_status(batch, messages, skip_duplicates=True):
    """Every row of a batch with ``status``: FAILED (no usable row),
    IMPORTED, or SKIPPED with a ``reason``: already_known or
    in_batch_duplicate. Only slim keys are compared with the catalogue, and
    the outcome is joined back by location."""
    usable = F.col(ID).isNotNull() & F.col("archive_file").isNotNull() & (F.col("mbox_offset") >= 0)
    usable = F.coalesce(usable, F.lit(False))
    if not skip_duplicates:
        return batch.withColumns({
            "status": F.when(usable, "IMPORTED").otherwise("FAILED"),
            "reason": F.lit(None).cast("string"),
        })
    firsts = dedup.first_seen(batch.filter(usable).select(ID, *LOCATION))
    known = known_among(messages, batch, ID).withColumn("_known", F.lit(True))
    outcome = firsts.join(known, ID, "left").select(
        *LOCATION, F.coalesce("_known", F.lit(False)).alias("_known"))
    rows = batch.join(outcome, list(LOCATION), "left")
    fresh = F.col("_known") == F.lit(False)
    reason = (F.when(~usable | fresh, None).when(F.col("_known"), "already_known")
              .otherwise("in_batch_duplicate"))
    status = F.when(~usable, "FAILED").when(fresh, "IMPORTED").otherwise("SKIPPED")
    return rows.withColumns({"status": status, "reason": reason}).drop("_known")


def append_messages(batch, messages, skip_duplicates=True):
    """Rows of a batch to append to the catalogue: those that
    ``append_status`` calls IMPORTED."""
    return append_status(batch, messages, skip_duplicates).filter(
        "status = 'IMPORTED'").select(*batch.columns)


def upsert_messages(messages, batch, order=None):
    """Catalogue after insert-or-replace by id: the last batch row of an id
    takes the place of all its catalogue rows. A small batch's ids are sent to
    the catalogue, which then isn't shuffled."""
    latest = latest_per(batch, [ID], order or [F.desc(c) for c in LOCATION])
    untouched = messages.join(keys_for_join(batch.select(ID).distinct()), ID, "left_anti")
    return untouched.select(*messages.columns).unionByName(latest.select(*messages.columns))


def delete_messages(messages, ids=None, key="gmail_id", archive_file=None):
    """Catalogue without the given ids, or without an archive."""
    if archive_file is not None:
        return messages.filter(~F.col("archive_file").eqNullSafe(archive_file))
    gone = keys_for_join(ids.select(key).distinct())
    return messages.join(gone, key, "left_anti").select(*messages.columns)


def deleted_count(messages, ids=None, key="gmail_id", archive_file=None):
    if archive_file is not None:
        gone = messages.filter(F.col("archive_file") == archive_file)
    else:
        gone = messages.join(keys_for_join(ids.select(key).distinct()), key, "left_semi")
    return gone.agg(F.count("*").alias("deleted"))


def remove_copies(messages, strategy="newest"):
    """Catalogue after a dedup; the copies go by location."""
    gone = dedup.removals(messages, strategy).select(*LOCATION)
    return messages.join(gone, list(LOCATION), "left_anti").select(*messages.columns)


def dry_run(messages, strategy="newest"):
    """The plan of a dedup: each row and what would happen to it."""
    return dedup.flag_copies(messages, strategy).select(
        dedup.ID, "gmail_id", *LOCATION, "action")


def distinct_archives(messages):
    return messages.select("archive_file").distinct().orderBy("archive_file")


# ------------------------------------------------------------------ audit log


def run_row(spark, operation, count, archive_file=None, notes=None, account_id="default",
            at=None):
    """One audit row; the note goes to ``query``, by default the operation."""
    at = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = (at, notes or operation, int(count), archive_file or "", account_id, operation)
    return spark.createDataFrame([row], schema.ARCHIVE_RUNS)


def record_run(path, run):
    run.write.mode("append").parquet(path)


def recent_runs(runs, limit=10):
    return runs.orderBy(F.desc("run_timestamp"), "query", "archive_file").limit(limit)


# ------------------------------------------------------------------- sessions


def session_event(spark, session_id, event, at=None, **values):
    """One row of the session log: event is create, progress, complete, abort
    or delete; a creation names target_file, query and message_ids."""
    if event not in ("create", "progress", "complete", "abort", "delete"):
        raise ValueError(f"unknown session event {event!r}")
    at = at or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    row = dict.fromkeys(schema.SESSION_EVENTS.names)
    row.update(session_id=session_id, event=event, event_time=at, **values)
    return spark.createDataFrame(
        [tuple(row[n] for n in schema.SESSION_EVENTS.names)], schema.SESSION_EVENTS)


def record_event(path, event):
    event.write.mode("append").parquet(path)


def session_states(events):
    """Current state of each session from its append-only event log.

    A session begins with its last creation; only events since then count, and
    without a creation there is no session. Progress never changes the status:
    a session is open until it is completed or aborted (the later one holds),
    and gone once it is deleted."""
    started = F.struct("event_time")
    created = events.filter("event = 'create'").groupBy("session_id").agg(
        *[F.max_by(c, started).alias(c) for c in ("target_file", "query", "compression", "account_id",
                                                  "message_ids")],
        F.max("event_time").alias("started_at"))
    later = events.filter("event <> 'create'").select(
        "session_id", "event", "event_time", F.col("processed_count").alias("_count"))
    rows = created.join(later, "session_id", "left")
    since = F.col("event_time") >= F.col("started_at")
    ending = since & F.col("event").isin("complete", "abort")
    counted = since & F.col("_count").isNotNull()
    of_creation = [c for c in created.columns if c != "session_id"]
    states = rows.groupBy("session_id").agg(
        *[F.any_value(c).alias(c) for c in of_creation],
        F.max(F.when(since, F.col("event_time"))).alias("updated_at"),
        F.coalesce(F.max_by("_count", F.when(counted, F.struct("event_time", "_count"))), F.lit(0))
        .alias("processed_count"),
        F.max_by("event", F.when(ending, F.struct("event_time", "event"))).alias("_end"),
        F.coalesce(F.bool_or(since & (F.col("event") == "delete")), F.lit(False)).alias("_gone"))
    ended = (F.when(F.col("_end") == "complete", "completed")
             .when(F.col("_end") == "abort", "aborted").otherwise("in_progress"))
    return states.filter(~F.col("_gone")).withColumns({
        "status": ended,
        "total_count": F.coalesce(F.size("message_ids"), F.lit(0)).cast("long"),
    }).drop("_end", "_gone")


def open_sessions(sessions):
    """Sessions that can be resumed, newest first."""
    return sessions.filter("status = 'in_progress'").orderBy(
        F.desc("started_at"), "session_id")


def latest_open_session(sessions, target_file=None, query=None, compression=None):
    """Newest open session of a target file, or of a query with the same
    compression (NULL equals NULL)."""
    rows = sessions.filter("status = 'in_progress'")
    if target_file is not None:
        rows = rows.filter(F.col("target_file") == target_file)
    else:
        rows = rows.filter((F.col("query") == query)
                           & F.col("compression").eqNullSafe(F.lit(compression)))
    return rows.orderBy(F.desc("started_at"), "session_id").limit(1)


def latest_open_per(sessions, *keys):
    """Newest open session for every value of the keys."""
    rows = sessions.filter("status = 'in_progress'")
    return latest_per(rows, keys, [F.desc("started_at"), F.asc("session_id")])
