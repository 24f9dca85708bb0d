"""Matching of messages against catalogues, archives and listings.

Key sides are reduced to distinct keys before they are joined, so no group of
copies meets another. The message side may be skewed: it is always the
streamed side of an outer, semi or anti join, which adaptive execution splits.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.operators import ranges
from mailspark.operators.search import misplaced
from mailspark.schema import LOCATION

#: Bytes up to which a key table is sent to every task; past it keys are shuffled.
BROADCAST_BYTES = 32 << 20


def keys_for_join(keys):
    """Key table with a broadcast hint if its rows, measured, stay within the
    bound; unchanged otherwise. ``keys`` should be narrow."""
    return F.broadcast(keys) if _bytes(keys) <= BROADCAST_BYTES else keys


def _bytes(rows):
    """Size of the rows in memory: 16 bytes a column, and the texts."""
    texts = [F.octet_length(F.col(f"`{n}`")) for n, kind in rows.dtypes if kind in ("string", "binary")]
    others = [F.lit(64) for _, kind in rows.dtypes if kind.startswith(("array", "map", "struct"))]
    width = sum((F.coalesce(t, F.lit(0)) for t in texts + others), F.lit(16 * len(rows.columns)))
    return rows.agg(F.sum(width.cast("long"))).first()[0] or 0


def known_among(messages, keys, key):
    """Distinct catalogue values of ``key`` that a batch may hold. A small
    batch is sent to the catalogue's tasks, which then shuffle nothing but
    the values found; past the bound all values are shuffled. ``keys`` is
    evaluated twice, so it should be cheap or written down."""
    rows = messages.filter(F.col(key).isNotNull()).select(key)
    wanted = keys.select(key).distinct()
    if _bytes(wanted) <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(wanted), key, "left_semi")
    return rows.distinct()


def not_yet_archived(ids, messages, incremental=True):
    """Remote ids without a catalogue row; all of them if not incremental."""
    if not incremental:
        return ids
    return ids.join(known_among(messages, ids, "gmail_id"), "gmail_id", "left_anti")


def archived_counts(ids, messages):
    """How many of the ids are new and how many are skipped: one row."""
    known = known_among(messages, ids, "gmail_id").withColumn("_known", F.lit(True))
    return ids.join(known, "gmail_id", "left").agg(
        F.count_if(F.col("_known").isNull()).alias("to_archive"),
        F.count("_known").alias("already_archived"),
    )


def split_new_known(scanned, messages, skip_duplicates=True):
    """Scanned messages with ``is_new``: no catalogue row has their id."""
    if not skip_duplicates:
        return scanned.withColumn("is_new", F.lit(True))
    known = known_among(messages, scanned, "rfc_message_id").withColumn("_known", F.lit(True))
    return scanned.join(known, "rfc_message_id", "left").withColumn(
        "is_new", F.col("_known").isNull()).drop("_known")


def scan_summary(flagged):
    """Per archive: messages, new ones, known ones."""
    return flagged.groupBy("archive_file").agg(
        F.count("*").alias("total_messages"),
        F.count_if("is_new").alias("new_messages"),
        F.count_if(~F.col("is_new")).alias("duplicate_messages"),
    )


def attach_remote_ids(scanned, mapping):
    """Adds the remote id of each message from a mapping (message_key,
    gmail_id); the key is the Message-ID without angle brackets."""
    key = F.nullif(F.btrim(F.col("rfc_message_id"), F.lit("<>")), F.lit(""))
    rows = scanned.drop("gmail_id").withColumn("message_key", key)
    wanted = rows.select("message_key").distinct()
    found = mapping.join(keys_for_join(wanted), "message_key", "left_semi").groupBy(
        "message_key").agg(F.min("gmail_id").alias("gmail_id"))
    return rows.join(found, "message_key", "left").drop("message_key")


def remote_id_counts(attached):
    """Distinct messages with and without a remote id: one row."""
    per_id = attached.groupBy("rfc_message_id").agg(F.max("gmail_id").alias("gmail_id"))
    return per_id.agg(
        F.count("gmail_id").alias("gmail_ids_found"),
        F.count_if(F.col("gmail_id").isNull()).alias("gmail_ids_not_found"),
    )


def attach_catalogue(archived, messages, files=None):
    """Adds the catalogue's remote id to messages read from archives. Only the
    catalogue rows of those archives are aggregated: ``files`` (archive_file)
    names them, else they are taken from the messages, which should then be
    cheap to read twice."""
    files = archived.select("archive_file").distinct() if files is None else files
    known = messages.join(keys_for_join(files), "archive_file", "left_semi").groupBy(
        "archive_file", "rfc_message_id").agg(
        F.min("gmail_id").alias("gmail_id"))
    rows = archived.drop("gmail_id").join(known, ["archive_file", "rfc_message_id"], "left")
    return rows.withColumn("gmail_id", F.coalesce("gmail_id", F.lit("unknown")))


def attach_account(messages, accounts):
    """Adds email and display name of the account each message belongs to."""
    return messages.join(keys_for_join(accounts), "account_id", "left")


def lookup_messages(messages, ids, key="gmail_id"):
    """Catalogue rows of the wanted ids, by remote id or by Message-ID."""
    return messages.join(keys_for_join(ids.select(key).distinct()), key, "left_semi")


def locate(messages, ids, key="gmail_id"):
    return lookup_messages(messages, ids, key).select(key, *LOCATION, "mbox_length")


def is_archived(ids, messages, key="gmail_id"):
    """The ids with ``archived`` true where the catalogue has them."""
    known = known_among(messages, ids, key)
    return ids.join(known.withColumn("_known", F.lit(True)), key, "left").withColumn(
        "archived", F.col("_known").isNotNull()).drop("_known")


def backfill_offsets(messages, archived):
    """Messages with bad locations repaired from what the archives hold,
    matched on archive and Message-ID; ``backfilled`` tells which."""
    bad = misplaced()
    at = F.struct("mbox_offset", "mbox_length")
    broken = messages.filter(bad)
    files = keys_for_join(broken.select("archive_file").distinct())
    found = archived.join(files, "archive_file", "left_semi").groupBy(
        "archive_file", "rfc_message_id").agg(F.max(at).alias("_at"))
    broken = broken.join(found, ["archive_file", "rfc_message_id"], "left")
    repaired = broken.withColumns({
        "mbox_offset": F.coalesce("_at.mbox_offset", "mbox_offset"),
        "mbox_length": F.coalesce("_at.mbox_length", "mbox_length"),
        "backfilled": F.col("_at").isNotNull(),
    })
    sound = messages.filter(~bad).withColumn("backfilled", F.lit(False))
    return sound.unionByName(repaired.select(*messages.columns, "backfilled"))


def update_locations(messages, moves, duplicates=None, key="gmail_id"):
    """Catalogue with new archive, offset and length for the moved keys, and
    without the listed duplicates. ``moves`` is (key, archive_file,
    mbox_offset, mbox_length), unique per key. Few moves are sent to the
    catalogue, which then isn't shuffled."""
    names = ("archive_file", "mbox_offset", "mbox_length")
    moved = keys_for_join(moves.select(key, *[F.col(c).alias(f"_to_{c}") for c in names]))
    rows = messages.join(moved, key, "left")
    rows = rows.withColumns({c: F.coalesce(f"_to_{c}", c) for c in names})
    rows = rows.select(*messages.columns)
    if duplicates is not None:
        rows = rows.join(keys_for_join(duplicates.select(key).distinct()), key, "left_anti")
    return rows.select(*messages.columns)


def zip_legacy(legacy, archived):
    """Pairs the n-th legacy row of an archive with its n-th message. Legacy
    rows count in the order (archived_timestamp, gmail_id)."""
    old = ranges.positions(
        legacy, ["archive_file"], [F.asc("archived_timestamp"), F.asc("gmail_id")])
    names = [c for c in archived.columns if c not in ("archive_file", "gmail_id")]
    new = ranges.positions(archived, ["archive_file"], [F.asc("mbox_offset")])
    return old.select("archive_file", "position", "gmail_id", "archived_timestamp").join(
        new.select("archive_file", "position", *names), ["archive_file", "position"])


def zip_leftovers(legacy, archived):
    """Legacy rows per archive that find no message."""
    old = legacy.groupBy("archive_file").agg(F.count("*").alias("legacy"))
    new = archived.groupBy("archive_file").agg(F.count("*").alias("found"))
    short = F.greatest(F.col("legacy") - F.coalesce("found", F.lit(0)), F.lit(0))
    return old.join(new, "archive_file", "left").select("archive_file", short.alias("skipped"))


def latest_per(rows, keys, order):
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")
