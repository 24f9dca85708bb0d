"""Duplicate messages by Message-ID.

Every operator works from the one row kept per id. Spark reduces to that row
inside each map task before the shuffle (``row_number() = 1``), so an id with
any number of copies costs one row per task. The copies are then told apart
from the kept row by their location, which is unique and therefore even."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.functions import columns as C
from mailspark.schema import LOCATION

STRATEGIES = ("newest", "largest", "first")
ID = "rfc_message_id"


def _check(strategy):
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, use one of {', '.join(STRATEGIES)}")


def _scan_order():
    """Copies of one message as a scan lists them: newest archived first."""
    return [F.desc("archived_timestamp"), F.asc("archive_file"), F.asc("mbox_offset")]


def keep_order(strategy):
    _check(strategy)
    lead = {
        "newest": [],
        "largest": [F.desc(C.effective_size())],
        "first": [F.asc("archive_file")],
    }[strategy]
    return lead + _scan_order()


def _first_per_id(rows, order, key=ID):
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def kept(messages, strategy="newest"):
    """The catalogue after dedup: one row per id, rows without id untouched."""
    with_id = messages.filter(F.col(ID).isNotNull())
    return _first_per_id(with_id, keep_order(strategy)).unionByName(
        messages.filter(F.col(ID).isNull()))


def _slim(messages):
    return messages.select(ID, *LOCATION, "archived_timestamp", "size_bytes", "mbox_length")


def flag_copies(messages, strategy="newest"):
    """All messages with ``action`` keep or remove."""
    winners = kept(_slim(messages), strategy).select(*LOCATION, F.lit(True).alias("_kept"))
    flagged = messages.join(winners, list(LOCATION), "left")
    action = F.when(F.col("_kept"), "keep").otherwise("remove")
    return flagged.withColumn("action", action).drop("_kept")


def removals(messages, strategy="newest"):
    """Rows a dedup removes."""
    winners = kept(_slim(messages), strategy).select(*LOCATION)
    return messages.join(winners, list(LOCATION), "left_anti")


def id_counts(messages):
    """Ids that occur more than once, with their number of rows."""
    return (messages.filter(F.col(ID).isNotNull()).groupBy(ID)
            .agg(F.count("*").alias("copies")).filter("copies > 1"))


def find_duplicates(messages):
    """Every location of every id that occurs more than once, one row per
    location. A group may be of any size, so it stays in rows."""
    listed = messages.select(
        ID, "gmail_id", *LOCATION, "mbox_length", C.effective_size().alias("size_bytes"),
        "archived_timestamp",
    )
    return listed.join(id_counts(messages), ID)


def duplicate_id_lists(messages):
    """Remote ids of each repeated message: one row per message and remote id,
    with the number of copies. A group may be of any size, so its ids stay in
    rows."""
    rows = messages.select(ID, "gmail_id").join(id_counts(messages), ID)
    return rows.distinct()


def _group_sizes(messages, strategy):
    """Per id: rows, bytes, and the bytes of the row that is kept."""
    _check(strategy)
    size = C.effective_size()
    with_id = messages.filter(F.col(ID).isNotNull())
    if strategy == "largest":
        return with_id.groupBy(ID).agg(
            F.count("*").alias("copies"), F.sum(size).alias("bytes"),
            F.max(size).alias("kept_bytes"))
    groups = with_id.groupBy(ID).agg(F.count("*").alias("copies"), F.sum(size).alias("bytes"))
    winners = _first_per_id(with_id.select(ID, *LOCATION, "archived_timestamp", "size_bytes",
                                           "mbox_length"), keep_order(strategy))
    return groups.join(winners.select(ID, size.alias("kept_bytes")), ID)


def _total(c):
    return F.coalesce(F.sum(c), F.lit(0))


def duplicate_report(messages, strategy="largest"):
    """Totals over the catalogue: one row."""
    repeated = F.col("copies") > 1
    groups = _group_sizes(messages, strategy)
    total = messages.agg(F.count("*")).scalar()
    return groups.agg(
        F.count_if(repeated).alias("duplicate_message_ids"),
        _total(F.when(repeated, F.col("copies"))).alias("total_duplicate_messages"),
        _total(F.col("copies") - 1).alias("messages_to_remove"),
        _total(F.col("bytes") - F.col("kept_bytes")).alias("space_recoverable"),
    ).select(total.alias("total_messages"), "*")


def duplicate_report_by_archive(messages, strategy="largest"):
    """Rows and bytes to remove per archive: what the archive holds minus what
    it keeps. No join of the copies is needed."""
    size = C.effective_size()
    slim = _slim(messages).filter(F.col(ID).isNotNull())
    held = slim.select("archive_file", F.lit(1).alias("n"), size.alias("b"))
    keeps = kept(slim, strategy).select("archive_file", F.lit(-1).alias("n"), (-size).alias("b"))
    return (
        held.unionByName(keeps).groupBy("archive_file")
        .agg(F.sum("n").alias("messages_to_remove"), F.sum("b").alias("space_recoverable"))
        .filter("messages_to_remove > 0")
    )


def dedup_summary(messages, strategy="newest", dry_run=True):
    """What a dedup removes, keeps and saves: one row."""
    return duplicate_report(messages, strategy).select(
        F.col("messages_to_remove").alias("messages_removed"),
        F.col("duplicate_message_ids").alias("messages_kept"),
        F.col("space_recoverable").alias("space_saved"),
        F.lit(dry_run).alias("dry_run"),
    )


# --------------------------------------------------------- merged raw messages


def merge_order(strategy):
    """Keep order among messages merged from several archives, whose input
    position is (source_number, mbox_offset)."""
    _check(strategy)
    lead = {
        "newest": [F.desc(C.sort_date(F.col("date")))],
        "largest": [F.desc("size_bytes")],
        "first": [],
    }[strategy]
    return lead + [F.asc("source_number"), F.asc("mbox_offset")]


def dedup_merged(messages, strategy="newest"):
    """One message per id out of merged archives."""
    return _first_per_id(messages, merge_order(strategy))


def first_seen(batch, order=None):
    """First occurrence of each id in a batch, by location unless told
    otherwise."""
    return _first_per_id(batch, order or [F.asc(c) for c in LOCATION])


def flag_seen(batch, order=None):
    """All rows of a batch with ``first`` true for the first of each id."""
    firsts = first_seen(batch.select(ID, *LOCATION), order)
    flags = firsts.select(*LOCATION, F.lit(True).alias("_first"))
    return batch.join(flags, list(LOCATION), "left").withColumn(
        "first", F.coalesce("_first", F.lit(False))).drop("_first")
