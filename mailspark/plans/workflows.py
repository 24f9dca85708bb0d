"""The jobs a user calls, composed of the operators. Each one writes new table
versions; no input is overwritten."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailspark import schema
from mailspark.functions import columns as C
from mailspark.operators import dedup as D
from mailspark.operators import index as I
from mailspark.operators import joins as J
from mailspark.operators import quality as Q
from mailspark.operators import reconcile as RC
from mailspark.operators import reports as A
from mailspark.operators import search as S
from mailspark.operators import segments as SG
from mailspark.operators import tables as M
from mailspark.operators.parse import parse_messages
from mailspark.schema import LOCATION
from mailspark.session import written
from mailspark.sources import archives as IO
from mailspark.sources import mbox
from mailspark.sources import tables as T


@dataclass
class Outcome:
    """Rows a job made or would make, and its report tables."""

    messages: DataFrame | None = None
    reports: dict = field(default_factory=dict)
    index: SG.SegmentedIndex | None = None


def import_archives(spark, paths, messages, mapping=None, skip_duplicates=True,
                    account_id="default", archived_at=None, catalogue_path=None, runs_path=None):
    """Messages of mbox archives that the catalogue lacks. One scan parses
    everything; duplicates are found on the slim rows. ``status`` has one row
    per scanned message."""
    files = mbox.require_sources(paths)
    parsed = parse_messages(mbox.read_mbox(spark, paths, files=files), account_id, archived_at)
    parsed = written(parsed, "parsed")
    if mapping is not None:
        parsed = J.attach_remote_ids(parsed, mapping)
    flagged = M.append_status(parsed, messages, skip_duplicates)
    if mapping is not None:
        flagged = written(flagged, "status")
    imported = flagged.filter("status = 'IMPORTED'").select(*schema.MESSAGES.names)
    per_file = A.import_summary(flagged)
    if catalogue_path:
        T.write_catalogue(imported, catalogue_path)
    if runs_path:
        _record_imports(per_file, account_id, runs_path, archived_at)
    return Outcome(imported, {"status": flagged, "per_file": per_file,
                              "totals": A.import_totals(per_file)})


#: Columns of the index of an archive: whole texts, not their previews.
WHOLE = ("subject", "from_addr", "to_addr", "body")


def index_archives(spark, paths, path, columns=WHOLE, stemmed=True, buckets=SG.BUCKETS):
    """Builds the text index of archives from the whole texts of their
    messages, under ``path``, and opens it. Each message is parsed once."""
    index = SG.create(spark, path, columns, stemmed, buckets)
    return index.add(written(_whole_texts(spark, paths, columns), "texts"))


def _whole_texts(spark, paths, columns):
    files = mbox.require_sources(paths)
    parsed = parse_messages(mbox.read_mbox(spark, paths, files=files), whole_body=True)
    return parsed.filter("parse_error IS NULL").select(*LOCATION, *columns)


def index_more(spark, paths, index):
    """The next version of an index, with what it lacks of these archives.
    Earlier segments stay; segments of like size are merged."""
    held = index.docs().select(*LOCATION)
    texts = _whole_texts(spark, paths, index.columns).join(held, list(LOCATION), "left_anti")
    return index.add(written(texts, "texts")).merge()


def _record_imports(per_file, account_id, runs_path, at):
    at = F.localtimestamp() if at is None else at
    M.record_run(runs_path, per_file.filter("imported > 0").select(
        at.cast("timestamp_ntz").alias("run_timestamp"), F.lit("import").alias("query"),
        F.col("imported").alias("messages_archived"), "archive_file",
        F.lit(account_id).alias("account_id"), F.lit("import").alias("operation_type")))


def archive_incremental(landed, messages, age, folder, as_of=None, incremental=True,
                        compression=None, archived_at=None, dry_run=False, shards=None):
    """Archives landed remote messages older than an age that the catalogue
    lacks, and names the ids that may then be deleted remotely: those whose
    written bytes read back as the right message.

    Mail without a readable date has no age and stays where it is; it is
    listed in the report ``undated``, what cannot be parsed in ``failed``.

    Landed bodies are read twice: parsed into slim rows, on which everything
    is settled, and once more to be written. Only id, shard and order of a
    message travel to its bytes."""
    parsed = written(parse_messages(landed, archived_at=archived_at), "parsed")
    usable = parsed.filter("parse_error IS NULL")
    reports = {
        "failed": parsed.filter("parse_error IS NOT NULL").select("gmail_id", "parse_error"),
        "undated": usable.filter("date IS NULL").select("gmail_id", "rfc_message_id", "date_raw"),
    }
    slim = S.older_than(usable, age, as_of)
    fresh = J.not_yet_archived(slim, messages, incremental)
    firsts = D.first_seen(fresh.select("rfc_message_id", "gmail_id"), [F.asc("gmail_id")])
    known = J.known_among(messages, slim, "rfc_message_id")
    wanted = firsts.join(known, "rfc_message_id", "left_anti").select("gmail_id")
    chosen = written(slim.join(wanted, "gmail_id", "left_semi"), "chosen")
    if dry_run:
        reports["plan"] = chosen.agg(F.count("*").alias("to_archive"))
        return Outcome(chosen, reports)
    order = ["date", "rfc_message_id", "gmail_id"]
    keys, count, pieces = IO.assign_shards(
        chosen.select(*order, "from_addr", "size_bytes"), [F.col(c) for c in order], "size_bytes",
        shards=shards)
    keys = written(keys.drop("size_bytes"), "keys")
    rows = landed.select("gmail_id", "raw").join(J.keys_for_join(keys), "gmail_id")
    placed = IO.write_mbox(rows, folder, order, compression, shards=count, pieces=pieces)
    RC.assert_written(chosen, placed)
    made = placed.select("gmail_id", *IO.MADE)
    catalogue = chosen.drop(*IO.MADE).join(made, "gmail_id").select(*schema.MESSAGES.names)
    checked = written(IO.verify_offsets(catalogue), "checked")
    reports.update(checked=checked, accuracy=A.offset_accuracy(checked),
                   deletable=checked.filter("status = 'ok'").select("gmail_id"))
    return Outcome(catalogue, reports)


def dedupe(messages, strategy="newest", dry_run=True):
    """Report, plan and result of a dedup."""
    reports = {
        "duplicates": D.find_duplicates(messages),
        "report": D.duplicate_report(messages),
        "by_archive": D.duplicate_report_by_archive(messages),
        "summary": D.dedup_summary(messages, strategy, dry_run),
        "plan": M.dry_run(messages, strategy),
    }
    return Outcome(messages if dry_run else M.remove_copies(messages, strategy), reports)


def merge_archives(spark, sources):
    """Messages of several archives with ``source_number``, the position of the
    source among the given ones. A missing source is an error."""
    sources = list(sources)
    files = mbox.require_sources(sources)
    return _numbered(mbox.read_mbox(spark, sources, files=files), files)


def consolidate(spark, sources, messages, folder, sort_by_date=True, deduplicate=True,
                strategy="newest", compression=None, shards=None):
    """Merges archives into one folder of shards and repoints the catalogue.

    Headers are parsed once. Which messages stay, and the shard and order of
    each, is settled on slim rows. Then the raw bytes meet their slim rows by
    location and go straight to their shard; if the slim rows are few they are
    sent to all tasks, so that raw bytes move only once."""
    sources = list(sources)
    files = mbox.require_sources(sources)
    raw = mbox.read_mbox(spark, sources, files=files)
    slim = parse_messages(raw).select(
        "rfc_message_id", *LOCATION, "mbox_length", "date", "from_addr", "size_bytes")
    merged = _files(spark, files).select("archive_file")
    slim = written(J.attach_catalogue(_numbered(slim, files), messages, merged), "merge")
    kept = D.dedup_merged(slim, strategy) if deduplicate else slim
    order = ["source_number", *LOCATION]
    if sort_by_date:
        kept = kept.withColumn("sort_date", C.sort_date(F.col("date")))
        order = ["sort_date"] + order
    kept, count, pieces = IO.assign_shards(
        kept, [F.col(c) for c in order], "mbox_length", shards=shards)
    kept = written(kept.drop("mbox_length", "size_bytes"), "kept")
    rows = raw.select(*LOCATION, "raw").join(J.keys_for_join(kept), list(LOCATION))
    rows = rows.withColumnsRenamed(
        {"archive_file": "source_archive", "mbox_offset": "source_offset"})
    order = ["source_archive" if c == "archive_file" else "source_offset" if c == "mbox_offset"
             else c for c in order]
    placed = IO.write_mbox(rows, folder, order, compression, shards=count, pieces=pieces)
    RC.assert_written(kept, placed)
    kept_at = kept.select(*LOCATION, F.lit(True).alias("_kept"))
    flagged = slim.join(kept_at, list(LOCATION), "left").withColumn(
        "kept", F.coalesce("_kept", F.lit(False))).drop("_kept")
    catalogue = _moved(messages, placed, J.keys_for_join(merged))
    return Outcome(catalogue, {
        "summary": A.consolidation_summary(
            flagged.withColumn("source_archive", F.col("archive_file"))),
        "locations": placed, "merged": flagged})


def _files(spark, files):
    return spark.createDataFrame(
        [(name, number) for name, _, number in files], "archive_file string, source_number int")


def _numbered(rows, files):
    """Adds the position of the source a row was read from: the first one that
    names its file."""
    return rows.join(J.keys_for_join(_files(rows.sparkSession, files)), "archive_file")


def _moved(messages, placed, source_files):
    """Catalogue after a merge: of the rows in merged archives those that were
    kept remain, at their new place."""
    outside = messages.join(source_files, "archive_file", "left_anti")
    targets = placed.select(
        F.col("source_archive").alias("archive_file"), "source_offset",
        F.struct(*LOCATION, "mbox_length").alias("_to"))
    inside = messages.join(
        targets, (messages["archive_file"] == targets["archive_file"])
        & (messages["mbox_offset"] == targets["source_offset"]))
    inside = inside.select(*[
        F.col(f"_to.{c}").alias(c) if c in (*LOCATION, "mbox_length") else messages[c]
        for c in messages.columns])
    return outside.select(*messages.columns).unionByName(inside)


def status(messages, runs=None, limit=10):
    """Totals of the catalogue, its archives, and the latest runs."""
    reports = {"totals": A.archive_stats(messages), "archives": A.archive_list(messages)}
    if runs is not None:
        reports["runs"] = M.recent_runs(runs, limit)
    return Outcome(messages, reports)


def compress(spark, files, messages, compression="zstd", dry_run=False, in_place=False,
             keep_original=True):
    """Compresses archives and points the catalogue at the new files."""
    results = IO.compress_archives(
        spark, files, compression, dry_run, in_place=in_place, keep_original=keep_original)
    if not dry_run:
        messages = IO.repoint(messages, results)
    return Outcome(messages, {"files": results, "summary": A.compression_summary(results)})


def validate_archives(archived, messages):
    """Per archive: counts agree, at least one message parses, the same ids on
    both sides, and every catalogue row has the checksum of the message that
    stands at its place. ``archived`` are parsed messages of the archives."""
    expected = messages.groupBy("archive_file").agg(F.count("*").alias("expected"))
    counted = A.count_messages(archived, expected)
    readable = archived.groupBy("archive_file").agg(
        (F.count_if(F.col("parse_error").isNull()) > 0).alias("integrity_check"))
    ids = RC.differing_ids(archived, messages).groupBy("archive_file").agg(
        F.lit(True).alias("_differs"))
    sums = IO.compare_checksums(archived, messages).groupBy("archive_file").agg(
        (F.count_if(F.col("status") != "ok") == 0).alias("spot_check"))
    out = counted.select("archive_file", "actual", "expected",
                         F.col("count_matches").alias("count_check"))
    for part in (readable, ids, sums):
        out = out.join(part, "archive_file", "left")
    # An archive without a differing id holds the same ids on both sides.
    agree = F.col("_differs").isNull() & F.col("archive_file").isNotNull()
    out = out.withColumn("database_check", agree).drop("_differs")
    checks = ["count_check", "integrity_check", "database_check", "spot_check"]
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in checks})
    passed = F.lit(True)
    for c in checks:
        passed = passed & F.col(c)
    return out.withColumn("passed", passed)


def verify(spark, paths, messages, indexed, present):
    """All checks of a catalogue against its archives and index."""
    archived = written(parse_messages(mbox.read_mbox(spark, paths)), "parsed")
    checked = written(IO.verify_offsets(messages), "checked")
    return Outcome(messages, {
        "archives": validate_archives(archived, messages),
        "consistency": Q.verify_consistency(messages, archived, indexed),
        "integrity": Q.check_integrity(messages, indexed, present),
        "offsets": checked, "accuracy": A.offset_accuracy(checked),
        "health": Q.health_report(messages, indexed, present)})


def _holding(paths, names):
    """The files among the paths that a table names (archive_file). The driver
    lists the files anyway."""
    wanted = {r.archive_file for r in names.select("archive_file").distinct().collect()}
    return [f for f in mbox.require_sources(paths) if f[0] in wanted]


def repair(spark, paths, messages, postings=None, lengths=None, backfill=True, dry_run=True,
           index=None, **options):
    """Index orphans dropped, missing messages indexed, and bad locations
    filled in from the archives. A dry run only counts.

    The index is either given as tables, which are made anew, or as a stored
    ``index``: then only tombstones and a segment of what was missing are
    written, and the next version is in the outcome. Of the archives only
    those that hold a bad row or a missing message are read."""
    held = lengths if index is None else index.docs()
    reports = {
        "index": Q.repair_counts(messages, held),
        "offsets": S.invalid_offsets(messages).agg(F.count("*").alias("invalid_offsets")),
    }
    if dry_run:
        return Outcome(messages, reports, index)
    if backfill:
        files = _holding(paths, S.invalid_offsets(messages))
        repaired = messages.withColumn("backfilled", F.lit(False))
        if files:
            archived = written(parse_messages(mbox.read_mbox(spark, paths, files=files)), "parsed")
            repaired = written(J.backfill_offsets(messages, archived), "repaired")
        reports["backfilled"] = repaired.agg(F.count_if("backfilled").alias("backfilled"))
        messages = repaired.drop("backfilled")
    if index is not None:
        index = _synced(spark, paths, messages, index)
    else:
        reports["postings"], reports["lengths"] = I.repair_index(messages, postings, lengths, **options)
    return Outcome(messages, reports, index)


def _synced(spark, paths, messages, index):
    """The index without orphans and with what it lacked, from the texts in
    the archives."""
    differing = written(index.differences(messages), "differing")
    index = index.drop(differing.filter("status = 'orphaned'"))
    missing = differing.filter("status = 'missing'").select(*LOCATION)
    files = _holding(paths, missing)
    if not files:
        return index
    texts = parse_messages(mbox.read_mbox(spark, paths, files=files), whole_body=True).select(
        *LOCATION, *index.columns)
    return index.add(written(texts.join(J.keys_for_join(missing), list(LOCATION), "left_semi"), "texts"))


def upgrade_catalogue(spark, catalogue, declared_version=None, paths=None, account_id="default"):
    """Catalogue in the current version. A 1.0 catalogue is paired with the
    messages of its archives by position; 1.1 and later only gain columns.
    Unknown versions are refused."""
    version = schema.schema_version(catalogue, declared_version)
    if version in ("1.1", "1.2", "1.3"):
        return Outcome(T.conform(catalogue, version), {})
    if version != "1.0" or not paths:
        raise schema.SchemaError(f"cannot upgrade catalogue version {version}")
    archived = written(
        parse_messages(mbox.read_mbox(spark, paths), account_id), "parsed")
    paired = J.zip_legacy(catalogue, archived.drop("archived_timestamp"))
    messages = paired.withColumn(
        "archived_timestamp", F.col("archived_timestamp").try_cast("timestamp_ntz"))
    return Outcome(messages.select(*schema.MESSAGES.names),
                   {"skipped": J.zip_leftovers(catalogue, archived)})


def refuse_downgrade(current, wanted):
    if schema.VERSIONS.index(wanted) < schema.VERSIONS.index(current):
        raise schema.SchemaError(f"cannot go back from version {current} to {wanted}")
