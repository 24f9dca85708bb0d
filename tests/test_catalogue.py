"""Dedup, matching, table changes and checks on small and on skewed tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mailspark import schema
from mailspark.functions import columns as C
from mailspark.operators import dedup as D
from mailspark.operators import index as I
from mailspark.operators import joins as J
from mailspark.operators import quality as QA
from mailspark.operators import reconcile as RC
from mailspark.operators import ranges as R
from mailspark.operators import reports as A
from mailspark.operators import tables as M
from mailspark.plans import workflows as WF
from tests.data import corpus, message, table


def day(n):
    return dt.datetime(2025, 1, n)


@pytest.fixture(scope="module")
def copies(spark):
    """Three copies of one message, two of another, one single, two without id."""
    rows = [
        message("a1", "<a>", "one.mbox", 0, 10, archived_timestamp=day(1), size_bytes=500),
        message("a2", "<a>", "two.mbox", 0, 10, archived_timestamp=day(3), size_bytes=100),
        message("a3", "<a>", "three.mbox", 0, 10, archived_timestamp=day(2), size_bytes=900),
        message("b1", "<b>", "one.mbox", 10, 70, archived_timestamp=day(1)),
        message(None, "<b>", "two.mbox", 10, 60, archived_timestamp=day(1)),
        message("c1", "<c>", "one.mbox", 20, 10, archived_timestamp=day(1), size_bytes=5),
    ]
    return table(spark, rows)


def at(df):
    return {(r.archive_file, r.mbox_offset) for r in df.collect()}


@pytest.mark.parametrize("strategy, kept_a", [
    ("newest", "two.mbox"), ("largest", "three.mbox"), ("first", "one.mbox")])
def test_strategies(copies, strategy, kept_a):
    kept = at(D.kept(copies, strategy))
    assert kept == {(kept_a, 0), ("one.mbox", 10), ("one.mbox", 20)}
    assert at(D.removals(copies, strategy)) == at(copies) - kept
    assert at(M.remove_copies(copies, strategy)) == kept


def test_unknown_strategy(copies):
    with pytest.raises(ValueError):
        D.kept(copies, "oldest")


def test_report(copies):
    row = D.duplicate_report(copies).collect()[0].asDict()
    assert row == {"total_messages": 6, "duplicate_message_ids": 2, "total_duplicate_messages": 5,
                   "messages_to_remove": 3, "space_recoverable": 500 + 100 + 60}
    by_archive = {r.archive_file: (r.messages_to_remove, r.space_recoverable)
                  for r in D.duplicate_report_by_archive(copies).collect()}
    assert by_archive == {"one.mbox": (1, 500), "two.mbox": (2, 160)}
    summary = D.dedup_summary(copies, "newest").collect()[0]
    assert (summary.messages_removed, summary.messages_kept, summary.space_saved) == (
        3, 2, 500 + 900 + 60)


def test_report_of_empty_table(spark):
    row = D.duplicate_report(table(spark, [])).collect()[0]
    assert list(row) == [0, 0, 0, 0, 0]
    assert D.find_duplicates(table(spark, [])).count() == 0


def test_ids_of_repeated_messages_stay_in_rows(spark):
    rows = [message(f"g{i:03d}", "<hot>", "a.mbox", i) for i in range(100)]
    rows += [message("g000", "<hot>", "b.mbox"), message("one", "<one>", "b.mbox", 1)]
    found = D.duplicate_id_lists(table(spark, rows)).collect()
    assert sorted(r.gmail_id for r in found) == [f"g{i:03d}" for i in range(100)]
    assert {(r.rfc_message_id, r.copies) for r in found} == {("<hot>", 101)}


def test_hot_id(spark):
    """A third of all rows share one id and one archive."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "<hot>").otherwise(
            F.concat(F.lit("<"), (F.col("id") / 2).cast("long"), F.lit(">")))
        .alias("rfc_message_id"),
        F.concat(F.lit("g"), "id").alias("gmail_id"),
        F.when(F.col("id") % 3 == 0, "hot.mbox").otherwise("cold.mbox").alias("archive_file"),
        F.col("id").alias("mbox_offset"), F.lit(1).cast("long").alias("mbox_length"),
        F.lit(1).cast("long").alias("size_bytes"),
        (F.lit("2024-01-01").cast("timestamp_ntz")
         + F.make_dt_interval(secs=F.col("id"))).alias("archived_timestamp"))
    distinct = df.select("rfc_message_id").distinct().count()
    assert D.kept(df).count() == distinct
    assert D.removals(df).count() == 30_000 - distinct
    assert D.find_duplicates(df).filter("rfc_message_id = '<hot>'").count() == 10_000
    hot = D.kept(df).filter("rfc_message_id = '<hot>'").collect()
    assert [r.mbox_offset for r in hot] == [29_997]


def test_first_seen_and_merge_order(spark):
    rows = [message("1", "<x>", "b.mbox", 0), message("2", "<x>", "a.mbox", 9),
            message("3", "<x>", "a.mbox", 4)]
    df = table(spark, rows)
    assert at(D.first_seen(df)) == {("a.mbox", 4)}
    merged = df.withColumn("source_number", F.when(F.col("archive_file") == "b.mbox", 0)
                           .otherwise(1)).withColumn("size_bytes", F.lit(1))
    assert at(D.dedup_merged(merged, "first")) == {("b.mbox", 0)}
    dated = merged.withColumn("date", F.when(F.col("mbox_offset") == 4, F.col(
        "archived_timestamp")))
    assert at(D.dedup_merged(dated, "newest")) == {("a.mbox", 4)}


# -------------------------------------------------------------- ordered ranges


def test_lengths_across_ranges(spark):
    places = [("a", o) for o in (0, 7, 8, 25, 26, 90)] + [("b", 3)]
    df = spark.createDataFrame(places, "archive_file string, mbox_offset long")
    sizes = spark.createDataFrame([("a", 100), ("b", 10)], "archive_file string, file_size long")
    got = {(r.archive_file, r.mbox_offset): r.mbox_length for r in
           R.lengths_from_offsets(df, sizes, range_bytes=8).collect()}
    assert got == {("a", 0): 7, ("a", 7): 1, ("a", 8): 17, ("a", 25): 1, ("a", 26): 64,
                   ("a", 90): 10, ("b", 3): 7}


def test_running_totals_of_a_hot_group(spark):
    df = spark.range(10_000).select(
        F.when(F.col("id") < 6_000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7))
        .alias("k"), (F.col("id") % 10).alias("day"), "id")
    order = [F.asc("day"), F.asc("id")]
    got = R.running_total(df, ["k"], order, F.lit(2), "before")
    assert got.filter("k = 'hot'").agg(F.max("before"), F.count_distinct("before")).collect()[
        0] == (11_998, 6_000)
    numbered = R.positions(df, [], order)
    assert numbered.agg(F.max("position"), F.count_distinct("position")).collect()[0] == (
        9_999, 10_000)
    rows = numbered.orderBy("position").select("day", "id").collect()
    assert rows == sorted(rows)


def test_batches(spark):
    df = spark.createDataFrame([(str(i),) for i in range(1, 6)], "id string")
    got = R.assign_batches(df, [F.asc("id")], 2).groupBy("batch").count().orderBy("batch").collect()
    assert [tuple(r) for r in got] == [(0, 2), (1, 2), (2, 1)]


# -------------------------------------------------------------------- matching


def test_incremental_filter(spark):
    known = table(spark, [message("a"), message(None, "<n>", offset=5)])
    ids = spark.createDataFrame([("a",), ("b",)], "gmail_id string")
    assert [r[0] for r in J.not_yet_archived(ids, known).collect()] == ["b"]
    assert J.not_yet_archived(ids, known, incremental=False).count() == 2
    assert tuple(J.archived_counts(ids, known).collect()[0]) == (1, 1)


def test_broadcast_only_below_the_bound(spark, monkeypatch):
    known, ids = table(spark, [message("a")]), spark.range(10).select(
        F.col("id").cast("string").alias("gmail_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def plan(df):
            return df._jdf.queryExecution().executedPlan().toString()

        assert "BroadcastHashJoin" in plan(J.lookup_messages(known, ids))
        monkeypatch.setattr(J, "BROADCAST_BYTES", 50)
        assert "BroadcastHashJoin" not in plan(J.lookup_messages(known, ids))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_compare_and_assert(spark):
    one = table(spark, [message("a"), message("b", offset=1)])
    two = table(spark, [message("b", offset=1), message("c", offset=2)])
    status = {r.rfc_message_id[1]: r.status for r in RC.compare_ids(one, two).collect()}
    assert status == {"a": "missing", "b": "ok", "c": "orphaned"}
    RC.assert_written(one, one)
    with pytest.raises(ValueError, match="lost"):
        RC.assert_written(two, one.filter("gmail_id = 'b'"))


def test_small_changes_leave_the_catalogue_in_place(spark, monkeypatch, tmp_path):
    """Neither upsert, delete nor move shuffles the catalogue for a small
    batch; past the bound they give the same rows by shuffle."""
    table(spark, [message(f"k{i}", f"<{i}>", "a.mbox", i) for i in range(6)]).write.parquet(str(tmp_path / "cat"))
    messages = spark.read.parquet(str(tmp_path / "cat"))
    batch = table(spark, [message("new", "<1>", "b.mbox", 0)])
    ids = spark.createDataFrame([("k1",), ("k2",), ("none",)], "gmail_id string")
    moves = spark.createDataFrame([("k3", "c.mbox", 7, 9)],
                                  "gmail_id string, archive_file string, mbox_offset long, mbox_length long")

    def made():
        return [M.upsert_messages(messages, batch), M.delete_messages(messages, ids),
                M.deleted_count(messages, ids), J.update_locations(messages, moves, ids)]

    def rows(frames):
        return [sorted(map(str, df.collect())) for df in frames]

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = made()
        for df in small:
            assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        kept = rows(small)
        monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
        shuffled = made()
        assert "SortMergeJoin" in shuffled[1]._jdf.queryExecution().executedPlan().toString()
        assert rows(shuffled) == kept
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [len(r) for r in kept] == [6, 4, 1, 4]


def test_append_and_upsert(spark):
    known = table(spark, [message("k", "<k>", "old.mbox", 0, subject="old")])
    batch = table(spark, [
        message("k2", "<k>", "new.mbox", 0, subject="new"), message("n", "<n>", "new.mbox", 1),
        message("n2", "<n>", "new.mbox", 2), message("bad", "<z>", "new.mbox", -1)])
    status = {r.gmail_id: (r.status, r.reason) for r in M.append_status(batch, known).collect()}
    assert status == {"k2": ("SKIPPED", "already_known"), "n": ("IMPORTED", None),
                      "n2": ("SKIPPED", "in_batch_duplicate"), "bad": ("FAILED", None)}
    unusable = batch.unionByName(table(spark, [message("null", "<y>", "new.mbox", 4)]).withColumn(
        "rfc_message_id", F.lit(None).cast("string")))
    assert [r.gmail_id for r in M.append_messages(unusable, known).collect()] == ["n"]
    assert {r.gmail_id for r in M.append_messages(unusable, known, False).collect()} == {
        "k2", "n", "n2"}
    every = M.append_status(batch, known, skip_duplicates=False)
    assert every.filter("status = 'IMPORTED'").count() == 3
    after = {r.rfc_message_id: r.subject for r in M.upsert_messages(known, batch).collect()}
    assert after["<k>"] == "new" and len(after) == 3


def test_delete(spark):
    df = table(spark, [message("a"), message("b", offset=1), message(None, "<n>", "x.mbox")])
    gone = spark.createDataFrame([("a",)], "gmail_id string")
    assert M.delete_messages(df, gone).count() == 2
    assert M.delete_messages(df, archive_file="x.mbox").count() == 2
    assert M.deleted_count(df, gone).collect()[0][0] == 1


def test_update_locations(spark):
    df = table(spark, [message("a"), message("b", offset=1), message("c", offset=2)])
    moves = spark.createDataFrame(
        [("a", "m.mbox", 50, 7)],
        "gmail_id string, archive_file string, mbox_offset long, mbox_length long")
    gone = spark.createDataFrame([("c",)], "gmail_id string")
    after = {r.gmail_id: (r.archive_file, r.mbox_offset, r.mbox_length)
             for r in J.update_locations(df, moves, gone).collect()}
    assert after == {"a": ("m.mbox", 50, 7), "b": ("a.mbox", 1, 100)}


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    for n in range(3):
        M.record_run(path, M.run_row(spark, "import", n, "a.mbox", at=day(n + 1)))
    M.record_run(path, M.run_row(spark, "repair", 9, notes="why", at=day(9)))
    rows = M.recent_runs(spark.read.parquet(path), 2).collect()
    assert [(r.query, r.messages_archived) for r in rows] == [("why", 9), ("import", 2)]


def test_sessions(spark):
    def event(s, kind, n, **more):
        row = dict.fromkeys(schema.SESSION_EVENTS.names)
        row.update(session_id=s, event=kind, event_time=day(n), **more)
        return tuple(row[c] for c in schema.SESSION_EVENTS.names)

    log = spark.createDataFrame([
        event("s1", "create", 1, target_file="f", query="q", message_ids=["a", "b"]),
        event("s1", "progress", 2, processed_count=1),
        event("s2", "create", 3, target_file="f", query="q", message_ids=["a"],
              compression="zstd"),
        event("s3", "create", 4, target_file="g", query="q", message_ids=[]),
        event("s3", "complete", 5),
        event("s4", "create", 4, target_file="g", query="q", message_ids=[]),
        event("s4", "delete", 5),
        event("s5", "create", 6, target_file="h", query="q", message_ids=[]),
        event("s5", "abort", 7),
        # What is over stays over; what never began, or is gone, stays away.
        event("s3", "progress", 8, processed_count=9), event("s5", "progress", 8),
        event("s4", "progress", 8), event("s4", "complete", 9), event("s6", "progress", 2),
        # A new creation starts anew.
        event("s7", "create", 1, target_file="old", query="x", message_ids=["a"]),
        event("s7", "progress", 2, processed_count=5), event("s7", "delete", 3),
        event("s7", "create", 0 + 4, target_file="new", query="x", message_ids=["b", "c"]),
    ], schema.SESSION_EVENTS)
    states = M.session_states(log)
    by_id = {r.session_id: r for r in states.collect()}
    assert set(by_id) == {"s1", "s2", "s3", "s5", "s7"}
    again = by_id["s7"]
    assert (again.target_file, again.processed_count, again.total_count, again.status) == (
        "new", 0, 2, "in_progress")
    assert by_id["s3"].processed_count == 9
    assert (by_id["s1"].processed_count, by_id["s1"].total_count) == (1, 2)
    assert by_id["s3"].status == "completed" and by_id["s5"].status == "aborted"
    assert [r.session_id for r in M.open_sessions(states).collect()] == ["s7", "s2", "s1"]
    assert M.latest_open_session(states, target_file="f").collect()[0].session_id == "s2"
    assert M.latest_open_session(states, query="q").collect()[0].session_id == "s1"
    assert M.latest_open_session(states, query="q", compression="zstd").collect()[
        0].session_id == "s2"
    assert M.latest_open_session(states, target_file="none").count() == 0


def test_session_log(spark, tmp_path):
    path = str(tmp_path / "log")
    M.record_event(path, M.session_event(spark, "s", "create", day(1), target_file="f", query="q",
                                         message_ids=["a", "b", "c"]))
    M.record_event(path, M.session_event(spark, "s", "progress", day(2), processed_count=2))
    row = M.session_states(spark.read.parquet(path)).collect()[0]
    assert (row.status, row.processed_count, row.total_count) == ("in_progress", 2, 3)
    with pytest.raises(ValueError):
        M.session_event(spark, "s", "explode")


def test_accounts(spark):
    accounts = spark.createDataFrame(
        [("default", "me@example.com", "Me")], schema.ACCOUNTS)
    rows = J.attach_account(table(spark, [message("a"), message("b", account_id="x")]), accounts)
    assert {r.gmail_id: r.email for r in rows.collect()} == {"a": "me@example.com", "b": None}


# --------------------------------------------------------------------- reports


def test_null_remote_ids_are_one_violation(spark):
    df = table(spark, [message(None, "<1>"), message(None, "<2>", offset=1), message("a", "<3>")])
    got = {r.key: r.violations for r in A.key_violations(df).collect()}
    assert got == {"gmail_id": 1, "rfc_message_id": 0}


def test_compression_summary_of_nothing(spark):
    files = spark.createDataFrame(
        [("a.gz", 10, 0, True)],
        "source_file string, original_size long, compressed_size long, skipped boolean")
    row = A.compression_summary(files).collect()[0]
    assert (row.files_compressed, row.files_skipped, row.compression_ratio) == (0, 1, 0.0)
    assert A.offset_accuracy(spark.createDataFrame([], "status string")).collect()[0][3] == 0.0


def test_consistency_health_and_repair(spark):
    messages = corpus(spark)
    postings, lengths = I.build_index(messages), I.doc_stats(messages)
    present = messages.select(F.col("archive_file").alias("path")).distinct()
    assert QA.check_integrity(messages, lengths, present).count() == 0
    assert QA.verify_consistency(messages, messages, lengths).filter("NOT passed").count() == 0
    rollup = A.health_rollup(QA.health_report(messages, lengths, present)).collect()[0]
    assert (rollup.overall_status, rollup.checks_passed, rollup.fixable_issues) == ("OK", 4, "")

    fewer = messages.filter("gmail_id <> 'swap'").unionByName(
        table(spark, [message("new", offset=-1, subject="Fresh word")]))
    report = QA.health_report(fewer, lengths, present.filter("path NOT LIKE '%winter%'"))
    assert {r.id: r.severity for r in report.collect()} == {
        "schema": "OK", "index": "WARNING", "archive_files": "WARNING", "offsets": "WARNING"}
    assert {r.id: r.fix for r in QA.planned_fixes(report).collect()} == {
        "index": "repair_index", "offsets": "backfill_offsets"}
    assert tuple(QA.repair_counts(fewer, lengths).collect()[0]) == (1, 1)
    repaired, repaired_lengths = I.repair_index(fewer, postings, lengths)
    assert I.compare_index(fewer, repaired_lengths).count() == 0
    assert sorted(map(str, repaired.collect())) == sorted(
        map(str, I.build_index(fewer).collect()))


def test_versions(spark):
    messages = corpus(spark)
    assert schema.schema_version(messages) == "1.3"
    assert schema.schema_version(messages.drop("date_raw")) == "1.1"
    assert schema.schema_version(messages, "1.2") == "1.2"
    assert schema.schema_version(messages, "9.9") == "unknown"
    legacy = spark.createDataFrame([], schema.LEGACY_MESSAGES)
    assert schema.schema_version(legacy) == "1.0"
    with pytest.raises(schema.SchemaError):
        WF.upgrade_catalogue(spark, legacy.select("checksum"))
    with pytest.raises(schema.SchemaError):
        WF.refuse_downgrade("1.3", "1.1")
    assert WF.upgrade_catalogue(spark, messages.drop("date_raw")).messages.count() == 9


def test_dedupe_job(copies):
    dry = WF.dedupe(copies, "largest")
    assert dry.messages.count() == 6
    assert dry.reports["plan"].filter("action = 'remove'").count() == 3
    assert WF.dedupe(copies, "largest", dry_run=False).messages.count() == 3


# --------------------------------------------------------------------- columns


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize("raw, want", [
    ("Wed, 7 Dec 2022 14:36:47 +0100", "2022-12-07 13:36:47"),
    ("7 Dec 22 14:36 EST", "2022-12-07 19:36:00"),
    ("Mon, 01 Jan 2024 00:00:00 GMT", "2024-01-01 00:00:00"),
    ("Mon, 01 Jan 2024 00:00:00 -0000 (UTC)", "2024-01-01 00:00:00"),
    ("Sun, 06 Nov 94 08:49:37 -0730", "1994-11-06 16:19:37"),
    ("2024-01-15T10:00:00", "2024-01-15 10:00:00"),
    ("Mon, 30 Feb 2024 00:00:00 +0000", None),
    ("junk", None), ("", None), (None, None),
])
def test_dates(spark, raw, want):
    got = value(spark, C.parse_mail_date(F.lit(raw).cast("string")))
    assert (str(got) if got else None) == want


def test_short_date(spark):
    shown = [value(spark, C.short_date(F.lit(d).cast("string"))) for d in
             ("Wed, 7 Dec 2022 14:36:47 +0100", "not a date at all!", None)]
    assert shown == ["2022-12-07 14:36", "not a date at al", ""]


@pytest.mark.parametrize("age, want", [
    ("3y", "2021-02-28 10:00:00"), ("1m", "2024-01-29 10:00:00"), ("2W", "2024-02-15 10:00:00"),
    ("30d", "2024-01-30 10:00:00"), ("2024-01-01", "2024-01-01 00:00:00")])
def test_age(spark, age, want):
    as_of = F.lit("2024-02-29 10:00:00")
    assert str(value(spark, C.age_cutoff(age, as_of))) == want


@pytest.mark.parametrize("age", ["", "0d", "10000d", "3x", "y3", "2024-02-30", "-1d", None])
def test_bad_age(age):
    with pytest.raises(ValueError):
        C.age_cutoff(age)


@pytest.mark.parametrize("size, want", [
    (0, "0.0 B"), (1023, "1023.0 B"), (1024, "1.0 KB"), (1280, "1.2 KB"), (1792, "1.8 KB"),
    (1048576, "1.0 MB"), (2**60, "1024.0 PB")])
def test_format_bytes(spark, size, want):
    assert value(spark, C.format_bytes(F.lit(size).cast("long"))) == want


@pytest.mark.parametrize("name, want", [
    ("archive_2025.mbox", "archive_2025.mbox"), ("../../etc/passwd", "passwd"),
    ("a b:c.txt", "a_b_c.txt"), (" .. ", "_.._"), ("...", None), ("größe.mbox", "größe.mbox"),
    ("x" * 300 + ".mbox", "x" * 250 + ".mbox"), ("x" * 300, "x" * 255)])
def test_safe_filename(spark, name, want):
    assert value(spark, C.safe_filename(F.lit(name))) == want


def test_previews_and_codecs(spark):
    def shown(text):
        return value(spark, C.truncate_preview(F.lit(text).cast("string")))

    assert shown(None) == shown("") == "(no preview)"
    assert shown(" a ") == "a" and shown("x" * 201) == "x" * 200 + "..."
    assert value(spark, C.compression_of(F.lit("A.MBOX.LZMA"))) == "lzma"
    assert value(spark, C.compression_of(F.lit("a.mbox"))) is None
    assert C.validate_compression(" ZSTD ") == "zstd" and C.validate_compression(None) is None
    with pytest.raises(ValueError):
        C.validate_compression("bz2")
