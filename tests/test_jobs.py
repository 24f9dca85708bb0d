"""File jobs end to end, streaming, and the shape of plans."""

import base64
import datetime as dt
import json
import mailbox
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from mailspark import schema, views
from mailspark.operators import dedup as D
from mailspark.operators import index as I
from mailspark.operators import parse as P
from mailspark.operators import search as Q
from mailspark.plans import workflows as WF
from mailspark.sources import archives as IO
from mailspark.sources import mbox
from mailspark.sources import tables as T
from mailspark.streaming import imports
from tests.data import mail, mbox_text, table


@pytest.fixture()
def box(tmp_path):
    """Two plain archives that share a message, and one compressed."""
    import gzip

    (tmp_path / "a.mbox").write_bytes(mbox_text([mail(1), mail(2), mail(3, body=">From me\n")]))
    (tmp_path / "b.mbox").write_bytes(mbox_text([mail(2), mail(9), mail(4, date="not a date")]))
    (tmp_path / "c.mbox.gz").write_bytes(gzip.compress(mbox_text([mail(5), mail(1)])))
    return tmp_path


def catalogue(spark, box):
    rows = P.parse_messages(mbox.read_mbox(spark, f"{box}/*.mbox*"),
                            archived_at=F.lit("2025-01-01"))
    return rows.withColumn("gmail_id", F.concat(
        F.lit("g"), F.regexp_extract("rfc_message_id", r"(\d+)", 1), F.lit("-"),
        F.substring(F.element_at(F.split("archive_file", "/"), -1), 1, 1)))


def names(df):
    return sorted(r.rfc_message_id for r in df.select("rfc_message_id").collect())


def test_import(spark, box):
    empty = table(spark, [])
    mapping = spark.createDataFrame([("m1@example.com", "remote1")],
                                    "message_key string, gmail_id string")
    out = WF.import_archives(spark, f"{box}/*.mbox*", empty, mapping,
                             catalogue_path=str(box / "cat"), runs_path=str(box / "runs"))
    totals = out.reports["totals"].collect()[0].asDict()
    assert totals == {"total_files": 3, "total_imported": 6, "total_skipped": 2,
                      "total_failed": 0, "total_gmail_ids_found": 1,
                      "total_gmail_ids_not_found": 5}
    stored = T.read_catalogue(spark, str(box / "cat"))
    assert names(stored) == [f"<m{i}@example.com>" for i in (1, 2, 3, 4, 5, 9)]
    assert spark.read.parquet(str(box / "runs")).agg(F.sum("messages_archived")).collect()[
        0][0] == 6
    again = WF.import_archives(spark, str(box / "a.mbox"), stored)
    assert again.messages.count() == 0
    both = WF.import_archives(spark, str(box / "a.mbox"), stored, skip_duplicates=False)
    assert both.messages.count() == 3
    with pytest.raises(FileNotFoundError):
        WF.import_archives(spark, str(box / "none.mbox"), empty)


def test_extract_verify_validate(spark, box):
    messages = catalogue(spark, box)
    raw = {(r.archive_file, r.mbox_offset): bytes(r.raw)
           for r in IO.extract_messages(messages.select(*schema.LOCATION, "mbox_length")).collect()}
    plain = (box / "a.mbox").read_bytes()
    first = raw[(str(box / "a.mbox"), 0)]
    assert plain.startswith(first) and len(raw) == 8
    assert IO.verify_offsets(messages).filter("status <> 'ok'").count() == 0
    wrong = messages.withColumns({
        "mbox_offset": F.when(F.col("gmail_id") == "g1-a", 5).when(
            F.col("gmail_id") == "g2-a", -1).otherwise(F.col("mbox_offset")),
        "mbox_length": F.when(F.col("gmail_id") == "g9-b", 10**6).otherwise(F.col("mbox_length")),
        "archive_file": F.when(F.col("gmail_id") == "g2-b", "/gone.mbox").otherwise(
            F.col("archive_file")),
        "rfc_message_id": F.when(F.col("gmail_id") == "g5-c", "<other>").otherwise(
            F.col("rfc_message_id"))})
    status = {r.gmail_id: r.status for r in IO.verify_offsets(wrong).collect()}
    assert status == {"g1-a": "id mismatch", "g2-a": "read error", "g3-a": "ok",
                      "g2-b": "read error", "g9-b": "length mismatch", "g4-b": "ok",
                      "g5-c": "id mismatch", "g1-c": "ok"}
    good = WF.validate_archives(messages, messages)
    assert good.filter("passed").count() == 3
    spoiled = messages.withColumn("checksum", F.when(
        F.col("gmail_id") == "g1-a", "0").otherwise(F.col("checksum")))
    bad = WF.validate_archives(messages, spoiled).filter("NOT passed").collect()
    assert [(os.path.basename(r.archive_file), r.spot_check, r.count_check) for r in bad] == [
        ("a.mbox", False, True)]


def test_eml_files(spark, box):
    messages = catalogue(spark, box)
    wanted = spark.createDataFrame([("g1-a",), ("g5-c",), ("nobody",)], "gmail_id string")
    outcome = IO.write_eml(IO.extract_ids(messages, wanted), str(box / "eml"))
    assert tuple(IO.extraction_summary(outcome).collect()[0]) == (2, 1)
    assert sorted(p.name for p in (box / "eml").iterdir()) == ["g1-a.eml", "g5-c.eml"]
    assert b"Message-ID: <m5@example.com>" in (box / "eml" / "g5-c.eml").read_bytes()


@pytest.mark.parametrize("compression", [None, "gzip", "zstd"])
def test_consolidate(spark, box, compression):
    messages = catalogue(spark, box)
    sources = [str(box / n) for n in ("a.mbox", "b.mbox", "c.mbox.gz")]
    out = WF.consolidate(spark, sources, messages, str(box / "out"), shards=2,
                         compression=compression)
    row = out.reports["summary"].collect()[0].asDict()
    assert row == {"total_messages": 8, "duplicates_removed": 2, "messages_consolidated": 6,
                   "sources": 3}
    merged = P.parse_messages(mbox.read_mbox(spark, str(box / "out")))
    order = [r.rfc_message_id[2] for r in merged.orderBy(*schema.LOCATION).collect()]
    assert order == ["4", "1", "2", "3", "5", "9"]
    assert merged.select("archive_file").distinct().count() == 2
    # Equal dates tie; the earlier source wins, so the copies in a stay.
    assert sorted(r.gmail_id for r in out.messages.collect()) == [
        "g1-a", "g2-a", "g3-a", "g4-b", "g5-c", "g9-b"]
    assert IO.verify_offsets(out.messages).filter("status <> 'ok'").count() == 0
    if compression is None:
        ids = [m["Message-ID"] for f in sorted((box / "out").glob("part*"))
               for m in mailbox.mbox(str(f))]
        assert [i[2] for i in ids] == order
    with pytest.raises(FileNotFoundError):
        WF.consolidate(spark, [str(box / "none.mbox")], messages, str(box / "out2"))


def test_compress(spark, box):
    messages = catalogue(spark, box)
    files = [str(box / n) for n in ("a.mbox", "b.mbox", "c.mbox.gz")]
    dry = WF.compress(spark, files, messages, "lzma", dry_run=True)
    assert dry.reports["summary"].collect()[0].files_skipped == 1
    assert not list(box.glob("*.xz"))
    out = WF.compress(spark, files, messages, "lzma")
    assert sorted(p.name for p in box.glob("*.xz")) == ["a.mbox.xz", "b.mbox.xz"]
    assert IO.verify_offsets(out.messages).filter("status <> 'ok'").count() == 0
    again = WF.compress(spark, files, messages, "lzma").reports["summary"].collect()[0]
    assert (again.files_compressed, again.files_skipped) == (0, 3)
    with pytest.raises(FileNotFoundError):
        WF.compress(spark, [str(box / "none.mbox")], messages)
    with pytest.raises(ValueError):
        WF.compress(spark, [], messages)


@pytest.mark.parametrize("codec", ["gzip", "lzma", "zstd"])
def test_frames_join(spark, box, codec):
    rows = IO.compress_archives(spark, [str(box / "a.mbox")], codec, frame_bytes=100).collect()
    packed = mbox.read_mbox(spark, rows[0].dest_file).collect()
    plain = mbox.read_mbox(spark, str(box / "a.mbox")).collect()
    assert [(r.mbox_offset, bytes(r.raw)) for r in packed] == [
        (r.mbox_offset, bytes(r.raw)) for r in plain]


def test_archive_incremental(spark, box):
    import base64

    (box / "landed").mkdir()
    rows = [{"id": f"r{i}", "threadId": "t", "labelIds": ["INBOX"],
             "raw": base64.urlsafe_b64encode(mail(i)).decode()} for i in range(1, 10)]
    (box / "landed" / "x.json").write_text("\n".join(map(json.dumps, rows)))
    known = table(spark, []).unionByName(
        catalogue(spark, box).filter("gmail_id = 'g2-a'").withColumn("gmail_id", F.lit("r2"))
        .select(*schema.MESSAGES.names))
    landed = T.read_api_messages(spark, str(box / "landed"))
    as_of = F.lit("2024-01-20 00:00:00")
    dry = WF.archive_incremental(landed, known, "2w", str(box / "out"), as_of, dry_run=True)
    assert dry.reports["plan"].collect()[0][0] == 4
    out = WF.archive_incremental(landed, known, "2w", str(box / "out"), as_of, shards=1)
    assert sorted(r.gmail_id for r in out.reports["deletable"].collect()) == [
        "r1", "r3", "r4", "r5"]
    assert out.messages.columns == schema.MESSAGES.names
    assert [m["Message-ID"][2] for m in mailbox.mbox(str(box / "out" / "part-00000.mbox"))] == [
        "1", "3", "4", "5"]


def test_repair_and_upgrade(spark, box):
    messages = catalogue(spark, box).select(*schema.MESSAGES.names)
    spoiled = messages.withColumn("mbox_offset", F.when(
        F.col("gmail_id") == "g3-a", -1).otherwise(F.col("mbox_offset")))
    postings, lengths = I.build_index(messages), I.doc_stats(messages)
    dry = WF.repair(spark, str(box), spoiled, postings, lengths)
    assert dry.reports["offsets"].collect()[0][0] == 1
    out = WF.repair(spark, f"{box}/*.mbox*", spoiled, postings, lengths, dry_run=False)
    assert out.reports["backfilled"].collect()[0][0] == 1
    assert sorted(map(str, out.messages.collect())) == sorted(map(str, messages.collect()))

    legacy = spark.createDataFrame(
        [(f"old{i}", f"2024-02-0{i} 00:00:00", str(box / "a.mbox"), None, None, None, None)
         for i in range(1, 6)], schema.LEGACY_MESSAGES)
    new = WF.upgrade_catalogue(spark, legacy, paths=[str(box / "a.mbox")])
    pairs = {r.gmail_id: r.rfc_message_id for r in new.messages.collect()}
    assert pairs == {f"old{i}": f"<m{i}@example.com>" for i in (1, 2, 3)}
    assert new.reports["skipped"].collect()[0].skipped == 2


def test_verify_job(spark, box):
    messages = catalogue(spark, box)
    present = T.discover(spark, str(box), "*.mbox*")
    out = WF.verify(spark, f"{box}/*.mbox*", messages, I.doc_stats(messages), present)
    assert out.reports["accuracy"].collect()[0].accuracy_percentage == 100.0
    assert out.reports["health"].filter("severity <> 'OK'").count() == 0
    assert [r.issue for r in out.reports["integrity"].collect()] == ["duplicate_ids"]


# ------------------------------------------------------ what is stored is true


def landed(spark, mails):
    rows = [(f"g{i}", raw) for i, raw in enumerate(mails)]
    return spark.createDataFrame(rows, "gmail_id string, raw binary")


def test_archived_rows_describe_what_is_stored(spark, tmp_path):
    """Quoted lines and missing line breaks: checksum, size and location are
    those of the written message."""
    mails = [mail(1), mail(2, body="no line break"), mail(3, body="a\nFrom b\n\nFrom c\n"),
             mail(4, body=""), mail(5, message_id="", subject="No id")]
    empty = table(spark, [])
    out = WF.archive_incremental(landed(spark, mails), empty, "1d", str(tmp_path / "mail"))
    archived = P.parse_messages(mbox.read_mbox(spark, str(tmp_path / "mail"))).cache()
    report = WF.validate_archives(archived, out.messages).collect()
    assert report and all(r.passed for r in report)
    sizes = {r.rfc_message_id: r.size_bytes for r in archived.collect()}
    assert {r.rfc_message_id: r.size_bytes for r in out.messages.collect()} == sizes
    assert out.reports["deletable"].count() == 5


def test_every_message_is_compared(spark, box):
    messages = catalogue(spark, box)
    one = messages.filter("gmail_id = 'g3-a'").select(*schema.LOCATION).collect()[0]
    here = (F.col("archive_file") == one[0]) & (F.col("mbox_offset") == one[1])
    spoiled = messages.withColumn("checksum", F.when(here, "0").otherwise(F.col("checksum")))
    moved = messages.withColumn("mbox_offset", F.when(
        here, F.col("mbox_offset") + 1).otherwise(F.col("mbox_offset")))
    for wrong, status in ((spoiled, "checksum mismatch"), (moved, "missing")):
        found = IO.compare_checksums(messages, wrong).filter("status <> 'ok'").collect()
        assert [r.status for r in found] == [status]
        assert WF.validate_archives(messages, wrong).filter("NOT passed").count() == 1


def test_what_is_not_archived_is_reported(spark, tmp_path):
    mails = [mail(1), mail(2, date="some day"), mail(3, date="Mon, 01 Jan 2091 12:00:00 +0000")]
    out = WF.archive_incremental(landed(spark, mails), table(spark, []), "1d", str(tmp_path / "mail"))
    assert [r.gmail_id for r in out.messages.collect()] == ["g0"]
    assert [r.gmail_id for r in out.reports["undated"].collect()] == ["g1"]
    assert out.reports["failed"].count() == 0


def test_short_reads_are_failures(spark, box):
    messages = catalogue(spark, box).select("gmail_id", *schema.LOCATION, "mbox_length")
    wrong = messages.withColumns({
        "mbox_offset": F.when(F.col("gmail_id").isin("g1-a", "g5-c"), F.lit(10**7)).otherwise(
            F.col("mbox_offset")),
        "mbox_length": F.when(F.col("gmail_id") == "g9-b", F.lit(10**7)).otherwise(
            F.col("mbox_length"))})
    rows = {r.gmail_id: r for r in IO.extract_messages(wrong).collect()}
    failed = {g for g, r in rows.items() if r.status == "failed"}
    assert failed == {"g1-a", "g5-c", "g9-b"}
    assert all(rows[g].raw is None and "truncated" in rows[g].error for g in failed)


def test_generated_ids_are_recomputed(spark, tmp_path):
    mails = [mail(1, message_id=""), mail(2, message_id="", subject="Other")]
    (tmp_path / "a.mbox").write_bytes(mbox_text(mails))
    rows = P.parse_messages(mbox.read_mbox(spark, str(tmp_path / "a.mbox"))).cache()
    assert IO.verify_offsets(rows).filter("status = 'ok'").count() == 2
    wrong = rows.withColumn("rfc_message_id", F.lit("<0000@generated>"))
    assert IO.verify_offsets(wrong).filter("status = 'id mismatch'").count() == 2


def test_null_archives_keep_their_rows(spark):
    from mailspark.operators import ranges

    rows = spark.createDataFrame(
        [(None, 1, 10), (None, 2, 20), ("a", 1, 5)], "archive_file string, n int, size long")
    total = ranges.running_total(rows, ["archive_file"], [F.asc("n")], F.col("size"), "before")
    assert {(r.archive_file, r.n, r.before) for r in total.collect()} == {
        ("a", 1, 0), (None, 1, 0), (None, 2, 10)}


def test_eml_names_never_meet(spark, box):
    messages = catalogue(spark, box).withColumn("gmail_id", F.when(
        F.col("gmail_id") == "g1-a", "<x/1@h>").when(F.col("gmail_id") == "g3-a", "<y/1@h>"))
    ids = spark.createDataFrame([("<x/1@h>",), ("<y/1@h>",)], "gmail_id string")
    outcome = IO.write_eml(IO.extract_ids(messages, ids), str(box / "eml"))
    assert tuple(IO.extraction_summary(outcome).collect()[0]) == (2, 0)
    assert len(list((box / "eml").iterdir())) == 2


def test_extraction_aggregates_wanted_ids_only(spark, box):
    ids = spark.createDataFrame([("g1-a",)], "gmail_id string")
    text = plan(IO.extract_ids(catalogue(spark, box), ids))
    # The join with the wanted ids stands below the first aggregate over places.
    assert text.index("LeftSemi") > text.index("min(struct")


@pytest.mark.parametrize("options, stays", [
    ({}, True), ({"in_place": True}, False), ({"keep_original": False}, False)])
def test_compress_options(spark, box, options, stays):
    files = [str(box / "a.mbox"), str(box / "b.mbox")]
    dry = IO.compress_archives(spark, files, "zstd", dry_run=True, frame_bytes=300)
    sizes = {r.source_file: r.compressed_size for r in dry.collect()}
    done = IO.compress_archives(spark, files, "zstd", frame_bytes=300, **options).collect()
    assert {r.source_file: r.compressed_size for r in done} == sizes
    assert all(os.path.getsize(r.dest_file) == sizes[r.source_file] for r in done)
    assert all(os.path.exists(f) == stays for f in files)
    with pytest.raises(FileNotFoundError):
        IO.compress_archives(spark, [str(box / "none.mbox")])


def test_failed_attempts_leave_no_files(spark, tmp_path):
    from mailspark.sources.archives import Shard

    shard = Shard(str(tmp_path / "part.mbox"), 7, None)
    shard.write(b"x")
    shard.drop()
    Shard(str(tmp_path / "other.mbox"), 8, "zstd").publish()
    assert list(tmp_path.iterdir()) == []


def test_shared_folder_or_error():
    from types import SimpleNamespace

    from mailspark.session import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    conf = SimpleNamespace(get=lambda key, default=None: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


# ------------------------------------------------------------------- streaming


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    (tmp_path / "in").mkdir()

    def land(name, numbers):
        rows = [{"id": f"r{i}", "threadId": "t", "raw": base64.urlsafe_b64encode(
            mail(i % 28 + 1, message_id=f"<m{i}@x>")).decode()} for i in numbers]
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))

    def run():
        stream = imports.landed_json(spark, str(tmp_path / "in"), max_files=1)
        imports.import_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"),
                              watermark="1 second").awaitTermination()
        return names(imports.read_imported(spark, str(tmp_path / "out")))

    land("a.json", [1, 2, 3, 3])
    land("b.json", [3, 4])
    assert run() == [f"<m{i}@x>" for i in range(1, 5)]
    assert run() == [f"<m{i}@x>" for i in range(1, 5)]
    land("c.json", [1, 5, 2])  # repeats of a finished run
    assert run() == [f"<m{i}@x>" for i in range(1, 6)]


def test_batch_is_replaced_when_repeated(spark, tmp_path):
    write = imports.append_batch(str(tmp_path / "out"), "one")
    batch = spark.createDataFrame([("<a>",), ("<b>",)], "rfc_message_id string")
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_new_checkpoint_loses_nothing(spark, tmp_path):
    def land(name, numbers):
        rows = [{"id": f"g{n}", "threadId": "t", "labelIds": [], "raw": base64.urlsafe_b64encode(
            mail(n, message_id=f"<m{n}@x>")).decode()} for n in numbers]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(map(json.dumps, rows)))

    def run(state, out="out"):
        imports.import_stream(imports.landed_json(spark, str(tmp_path / "in")), str(tmp_path / out),
                              str(tmp_path / state)).awaitTermination()
        return sorted(r[0] for r in imports.read_imported(
            spark, str(tmp_path / out)).select("rfc_message_id").collect())

    land("a.json", [1, 2])
    assert run("state") == ["<m1@x>", "<m2@x>"]
    land("b.json", [2, 3])
    assert run("other") == ["<m1@x>", "<m2@x>", "<m3@x>"]
    imports.compact(spark, str(tmp_path / "out"), str(tmp_path / "compacted"))
    land("c.json", [1, 4])
    assert run("other", "compacted") == [f"<m{i}@x>" for i in range(1, 5)]


def test_later_batches_read_no_earlier_one(spark, tmp_path, monkeypatch):
    """Late copies are caught by the state, also after a restart; what cannot
    be parsed is written down, once."""
    (tmp_path / "in").mkdir()

    def land(name, rows):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(
            {"id": i, "threadId": "t", "raw": raw}) for i, raw in rows))

    def good(n):
        return f"g{n}", base64.urlsafe_b64encode(mail(n, message_id=f"<m{n}@x>")).decode()

    calls, earlier = [], imports._earlier
    monkeypatch.setattr(imports, "_earlier", lambda s, p, own: calls.append(own) or earlier(s, p, own))

    def run(state, out="out"):
        stream = imports.landed_json(spark, str(tmp_path / "in"), max_files=1)
        query = imports.import_stream(stream, str(tmp_path / out), str(tmp_path / state))
        query.awaitTermination()
        assert query.exception() is None
        return (names(imports.read_imported(spark, str(tmp_path / out))),
                sorted(r.gmail_id for r in imports.read_failures(spark, str(tmp_path / out)).collect()))

    land("a.json", [good(1), good(2), ("bad1", "%%%"), good(2)])
    land("b.json", [good(2), good(3), ("bad1", "%%%"), ("bad2", None)])
    bad = ["bad1", "bad2"]
    assert run("state") == ([f"<m{i}@x>" for i in (1, 2, 3)], bad)
    first = len(calls)
    assert [c for c in calls if c and not c.endswith("-000000000")] == []
    land("c.json", [good(1), good(4)])
    assert run("state") == ([f"<m{i}@x>" for i in (1, 2, 3, 4)], bad)
    assert len(calls) == first
    # Another checkpoint takes over: the ids of the catalogue fill its state.
    land("d.json", [good(4), good(5)])
    assert run("other")[0] == [f"<m{i}@x>" for i in range(1, 6)]
    land("e.json", [good(n) for n in range(1, 7)])
    calls.clear()
    assert run("other")[0] == [f"<m{i}@x>" for i in range(1, 7)]
    assert calls == []
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != imports.ROCKSDB


# ----------------------------------------------------------------------- plans


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedup_reduces_before_the_shuffle(spark, sf_dir):
    text = plan(D.kept(views.messages(spark, sf_dir)))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_searches_shuffle_no_rows(spark, sf_dir):
    m = views.messages(spark, sf_dir)
    for df in (Q.search_fulltext(m, "the and", stemmed=False), Q.search_metadata(m, "en@")):
        text = plan(df)
        assert "TakeOrderedAndProject" in text and "hashpartitioning" not in text
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir, tmp_path):
    T.write_catalogue(views.messages(spark, sf_dir), str(tmp_path / "cat"))
    rows = T.read_catalogue(spark, str(tmp_path / "cat"))
    text = plan(Q.filter_messages(rows, from_addr="en@src1.example.com",
                                  date_start="2024-01-02").select("gmail_id"))
    assert "EqualTo(from_addr,en@src1.example.com)" in text
    assert "GreaterThanOrEqual(date" in text
    assert "body_preview" not in text[text.index("ReadSchema"):]


def test_no_pair_joins_anywhere(spark, sf_dir):
    import __spark_entry__ as entry

    for name in ("find_duplicates", "dry_run", "split_new_known", "attach_catalogue",
                 "update_locations", "verify_consistency", "lengths_from_offsets"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_frames_are_spread(spark, box):
    """Each frame, and each file, has a task of its own, however small its row
    is."""
    files = [str(box / n) for n in ("a.mbox", "b.mbox")]
    todo = IO._targets(spark, files, "gzip")
    frames = IO._frames(todo, 200).withColumn("_at", F.spark_partition_id())
    rows = frames.collect()
    assert len(rows) == sum(-(-os.path.getsize(f) // 200) for f in files) > 3
    assert len({r._at for r in rows}) == len(rows)
    joined = IO._file_by_file(frames.drop("_at")).withColumn("_at", F.spark_partition_id()).collect()
    assert len({(r.source_file, r._at) for r in joined}) == 2 == len({r._at for r in joined})


def test_batches_are_bounded_in_bytes(spark, tmp_path):
    """What a Python worker holds at a time does not grow with long messages:
    reading, extraction and what Spark sends to a worker."""
    raw = b"Subject: long\n\n" + b"x" * 600_000 + b"\n"
    rows = [(f"<m{n}@x>", dt.datetime(2024, 1, 1, n), "a@x.example", raw) for n in range(20)]
    messages = spark.createDataFrame(
        rows, "rfc_message_id string, date timestamp_ntz, from_addr string, raw binary")
    placed = IO.write_mbox(messages, str(tmp_path / "a"))
    [path] = [p for p, _ in mbox.list_files(str(tmp_path / "a"))]
    batches = list(mbox.read_pieces(((path, 0, os.path.getsize(path)),)))
    assert sum(b.num_rows for b in batches) == 20 and max(b.nbytes for b in batches) < 4 << 20

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    for df in (mbox.read_mbox(spark, path).coalesce(1), IO.extract_messages(placed).coalesce(1)):
        got = df.mapInArrow(sizes, "rows long, bytes long").collect()
        assert sum(r.rows for r in got) == 20 and max(r.bytes for r in got) < 6 << 20


def test_tables_in_the_shared_folder_are_packed(spark, sf_dir):
    """Texts that are written down between steps take less than in the default codec."""
    from checks import stored_messages
    from mailspark.session import written

    def codecs(df):
        names = [n.removeprefix("file://") for n in df.inputFiles()]
        return {pq.ParquetFile(n).metadata.row_group(0).column(0).compression for n in names}

    assert codecs(written(spark.range(100), "numbers")) == {"ZSTD"}
    assert codecs(spark.read.parquet(stored_messages(spark, sf_dir))) == {"ZSTD"}
