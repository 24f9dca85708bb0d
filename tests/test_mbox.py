"""The mbox source against the mailbox module, at every way of cutting."""

import datetime as dt
import gzip
import io
import lzma
import mailbox
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from mailspark.operators import parse as P
from mailspark.sources import archives as IO
from mailspark.sources import mbox, storage
from mailspark.sources import tables as T
from tests.data import mail, mbox_text

ODD = (
    b"garbage before the first message\n\n"
    + mbox_text([mail(1, body="From the start\nFrom me\n>From you\n\n\n"), mail(2, body=""),
                 mail(3, body="no break at the end"), mail(4, body="a\nFromage\n\nFrom x\n")])
    + b"From a\n\nFrom b\nFrom c\n\n\n" + b"From last without end"
)
FILES = {"plain": mbox_text([mail(i, body="line\n" * i) for i in range(1, 30)]), "odd": ODD,
         "empty": b"", "no messages": b"just\ntext\n", "crlf": ODD.replace(b"\n", b"\r\n")}


def by_mailbox(path, size):
    box = mailbox.mbox(str(path))
    box.keys()
    toc = [box._toc[k] for k in box.keys()]
    data = path.read_bytes()
    out = []
    for i, (start, stop) in enumerate(toc):
        end = toc[i + 1][0] if i + 1 < len(toc) else size
        body = data[start:stop]
        out.append((start, end - start, body[body.find(b"\n") + 1:] if b"\n" in body else b""))
    return out


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("split", [1, 7, 64, 100, 1000, 1 << 20])
def test_ranges_equal_mailbox(tmp_path, monkeypatch, name, split):
    path = tmp_path / "x.mbox"
    path.write_bytes(FILES[name])
    monkeypatch.setattr(mbox, "CHUNK", 13)
    got = []
    for part in mbox.plan_splits([(str(path), len(FILES[name]))], split):
        for batch in mbox.read_pieces(part.pieces):
            got += [(r["mbox_offset"], r["mbox_length"], r["raw"]) for r in batch.to_pylist()]
    assert got == by_mailbox(path, len(FILES[name]))


def test_small_files_share_a_partition(tmp_path):
    packed = str(tmp_path / "c.mbox.gz")
    (tmp_path / "c.mbox.gz").write_bytes(gzip.compress(b"of one member without sizes"))
    files = [(f"f{i}.mbox", 10) for i in range(10)] + [("big.mbox", 95), (packed, 400)]
    splits = [s.pieces for s in mbox.plan_splits(files, 30)]
    assert sum(len(s) for s in splits) == 10 + 4 + 1
    assert max(len(s) for s in splits) == 3


def test_codecs(spark, tmp_path):
    data = FILES["plain"]
    (tmp_path / "a.mbox").write_bytes(data)
    (tmp_path / "b.mbox.gz").write_bytes(gzip.compress(data[:999]) + gzip.compress(data[999:]))
    (tmp_path / "c.mbox.xz").write_bytes(lzma.compress(data))
    (tmp_path / "d.mbox.lzma").write_bytes(lzma.compress(data, format=lzma.FORMAT_ALONE))
    buffer = io.BytesIO()
    for piece in (data[:500], data[500:]):
        buffer.write(zstandard.ZstdCompressor().compress(piece))
    (tmp_path / "e.mbox.zst").write_bytes(buffer.getvalue())
    rows = mbox.read_mbox(spark, str(tmp_path), split_bytes=300)
    per_file = {}
    for r in rows.orderBy("archive_file", "mbox_offset").collect():
        per_file.setdefault(r.archive_file[-9:], []).append(
            (r.mbox_offset, r.mbox_length, bytes(r.raw)))
    assert len(per_file) == 5
    assert all(v == by_mailbox(tmp_path / "a.mbox", len(data)) for v in per_file.values())


def test_paths_and_globs(spark, tmp_path):
    for n in ("a.mbox", "b.mbox", "c.txt", ".hidden.mbox"):
        (tmp_path / n).write_bytes(mbox_text([mail(1)]))
    (tmp_path / "sub" / "_tmp").mkdir(parents=True)
    for n in ("sub/d.mbox", "sub/.d.mbox.17", "sub/_tmp/e.mbox"):
        (tmp_path / n).write_bytes(mbox_text([mail(1)]))

    def files(*paths):
        rows = mbox.read_mbox(spark, [f"{tmp_path}/{p}" for p in paths]).select("archive_file")
        return sorted(os.path.relpath(r[0], tmp_path) for r in rows.distinct().collect())

    # Segment by segment, and never hidden files: they may be half written.
    assert files("*.mbox") == ["a.mbox", "b.mbox"] and files("*.mbox*") == ["a.mbox", "b.mbox"]
    assert files("*/*.mbox*") == files("sub/?.mbox") == ["sub/d.mbox"]
    assert files("") == ["a.mbox", "b.mbox", "c.txt", "sub/d.mbox"]
    assert mbox.read_mbox(spark, [f"{tmp_path}/a.mbox", f"{tmp_path}/c.txt"]).count() == 2
    assert mbox.read_mbox(spark, f"{tmp_path}/none*").count() == 0
    with pytest.raises(FileNotFoundError):
        mbox.require_sources([f"{tmp_path}/none.mbox"])


def test_discovery(spark, tmp_path):
    (tmp_path / "a.mbox").write_bytes(b"12345")
    (tmp_path / "b.mbox.zst").write_bytes(b"1")
    rows = T.discover(spark, str(tmp_path), "*.mbox*").orderBy("path").collect()
    assert [(r.path, r.size_bytes, r.compression) for r in rows] == [
        (f"{tmp_path}/a.mbox", 5, None), (f"{tmp_path}/b.mbox.zst", 1, "zstd")]
    wanted = spark.createDataFrame([(f"{tmp_path}/a.mbox",), ("/gone.mbox",)], "path string")
    listing = T.discover(spark, str(tmp_path))
    assert [r.path for r in T.missing_sources(wanted, listing).collect()] == ["/gone.mbox"]


def parsed(spark, *raws):
    df = spark.createDataFrame(
        [("a.mbox", i, len(r), bytearray(r)) for i, r in enumerate(raws)],
        "archive_file string, mbox_offset long, mbox_length long, raw binary")
    return P.parse_messages(df, whole_body=True).orderBy("mbox_offset").collect()


def test_parse_headers(spark):
    rows = parsed(
        spark,
        mail(1, extra="X-GM-THRID:  1234 \nReferences: <a@x> <b@x>\n"),
        mail(2, extra="References:  <a@x>\n <b@x>\nCc: c@example.com\n"),
        mail(3, message_id="", date="Tue, 02 Jan 2024 10:00:00 +0200"),
        mail(4, message_id="  <spaced@x>  "),
        mail(5, subject="Grüße", body="größer\n"),
        b"no header at all",
        b"",
    )
    assert rows[0].thread_id == "1234" and rows[0].rfc_message_id == "<m1@example.com>"
    assert rows[1].thread_id == "<a@x>" and rows[1].cc_addr == "c@example.com"
    assert rows[2].rfc_message_id.endswith("@generated>") and len(rows[2].rfc_message_id) == 76
    assert str(rows[2].date) == "2024-01-02 08:00:00"
    assert rows[3].rfc_message_id == "<spaced@x>" and rows[3].thread_id is None
    assert rows[4].subject == "Grüße" and rows[4].body == "größer\n"
    assert rows[5].rfc_message_id.endswith("@generated>") and rows[5].subject is None
    assert rows[6].size_bytes == 0


def test_parse_bodies(spark):
    multipart = (b"Message-ID: <m@x>\nContent-Type: multipart/alternative; boundary=b\n\n"
                 b"--b\nContent-Type: text/html\n\n<p>html</p>\n--b\nContent-Type: text/plain\n"
                 b"Content-Transfer-Encoding: base64\n\ncGxhaW4gcGFydA==\n--b--\n")
    quoted = (b"Message-ID: <q@x>\nContent-Transfer-Encoding: quoted-printable\n\n"
              b"caf=C3=A9 =\njoined")
    rows = parsed(spark, multipart, quoted, mail(1, body="x" * 5000), mail(2, body="ä" * 5000),
                  mail(3, body=""), b"Message-ID: <h@x>\nContent-Type: multipart/mixed; boundary=b\n"
                  b"\n--b\nContent-Type: text/html\n\n<p>\n--b--\n")
    assert rows[0].body == "plain part"
    assert rows[1].body == "café joined"
    assert rows[2].body_preview == "x" * 1000 and len(rows[2].body) == 5000
    assert rows[3].body_preview == "ä" * 1000
    assert rows[4].body_preview == "" and rows[5].body_preview == ""


def test_api_messages(spark, tmp_path):
    import base64
    import json

    raw = mail(1, body="ÿþ?>~\n" * 5)
    rows = [
        {"id": "1", "threadId": "t", "labelIds": ["INBOX"],
         "raw": base64.urlsafe_b64encode(raw).decode()},
        {"id": "2", "threadId": "t", "raw": base64.urlsafe_b64encode(raw).decode().rstrip("=")},
        {"id": "3", "threadId": "t", "raw": "*not base64*"},
    ]
    (tmp_path / "a.json").write_text("\n".join(json.dumps(r) for r in rows))
    got = T.read_api_messages(spark, str(tmp_path)).orderBy("gmail_id").collect()
    assert [bytes(r.raw) if r.raw else None for r in got] == [raw, raw, None]
    assert got[0].labels == ["INBOX"] and got[1].remote_thread_id == "t"


def test_conform_fills_and_refuses(spark):
    old = spark.createDataFrame(
        [("g", "<a>", "x.mbox", 0, 5, "Mon, 01 Jan 2024 00:00:00 +0000", '["A","B"]', "2024-01-01")],
        "gmail_id string, rfc_message_id string, archive_file string, mbox_offset long, "
        "mbox_length long, date string, labels string, archived_timestamp string")
    row = T.conform(old, "1.1").collect()[0]
    assert row.labels == ["A", "B"] and str(row.date) == "2024-01-01 00:00:00"
    assert row.date_raw.startswith("Mon")
    with pytest.raises(ValueError):
        T.conform(old.select("gmail_id"), None)
    assert old.select(F.lit(1)).columns


def test_filters_prune_files(spark, tmp_path):
    for n in "abc":
        (tmp_path / f"{n}.mbox").write_bytes(mbox_text([mail(1), mail(2)]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = mbox.read_mbox(spark, str(tmp_path), split_bytes=1 << 20)
        one = rows.filter(F.col("archive_file") == f"{tmp_path}/a.mbox")
        (tmp_path / "c.mbox").chmod(0)
        assert one.count() == 2
        two = rows.filter(F.col("archive_file").isin(f"{tmp_path}/a.mbox", f"{tmp_path}/b.mbox"))
        assert two.filter("mbox_offset > 0").count() == 2
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
    reader = mbox.PruningMboxReader({"path": str(tmp_path)})
    assert len(list(reader.pushFilters([mbox.EqualTo(("archive_file",), f"{tmp_path}/b.mbox")]))) == 1
    assert [p.pieces[0][0] for p in reader.partitions()] == [f"{tmp_path}/b.mbox"]


def test_zstd_with_frame_table_is_split(spark, tmp_path):
    """One large zstd file gives several partitions and the same rows; other
    readers skip the table."""
    mails = [mail(n % 28 + 1, message_id=f"<m{n}@x>", body=f"{n} " * 400 + "\n") for n in range(60)]
    plain = tmp_path / "a.mbox"
    plain.write_bytes(mbox_text(mails))
    IO.compress_archives(spark, [str(plain)], "zstd", frame_bytes=5000).collect()
    packed = f"{plain}.zst"
    table = mbox.seek_table(packed)
    assert len(table[0]) == -(-plain.stat().st_size // 5000) and table[2] == plain.stat().st_size
    whole = zstandard.ZstdDecompressor().stream_reader(open(packed, "rb"), read_across_frames=True)
    assert whole.read() == plain.read_bytes()
    files = [(packed, os.path.getsize(packed))]
    splits = mbox.plan_splits(files, 1000)
    assert len(splits) > 20
    rows = [(o, n) for s in splits for b in mbox.read_pieces(s.pieces)
            for o, n in zip(b.column("mbox_offset").to_pylist(), b.column("mbox_length").to_pylist())]
    want = [(r.mbox_offset, r.mbox_length) for r in mbox.read_mbox(spark, str(plain)).collect()]
    assert sorted(rows) == sorted(want) and len(want) == 60
    without = tmp_path / "b.mbox.zst"
    without.write_bytes(zstandard.ZstdCompressor().compress(plain.read_bytes()))
    assert mbox.seek_table(str(without)) is None
    assert len(mbox.plan_splits([(str(without), 10**9)], 1000)) == 1


def test_zstd_ranges_are_extracted_by_several_tasks(spark, tmp_path, monkeypatch):
    from mailspark.operators import ranges
    monkeypatch.setattr(ranges, "RANGE_BYTES", 4000)
    mails = [mail(n % 28 + 1, message_id=f"<m{n}@x>", body=f"{n} " * 300 + "\n") for n in range(40)]
    plain = tmp_path / "a.mbox"
    plain.write_bytes(mbox_text(mails))
    IO.compress_archives(spark, [str(plain)], "zstd", frame_bytes=3000).collect()
    located = mbox.read_mbox(spark, f"{plain}.zst").drop("raw")
    out = IO.extract_messages(located).withColumn("task", F.spark_partition_id()).collect()
    data = plain.read_bytes()
    assert all(bytes(r.raw) == data[r.mbox_offset:r.mbox_offset + r.mbox_length] for r in out)
    assert len(out) == 40 and all(r.status == "extracted" for r in out)


# -------------------------------------------------- other codecs by their frames


def many_mails(count=400):
    return mbox_text([mail(n, body=f"line {n}\n" * (n % 37) + "From here on\n") for n in range(count)])


def in_tasks(spark, path, **options):
    rows = mbox.read_mbox(spark, str(path), **options)
    return rows.rdd.getNumPartitions(), sorted(map(tuple, rows.select("mbox_offset", "mbox_length", "raw").collect()))


@pytest.mark.parametrize("codec", ["gzip", "lzma", "zstd"])
def test_frames_of_every_codec_are_split(spark, tmp_path, monkeypatch, codec):
    """A file of many frames gives the rows of the plain file from several
    partitions, and other tools read it."""
    monkeypatch.setattr(mbox, "SMALLEST_SPLIT", 1000)
    plain = tmp_path / "a.mbox"
    plain.write_bytes(many_mails())
    IO.compress_archives(spark, [str(plain)], codec, frame_bytes=5000).collect()
    packed = next(p for p in tmp_path.iterdir() if p.name.startswith("a.mbox."))
    with storage.open_decoded(str(packed)) as whole:
        assert whole.read() == plain.read_bytes()
    if codec == "gzip":
        assert gzip.decompress(packed.read_bytes()) == plain.read_bytes()
    want = in_tasks(spark, plain)[1]
    tasks, rows = in_tasks(spark, packed, split_bytes=4000)
    assert tasks > 2 and rows == want
    table = storage.seek_table(str(packed))
    assert table[2] == plain.stat().st_size and len(table[0]) > 5
    for offset in (0, 1, 4999, 5000, 5001, 40_000, table[2] - 1, table[2]):
        with storage.open_at(str(packed), offset, table) as stream:
            assert stream.read(700) == plain.read_bytes()[offset:offset + 700]


def test_xz_of_other_makers_is_split(spark, tmp_path, monkeypatch):
    """Streams of one block each, with padding between them, and the old
    format, which tells nothing."""
    monkeypatch.setattr(mbox, "SMALLEST_SPLIT", 1000)
    text = many_mails()
    parts = [text[i:i + 20_000] for i in range(0, len(text), 20_000)]
    path = tmp_path / "b.mbox.xz"
    path.write_bytes(b"".join(lzma.compress(p, check=lzma.CHECK_CRC32) + b"\0" * 4 * (i % 3)
                              for i, p in enumerate(parts)))
    (tmp_path / "b.mbox").write_bytes(text)
    tasks, rows = in_tasks(spark, path, split_bytes=5000)
    assert tasks > 2 and rows == in_tasks(spark, tmp_path / "b.mbox")[1]
    (tmp_path / "c.mbox.xz").write_bytes(lzma.compress(text, lzma.FORMAT_ALONE))
    assert storage.seek_table(str(tmp_path / "c.mbox.xz")) is None
    broken = bytearray(path.read_bytes())
    broken[-20] ^= 1
    (tmp_path / "d.mbox.xz").write_bytes(broken)
    assert storage.seek_table(str(tmp_path / "d.mbox.xz")) is None
    (tmp_path / "e.mbox.xz").write_bytes(b"")
    assert storage.seek_table(str(tmp_path / "e.mbox.xz")) == ([], [], 0, [])


def test_gzip_members_of_other_makers_are_found(spark, tmp_path, monkeypatch):
    """Members without sizes are found by looking for them; bytes that look
    like the start of one are none."""
    monkeypatch.setattr(mbox, "SMALLEST_SPLIT", 1000)
    text = many_mails() + b"\n" + b"\x1f\x8b\x08\x00 no member" * 50 + b"\n"
    path, parts = tmp_path / "b.mbox.gz", [text[i:i + 9000] for i in range(0, len(text), 9000)]
    path.write_bytes(b"".join(gzip.compress(p, compresslevel=0) for p in parts))
    (tmp_path / "b.mbox").write_bytes(text)
    want = in_tasks(spark, tmp_path / "b.mbox")[1]
    assert storage.seek_table(str(path)) is None
    files = mbox.require_sources(str(path))
    points = mbox.access_points(spark, files, 30_000)
    assert points[str(path)][0] == [0, 0] or points[str(path)][0] == (0, 0)
    assert points[str(path)][-1][1] == len(text)
    tasks, rows = in_tasks(spark, path, files=files, points=points)
    assert tasks == len(points[str(path)]) - 1 > 2 and rows == want
    (tmp_path / "one.mbox.gz").write_bytes(gzip.compress(text, compresslevel=0))
    assert mbox.access_points(spark, mbox.require_sources(str(tmp_path / "one.mbox.gz")), 30_000) == {}


@pytest.mark.parametrize("codec, suffix", [("gzip", ".gz"), ("lzma", ".xz"), ("zstd", ".zst")])
def test_compressed_shards_are_made_in_pieces(spark, tmp_path, monkeypatch, codec, suffix):
    """Several tasks make a compressed shard; places, order and content are
    those of one that is written whole."""
    monkeypatch.setattr(IO, "PIECE_BYTES", 4000)
    rows = [(f"g{n % 50}", f"<m{n}@x>", dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), "a@x.example",
             mail(n % 28 + 1, message_id=f"<m{n}@x>", body=f"{n} " * 200)) for n in range(60)]
    rows.append((None, None, None, None, mail(1, body="")))
    messages = spark.createDataFrame(
        rows, "gmail_id string, rfc_message_id string, date timestamp_ntz, from_addr string, raw binary")
    whole = IO.write_mbox(messages, str(tmp_path / "plain"), shard_bytes=1 << 20).collect()
    placed = IO.write_mbox(messages, str(tmp_path / "packed"), compression=codec, shard_bytes=1 << 20)
    path = f"{tmp_path}/packed/part-00000.mbox{suffix}"
    assert os.listdir(tmp_path / "packed") == [os.path.basename(path)]
    with storage.open_decoded(path) as stream:
        assert stream.read() == (tmp_path / "plain/part-00000.mbox").read_bytes()
    assert len(storage.seek_table(path)[0]) > 5
    names = ["gmail_id", "rfc_message_id", "mbox_offset", "mbox_length", "checksum", "size_bytes"]
    found = {tuple(r[n] for n in names) for r in placed.collect()}
    assert found == {tuple(r[n] for n in names) for r in whole} and placed.count() == 61
    assert {r.status for r in IO.extract_messages(placed).collect()} == {"extracted"}
    back = mbox.read_mbox(spark, str(tmp_path / "packed"), split_bytes=3000)
    assert {(r.mbox_offset, r.mbox_length) for r in back.collect()} == {
        (r.mbox_offset, r.mbox_length) for r in whole}


def test_assigned_shards_are_made_in_pieces(spark, tmp_path, monkeypatch):
    """Rows that carry their shard are cut into pieces by the same total."""
    monkeypatch.setattr(IO, "PIECE_BYTES", 4000)
    rows = [(f"<m{n}@x>", dt.datetime(2024, 1, 1) + dt.timedelta(hours=n), "a@x.example",
             mail(n % 28 + 1, message_id=f"<m{n}@x>", body=f"{n} " * 200)) for n in range(60)]
    messages = spark.createDataFrame(
        rows, "rfc_message_id string, date timestamp_ntz, from_addr string, raw binary")
    sized = messages.withColumn("size_bytes", F.octet_length("raw").cast("long"))
    cut, shards, pieces = IO.assign_shards(sized, [F.col("date")], "size_bytes", shards=2)
    assert shards == 2 and pieces > 3
    placed = IO.write_mbox(cut, str(tmp_path / "a"), ["date"], "zstd", shards=shards, pieces=pieces)
    assert len(os.listdir(tmp_path / "a")) == 2
    assert placed.columns == ["rfc_message_id", "date", "from_addr", *IO.MADE]
    at = placed.orderBy("archive_file", "mbox_offset").collect()
    assert [r.date for r in at] == [r[1] for r in rows]
    assert all(len(storage.seek_table(r.archive_file)[0]) == pieces for r in at)
    assert {r.status for r in IO.extract_messages(placed).collect()} == {"extracted"}
