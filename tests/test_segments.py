import collections
import pathlib
import random
import time

import pytest
from pyspark.sql import functions as F

from mailspark import views
from mailspark.operators import index as I
from mailspark.operators import search as Q
from mailspark.operators import segments as SG
from mailspark.plans import workflows as WF
from tests.data import mail, mbox_text

WHOLE = ("subject", "from_addr", "to_addr", "body")
KEY = ("archive_file", "mbox_offset")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return views.messages(spark, sf_dir).drop("doc_id").cache()


def rows(found):
    return sorted((r.archive_file, r.mbox_offset, round(r.relevance_score, 9), r.total_results)
                  for r in found.select(*KEY, "relevance_score", "total_results").collect())


SEARCHES = (
    lambda m, **o: Q.search_fulltext(m, "the ands", limit=9, **o),
    lambda m, **o: Q.search_fulltext(m, "the", limit=9, offset=4, **o),
    lambda m, **o: Q.search_fulltext(m, '"in the" hea*', limit=1000, **o),
    lambda m, **o: Q.search_fulltext(m, "de", ["subject"], limit=1000, **o),
    lambda m, **o: Q.search(m, "from:en@ after:2024-01-02 the", limit=12, **o),
    lambda m, **o: Q.any_of(m, Q.word("der"), Q.prefix("tha"), **o),
    lambda m, **o: Q.none_of(m, [Q.word("the")], [Q.word("and")], **o),
    lambda m, **o: Q.all_of(m, Q.near("of the", "and", 6), Q.word("in").within("body"), **o),
)


def test_segments_equal_a_rebuilt_index(spark, documents, tmp_path):
    """Three additions, a dropped archive, dropped messages; then the same
    merged."""
    part = F.pmod(F.xxhash64("rfc_message_id"), F.lit(3))
    index = SG.create(spark, str(tmp_path / "parts"), WHOLE, buckets=8)
    assert Q.search_fulltext(documents, "the", index=index).count() == 0
    for k in range(3):
        before = files(tmp_path / "parts")
        index = index.add(documents.filter(part == k))
        assert before <= files(tmp_path / "parts") and len(index.segments) == k + 1
    archive = documents.agg(F.min("archive_file")).first()[0]
    gone = (F.col("archive_file") == archive) | (F.pmod("mbox_offset", F.lit(5)) == 1)
    before = files(tmp_path / "parts")
    index = index.drop_archives([archive]).drop(documents.filter(gone))
    made = files(tmp_path / "parts") - before
    assert made and not any("postings" in f or "blocks" in f for f in made)
    left = documents.filter(~gone)
    whole = SG.create(spark, str(tmp_path / "whole"), WHOLE, buckets=8).add(left)
    assert (index.size, index.tokens) == (whole.size, whole.tokens)
    merged = index.merge(everything=True)
    assert len(merged.segments) == 1 and not merged.segments[0].dead
    assert merged.size == whole.size and merged.merge(everything=True) is merged
    assert sorted(map(str, SG.open_index(spark, merged.path).segments)) == sorted(map(str, merged.segments))
    for make in (SEARCHES[0], SEARCHES[2], SEARCHES[4]):
        want = rows(make(left, index=whole))
        assert want and rows(make(left, index=index)) == want
        assert rows(make(left, index=merged)) == want


def files(path):
    return {str(p) for p in path.rglob("part-*")}


def test_scan_and_index_agree(documents, tmp_path):
    index = SG.create(documents.sparkSession, str(tmp_path / "i"), WHOLE, buckets=8).add(documents)
    for make in SEARCHES:
        assert rows(make(documents.drop("body"), index=index)) == rows(make(documents, columns=WHOLE))


def test_merge_waits_for_like_segments(spark, documents, tmp_path):
    index = SG.create(spark, str(tmp_path), WHOLE, stemmed=False, buckets=2)
    ids = [r[0] for r in documents.select("gmail_id").orderBy("gmail_id").collect()]
    for part in (ids[:100], ids[100:120], ids[120:140]):
        index = index.add(documents.filter(F.col("gmail_id").isin(part)))
    assert index.merge(fanout=4) is index
    merged = index.merge(fanout=2)
    assert [s.messages for s in merged.segments] == [100, 40]
    assert index.add(documents.limit(0)) is index and index.drop(documents.limit(0)) is index


def test_sync_writes_only_the_difference(spark, documents, tmp_path):
    half = documents.filter(F.pmod("mbox_offset", F.lit(2)) == 0)
    index = SG.create(spark, str(tmp_path), WHOLE, buckets=4).add(documents.filter("gmail_id < 'm3'"))
    after = index.sync(half)
    assert after.differences(half).count() == 0 and after.size == half.count()
    assert after.segments[0].segment == index.segments[0].segment
    stored = after._postings(None).filter(F.col("segment") == after.segments[1].segment)
    added = half.filter("gmail_id >= 'm3'")
    assert stored.count() == I.build_index(added, WHOLE).count()
    assert after.sync(half) is after


def skewed_words(spark):
    """Two words in all messages; a few messages are full of them."""
    seeded = random.Random(3)
    made = []
    for i in range(6400):
        often = 40 if i % 400 == 7 else 1
        words = ["alpha"] * often + ["beta"] * often + [f"w{seeded.randint(0, 99)}" for _ in range(60)]
        seeded.shuffle(words)
        made.append((f"a{i % 3}", i, f"m{i}", " ".join(words)))
    messages = spark.createDataFrame(made, "archive_file string, mbox_offset long, rfc_message_id string, body string")
    names = ("gmail_id", "subject", "from_addr", "to_addr", "date", "body_preview")
    return messages.selectExpr("*", *[f"CAST(NULL AS STRING) AS {n}" for n in names])


def test_blocks_that_cannot_win_are_not_read(spark, tmp_path, monkeypatch):
    messages = skewed_words(spark).cache()
    index = SG.create(spark, str(tmp_path), ("body",), stemmed=False, buckets=4).add(messages)
    every = [("alpha", False), ("beta", False)]
    read = []
    lookup = SG.SegmentedIndex._counted

    def counted(self, terms, blocks=None):
        rows = self._lookup("blocks", SG._BLOCKS, every)
        read.append(rows if blocks is None else rows.filter(self._within(blocks)))
        return lookup(self, terms, blocks)

    monkeypatch.setattr(SG.SegmentedIndex, "_counted", counted)
    want = rows(Q.search_fulltext(messages, "alpha beta", limit=5, columns=("body",), stemmed=False))
    assert rows(Q.search_fulltext(messages, "alpha beta", limit=5, index=index)) == want
    monkeypatch.setattr(SG, "AT_ONCE", 0)
    read.clear()
    assert rows(Q.search_fulltext(messages, "alpha beta", limit=5, index=index)) == want
    size = F.sum(F.size("entries"))
    scanned = index._postings(every).count()
    assert 0 < sum(r.agg(size).first()[0] for r in read) < 0.2 * scanned
    assert all("PushedFilters" in plan(r) and "block" in plan(r) for r in read)
    # A filter that few of the best pass, ties at the end, and a deep page.
    for make in (lambda **o: Q.search_hybrid(messages, "alpha beta", after=None, limit=3, **o),
                 lambda **o: Q.search_fulltext(messages, "alpha", limit=30, offset=10, **o)):
        assert rows(make(index=index)) == rows(make(columns=("body",), stemmed=False))
    monkeypatch.setattr(SG, "DEEP", 5)
    assert rows(Q.search_fulltext(messages, "alpha", limit=4, offset=20, index=index)) == rows(
        Q.search_fulltext(messages, "alpha", limit=4, offset=20, columns=("body",), stemmed=False))
    monkeypatch.setattr(SG, "DEEP", 10_000)
    monkeypatch.setattr(SG, "TIES", 2)
    assert rows(Q.search_fulltext(messages, "beta", limit=40, index=index)) == rows(
        Q.search_fulltext(messages, "beta", limit=40, columns=("body",), stemmed=False))


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_read_their_buckets(spark, documents, tmp_path):
    index = SG.create(spark, str(tmp_path), WHOLE, stemmed=False, buckets=16).add(documents)
    for slot in (("the", False), ("hea", True), ("ü", False)):
        found = index._lookup("blocks", SG._BLOCKS, [slot])
        paths = {f.rsplit("bucket=", 1)[1].split("/")[0] for f in found.inputFiles()}
        assert paths <= {str(SG.bucket_of(slot[0], 16))}
        same = F.col("term").startswith(slot[0]) if slot[1] else F.col("term") == slot[0]
        assert found.count() == index._lookup("blocks", SG._BLOCKS, None).filter(same).count()
    # A prefix of one letter may be in any bucket.
    one = index._lookup("blocks", SG._BLOCKS, [("t", True)])
    assert one.count() == index._lookup("blocks", SG._BLOCKS, None).filter("startswith(term, 't')").count()


def test_long_texts_in_linear_time(spark, tmp_path):
    """Phrases and near words of a text of a million words, half of them the
    searched ones."""
    text = " ".join("ping pong" if i % 2 else "filler words" for i in range(500_000))
    messages = skewed_words(spark).limit(1).withColumn("body", F.lit(text))
    index = SG.create(spark, str(tmp_path), ("body",), stemmed=False, buckets=2).add(messages)
    start = time.perf_counter()
    for term, count in ((Q.phrase("ping pong filler"), 249_999), (Q.near("ping", "pong", 3), 250_000),
                        (Q.near("ping pong", "words", 900), 250_000)):
        every = SG._slots([term])
        found = I.counts(index._postings(every), [term], ["segment", "doc"]).first()
        assert found._n0 == count
    assert time.perf_counter() - start < 60


def test_near_against_all_pairs(spark):
    seeded = random.Random(5)
    for first, second, distance in (("a", "b", 0), ("a", "b", 3), ("a b", "c", 2), ("a", "a", 4), ("b c", "a b", 1)):
        texts = [" ".join(seeded.choices("abcd", k=seeded.randint(0, 40))) for _ in range(30)]
        made = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)],
                                     "archive_file string, mbox_offset long, body string")
        term = Q.near(first, second, distance)
        got = {r.mbox_offset: r._n0 for r in I.counts(
            I.build_index(made, ("body",), stemmed=False), [term]).collect()}
        for i, text in enumerate(texts):
            words, a, b = text.split(), first.split(), second.split()
            starts = [[k for k in range(len(words)) if words[k:k + len(x)] == x] for x in (a, b)]
            want = sum(a == b or any(0 <= j - k - len(a) <= distance or 0 <= k - j - len(b) <= distance
                                     for j in starts[1]) for k in starts[0])
            assert got.get(i, 0) == want


def test_another_writer_is_refused(spark, documents, tmp_path):
    index = SG.create(spark, str(tmp_path), WHOLE, buckets=2)
    index.add(documents.limit(3))
    with pytest.raises(Exception, match="(?i)exists"):
        index.add(documents.limit(2))
    assert SG.open_index(spark, str(tmp_path)).size == 3
    with pytest.raises(Exception):
        SG.open_index(spark, str(tmp_path / "none"))


def test_index_of_archives_grows_and_is_repaired(spark, tmp_path):
    """Only archives with a bad row or a missing message are parsed again."""
    from mailspark.operators import parse as P
    from mailspark.sources import mbox

    box = tmp_path / "box"
    box.mkdir()
    for name, numbers in (("a", (1, 2)), ("b", (3, 4)), ("c", (5,))):
        (box / f"{name}.mbox").write_bytes(mbox_text([mail(n, body=f"needle{n} hay\n") for n in numbers]))
    index = WF.index_archives(spark, str(box / "a.mbox"), str(tmp_path / "index"), buckets=2)
    index = WF.index_more(spark, [str(box / "a.mbox"), str(box / "b.mbox")], index)
    assert index.size == 4 and len(index.segments) == 2
    messages = P.parse_messages(mbox.read_mbox(spark, str(box))).drop("parse_error")
    messages = messages.filter("rfc_message_id <> '<m1@example.com>'")
    spoiled = messages.withColumn("mbox_length", F.when(
        F.col("rfc_message_id") == "<m3@example.com>", 0).otherwise(F.col("mbox_length")))
    opened, read = [], mbox.read_mbox
    mbox.read_mbox = lambda s, p, files=None: opened.append([f[0][-6:] for f in files]) or read(s, p, files=files)
    try:
        dry = WF.repair(spark, str(box), spoiled, index=index)
        assert tuple(dry.reports["index"].collect()[0]) == (1, 1) and dry.index is index
        out = WF.repair(spark, str(box), spoiled, index=index, dry_run=False)
    finally:
        mbox.read_mbox = read
    assert opened == [["b.mbox"], ["c.mbox"]]
    assert out.reports["backfilled"].collect()[0][0] == 1 and out.index.size == 4
    for n in range(1, 6):
        found = Q.search(out.messages, f"needle{n}", index=out.index).collect()
        assert [r.rfc_message_id for r in found] == ([f"<m{n}@example.com>"] if n > 1 else [])


def test_rows_are_whole_before_they_move(spark, tmp_path):
    """A row per (term, block) comes out of one pass over the texts, without
    an aggregate; postings are stored in it, not beside it."""
    made = [("a", i, " ".join(f"w{(i * k) % 17}" for k in range(i % 23))) for i in range(300)]
    messages = spark.createDataFrame(made, "archive_file string, mbox_offset long, body string")
    index = SG.create(spark, str(tmp_path), ("body",), stemmed=False, buckets=2).add(messages)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["blocks", "docs", "versions"]
    stored = index._lookup("blocks", SG._BLOCKS, None)
    assert stored.count() == stored.select("term", "block").distinct().count()
    words = {(o, w): text.split().count(w) for _, o, text in made for w in text.split()}
    at = {r.doc: r.mbox_offset for r in index.docs().collect()}
    assert {(at[r.doc], r.term): r.tf for r in index._postings(None).collect()} == words
    found = stored.selectExpr("term", "block", "bits", "most", "inline(entries)").collect()
    assert {(at[64 * r.block + r.seat], r.term): r.tf for r in found} == words
    assert all((r.bits >> r.seat) & 1 and r.most >= r.tf for r in found)
    texts = messages.selectExpr("mbox_offset AS doc", "body").repartition("doc")
    assert "Aggregate" not in plan(I.build_blocks(texts, ("body",), False, 64, SG._MADE))


def test_merge_of_places_that_come_twice(spark, tmp_path):
    """A place that comes twice has several numbers, each kept by a merge."""
    made = [("a", i % 40, f"alpha w{i % 40}") for i in range(80)] + [("b", i, "alpha beta") for i in range(9)]
    messages = spark.createDataFrame(made, "archive_file string, mbox_offset long, body string")
    index = SG.create(spark, str(tmp_path), ("body",), stemmed=False, buckets=2)
    index = index.add(messages.filter("archive_file = 'a'")).add(messages.filter("archive_file = 'b'"))
    merged = index.merge(everything=True)
    key = ["archive_file", "mbox_offset", "dl"]
    assert sorted(merged.docs().select(*key).collect()) == sorted(index.docs().select(*key).collect())
    words = merged._postings(None).join(merged.docs().select("doc", *key[:2]), "doc")
    found = {(r.archive_file, r.mbox_offset, r.term) for r in words.collect()}
    assert found == {(a, o, w) for a, o, text in made for w in text.split()}


def shuffled_bytes(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum(p.stat().st_size for d in manager.localDirsString()
               for p in pathlib.Path(d).rglob("shuffle_*.data"))


def test_writing_leaves_no_shuffle_files(spark, tmp_path):
    """Texts are moved once, and what was moved goes with the job."""
    seeded = random.Random(11)
    made = [("a", i, " ".join(f"{seeded.getrandbits(40):x}" for _ in range(300))) for i in range(2000)]
    size = sum(len(text) for *_, text in made)
    messages = spark.createDataFrame(made, "archive_file string, mbox_offset long, body string")
    before = shuffled_bytes(spark)
    index = SG.create(spark, str(tmp_path), ("body",), stemmed=False, buckets=2)
    index = index.add(messages.filter("mbox_offset < 1000")).add(messages.filter("mbox_offset >= 1000"))
    index.merge(everything=True)
    end = time.time() + 20
    while shuffled_bytes(spark) - before > size / 8 and time.time() < end:
        time.sleep(0.2)
    assert shuffled_bytes(spark) - before <= size / 8


def test_texts_are_moved_once_without_a_join(spark, tmp_path, monkeypatch):
    """Also where the places of all messages are too many to be sent around."""
    monkeypatch.setattr(SG.joins, "BROADCAST_BYTES", 0)
    plans, build = [], I.build_blocks
    monkeypatch.setattr(I, "build_blocks", lambda texts, *a: plans.append(plan(texts)) or build(texts, *a))
    made = [("a", i, f"alpha w{i % 7}") for i in range(300)]
    messages = spark.createDataFrame(made, "archive_file string, mbox_offset long, body string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        index = SG.create(spark, str(tmp_path), ("body",), stemmed=False, buckets=2).add(messages)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert index.size == 300 and len(plans) == 1
    assert "SortMergeJoin" not in plans[0] and "ShuffledHashJoin" not in plans[0]
    assert plans[0].replace("BroadcastExchange", "").count("Exchange ") == 1


def test_rounds_make_the_same_rows(spark, tmp_path, monkeypatch):
    """In one go or in rounds, by few tasks or many; messages without a place
    are left out, and those of one place come under each of its numbers."""
    made = [("a", i, " ".join(f"w{(i * k) % 17}" for k in range(i % 40))) for i in range(400)]
    made += [("b", i % 20, f"twice w{i % 20} x{i}") for i in range(40)]
    made += [(None, 1, "lost"), ("a", None, "lost")]
    messages = spark.createDataFrame(made, "archive_file string, mbox_offset long, body string").repartition(5).cache()
    words = collections.Counter()
    for archive, offset, text in made:
        for w in text.split():
            # Two messages have two numbers there, each with both texts.
            words[archive, offset, w] += 2 if archive == "b" else 1
    words = {k: n for k, n in words.items() if k[2] != "lost"}

    def stored(index):
        docs = index.docs().select("segment", "doc", *KEY).distinct()
        rows = index._postings(None).join(docs, ["segment", "doc"]).collect()
        assert all(r.tf == len(r.positions) for r in rows)
        found = collections.Counter()
        for r in rows:
            found[r.archive_file, r.mbox_offset, r.term] += r.tf
        seats = index._lookup("blocks", SG._BLOCKS, None).selectExpr("bits", "entries.seat AS seats").collect()
        assert all(sorted(r.seats) == r.seats and sum(1 << s for s in r.seats) == r.bits % (1 << 64) for r in seats)
        return found

    rounds, plain = [], SG.SegmentedIndex._rounds
    monkeypatch.setattr(SG.SegmentedIndex, "_rounds", lambda *a: rounds.append(plain(*a)) or rounds[-1])
    for name, task, round_bytes in (("one", SG.TASK_BYTES, SG.ROUND_BYTES), ("many", 800, 1000)):
        monkeypatch.setattr(SG, "TASK_BYTES", task)
        monkeypatch.setattr(SG, "ROUND_BYTES", round_bytes)
        index = SG.create(spark, str(tmp_path / name), ("body",), stemmed=False, buckets=8)
        half = F.col("mbox_offset") % 2 == 0
        index = index.add(messages.filter(half)).add(messages.filter(~half))
        assert stored(index) == words
        assert index.docs().filter("archive_file = 'a'").count() == 400
        merged = index.merge(everything=True)
        assert stored(merged).keys() == words.keys() and len(merged.segments) == 1
        assert merged.docs().filter("archive_file = 'a'").count() == 400
        assert {k: n for k, n in stored(merged).items() if k[0] == "a"} == {
            k: n for k, n in words.items() if k[0] == "a"}
    assert rounds[0] == 1 and rounds[-1] > 1
