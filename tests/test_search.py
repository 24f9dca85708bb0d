"""A small corpus, and ranking against SQLite's full-text search."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from mailspark import views
from mailspark.functions import text as X
from mailspark.functions.porter import stem
from mailspark.operators import index as I
from mailspark.operators import segments as SG
from mailspark.operators import search as Q
from tests.data import corpus


@pytest.fixture(scope="module")
def messages(spark):
    return corpus(spark).cache()


def ids(df):
    return [r.gmail_id for r in df.collect()]


def test_single_word(messages):
    rows = Q.search_fulltext(messages, "committee").collect()
    assert {r.gmail_id for r in rows} == {"minutes", "supper"}
    scores = [r.relevance_score for r in rows]
    assert scores == sorted(scores, reverse=True) and rows[0].total_results == 2


def test_stems_match(messages):
    assert set(ids(Q.search_fulltext(messages, "committees"))) == {"minutes", "supper"}
    assert set(ids(Q.search_fulltext(messages, "deliveries fences"))) == {"offer", "arrival"}
    assert ids(Q.search_fulltext(messages, "committees", stemmed=False)) == []


def test_fields(messages):
    assert ids(Q.search_fulltext(messages, "committee", ["subject"])) == ["minutes"]
    assert ids(Q.search_fulltext(messages, "thursday", ["from_addr"])) == []
    with pytest.raises(ValueError):
        Q.search_fulltext(messages, "seed", ["no_such_field"])


def test_nothing_found(messages):
    assert ids(Q.search_fulltext(messages, "submarine")) == []
    assert ids(Q.search_fulltext(messages, '"open end')) == []
    assert ids(Q.search_fulltext(messages, '"" ...')) == []


def test_metadata(messages):
    assert set(ids(Q.search_metadata(messages, from_addr="petra@garden.example"))) == {
        "minutes", "accounts"}
    assert ids(Q.search_metadata(messages, from_addr="NORA", after="2022-04-03")) == ["rota"]
    assert ids(Q.search_metadata(messages, to_addr="petra@")) == ["arrival", "offer"]
    rows = Q.search_metadata(messages, after="2020-06-01", limit=4).collect()
    assert len(rows) == 4 and rows[0].total_results == 9


def test_before_is_exclusive_and_date_end_inclusive(messages):
    edge = "2022-05-19 07:05:00"
    assert "offer" not in ids(Q.search_metadata(messages, before=edge))
    assert "offer" in ids(Q.filter_messages(messages, date_end=edge))


def test_mail_query(messages):
    assert ids(Q.search(messages, "from:sales@timber.example")) == ["arrival", "offer"]
    assert ids(Q.search(messages, "from:rosa committee")) == ["supper"]
    assert ids(Q.search(messages, "subject:swap")) == ["reply", "swap"]
    assert ids(Q.search(messages, "subject:fence payment")) == ["arrival"]
    assert ids(Q.search(messages, "after:2022-05-01 before:2022-06-01")) == ["offer", "minutes"]
    assert ids(Q.search(messages, "seeds before:2022/01/01")) == ["accounts"]
    assert len(ids(Q.search(messages, "  "))) == 9


def test_first_operator_counts_and_all_are_removed():
    assert Q.split_query("to:x from:a from:b  y to:c") == ({"from": "a", "to": "x"}, "y")
    assert Q.split_query("xfrom:a from: y") == ({}, "xfrom:a from: y")


def test_wildcards_are_literal_in_contains(messages):
    assert ids(Q.search_metadata(messages, from_addr="n%a")) == []
    assert len(ids(Q.filter_messages(messages, from_addr="%@garden.example"))) == 5
    assert ids(Q.filter_messages(messages, from_addr="nora")) == []


def test_page_and_offset(messages):
    everything = ids(Q.search_all(messages))
    assert ids(Q.search_all(messages, limit=3, offset=4)) == everything[4:7]
    assert everything[0] == "supper" and everything[-1] == "accounts"


def test_match_forms(messages):
    plain = {"stemmed": False}

    def all_of(*terms):
        return ids(Q.all_of(messages, *terms, **plain))

    assert all_of(Q.phrase("the watering rota")) == ["rota"]
    assert all_of(Q.prefix("beek")) == ["bees"]
    assert all_of(Q.near("sign", "rota", 4)) == ["rota"]
    assert all_of(Q.near("sign", "rota", 3)) == []
    assert set(ids(Q.any_of(messages, Q.word("supper"), Q.word("visitors"), **plain))) == {
        "supper", "bees"}
    assert ids(Q.none_of(messages, [Q.word("committee")], [Q.word("euros")], **plain)) == [
        "supper"]
    assert all_of(Q.word("petra").within("to_addr"), Q.word("thursday")) == ["arrival"]


def test_near_takes_phrases(messages):
    plain = {"stemmed": False}

    def near(a, b, n):
        return ids(Q.all_of(messages, Q.near(a, b, n), **plain))

    # "The committee approved the new fence. Cost of the fence is 340 euros."
    assert near("committee approved", "340 euros", 8) == ["minutes"]
    assert near("340 euros", "committee approved", 8) == ["minutes"]
    assert near("committee approved", "340 euros", 7) == []
    assert near("committee rejected", "340 euros", 20) == []
    assert near("new fence", "fence", 2) == [] and near("new fence", "fence", 3) == ["minutes"]


def test_terms_without_words_are_refused():
    for make in (Q.phrase, Q.word, Q.prefix, lambda t: Q.near(t, "x"), lambda t: Q.near("x", t)):
        for text in ("", "...", '"'):
            with pytest.raises(ValueError):
                make(text)


def test_default_nulls(messages):
    row = Q.search_fulltext(messages, "beekeeping").collect()[0]
    assert row.body_preview is None and row.gmail_id == "bees"


def test_order_results(messages):
    nulls = messages.withColumn("date", F.when(F.col("gmail_id") != "rota", F.col("date")))
    assert ids(Q.order_results(nulls, ascending=True))[0] == "rota"
    assert ids(Q.order_results(nulls))[-1] == "rota"


# ---------------------------------------------------------------------- SQLite

WHOLE = ("subject", "from_addr", "to_addr", "body")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return views.messages(spark, sf_dir).cache()


@pytest.fixture(scope="module")
def fts(documents):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(gmail_id UNINDEXED, subject, from_addr, "
                "to_addr, body, tokenize='porter unicode61 remove_diacritics 1')")
    rows = [tuple(r) for r in documents.select("gmail_id", *WHOLE).collect()]
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?)", rows)
    return con


@pytest.mark.parametrize("text, query", [
    ("the ands", "the ands"),
    ('"in the"', '"in the"'),
    ("hea*", "hea*"),
    ("tions", "tions"),
    ("éleau*", "éleau*"),
    ("und die der", "und die der"),
])
def test_same_ranking_as_sqlite(documents, fts, text, query):
    want = fts.execute(
        "SELECT gmail_id, -rank FROM t WHERE t MATCH ? ORDER BY rank", (query,)).fetchall()
    rows = Q.search_fulltext(documents, text, limit=100_000, columns=WHOLE).select(
        "gmail_id", "relevance_score").collect()
    assert {r[0]: pytest.approx(r[1], rel=1e-9) for r in rows} == dict(want)
    assert [r[1] for r in rows] == pytest.approx([w[1] for w in want])


@pytest.fixture(scope="module")
def index(documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "whole")
    return SG.create(documents.sparkSession, path, WHOLE, buckets=16).add(documents)


def same(found, want):
    key = ("archive_file", "mbox_offset", "relevance_score", "total_results")
    got, expected = ({(r[0], r[1]): (r[2], r[3]) for r in df.select(*key).collect()}
                     for df in (found, want))
    assert got.keys() == expected.keys()
    for k in got:
        assert got[k] == pytest.approx(expected[k])


@pytest.mark.parametrize("text, fields", [
    ("the ands", None), ('"in the" and', None), ("of", ["subject"]), ('"und die"', ["body"]),
    ("nothinglikethis", None), ("the the", None), ("hea*", None), ('"in th"*', ["body"])])
def test_index_equals_scan(documents, index, text, fields):
    options = {"fields": fields, "limit": 100_000}
    same(Q.search_fulltext(documents.drop("body"), text, index=index, **options),
         Q.search_fulltext(documents, text, columns=WHOLE, **options))


def test_index_forms_equal_scan(documents, index):
    slim = documents.drop("body")
    for make in (
        lambda m, **o: Q.any_of(m, Q.word("der"), Q.phrase("the and"), **o),
        lambda m, **o: Q.none_of(m, [Q.word("the")], [Q.prefix("tha"), Q.word("of")], **o),
        lambda m, **o: Q.all_of(m, Q.near("of the", "and", 6), Q.word("in").within("body"), **o),
        lambda m, **o: Q.search_hybrid(m, "the", from_addr="src1", after="2024-01-02", **o),
        lambda m, **o: Q.search(m, "from:en@ subject:the of", 1000, **o),
    ):
        same(make(slim, index=index), make(documents, columns=WHOLE))
    pages = [Q.search_fulltext(slim, "the", limit=7, offset=n, index=index).collect() for n in (0, 7)]
    whole = Q.search_fulltext(documents, "the", limit=14, columns=WHOLE).collect()
    assert [r.rfc_message_id for p in pages for r in p] == [r.rfc_message_id for r in whole]
    with pytest.raises(ValueError):
        Q.search_fulltext(slim, "the", ["body_preview"], index=index)
    assert Q.search_fulltext(slim, '"open', index=index).count() == 0


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_of_archives_covers_whole_texts(spark, tmp_path):
    """A word beyond the preview is found by a catalogue without bodies."""
    from mailspark.operators import parse as P
    from mailspark.plans import workflows as WF
    from mailspark.sources import mbox
    from tests.data import mail, mbox_text

    mails = [mail(1, body="word " * 400 + "needle\n"), mail(2, body="word\n"), mail(3, body="")]
    (tmp_path / "a.mbox").write_bytes(mbox_text(mails))
    index = WF.index_archives(spark, str(tmp_path / "a.mbox"), str(tmp_path / "index"), buckets=4)
    messages = P.parse_messages(mbox.read_mbox(spark, str(tmp_path / "a.mbox"))).drop("parse_error")
    assert index.size == 3
    found = Q.search(messages, "needles", index=index).collect()
    assert [r.rfc_message_id for r in found] == ["<m1@example.com>"]
    assert Q.search(messages, "needles").count() == 0


def test_stems_and_tokens_equal_sqlite(documents):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, tokenize='porter unicode61 "
                "remove_diacritics 1')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, row)")
    words = {w for r in documents.select("body").collect() for w in X.local_tokens(r.body)}
    words |= set("""relational conditional digitizer conformably analogously operator feudalism
        decisiveness hopefulness sensibility triplicate formalize electricity revival inference
        adjustable replacement adoption activate bowdlerize probate controll roll happy sky ties
        ponies caress agreed plastered hopping filing fizzed psychology visibility""".split())
    words |= {"x" * n + "ings" for n in (58, 59, 60, 61, 62)}
    for w in sorted(words):
        con.execute("DELETE FROM t")
        con.execute("INSERT INTO t VALUES (?)", (w,))
        assert con.execute("SELECT term FROM v").fetchall() == [(stem(w),)]
        # What the scan relies on to skip rows early.
        assert w.startswith(stem(w)[:-1])


def test_jvm_tokens_equal_local_ones(documents):
    for r in documents.select("body", X.tokenize(F.col("body")).alias("t")).collect():
        assert r.t == X.local_tokens(r.body)
