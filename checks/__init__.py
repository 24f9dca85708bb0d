"""Registered queries, each next to the SQL that must give the same rows."""

import functools

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark import views
from mailspark.session import configure, scratch

QUERIES = {}
ORACLES = {}


def shown(df):
    """Columns in plain types: timestamps as text, whole numbers as BIGINT."""
    out = []
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.TimestampNTZType, T.TimestampType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(c, ",")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(sql=None):
    """Registers a function (spark, sf_dir) -> DataFrame and its SQL."""

    def register(make):
        def run(spark, sf_dir):
            return shown(make(configure(spark), sf_dir))

        QUERIES[make.__name__] = run
        if sql is not None:
            ORACLES[make.__name__] = sql
        return run

    return register


_KEPT = {}


def kept(make):
    """Files a query reads are made once per session and folder of tables."""

    @functools.wraps(make)
    def once(spark, sf_dir, *options):
        key = (make.__name__, spark.sparkContext.applicationId, sf_dir, options)
        if key not in _KEPT:
            _KEPT[key] = make(spark, sf_dir, *options)
        return _KEPT[key]

    return once


@kept
def stored_messages(spark, sf_dir):
    """The message view of all documents, written once as a table."""
    path = scratch(spark, "messages")
    views.messages(spark, sf_dir, spread_rows=True).write.option("compression", "zstd").parquet(path)
    return path


def msgs(spark, sf_dir):
    return spark.read.parquet(stored_messages(spark, sf_dir))


def unstored(spark, sf_dir):
    """The same messages, made from the documents as they are read: for large
    writing jobs, so that no copy of all texts lies beside what they write."""
    return views.messages(spark, sf_dir, spread_rows=True)


def labelled(spark, sf_dir):
    return views.load(spark, sf_dir, "labels").select("doc_id").distinct()


def known(spark, sf_dir):
    """The part of the messages that a label table covers, as a catalogue that
    does not hold everything yet."""
    return msgs(spark, sf_dir).join(labelled(spark, sf_dir), "doc_id", "left_semi")


def with_msgs(body, *parts):
    """A query over the message view."""
    return "WITH " + ", ".join([views.MSGS_SQL, *parts]) + "\n" + body


KNOWN_SQL = "known AS (SELECT * FROM msgs WHERE doc_id IN (SELECT doc_id FROM labels))"
TS = "'%Y-%m-%d %H:%M:%S'"
