"""Message tables derived from the given text tables."""

from pyspark.sql import functions as F


def load(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df, key):
    """Rows of a small table over all cores. Large tables come in as many
    splits as they need and are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def messages(spark, sf_dir, spread_rows=False):
    """The documents table as a catalogue: one message per document, whole
    text in ``body``."""
    documents = load(spark, sf_dir, "documents")
    return as_messages(spread(documents, "doc_id") if spread_rows else documents)


def as_messages(documents):
    text, doc = F.col("text"), F.col("doc_id")
    size = F.octet_length(text).cast("long")
    date = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=doc.cast("int"))
    digest = F.sha2(text, 256)
    day = F.make_dt_interval(mins=(doc * 37 % 1000).cast("int"))
    return documents.select(
        F.concat(F.lit("m"), doc.cast("string")).alias("gmail_id"),
        F.concat(F.lit("<"), digest, F.lit("@generated>")).alias("rfc_message_id"),
        F.concat(F.lit("t"), (doc % 50).cast("string")).alias("thread_id"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("subject"),
        F.concat("lang", F.lit("@"), "source", F.lit(".example.com")).alias("from_addr"),
        F.concat(F.lit("list-"), (doc % 7).cast("string"), F.lit("@example.com")).alias("to_addr"),
        F.lit(None).cast("string").alias("cc_addr"),
        date.alias("date"),
        F.date_format(date, "EEE, dd MMM yyyy HH:mm:ss +0000").alias("date_raw"),
        (date + day).alias("archived_timestamp"),
        F.concat("source", F.lit(".mbox")).alias("archive_file"),
        (doc * F.lit(1048576)).alias("mbox_offset"),
        size.alias("mbox_length"),
        F.left(text, F.lit(1000)).alias("body_preview"),
        digest.alias("checksum"),
        size.alias("size_bytes"),
        F.array("source", "lang").alias("labels"),
        F.lit("default").alias("account_id"),
        text.alias("body"),
        doc.alias("doc_id"),
    )


#: The same view for DuckDB, as a common table expression.
MSGS_SQL = """msgs AS (
  SELECT 'm' || doc_id AS gmail_id,
    '<' || sha256(text) || '@generated>' AS rfc_message_id,
    't' || (doc_id % 50) AS thread_id,
    split_part(text, chr(10), 1) AS subject,
    lang || '@' || source || '.example.com' AS from_addr,
    'list-' || (doc_id % 7) || '@example.com' AS to_addr,
    CAST(NULL AS VARCHAR) AS cc_addr,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)) AS date,
    strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)),
             '%a, %d %b %Y %H:%M:%S +0000') AS date_raw,
    TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER))
      + to_minutes(CAST(doc_id * 37 % 1000 AS INTEGER)) AS archived_timestamp,
    source || '.mbox' AS archive_file,
    doc_id * 1048576 AS mbox_offset,
    CAST(octet_length(encode(text)) AS BIGINT) AS mbox_length,
    left(text, 1000) AS body_preview,
    sha256(text) AS checksum,
    CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
    'default' AS account_id,
    text AS body, source, lang, doc_id
  FROM documents)"""
