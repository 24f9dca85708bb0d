"""Listings, landed JSON and catalogue tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark import schema
from mailspark.functions import columns as C


def discover(spark, path, glob="*"):
    """Files under a folder: path, size_bytes, compression. Contents are not
    read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
             .option("recursiveFileLookup", "true").load(path))
    name = F.regexp_replace(F.col("path"), "^file:/*", "/")
    return files.select(
        name.alias("path"), F.col("length").alias("size_bytes"),
        C.compression_of(F.col("path")).alias("compression"))


def missing_sources(wanted, listing):
    """Wanted paths that a listing lacks."""
    return wanted.join(listing.select("path").distinct(), "path", "left_anti")


def decode_api_messages(landed):
    """Remote message resources with their base64url body decoded; a body that
    is no base64 gives NULL."""
    text = F.translate("raw", "-_", "+/")
    text = F.rtrim(text, F.lit("="))
    missing = F.pmod(-F.length(text), F.lit(4)).cast("int")
    padded = F.concat(text, F.repeat(F.lit("="), missing))
    return landed.select(
        F.col("id").alias("gmail_id"), F.col("threadId").alias("remote_thread_id"),
        F.col("labelIds").alias("labels"),
        F.try_to_binary(padded, F.lit("base64")).alias("raw"))


def read_api_messages(spark, path):
    return decode_api_messages(spark.read.schema(schema.API_MESSAGE).json(path))


def read_catalogue(spark, path, declared_version=None):
    """Catalogue table. Columns that came with later versions are filled with
    NULL; older layouts than 1.1 are refused."""
    df = spark.read.parquet(path)
    return conform(df, declared_version)


def conform(df, declared_version=None):
    version = schema.schema_version(df, declared_version)
    if version not in ("1.1", "1.2", "1.3"):
        raise schema.SchemaError(f"catalogue version {version} needs an upgrade first")
    schema.require(df, ("rfc_message_id", "archive_file", "mbox_offset", "mbox_length"))
    for field in schema.MESSAGES:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    if isinstance(df.schema["labels"].dataType, T.StringType):
        df = df.withColumn("labels", C.labels(F.col("labels")))
    if isinstance(df.schema["date"].dataType, T.StringType):
        df = df.withColumns({
            "date_raw": F.coalesce("date_raw", "date"), "date": C.parse_mail_date(F.col("date"))})
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.MESSAGES])


def write_catalogue(messages, path, mode="append"):
    """Catalogue files by month of the message, sorted by date inside, so that
    date ranges prune folders and row groups. Undated mail has a folder of its
    own. A month is split by id, whatever its size."""
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("undated"))
    rows = messages.select(*schema.MESSAGES.names).withColumn("month", month)
    (rows.repartitionByRange(F.col("month"), F.col("date"), F.col("rfc_message_id"))
     .sortWithinPartitions("month", "date")
     .write.mode(mode).partitionBy("month").parquet(path))
