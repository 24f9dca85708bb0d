"""Import as a continuously running job: landed files in, new messages out.

Which ids were seen is keyed state in RocksDB: a batch is told apart by its own
ids and reads no earlier batch. What the catalogue held before the job was
first started goes into the state with the first batch. Rows that cannot be
parsed go to a table of failures.
"""

import uuid

from pyspark.sql import functions as F

from mailspark import schema
from mailspark.operators.joins import known_among
from mailspark.operators.parse import parse_messages
from mailspark.sources import tables as T
from mailspark.sources.storage import exists, list_folders

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: What the state tells rows apart by: the id; of a failure, what is left.
_KEY, _SEED = "_key", "_seed"


def landed_json(spark, path, max_files=None):
    """Stream of landed remote messages."""
    reader = spark.readStream.schema(schema.API_MESSAGE)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return T.decode_api_messages(reader.json(path))


def parsed_stream(raw_stream, archived_at=None):
    """Stream of parsed messages, failures among them, with the key of their
    state."""
    rows = parse_messages(raw_stream, archived_at=archived_at)
    left = F.concat_ws(":", F.lit("failed"), "gmail_id", F.sha2(F.coalesce("parse_error", F.lit("")), 256))
    return rows.withColumn(_KEY, F.when(F.col("parse_error").isNull(), F.col("rfc_message_id")).otherwise(left))


def new_messages(raw_stream, archived_at=None, seed_path=None, watermark=None):
    """Stream of parsed messages and failures, each once. ``seed_path`` holds
    ids (rfc_message_id) that were there before; their rows come with
    ``_seed`` and carry nothing else.

    The state keeps every id. With a ``watermark`` it keeps recent ids only;
    the watermark runs on arrival, not on the date of the mail, so old mail
    that lands late is never dropped."""
    rows = parsed_stream(raw_stream, archived_at).withColumn(_SEED, F.lit(False))
    if seed_path is not None:
        seed = raw_stream.sparkSession.readStream.schema("rfc_message_id string").parquet(seed_path)
        seed = seed.select(F.col("rfc_message_id").alias(_KEY), "rfc_message_id", F.lit(True).alias(_SEED))
        rows = rows.unionByName(seed, allowMissingColumns=True)
    if watermark is None:
        return rows.dropDuplicates([_KEY])
    return (rows.withColumn("arrival", F.current_timestamp()).withWatermark("arrival", watermark)
            .dropDuplicatesWithinWatermark([_KEY]).drop("arrival"))


def append_batch(catalogue_path, query=None, failures_path=None, every_batch=True):
    """A ``foreachBatch`` function that appends what the catalogue lacks, and
    failures to a table of theirs.

    Each micro-batch of a query owns one folder, which a repeated attempt
    replaces, so a restart neither loses nor repeats a message. The folder
    carries the id of the query, which lives in its checkpoint: a new
    checkpoint writes to folders of its own.

    The first batch is compared with the ids of all other folders, as its
    messages may meet the ids that fill the state; later ones are not, unless
    the state forgets (``every_batch``)."""

    def write(batch, number):
        context = batch.sparkSession.sparkContext
        owner = query or context.getLocalProperty("sql.streaming.queryId")
        if not owner:
            raise RuntimeError("the batch does not tell its query")
        name = f"batch={owner}-{number:09d}"
        batch = batch.persist()
        if "parse_error" in batch.columns:
            failed = batch.filter("parse_error IS NOT NULL")
            (failed.select(*[c for c in FAILURE if c in batch.columns])
             .write.mode("overwrite").parquet(f"{failures_path or failures_of(catalogue_path)}/{name}"))
            batch = batch.filter(f"parse_error IS NULL AND NOT {_SEED}").drop("parse_error", _KEY, _SEED)
        fresh = batch
        earlier = _earlier(batch.sparkSession, catalogue_path, name) if every_batch or not number else None
        if earlier is not None:
            known = known_among(earlier, batch, "rfc_message_id")
            fresh = batch.join(known, "rfc_message_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{catalogue_path}/{name}")
        batch.unpersist()

    return write


#: Columns of the table of failures.
FAILURE = ("gmail_id", "rfc_message_id", "archived_timestamp", "parse_error")


def failures_of(catalogue_path):
    """Where the failures of an import go unless told otherwise."""
    return f"{catalogue_path.rstrip('/')}-failures"


def read_failures(spark, catalogue_path):
    """What the import could not parse, each once."""
    return spark.read.parquet(failures_of(catalogue_path)).select(*FAILURE)


def _earlier(spark, catalogue_path, own):
    """Catalogue rows of all other batches; None if there are none."""
    done = [name for name in list_folders(catalogue_path)
            if name.startswith("batch=") and name != own]
    if not done:
        return None
    return spark.read.schema(schema.MESSAGES).parquet(*[f"{catalogue_path}/{n}" for n in done])


def compact(spark, catalogue_path, target):
    """Writes all batches to a new catalogue folder as one batch, so that later
    batches read few files. Streams go on with the new folder."""
    read_imported(spark, catalogue_path).write.parquet(f"{target}/batch=compacted-{uuid.uuid4().hex}")


def _seeded(spark, catalogue_path, checkpoint_path):
    """Folder of the ids that the catalogue held when the checkpoint was first
    used. It is written once and stays as it is."""
    path = f"{checkpoint_path.rstrip('/')}-seed"
    if not exists(f"{path}/_SUCCESS"):
        earlier = _earlier(spark, catalogue_path, None)
        ids = (spark.createDataFrame([], "rfc_message_id string") if earlier is None
               else earlier.select("rfc_message_id").distinct())
        ids.write.mode("overwrite").parquet(path)
    return path


def import_stream(raw_stream, catalogue_path, checkpoint_path, archived_at=None,
                  watermark=None, available_now=True, state_partitions=None):
    """Starts the import. With ``available_now`` it handles what has landed
    and stops; otherwise it keeps running. One import at a time writes to a
    catalogue. The number of state partitions is fixed when a checkpoint is
    first used, so it can be chosen here.

    Without a ``watermark`` the state, on the executors' disks and in the
    checkpoint, keeps every id, and a batch reads nothing but its own rows.
    With one the state is bounded, and each batch is compared with the ids of
    all others."""
    spark = raw_stream.sparkSession
    seed = _seeded(spark, catalogue_path, checkpoint_path) if watermark is None else None
    rows = new_messages(raw_stream, archived_at, seed, watermark)
    writer = (rows.writeStream
              .foreachBatch(append_batch(catalogue_path, every_batch=watermark is not None))
              .option("checkpointLocation", checkpoint_path))
    if available_now:
        writer = writer.trigger(availableNow=True)
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if state_partitions is not None:
        wanted["spark.sql.shuffle.partitions"] = str(state_partitions)
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read_imported(spark, catalogue_path):
    return spark.read.parquet(catalogue_path).select(*schema.MESSAGES.names)
