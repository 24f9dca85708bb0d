"""Session settings and shared scratch space."""

import contextlib
import tempfile
import uuid

#: Runtime settings the operators are planned for. Skewed sort-merge joins are
#: split even where that adds a shuffle.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # A Python worker holds a few batches at a time, of long texts too.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


#: Bytes a shuffle partition should hold at most; AQE joins smaller ones.
PARTITION_BYTES = 128 << 20


def configure(spark, data_bytes=None):
    """Applies the settings; given the size of the data, also the number of
    shuffle partitions it needs."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if data_bytes is not None:
        now = int(spark.conf.get("spark.sql.shuffle.partitions"))
        needed = -(-data_bytes // PARTITION_BYTES)
        spark.conf.set("spark.sql.shuffle.partitions", str(max(now, needed)))
    return spark


def shared_dir(spark):
    """The folder every executor sees: the cluster's checkpoint folder. Only a
    local session, where all is one machine, may go without: it gets a
    temporary one."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="mailspark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return path


def scratch(spark, label):
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleared(spark):
    """Jobs that write inside remove their shuffle files as they end; else
    these stay on disk until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def written(df, label):
    """The rows as a table in the shared folder, computed once. Later stages
    read the table, also after executors were lost."""
    path = scratch(df.sparkSession, label)
    with cleared(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
