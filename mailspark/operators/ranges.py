"""Ordered computations over groups of any size.

A window over a whole archive would put that archive into one task. Here an
ordered group is cut into ranges first: each range is computed by itself, and
a small table with one row per range carries the totals across."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.session import written

#: Archive bytes per range. A range holds at most this many bytes of mail.
RANGE_BYTES = 1 << 28


def lengths_from_offsets(records, sizes, range_bytes=RANGE_BYTES):
    """Length of each record: next offset in the archive minus its own, the
    last one up to the end of the file. ``sizes`` is (archive_file, file_size).
    """
    rows = records.withColumn("_range", F.floor(F.col("mbox_offset") / range_bytes))
    inside = W.partitionBy("archive_file", "_range").orderBy("mbox_offset")
    across = W.partitionBy("archive_file").orderBy("_range")
    ranges = (
        rows.groupBy("archive_file", "_range").agg(F.min("mbox_offset").alias("_first"))
        .join(sizes.select("archive_file", "file_size"), "archive_file", "left")
        .withColumn("_end", F.coalesce(F.lead("_first").over(across), F.col("file_size")))
        .select("archive_file", "_range", "_end")
    )
    following = F.coalesce(F.lead("mbox_offset").over(inside), F.col("_end"))
    return (
        rows.join(ranges, ["archive_file", "_range"], "left")
        .withColumn("mbox_length", following - F.col("mbox_offset"))
        .drop("_range", "_end")
    )


def _in_ranges(df, keys, order):
    """Rows range-partitioned by (keys, order) and written down, so that the
    range of a row is the same for every reader."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return written(ranged.withColumn("_range", F.spark_partition_id()), "ranges")


def _carried(df, keys, order, inside_total, range_total, name):
    keys = list(keys)
    rows = _in_ranges(df, keys, order)
    totals = rows.groupBy(*keys, "_range").agg(range_total.alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order)
    totals = totals.withColumnsRenamed({k: f"_of_{k}" for k in [*keys, "_range"]})
    same = F.lit(True)
    for k in [*keys, "_range"]:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return (
        rows.join(totals, same).drop(*[f"_of_{k}" for k in [*keys, "_range"]])
        .withColumn(name, (inside_total(inside) + F.col("_before")).cast("long"))
        .drop("_range", "_before")
    )


def positions(df, keys, order, name="position"):
    """0-based position of each row within its keys. ``order`` must tell all
    rows of a key apart."""
    return _carried(df, keys, order, lambda w: F.row_number().over(w) - 1, F.count("*"), name)


def running_total(df, keys, order, value, name):
    """Sum of ``value`` over the rows before this one within its keys."""

    def inside(window):
        earlier = window.rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    return _carried(df, keys, order, inside, F.sum(value), name)


def repack_offsets(messages, keys, order, length="mbox_length"):
    """Offsets in a new archive: running total of the lengths in output
    order, one archive per combination of the keys."""
    return running_total(messages, keys, order, F.col(length), "new_offset")


def assign_batches(df, order, size):
    """Number of the fixed-size batch each row falls into."""
    numbered = positions(df, [], order, "_position")
    return numbered.withColumn("batch", F.floor(F.col("_position") / size)).drop("_position")
