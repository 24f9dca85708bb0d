"""Helpers of the operators in this package."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.session import configure

#: White space between words, as the operators take it.
GAPS = r"[\x20\x09-\x0D]+"

#: Pieces into which a group is cut to rank its rows: three hex digits.
PIECES = 4096


def table(spark, sf_dir, name):
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(df, name="text"):
    """The text column, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def group_key(column):
    """A text that tells all values of a column apart, null too."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def shuffled(column, seed):
    """Seeded shuffle key: an MD5 in hex, evenly spread."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(column.cast("string"), F.lit("null"))))


def ranked(df, group, order, rank, size):
    """Adds ``rank`` (0-based, by ``order``, then by the other columns) and
    ``size`` of the group to each row, and gives the table of pieces.

    ``order`` holds MD5 hex texts. A group is cut into 4096 pieces by their
    first digits; the counts of the pieces before a piece carry the rank
    across. So no task holds a whole group, even one of a third of all rows.
    """
    piece, before = "__piece", "__before"
    rows = df.withColumn(piece, F.conv(F.substring(order, 1, 3), 16, 10).cast("int"))
    inside = W.partitionBy(group)
    pieces = (
        rows.groupBy(group, piece).agg(F.count(F.lit(1)).alias("__n"))
        .withColumn(before, F.coalesce(
            F.sum("__n").over(inside.orderBy(piece).rowsBetween(W.unboundedPreceding, -1)),
            F.lit(0)))
        .withColumn(size, F.sum("__n").over(inside))
    )
    others = [F.col(f"`{c}`") for c in df.columns if c not in (group, order)]
    by_order = W.partitionBy(group, piece).orderBy(order, F.xxhash64(*others))
    out = (
        rows.join(pieces.drop("__n"), [group, piece])
        .withColumn(rank, F.row_number().over(by_order).cast("long") - 1 + F.col(before))
        .drop(piece, before)
    )
    return out, pieces
