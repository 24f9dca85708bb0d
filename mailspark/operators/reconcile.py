"""Set reconciliation: two sides that mostly agree are compared by digests, and
only where those differ by their rows.

A digest doesn't depend on the order of rows, and each task makes a part of it,
so what is shuffled is a few numbers per group and task. It takes two rounds:
first per group (an archive), then, in the groups that differ, per bucket of
ids; the first round's counts say how many buckets a group needs. The ids of the
buckets that still differ are all that is left to join.
"""

import secrets

from pyspark.sql import functions as F

from mailspark.operators.joins import keys_for_join
from mailspark.session import written

#: Ids a bucket holds on average.
BUCKET_ROWS = 1024

#: Bits of a word of the digest: sums of it fit in a BIGINT for 2^41 rows.
WORD = 22


def _differs(salt):
    """Aggregates over the rows of both sides, and whether they tell of a
    difference. The sums of a group are zero if both sides have the same ids
    equally often; so is the bitwise sum of a second hash."""
    sign = F.when(F.col("_side") == 0, F.lit(1)).otherwise(F.lit(-1)).cast("long")
    one, two = F.xxhash64(F.lit(salt), "_id"), F.xxhash64(F.lit(salt), F.lit(2), "_id")
    words = {f"_w{k}": F.sum(sign * F.shiftrightunsigned(one, at).bitwiseAND(F.lit((1 << WORD) - 1)))
             for k, at in enumerate(range(0, 64, WORD))}
    found = {"_n": F.sum(sign), "_x": F.bit_xor(two), **words,
             # A row without a key equals none, so its group has to be joined.
             "_nulls": F.count_if(F.col("_keyless")),
             "_most": F.greatest(F.count_if(F.col("_side") == 0), F.count_if(F.col("_side") == 1))}
    differs = F.col("_nulls") > 0
    for name in ("_n", "_x", *words):
        differs = differs | (F.col(name) != 0)
    return [c.alias(name) for name, c in found.items()], differs


def _sides(left, right, by):
    """Rows of both sides in common types, with side, group and id."""
    rows = left.select(*by, F.lit(0).alias("_side")).unionByName(right.select(*by, F.lit(1).alias("_side")))
    group = F.struct(*by[:-1]) if len(by) > 1 else F.lit(0)
    keyless = F.lit(False)
    for c in by:
        keyless = keyless | F.col(c).isNull()
    return rows.withColumns({"_group": group, "_id": F.col(by[-1]), "_keyless": keyless})


def differing_groups(rows, salt, bucket_rows=BUCKET_ROWS):
    """Groups (all columns of the key but the last) on which the sides differ,
    with the number of buckets that their ids are cut into."""
    found, differs = _differs(salt)
    return rows.groupBy("_group").agg(*found).filter(differs).select(
        "_group", F.ceil(F.col("_most") / bucket_rows).cast("long").alias("_buckets"))


def _bucketed(rows, groups, salt):
    """The rows of these groups with the bucket of their id."""
    wanted = groups.withColumnRenamed("_group", "_g")
    bucket = F.pmod(F.xxhash64(F.lit(salt), F.lit(3), "_id"), F.col("_buckets"))
    return rows.join(keys_for_join(wanted), F.col("_group").eqNullSafe(F.col("_g"))).withColumn(
        "_bucket", bucket).drop("_g", "_buckets")


def agree(left, right, by):
    """Whether both sides hold the same keys, equally often and none null: one
    job, which shuffles digests only."""
    return differing_groups(_sides(left, right, list(by)), secrets.randbits(62)).isEmpty()


def narrowed(left, right, by, bucket_rows=BUCKET_ROWS):
    """The ``by`` columns of both sides, without the rows of buckets on which
    the sides agree; rows come as often as they are given there.

    A join of what is left finds the same differences as one of all rows: rows
    in different buckets never meet, and rows with a null in their key, which
    meet none, are always left. Copies that only one side has make a bucket
    differ and are left for the join. Sides that agree are read once and give
    two empty tables; others are read three times, so they should be tables.

    Hashes of 64 bits are salted anew in each call. Two sides that differ by
    chance go unseen with a probability of about 2^-128; ids that somebody
    made to collide would have to do so under a salt not known beforehand.
    """
    by, salt = list(by), secrets.randbits(62)
    rows = _sides(left, right, by)
    groups = written(differing_groups(rows, salt, bucket_rows), "differing-groups")
    if groups.isEmpty():
        rest = rows.filter(F.lit(False))
    else:
        rows = _bucketed(rows, groups, salt)
        found, differs = _differs(salt)
        buckets = written(rows.groupBy("_group", "_bucket").agg(*found).filter(differs)
                          .select(F.col("_group").alias("_g"), F.col("_bucket").alias("_b")), "differing-buckets")
        # The bucket of a row without an id is that of its hash, as of any other.
        rest = rows.join(keys_for_join(buckets), F.col("_group").eqNullSafe(F.col("_g"))
                         & (F.col("_bucket") == F.col("_b")), "left_semi")
    return tuple(rest.filter(F.col("_side") == side).select(*by) for side in (0, 1))


def compare_ids(archived, messages, by=("archive_file", "rfc_message_id")):
    """Every distinct id of both sides with ``status``: ok, orphaned (only in
    the catalogue) or missing (only in the archive)."""
    by = list(by)
    left = archived.select(*by).distinct().withColumn("_a", F.lit(True))
    right = messages.select(*by).distinct().withColumn("_c", F.lit(True))
    status = (F.when(F.col("_a").isNull(), "orphaned").when(F.col("_c").isNull(), "missing")
              .otherwise("ok"))
    return left.join(right, by, "full_outer").select(*by, status.alias("status"))


def differing_ids(archived, messages, by=("archive_file", "rfc_message_id")):
    """Those rows of ``compare_ids`` whose status is not ok."""
    return compare_ids(*narrowed(archived, messages, by), by).filter("status <> 'ok'")


def expected_vs_written(expected, written, key="rfc_message_id"):
    """Ids that differ between what was to be written and what was."""
    return differing_ids(written, expected, [key]).select(
        key, F.when(F.col("status") == "orphaned", "lost").otherwise("unexpected").alias("status"))


def assert_written(expected, written, key="rfc_message_id"):
    if agree(written, expected, [key]):
        return
    differing = expected_vs_written(expected, written, key).limit(10).collect()
    if differing:
        shown = ", ".join(f"{row[0]} ({row[1]})" for row in differing)
        raise ValueError(f"written archive differs from the messages: {shown}")
