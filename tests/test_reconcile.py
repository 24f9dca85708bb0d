"""Reconciliation by digests against the full outer join."""

import random
from collections import Counter

import pytest

from mailspark.operators import index as I
from mailspark.operators import joins as J
from mailspark.operators import reconcile as RC

BY = ("archive_file", "rfc_message_id")


def side(spark, rows):
    return spark.createDataFrame(rows, "archive_file string, rfc_message_id string").repartition(5)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def outer(left, right, by=BY):
    return counted(RC.compare_ids(left, right, by).filter("status <> 'ok'"))


def differing(left, right, by=BY, bucket_rows=4):
    return counted(RC.compare_ids(*RC.narrowed(left, right, by, bucket_rows), by).filter("status <> 'ok'"))


def random_sides(seed, rows=600):
    """Two sides that mostly agree, a third of them in one archive, with
    copies on either side."""
    draw = random.Random(seed)
    names = ["hot.mbox"] * 5 + [f"{i}.mbox" for i in range(10)]
    shared = [(draw.choice(names), f"<{i}>") for i in range(rows)]
    left = [r for r in shared if draw.random() > 0.02] + draw.choices(shared, k=20)
    right = [r for r in shared if draw.random() > 0.02] + draw.choices(shared, k=20)
    return left + [("left.mbox", "<l>")], right + [("right.mbox", "<r>"), ("hot.mbox", "<l>")]


@pytest.mark.parametrize("seed", range(3))
def test_same_differences_as_the_outer_join(spark, seed):
    left, right = (side(spark, rows) for rows in random_sides(seed))
    assert differing(left, right) == outer(left, right)
    one = ("rfc_message_id",)
    assert differing(left, right, one) == outer(left, right, one)


def test_nulls_copies_and_empty_sides(spark):
    rows = [("a", "<1>"), ("a", "<1>"), ("a", None), (None, "<2>"), (None, None), ("", "")]
    left, none = side(spark, rows), side(spark, rows[:0])
    for one, two in ((left, left), (left, none), (none, left), (none, none)):
        assert differing(one, two) == outer(one, two)
    # Copies of one id cancel in no digest, whatever stands on the other side.
    one, two = side(spark, [("a", "<1>")] * 2), side(spark, [("a", "<2>")] * 2)
    assert differing(one, two) == outer(one, two) == Counter(
        {("a", "<1>", "missing"): 1, ("a", "<2>", "orphaned"): 1})
    once, twice = side(spark, [("a", "<1>")]), side(spark, [("a", "<1>")] * 2)
    assert not differing(once, twice)


def test_agree(spark):
    one = side(spark, [("a", "<1>"), ("b", "<1>"), ("b", "<2>")])
    other = side(spark, [("b", "<2>"), ("a", "<1>"), ("b", "<1>")])
    assert RC.agree(one, other, BY) and RC.agree(one.limit(0), other.limit(0), BY)
    assert not RC.agree(one, side(spark, [("b", "<1>"), ("a", "<1>"), ("a", "<2>")]), BY)
    assert not RC.agree(one, one.limit(0), BY)
    # Copies on one side, or keys without a value, are left for the join.
    assert not RC.agree(one, one.union(other.limit(1)), BY)
    nulls = side(spark, [("a", None)])
    assert not RC.agree(nulls, nulls, BY)
    RC.assert_written(one, one.union(other))


def test_sides_of_different_types(spark):
    left = spark.range(50).selectExpr("'a' AS archive_file", "CAST(id AS int) AS mbox_offset")
    right = spark.range(1, 51).selectExpr("'a' AS archive_file", "id AS mbox_offset")
    by = ("archive_file", "mbox_offset")
    assert differing(left, right, by) == outer(left, right, by)
    assert sum(differing(left, right, by).values()) == 2


def test_equal_buckets_are_not_joined(spark):
    rows = [(f"{i % 20}.mbox", f"<{i}>") for i in range(4000)]
    left = side(spark, rows)
    assert [side.isEmpty() for side in RC.narrowed(left, left, BY)] == [True, True]
    one, two = RC.narrowed(left, side(spark, rows[1:]), BY, bucket_rows=10)
    # One archive of 200 ids, in 20 buckets, of which one differs.
    assert 1 <= one.count() <= 40 and two.count() == one.count() - 1
    assert {r.archive_file for r in one.collect()} == {"0.mbox"}


def test_only_digests_are_shuffled(spark):
    left = side(spark, [("a", f"<{i}>") for i in range(100)])
    rows = RC._sides(left, left, BY)
    text = RC.differing_groups(rows, 1)._jdf.queryExecution().executedPlan().toString()
    above = text[:text.index("Union")]
    # One exchange above the union, of what the tasks have aggregated.
    assert above.count("Exchange") == 1
    assert "partial_bit_xor" in above[above.index("Exchange"):]


def test_past_the_broadcast_bound(spark, monkeypatch):
    left, right = (side(spark, rows) for rows in random_sides(9, 200))
    monkeypatch.setattr(J, "BROADCAST_BYTES", 0)
    assert differing(left, right) == outer(left, right)


def test_index_rows_come_as_often_as_given(spark):
    """Messages without a place share one; each is missing from the index."""
    make = lambda rows: spark.createDataFrame(rows, "archive_file string, mbox_offset long")
    messages = make([("a", 0), ("a", -1), ("a", -1), ("b", 5)])
    indexed = make([("a", 0), ("a", 0), ("b", 5), ("c", 1), ("c", 1)])
    found = counted(I.compare_index(messages, indexed).select("archive_file", "mbox_offset", "status"))
    assert found == Counter({("a", -1, "missing"): 2, ("c", 1, "orphaned"): 1})
