from collections import Counter
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mailspark.llm import mixing, sharding
from tests.llm.data import TEXTS, documents, skewed


def test_shards_hold_the_mixture(spark):
    rows = sharding.interleave(skewed(spark), 7).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(7):
        mine = [r for r in rows if r.shard == s]
        assert sorted(r.slot for r in mine) == list(range(len(mine)))
        assert abs(sum(r.source == "hot" for r in mine) - len(mine) / 3) <= 1.5
    assert len(rows) == 600


def test_shards_of_odd_rows(spark):
    docs = documents(spark)
    rows = sharding.interleave(docs, 4)
    assert rows.columns.count("shard") == rows.columns.count("slot") == 1
    assert rows.count() == len(TEXTS)
    assert sharding.interleave(docs.limit(0), 4).count() == 0
    again = sharding.interleave(docs.repartition(5), 4)
    key = ["doc_id", "text", "shard", "slot"]
    assert sorted(map(str, rows.select(key).collect())) == sorted(map(str, again.select(key).collect()))


def test_shards_are_written_whole(spark, tmp_path):
    sharding.write_shards(sharding.interleave(skewed(spark, 60), 3), str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=8))
def test_deviation_stays_below_one_block(quotas):
    quotas = {f"s{i}": q for i, q in enumerate(quotas)}
    length = sum(quotas.values())
    order = sorted((t, s) for s, times in mixing.period(quotas).items() for t in times)
    assert [t for t, _ in order] == list(range(length))
    have = Counter()
    for t, s in order:
        have[s] += 1
        assert all(abs(have[k] - Fraction(q * (t + 1), length)) < 1 for k, q in quotas.items())


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 90), st.integers(1, 9)), min_size=1))
def test_schedule_places_each_block_once(sources):
    segments = mixing.schedule({s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()})
    times, blocks = [], Counter()
    for seg in segments:
        for s, own in seg["times"].items():
            for r in range(seg["repeats"]):
                times += [seg["start"] + r * seg["length"] + t for t in own]
            blocks[s] += len(own) * seg["repeats"]
    assert sorted(times) == list(range(sum(n for n, _ in sources.values())))
    assert blocks == {s: n for s, (n, _) in sources.items() if n}


def test_weights():
    assert mixing.parts({"a": 1, "b": 3}) == {"a": 1, "b": 3}
    assert sum(mixing.parts({"a": 0.123, "b": 0.5, "c": 0.377}).values()) <= mixing.RESOLUTION
    with pytest.raises(ValueError):
        mixing.parts({"a": 0})


def test_mix_follows_targets(spark):
    docs = skewed(spark, 2100)
    rows = mixing.mix(docs, {"hot": 1, **{f"s{i}": 1 for i in range(7)}}, block=4).collect()
    rows.sort(key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(2100))
    # While all sources last, each has a block more or less than an eighth.
    for n in (160, 480, 800):
        for s, have in Counter(r.source for r in rows[:n]).items():
            assert abs(have - n / 8) <= 2 * 4, s
    assert {r.source for r in rows[-100:]} == {"hot"}


def test_mix_of_odd_rows(spark):
    docs = documents(spark)
    mixed = mixing.mix(docs, block=2)
    rows = mixed.collect()
    assert sorted(r.position for r in rows) == list(range(len(TEXTS)))
    assert mixed.columns.count("position") == 1
    assert mixing.mix(docs.limit(0)).count() == 0
    few = mixing.mix(docs, block=2, strata=2).collect()
    assert sorted(r.position for r in few) == list(range(len(TEXTS)))
    assert len({r.stratum for r in few}) <= 2


def test_laid_out_in_order(spark, tmp_path):
    docs = skewed(spark, 300).select("doc_id", "text", "source")
    mixed = mixing.mix(docs)
    mixing.in_order(mixed, 5).write.parquet(str(tmp_path / "mixed"))
    import pyarrow.parquet as pq

    files = sorted((tmp_path / "mixed").glob("part-*"))
    found = [i for f in files for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert found == [r.doc_id for r in sorted(mixed.collect(), key=lambda r: r.position)]


def due(blocks, weights, time):
    """Blocks due to each source at a time, by filling up in turns."""
    have, left = dict.fromkeys(blocks, Fraction(0)), Fraction(time)
    while left:
        total = sum(Fraction(weights[s]) for s in blocks if have[s] < blocks[s])
        step = min([left / total, *((blocks[s] - have[s]) / Fraction(weights[s])
                                    for s in blocks if have[s] < blocks[s])])
        for s in blocks:
            if have[s] < blocks[s]:
                have[s] += step * Fraction(weights[s])
                left -= step * Fraction(weights[s])
    return have


def follows(order, rows, weights, block):
    """Each source has less than one block more or less than its due, after
    each block of the order (a source per row)."""
    blocks = {s: -(-n // block) for s, n in rows.items()}
    have, time = Counter(), 0
    for at, s in enumerate(order):
        have[s] += 1
        if have[s] % block and have[s] < rows[s]:
            assert order[at + 1] == s
            continue
        time += 1
        if time % 7 == 0 or time < 50:
            for k, want in due(blocks, weights, time).items():
                assert abs(-(-have[k] // block) - want) < 1, (k, time)
    assert have == rows


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(1, 60), st.floats(1e-4, 9)), min_size=1))
def test_order_follows_what_is_due(sources):
    rows, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    follows([s for s, _ in mixing.taken(rows, weights)], rows, weights, 1)


def test_true_weights_over_many_blocks():
    """Weights that are no thousandths stay exact; a small one isn't raised."""
    weights = {"a": Fraction(1, 10000), "b": Fraction(1, 3), "c": Fraction(2, 7), "d": Fraction(30467, 80000)}
    weights["d"] = 1 - weights["a"] - weights["b"] - weights["c"]
    have = Counter()
    for time, (s, i) in enumerate(mixing.taken(dict.fromkeys(weights, 60_000), weights), 1):
        assert i == have[s]
        have[s] += 1
        assert all(abs(have[k] - w * time) < 1 for k, w in weights.items())
        if time == 100_000:
            break
    assert have["a"] in (9, 10, 11)


def test_every_source_has_its_weight(spark):
    """400 sources and rows of none, each a stratum of its own."""
    made = [(i, "x", None if s == 0 else f"s{s}") for s in range(401) for i in range(s * 1000, s * 1000 + 3 + s % 9)]
    rows = mixing.mix(documents(spark, made), block=2).collect()
    sizes = Counter(str(r.source) for r in rows)
    assert len(sizes) == 401 and all(r.stratum == r.source for r in rows)
    rows.sort(key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(made)))
    order, blocks = [str(r.source) for r in rows], {s: -(-n // 2) for s, n in sizes.items()}
    weights = {s: Fraction(n ** mixing.TEMPERATURE) for s, n in sizes.items()}
    have, time = Counter(), 0
    for s in order:
        have[s] += 1
        if have[s] % 2 and have[s] < sizes[s]:
            continue
        time += 1
        if time % 400 == 0:
            for k, want in due(blocks, weights, time).items():
                assert abs(-(-have[k] // 2) - want) < 1, (k, time)
