import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from mailspark.llm import components, exact_dedup, simhash
from tests.llm.data import TEXTS, documents, skewed


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_exact_decisions(spark):
    rows = exact_dedup.new_index(spark).ingest(documents(spark), "one").collect()
    assert len(rows) == len(TEXTS)
    groups = {}
    for i, t, _ in TEXTS:
        groups.setdefault(lowered(t), []).append(i)
    keeps = {i: (max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g}
    for r in rows:
        assert (r.keep_id, r.group_size) == keeps[r.doc_id]
        assert r.kept == (r.doc_id == r.keep_id)


def test_exact_survivors(spark):
    docs = documents(spark)
    rows = exact_dedup.survivors(docs)
    assert rows.columns == docs.columns
    got = [(r.doc_id, r.text) for r in rows.collect()]
    assert len(got) == len(set(got)) == len({lowered(t) for _, t, _ in TEXTS})
    assert exact_dedup.survivors(docs.limit(0)).count() == 0


def test_exact_hot_text(spark):
    rows = exact_dedup.new_index(spark).ingest(skewed(spark), "one").filter("group_size > 1").collect()
    assert len(rows) == 200 and {r.keep_id for r in rows} == {597}
    assert exact_dedup.survivors(skewed(spark)).count() == 401


def test_exact_batches(spark, tmp_path):
    docs = documents(spark).select("doc_id", "text")
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    first = exact_dedup.survivors(docs.filter("doc_id <= 6"), index, "first")
    assert sorted(r.doc_id for r in first.collect()) == [3, 5, 6]
    second = index.ingest(docs.filter("doc_id <= 8"), "second").collect()
    known = {r.doc_id: r for r in second}
    assert known[1].known and not known[1].kept and known[1].keep_id == 3
    assert known[8].kept and not known[8].known
    assert index.entries().count() == 5
    reopened = index.compact(str(tmp_path / "compacted"))
    assert reopened.entries().count() == 5
    plan = docs.select(docs.text.cast("binary").alias("digest")).hint("merge").join(
        reopened.entries(), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan


def test_index_reopened_under_other_settings(spark, tmp_path):
    """The bucket count is the index's own, not the session's."""
    docs = documents(spark, [(i, f"text number {i}", "a") for i in range(200)])
    name, path = "spark.sql.shuffle.partitions", str(tmp_path / "index")
    before = spark.conf.get(name)
    try:
        for count, batch in ((8, "one"), (3, "two"), (13, "three")):
            spark.conf.set(name, count)
            rows = exact_dedup.DigestIndex(spark, path).ingest(docs, batch).collect()
            assert len(rows) == 200 and all(r.known == (batch != "one") for r in rows)
            assert all(r.kept == (batch == "one") for r in rows)
    finally:
        spark.conf.set(name, before)
    again = exact_dedup.DigestIndex(spark, path, 8)
    assert again.buckets == 8 and again.entries().count() == 200
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 4)
    spark.createDataFrame([(b"x" * 32, 1, "old", 1)], "digest binary, keep_id long, batch string, rows long").write.parquet(
        str(tmp_path / "bare"))
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, str(tmp_path / "bare"))


def test_second_batch_meets_the_first(spark, tmp_path):
    """Half of a group of copies in either batch, with null and repeated ids."""
    rows = [(i, f"Copy of {'many' if i % 3 == 0 else i % 7}", "a") for i in range(90)]
    rows += [(None, "copy of many", "a"), (None, "alone", "a"), (89, "COPY OF MANY", "b")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = exact_dedup.op9_digest_index(spark, str(tmp_path)).collect()
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(text.lower(), []).append(i)
    want = []
    for i, text, _ in rows:
        ids = groups[text.lower()]
        last = max((x for x in ids if x is not None), default=None)
        want.append((i, last, len(ids), i == last))
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got)



def brute_fingerprint(text):
    words = lowered(text).replace("\x0b", " ").replace("\x0c", " ")
    for c in "\t\n\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(values, radius=3):
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return [top(i) for i in range(len(values))]


def test_fingerprints():
    for _, t, _ in TEXTS[:11] + TEXTS[12:]:
        assert simhash.fingerprint(t or "") == brute_fingerprint(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=40), st.integers(0, 64), st.integers(0, 5))
def test_bk_tree_finds_all(values, query, radius):
    values = values + [v ^ (1 << query % 64) for v in values[:5]]
    tree = simhash.BkTree()
    for i, v in enumerate(values):
        tree.add(v, i)
    for q in values[:5] + [query]:
        assert sorted(tree.near(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def test_masks_find_every_pair():
    for n in (10, 10**8, 10**11):
        masks = simhash.first_masks(n)
        for bits in ((0, 1, 2), (0, 20, 40), (3, 21, 63), (15, 16, 17)):
            differing = sum(1 << b for b in bits)
            assert any(not m & differing for m in masks)
    for m in simhash.finer_masks(simhash.first_masks(10)[0]):
        assert m.bit_count() > 16


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    centre = int(rng.integers(0, 1 << 62))
    out = {0}
    for _ in range(n):
        v = centre if rng.random() < 0.6 else int(rng.integers(0, 1 << 62))
        for b in rng.integers(0, 64, rng.integers(0, 9)):
            v ^= 1 << int(b)
        out.add(v)
    return sorted(out)


def test_links_of_large_shards(spark):
    """Small trees: shards are keyed anew, and in the end paired off."""
    values = clustered(3, 260)
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    want = brute_classes(values)
    for tree, depth in ((4096, 3), (20, 3), (12, 1), (9, 0)):
        labels = {r.node: r.label for r in components.components(simhash.links(fps, 3, tree, depth)).collect()}
        signed = [v - (1 << 64) if v >> 63 else v for v in values]
        got = [labels.get(v, v) for v in signed]
        assert len({(w, g) for w, g in zip(want, got)}) == len(set(want)) == len(set(got)), (tree, depth)


def test_near_duplicates(spark):
    rows = simhash.near_duplicates(documents(spark)).collect()
    assert len(rows) == len(TEXTS)
    values = [simhash.fingerprint(t or "") for _, t, _ in TEXTS]
    tops = brute_classes(values)
    least = {}
    for (i, _, _), t in zip(TEXTS, tops):
        if i is not None:
            least[t] = min(i, least.get(t, i))
    want = sorted((str(i), str(least.get(t))) for (i, _, _), t in zip(TEXTS, tops))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == want
    assert {r.fp for r in rows if r.doc_id in (4, 5, 6)} == {0}
    kept = simhash.survivors(documents(spark))
    assert kept.count() == len(set(tops)) and kept.columns == documents(spark).columns
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0


def test_near_survivors_of_null_and_repeated_ids(spark):
    """One id, or none, on different texts: each component keeps a row."""
    texts = ["the first text is about boats and rivers in the far north of the land",
             "a second one tells of bread and how to bake it at home every day",
             "some third piece deals with stars planets and comets seen at night",
             "number four has nothing to do with any other of these short texts"]
    rows = [(None, t, "a") for t in texts[:3]] + [(None, texts[0], "a")]
    rows += [(5, texts[3], "a"), (5, texts[3] + " " + texts[1][::-1], "a"), (7, texts[2][::-1], "a")]
    # Id 9 leads one of its two components only.
    rows += [(9, texts[0][::-1], "a"), (9, texts[2][::-1], "a")]
    want = sorted([texts[0], texts[1], texts[2], rows[4][1], rows[5][1], texts[2][::-1], texts[0][::-1]])
    values = {simhash.fingerprint(t) for _, t, _ in rows}
    assert len(values) == 7 == len({t for t in brute_classes(sorted(values))})
    kept = simhash.survivors(documents(spark, rows)).collect()
    assert sorted(r.text for r in kept) == want
    assert sorted(str(r.doc_id) for r in kept) == ["5", "5", "7", "9", "None", "None", "None"]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (200, 201)]
    edges = spark.createDataFrame(chain, "u long, v long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
    assert components.components(edges.limit(0)).count() == 0
