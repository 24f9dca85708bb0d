import zlib

import numpy as np
import pytest

import corpus_pipeline
from mailspark.llm import mixing, quality_model, quality_rules, simhash
from mailspark.llm.common import table
from tests.llm.data import TEXTS, documents
from tests.llm.test_dedup import brute_classes, lowered


def test_held_out_accuracy(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality_model.scored(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.85 * len(held)
    assert len(rows) == docs.count()


def test_held_out_labels_are_not_read(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    other = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(encode(cast(doc_id AS string), 'UTF-8')) % 4 = 2 THEN 1 - quality "
        "ELSE quality END AS quality")
    one = sorted(map(str, quality_model.scored(docs, labels).collect()))
    assert one == sorted(map(str, quality_model.scored(docs, other).collect()))


def test_odd_rows_are_scored(spark):
    docs = documents(spark)
    some = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (7, 0), (8, 1), (9, 1), (None, 1), (99, 0), (1, None)],
                                 "doc_id long, quality int")
    rows = quality_model.scored(docs, some).collect()
    assert len(rows) == len(TEXTS) and len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    none = quality_model.scored(docs, some.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_model.scored(docs.limit(0), some).count() == 0


def test_word_vectors_count_all_neighbours(spark):
    texts = ["alpha beta gamma delta", "beta alpha. 77 77 BIG", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = quality_model.word_vectors(docs.repartition(3))
    places, signs = quality_model.index_vectors()
    want, reader = np.zeros_like(got, float), quality_model.Reader()
    for t in texts:
        ids = reader.buckets(t or "")
        for i, a in enumerate(ids):
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= quality_model.REACH:
                    want[a, places[b]] += signs[b]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, want / np.where(norm > 0, norm, 1), atol=1e-6)


def test_forms():
    reader = quality_model.Reader()
    ids = reader.buckets("one two\none two\nTHREE! 12 x x")
    assert list(ids).count(quality_model.COPIED) == 2
    assert quality_model.CAPITALS in ids and quality_model.NUMBER in ids and quality_model.AGAIN in ids


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, quality_model.DIMENSIONS))
    p = 1 / (1 + np.exp(-2 * x[:, 0] - x[:, 1] * (x[:, 1] > 0)))
    y = (rng.random(3000) < p).astype(float)
    net = quality_model.Network().fit(x[:2000], y[:2000], np.arange(2000) % 8 == 0)
    score = net.score(x[2000:])
    assert ((score > 0.5) == (p[2000:] > 0.5)).mean() > 0.75
    assert net.temperature > 1


# ---------------------------------------------------------------------- pipeline


def stages(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        yield docs


def brute_pipeline(rows, kept):
    """Ids after the three filtering stages, from (id, text) rows."""
    rows = [r for r in rows if r[0] in kept]
    last = {}
    for i, t in rows:
        last[lowered(t)] = max(i, last.get(lowered(t), i))
    rows = sorted((i, t) for i, t in rows if last[lowered(t)] == i)
    tops = brute_classes([simhash.fingerprint(t) for _, t in rows])
    return [i for (i, _), top in zip(rows, tops) if rows[top][0] == i]


def test_pipeline_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = {r.doc_id for r in quality_rules.ledger(docs).filter(quality_rules.passes()).collect()}
    want = brute_pipeline([(r.doc_id, r.text) for r in docs.collect()], kept)
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == want
    texts = {r.doc_id: r.text for r in docs.collect()}
    from tokenizers import Tokenizer

    from mailspark.llm import bpe

    library = Tokenizer.from_file(bpe.default_path())
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names, found = docs.columns, list(stages(spark, docs, sf_dir))
    assert all(d.columns == names for d in found[:-1])


def test_mixing_stage_orders_the_files(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    corpus_pipeline.mixed(spark, docs, sf_dir).write.parquet(str(tmp_path / "mixed"))
    import pyarrow.parquet as pq

    order = [i for f in sorted((tmp_path / "mixed").glob("part-*")) for i in pq.read_table(f)["doc_id"].to_pylist()]
    want = [r.doc_id for r in mixing.mix(docs).orderBy("position").collect()]
    assert order == want


def test_mixture_reaches_the_result(spark, sf_dir):
    """Every prefix of the result by position holds the sources by weight."""
    from collections import Counter

    from tests.llm.test_sharding_mixing import follows

    rows = sorted(corpus_pipeline.run(spark, sf_dir).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(len(rows)))
    sizes = Counter(r.source for r in rows)
    weights = {s: n ** mixing.TEMPERATURE for s, n in sizes.items()}
    follows([r.source for r in rows], sizes, weights, mixing.BLOCK)


@pytest.mark.parametrize("rows", [TEXTS, []])
def test_odd_rows_pass(spark, sf_dir, rows):
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    out = list(stages(spark, docs, sf_dir))[-1].collect()
    assert len(out) == len({r.doc_id for r in out})


def test_scores_with_repeated_ids_do_not_depend_on_the_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    again = docs.filter("doc_id < 40").selectExpr("doc_id", "concat('another text ', text, ' spam spam') AS text")
    whole = docs.unionByName(again)
    one, other = ({(r.doc_id, r.score) for r in quality_model.scored(rows, labels).collect()}
                  for rows in (whole.repartition(7), whole.orderBy("text").coalesce(2)))
    assert {(i, round(s, 9)) for i, s in one} == {(i, round(s, 9)) for i, s in other}
