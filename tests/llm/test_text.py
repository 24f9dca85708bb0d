import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash  # noqa: F401
from tokenizers import Tokenizer

from mailspark.llm import bpe, pii, quality_rules
from mailspark.llm.common import table
from tests.llm.data import LONG, TEXTS, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ----------------------------------------------------------------- quality rules


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    counts, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            covered.update(range(i, i + 5))
    return {"n_words": len(words), "word_chars": sum(map(len, words)),
            "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len(covered), "n_lines": len(lines), "n_upper": sum(c.isupper() for c in text),
            "n_echoes": sum(a == b for a, b in zip(words, words[1:]))}


ODD = ["a b c d e a b c d e", "a a a a a a", "x " * 11, "1 2 3 4 5 6 1 2 3 4 5 6 7 3 4 5 6 7", "# * $\x0b%\x0c& | < >",
       "one word   here", "A B C D E F G H I J", "\n\n a \n a \n", LONG + " " + LONG[:5000]]


def test_measures(spark):
    rows = TEXTS + [(100 + i, t, "z") for i, t in enumerate(ODD)]
    docs = documents(spark, rows)
    got = quality_rules.ledger(docs).collect()
    want = sorted(((i, *brute_measures(t).values()) for i, t, _ in rows), key=str)
    assert sorted(((r.doc_id, *[r[m] for m in quality_rules.MEASURES]) for r in got), key=str) == want
    for r in got:
        assert bool(r.failed & 1) == (r.n_words < 10)
        assert bool(r.failed & 2) == (100 * r.n_repeat_words > 20 * r.n_words)


def test_filter_keeps_rows_whole(spark):
    docs = documents(spark)
    kept = quality_rules.filtered(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and ids.count(9) == 2 and not {4, 5, 6, 7} & set(ids)
    assert quality_rules.filtered(docs.limit(0)).count() == 0


def test_ablation(spark, sf_dir):
    rows = quality_rules.ledger(table(spark, sf_dir, "documents"))
    failed = [r.failed for r in rows.select("failed").collect()]
    for r in quality_rules.ablation(rows).collect():
        bit, rest = quality_rules.BIT[r.rule], quality_rules.mask("v2") & ~quality_rules.BIT[r.rule]
        assert r.fails == sum(bool(f & bit) for f in failed)
        assert r.kept == sum(not f & rest for f in failed)
        assert r.alone == sum(bool(f & bit) and not f & rest for f in failed)


def test_policies_agree_with_labels(spark, sf_dir):
    """Documents labelled as good stay, the others go, but for the base rules."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    rows = quality_rules.ledger(table(spark, sf_dir, "documents")).join(labels, "doc_id").withColumn(
        "kept", quality_rules.passes()).collect()
    assert all(r.kept or r.failed & quality_rules.mask("base") for r in rows if r.quality)
    assert sum(r.kept for r in rows if not r.quality) <= 1


# --------------------------------------------------------------------------- bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.read_vocabulary(bpe.default_path()))


def test_every_code_point(own, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 61 == 0)]
    texts = [f"a{chr(c)}b {chr(c) * 2} 1{chr(c)}" for c in points]
    for start in range(0, len(texts), 5000):
        part = texts[start:start + 5000]
        for text, theirs, mine in zip(part, library.encode_batch(part, add_special_tokens=False),
                                      own.encode_batch(part)):
            assert theirs.ids == mine.tolist(), text


def test_random_words(own, library):
    rng = random.Random(7)
    alphabets = ["ehtanosir", "abcdeeettt  \n'sé一ñ😀#!0123", [chr(c) for c in range(33, 127)], " \n\t", "ab"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 200))) for a in alphabets for _ in range(800)]
    texts += ["a" * 5000, " " * 700, "<|endoftext|>" * 3 + "x", "x<|endoftext|>", "<|endoftext", "\x00", "I'll've 'S's"]
    ids = own.encode_batch(texts)
    for text, theirs, mine in zip(texts, library.encode_batch(texts, add_special_tokens=False), ids):
        assert theirs.ids == mine.tolist(), text[:50]
        assert own.decode(mine) == text


def test_verification_is_exact(own):
    """A proposal passes exactly when it is what merging gives."""
    rng = random.Random(11)
    words = ["".join(rng.choice("ehtanosirdlu") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    words = sorted(set(words))
    assert own.encode_words(words) == [own.merge(w.encode()) for w in words]
    import numpy as np

    proposed = [own.propose(w.encode()) for w in words]
    for tokens, w in zip(proposed, words):
        a = np.array(tokens)
        fits = bool(own.reachable[a].all() and own.compatible(a[:-1], a[1:]).all())
        assert fits == (tokens == own.merge(w.encode()))


def test_encode_rows(spark, library):
    docs = documents(spark)
    out = bpe.encode(docs)
    assert out.columns.count("ids") == out.columns.count("n_tokens") == 1
    rows = out.collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert r.ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    back = bpe.decode(out.select("text", "ids")).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert bpe.encode(docs.limit(0)).count() == 0


# --------------------------------------------------------------------------- pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_valid(kind, match):
    digits = [int(c) for c in match if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "")
            if brute_valid(k, m[0])]


PII = [
    "a@b.c_m@x.y.z 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 4111 1111-1111 1111 +1 (017) 555-7713. x",
    "😀é call +44 20 7946 0958, or x.y@mail.example.com; token = \"f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda\"",
    "john (at) site (dot) org wrote to Dr. Anna Meier, ssn 123-45-6789, tel (212) 555-1234 now",
    "@ a@ @b a@b a@b. a@b..c +1 +1( +12345678 ++4912345678 12345678901234567890 1-2-3-4",
    "9" * 4000 + " " + "a" * 4000 + "@ " + "1-" * 3000 + " q@w.er" * 400,
    "version 10.0.0.1 and 4929348385146306 4417744280351547",
]


def test_base_spans(spark):
    rng = random.Random(5)
    noise = ["".join(rng.choice("@.+-() 0123456789ab") for _ in range(300)) for _ in range(60)]
    rows = TEXTS + [(1000 + i, t, "p") for i, t in enumerate(PII + noise)]
    docs = documents(spark, rows)
    found = pii.candidates(docs).collect()
    want = sorted(((i, brute_base(t)) for i, t, _ in rows), key=str)
    got = sorted(((r.doc_id, [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s.kind < 4])
                  for r in found), key=str)
    assert got == want
    by_id = {r.doc_id: r.spans for r in found}
    kinds = {pii.KINDS[s.kind] for i in (1001, 1002) for s in by_id[i]}
    assert {"secret", "alias", "person", "id_number", "local_phone"} <= kinds


def test_long_secrets_and_aliases_are_whole(spark):
    key = "".join(random.Random(7).choice("abcXYZ0189+/_-") for _ in range(6000))
    local = "first.last+" + "x" * 50_000
    alias = f"{local} (at) {'sub-' * 30}host (dot) {'c' * 40}"
    rows = [(1, f"see token={key}, then", "a"), (2, f"write {alias}!", "a"), (3, f"secret: {'k' * 100_000}1", "a")]
    found = {r.doc_id: r.spans for r in pii.candidates(documents(spark, rows)).collect()}
    texts = {i: t for i, t, _ in rows}
    got = {i: [(pii.KINDS[s.kind], texts[i][s.start:s.end]) for s in spans] for i, spans in found.items()}
    assert got[1] == [("secret", f"token={key}")]
    assert got[2] == [("alias", alias)]
    assert got[3] == [("secret", texts[3])]


def test_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for i, spans in rows.items():
        assert [(pii.KINDS[s.kind], s.start, s.end) for s in spans if s.kind < 4] == brute_base(texts[i])
        for s in spans:
            if s.kind >= 4:
                assert pii.KINDS[s.kind] == "secret" and "token" in texts[i][s.start:s.end]
    planted = {i for i, t in texts.items() if t and re.search(r'token = "[0-9a-f]{20,}"', t)}
    assert planted == {i for i, spans in rows.items() if any(s.kind >= 4 for s in spans)}


def test_weak_supervision_recovers_reliabilities(spark):
    """Votes drawn from known labelers: the good ones get the large weights."""
    rng = random.Random(3)
    accuracy = [0.95, 0.9, 0.85, 0.7, 0.55, 0.5]
    rows, truth = [], []
    for _ in range(4000):
        y = rng.random() < 0.5
        votes = [(2 if y else 0) if rng.random() < a else (0 if y else 2) for a in accuracy]
        rows.append(([(5, 0, 1, sum(v * 3 ** i for i, v in enumerate(votes)) + pii.PLACES["kind"] * 5)],))
        truth.append(y)
    spans = spark.createDataFrame(rows, "spans array<struct<kind int, start long, end long, code int>>")
    weights = pii.trained(spans)[5][1]
    spread = [weights[f"v{i}"][2] - weights[f"v{i}"][0] for i in range(6)]
    assert spread[0] > spread[2] > spread[4] and spread[1] > spread[3]
    kept = pii.decided(spans.withColumn("doc_id", spans.spans[0].code), pii.trained(spans)).collect()
    assert len(kept) == 4000
    assert pii.trained(spans.limit(0)) == {}


def test_names_are_whole_runs(spark):
    texts = [f"see Dr. {'A' + 'b' * 60} now", "ask Mrs. Ana Maria de", "for Prof. Eva Lu Ann Kay Doe.",
             "Mr. " + "Xy " * 50_000 + "."]
    found = pii.candidates(documents(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    got = {r.doc_id: [texts[r.doc_id][s.start:s.end] for s in r.spans] for r in found}
    assert got == {0: ["Dr. " + "A" + "b" * 60], 1: ["Mrs. Ana Maria"], 2: ["Prof. Eva Lu Ann Kay Doe"],
                   3: [texts[3][:-2]]}


def loose(spark, rows):
    found = pii.find(documents(spark, rows))
    return {r.doc_id: [pii.KINDS[s.kind] for s in r.spans if s.kind >= 4] for r in found.collect()}


KEY = 'use token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" now'


def test_secrets_stay_at_every_size(spark):
    """Candidates that look alike are kept by their votes, however many there
    are, and whatever other kinds hold."""
    others = [(1000 + i, "order 415-555-0000 and item 000-00-0000 " * 5, "a") for i in range(60)]
    for times, more in ((1, []), (400, []), (13, others)):
        got = loose(spark, [(i, KEY, "a") for i in range(times)] + more)
        assert all(got[i] == ["secret"] for i in range(times)) and len(got) == times + len(more)


def test_classifier_tells_candidates_apart(spark):
    """Of one kind, those that the labelers speak for stay, the others go."""
    good = [(i, f"my ssn 123-45-{6000 + i}, call", "a") for i in range(40)]
    bad = [(100 + i, f"order 000-00-0000, test {i}", "a") for i in range(40)]
    got = loose(spark, good + bad)
    assert all(got[i] == ["id_number"] for i in range(40)) and not any(got[100 + i] for i in range(40))
