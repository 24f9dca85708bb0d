import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from mailspark.llm import conversation_trie, queries, spelling, token_counts
from mailspark.llm.common import table
from tests.llm.data import LONG, TEXTS, documents, skewed


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ----------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(token_counts.default_path())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.read_vocabulary(token_counts.default_path()))


PIECES = ["<|endoftext|>", "<|startoftext|>", "<|endof", "ΑΣ", "Σ", "İ", "ﬁ", "é", "é", "'s", "'LL", "՘",
          "\x1c", "\x85", "᠎", "​", " ", "　", " ", "\n", "12", "½", "Ⅷ", "日本", "😀", "ẞ", "ǅ",
          "́", "\U0003fc36", "a", "B", "strasse", "_", "\0"]


def test_proven_words_are_one_token(counter, library):
    words = sorted(w for w, n in counter.counts.items() if n == 1)
    assert len(words) > 30_000
    assert all(library(w) == 1 for w in words[::37])


def test_counts_against_library(counter, library):
    seeded = random.Random(11)
    texts = ["".join(seeded.choices(PIECES, k=seeded.randint(0, 12))) for _ in range(4000)]
    texts += ["".join(chr(seeded.choice([seeded.randrange(32, 0x3000), seeded.randrange(0x10000, 0x11000)]))
                      for _ in range(seeded.randint(1, 9))) for _ in range(2000)]
    texts += ["ab" * 700, "z" * 5000, LONG, "word " * 300_000]
    for text in texts:
        assert counter.count(text) == library(text), ascii(text[:80])


def test_memory_of_words_is_bounded(counter, monkeypatch):
    counts = token_counts._Counts(counter.counts.vocabulary)
    monkeypatch.setattr(counts, "most", len(counts) + 10)
    want = [counts[f"qxz{i}"] for i in range(100)]
    assert len(counts) <= counts.most and [counts[f"qxz{i}"] for i in range(100)] == want
    counts["q" * 1000]
    assert "q" * 1000 not in counts


def test_token_counts_of_a_table(spark, sf_dir, library):
    docs = table(spark, sf_dir, "documents")
    got = queries.QUERIES["op11_whole_token_counts"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        assert r.n_tokens == library(texts[r.doc_id])
        assert r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)


def test_token_counts_of_odd_rows(spark, library):
    docs = documents(spark)
    got = token_counts.count_tokens(docs, limit=5)
    assert {*docs.columns, "n_bytes", "over_limit"} == set(got.columns)
    assert got.schema["n_tokens"].dataType.simpleString() == "bigint"
    assert Counter((r.doc_id, r.n_tokens, r.over_limit) for r in got.collect()) == Counter(
        (i, library(t or ""), library(t or "") > 5) for i, t, _ in TEXTS)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    import public_tokenizers

    with pytest.raises(ValueError):
        token_counts.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


# ------------------------------------------------------------ conversation trie


def brute_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, path in own.items():
        keep, source = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = path if source == c or not rebuild else own.get(source, [])[:keep] + path[keep:]
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, path in built.items():
        for depth in range(len(path) + 1):
            members[tuple(path[:depth])].append(c)
    children.update(node[:-1] for node in members if node)
    for node, inside in members.items():
        spared = (len(inside) - 1) * len(node[-1][1].encode()) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += not children[node]
            saved[node[:depth]] += spared
    return sorted(((
        min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), children[node],
        leaves[node], saved[node],
        hashlib.sha256(",".join(str(c) for c in sorted(inside) if len(built[c]) == len(node)).encode()).hexdigest())
        for node, inside in members.items()), key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr(
        "*", "'x' AS path", "'x' AS node", "1 AS rank", "1 AS lo", "1 AS block", "1 AS t1")


def test_trie_of_the_table(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()
    assert rows_of(queries.QUERIES["op12_rollup_prefix_trie"](spark, sf_dir)) == brute_trie(map(tuple, turns))


def odd_turns():
    seeded = random.Random(12)
    rows = [(1, None, "user", "null first"), (1, 0, "user", "a"), (1, 0, "bot", "tie"), (1, 0, "bot", "tie"),
            (2, 1, None, None), (2, 2, "", ""), (3, 1, "", None), (-4, 5, "u", "ü€😀"), (-5, 1, "u", "negative"),
            (None, 1, "user", "of no conversation"), (7, 1, "u", "b\nc"), (8, 1, "ub", "\nc")]
    # Long conversations with common beginnings, over many blocks.
    for c in range(100, 160):
        length = seeded.choice([1, 7, 8, 9, 16, 17, 40, 70])
        rows += [(c, t, "user", f"turn {t if t < 20 else t * c % 5}") for t in range(length)]
    rows += [(c, t, "bot", f"same {t}") for c in range(5000, 14_000, 9) for t in range(3)]
    return rows


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_of_odd_conversations(spark, rebuild):
    rows = odd_turns()
    turns = conversation_trie.turn_ids(conversations(spark, rows))
    made = conversation_trie.rebuilt_paths(turns) if rebuild else conversation_trie.paths(turns)
    assert rows_of(conversation_trie.prefix_trie(made)) == brute_trie(rows, rebuild)


def test_trie_of_nothing(spark):
    none = conversation_trie.turn_ids(conversations(spark, odd_turns()[:1]).limit(0))
    assert conversation_trie.prefix_trie(conversation_trie.rebuilt_paths(none)).count() == 0


def test_trie_is_one_rollup(spark, sf_dir):
    """Prefixes longer than their conversation are dropped before the shuffle."""
    turns = conversation_trie.turn_ids(table(spark, sf_dir, "conversations"))
    paths = conversation_trie.paths(turns).withColumns(
        {"marks": conversation_trie._marks("path")}).selectExpr("*", "element_at(marks, -1) AS end")
    plan = conversation_trie._nodes(conversation_trie._ranked(paths))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.index("Filter", plan.index("Aggregate")) < plan.index("Expand")


# ------------------------------------------------------------ spelling variants


def brute_variants(docs, loses=199, length=6, count=5):
    lower, counts = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % loses == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= count and len(w) >= length}
    near, masked = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masked[w[:i] + "?" + w[i + 1:]].add(w)
            if (less := w[:i] + w[i + 1:]) in words:
                near[w].add(less)
                near[less].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out, key=str)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_scan_against_the_full_matrix():
    seeded = random.Random(13)
    for _ in range(300):
        m = seeded.randint(1, 6)
        words = sorted({"".join(seeded.choices("abé", k=seeded.choice([m, m + 1]))) for _ in range(40)})
        shared = [0] + [spelling._shared(x, y) for x, y in zip(words, words[1:])]
        for query in words:
            if len(query) == m:
                assert spelling.scan(query, words, shared) == [
                    i for i, w in enumerate(words) if distance(query, w) == 1]


def test_variants_of_the_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    got = queries.QUERIES["op13_sorted_list_variants"](spark, sf_dir)
    assert rows_of(got) == brute_variants(map(tuple, docs))


def test_variants_of_odd_rows(spark):
    text = "Straße strasse strassen STRASSE strase çedille cedille " * 9 + "strasse " * 200 + "x" * 100_000 + " Éclair×"
    rows = [(i, text, "a") for i in range(5)] + [(1, None, "a"), (2, "", "b"), (None, text, "c"), (None, text, "c")]
    assert rows_of(spelling.spelling_variants(documents(spark, rows), loses=199)) == brute_variants(
        [r[:2] for r in rows])
    assert spelling.spelling_variants(documents(spark, rows).limit(0)).count() == 0
    assert rows_of(spelling.spelling_variants(skewed(spark), loses=199)) == brute_variants(
        [(r.doc_id, r.text) for r in skewed(spark).collect()])


def test_long_lists_are_keyed_anew(spark, monkeypatch):
    """A third of the words share their first half; lists of any length find
    the same pairs once each."""
    seeded = random.Random(14)
    made = {"aaaaaa" + "".join(seeded.choices("abc", k=seeded.randint(5, 7))) for _ in range(500)}
    made |= {"".join(seeded.choices("abcd", k=seeded.randint(1, 9))) for _ in range(1000)}
    words = spark.createDataFrame([(w, seeded.randint(1, 50)) for w in made], "word string, n long")
    monkeypatch.setattr(spelling, "SCAN", 10)
    got = [rows_of(spelling.near_words(words, most)) for most in (4, 60, 100_000)]
    assert got[0] == got[1] == got[2]
    counts = {w: n for w, n in map(tuple, words.collect())}
    want = {}
    for a in counts:
        near = [b for b in counts if abs(len(a) - len(b)) < 2 and distance(a, b) == 1]
        if near:
            best = min(near, key=lambda b: (-counts[b], b))
            want[a] = (a, len(near), counts[best], best)
    assert got[0] == sorted(want.values(), key=str)


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("a", "w40")], "word string, form string")
    assert {r.root for r in spelling._roots(forms).collect()} == {"w40"}
