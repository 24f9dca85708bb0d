"""Quality classifier on random-indexing word vectors.

Every word has a sparse random index vector; a word's vector is the sum of the
index vectors of its neighbours over the whole corpus. Words are hashed to a
fixed number of buckets, so the vectors are a bounded table however large the
vocabulary grows: tasks sum them, Spark adds the sums up. A document is pooled
to the mean of its words' vectors; a two-layer network on that gives a score,
and a temperature fitted on rows kept apart calibrates it.

Texts are read whole. Only the network is fitted on a bounded sample.
"""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.llm.common import table
from mailspark.session import written

#: Buckets of words, length of a vector, entries of an index vector, reach of
#: the neighbourhood.
BUCKETS, DIMENSIONS, ENTRIES, REACH = 8192, 32, 4, 2

#: Labelled rows that the network is fitted on at most: those of least hash.
SAMPLE = 20_000

#: One sample row in this many fits the temperature instead of the network.
APART = 8

HIDDEN, EPOCHS, BATCH, SEED = 32, 60, 256, 5
THRESHOLD = 0.7

#: Words kept with their buckets by a worker; then it starts anew.
REMEMBERED = 400_000

#: Words that a task sums up at once, about.
RUN = 400_000

#: Buckets of forms that stand for many words.
CAPITALS, NUMBER, AGAIN, COPIED, BARE = range(5)
_FIRST = 8
_SHAPE = re.compile(r"^([\W_]*)(.*?)([\W_]*)$", re.S)


def _bucket(word):
    return _FIRST + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - _FIRST)


class Reader:
    """Texts to arrays of buckets."""

    def __init__(self):
        self.known = {}

    def _look(self, word):
        before, core, after = _SHAPE.match(word).groups()
        mark = _bucket("mark " + (before + after)[:3]) if before or after else -1
        if not core:
            form = BARE
        elif any(c.isdigit() for c in core):
            form = NUMBER
        elif len(core) > 1 and core.isupper():
            form = CAPITALS
        else:
            form = _bucket(core.lower())
        return form, mark

    def buckets(self, text):
        """A word gives the bucket of its form, and one of the punctuation at
        it. A word like the one before, and words of a line that came before,
        have buckets of their own."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        for w in set(words).difference(known):
            known[w] = self._look(w)
        pairs = np.array([known[w] for w in words], np.int64)
        if len(known) > REMEMBERED:
            self.known = {}
        form = pairs[:, 0]
        pairs[1:, 0][form[1:] == form[:-1]] = AGAIN
        lines = text.splitlines()
        if len(set(lines)) < len(lines):
            seen, at = set(), 0
            for line in lines:
                n = len(line.split())
                if n and line in seen:
                    pairs[at:at + n, 0] = COPIED
                seen.add(line)
                at += n
        flat = pairs.ravel()
        return flat[flat >= 0]


def index_vectors():
    """(places, signs) of the entries of each bucket's index vector."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIMENSIONS)), axis=1)[:, :ENTRIES]
    return places, rng.choice(np.array([-1, 1]), (BUCKETS, ENTRIES))


_READERS = {}


def _reader():
    return _READERS.setdefault("reader", Reader())


def _summed(batches):
    """Task code: sums of neighbours' index vectors over the task's rows."""
    places, signs = index_vectors()
    sums, reader = np.zeros(BUCKETS * DIMENSIONS, np.int64), _reader()

    def add(ids):
        """Neighbours in a run of documents, parted by gaps of -1."""
        for o in range(1, REACH + 1):
            a, b = ids[:-o], ids[o:]
            both = (a >= 0) & (b >= 0)
            a, b = a[both], b[both]
            for word, near in ((a, b), (b, a)):
                for e in range(ENTRIES):
                    sums[:] += np.bincount(word * DIMENSIONS + places[near, e], signs[near, e],
                                           len(sums)).astype(np.int64)

    gap, run, held = np.full(REACH, -1), [], 0
    for batch in batches:
        for text in batch["text"].fillna(""):
            run += [reader.buckets(text), gap]
            held += len(run[-2]) + REACH
            if held > RUN:
                add(np.concatenate(run))
                run, held = [], 0
    if run:
        add(np.concatenate(run))
    sums = sums.reshape(BUCKETS, DIMENSIONS)
    used = np.flatnonzero(sums.any(1))
    out = pd.DataFrame(sums[used], columns=[f"v{i}" for i in range(DIMENSIONS)])
    out.insert(0, "bucket", used.astype(np.int32))
    yield out


def word_vectors(df, text="text"):
    """Unit vectors of all buckets, as an array; zero for unused ones. The
    sums are whole numbers, so any order of adding gives the same."""
    kind = ", ".join(["bucket int", *(f"v{i} long" for i in range(DIMENSIONS))])
    sums = (
        df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInPandas(_summed, kind)
        .groupBy("bucket").agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(DIMENSIONS)])
    )
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in sums.collect():  # at most BUCKETS rows
        out[row[0]] = row[1:]
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pool(vectors, ids):
    """Mean vector of a document; zero without words."""
    if not len(ids):
        return np.zeros(DIMENSIONS, np.float32)
    counts = np.bincount(ids, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    return counts[used] @ vectors[used] / len(ids)


class Network:
    """Two layers: tanh units, then one logistic unit; divided by a
    temperature."""

    def fit(self, x, y, apart):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z, rng = (x - self.mean) / self.scale, np.random.default_rng(SEED)
        d = x.shape[1]
        w = [rng.normal(0, d ** -0.5, (d, HIDDEN)), np.zeros(HIDDEN),
             rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        first, second, t = [0 * p for p in w], [0 * p for p in w], 0
        zt, yt = z[~apart], y[~apart]
        for _ in range(EPOCHS):
            order = rng.permutation(len(zt))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                a, target = zt[rows], yt[rows]
                h = np.tanh(a @ w[0] + w[1])
                error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - target) / len(rows)
                back = np.outer(error, w[2]) * (1 - h * h)
                grads = [a.T @ back + 1e-4 * w[0], back.sum(0), h.T @ error + 1e-4 * w[2], error.sum(keepdims=True)]
                t += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    w[i] = w[i] - 0.004 * (first[i] / (1 - 0.9 ** t)) / (
                        np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)
        self.weights, self.temperature = w, 1.0
        held = apart if apart.any() else ~apart
        raw, target = self.logits(x[held]), y[held]
        loss = lambda u: np.logaddexp(0, np.where(target > 0.5, -raw, raw) / np.exp(u)).mean()
        grid = np.linspace(-2, 2, 401)
        self.temperature = float(np.exp(grid[int(np.argmin([loss(u) for u in grid]))]))
        return self

    def logits(self, x):
        w = self.weights
        return (np.tanh((x - self.mean) / self.scale @ w[0] + w[1]) @ w[2] + w[3]) / self.temperature

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -40, 40)))


def held_out(doc_id):
    """Rows whose labels are never learned from."""
    key = F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")
    return F.crc32(key) % 4 == 2


def _pooled(vectors):
    shared = vectors

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def pooled(texts: pd.Series) -> pd.Series:
        reader, v = _reader(), shared.value
        return pd.Series([pool(v, reader.buckets(t)).astype(float) for t in texts.fillna("")])

    return pooled


def train(df, labels, vectors, sample=SAMPLE):
    """Network fitted on at most ``sample`` labelled documents that are not
    held out. A document with several labels has the more frequent one (a tie:
    1); labels without an id or value, and of unknown documents, don't count.
    Of rows that repeat an id, the text of the least digest is learned from, so
    the scores don't depend on the order of the rows. None without labels of
    both kinds."""
    order = F.md5(F.concat(F.lit(f"{SEED}:"), F.col("doc_id").cast("string")))
    chosen = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(order, "doc_id").limit(sample)
    )
    chosen = written(chosen, "label-sample")
    text = F.coalesce("text", F.lit(""))
    rows = (
        df.join(F.broadcast(chosen), "doc_id")  # at most ``sample`` rows of two numbers
        .groupBy("doc_id", "label").agg(F.min_by(text, F.sha2(text, 256)).alias("text"))
        .select("doc_id", "label", _pooled(vectors)("text").alias("x")).collect()
    )
    rows = {r["doc_id"]: r for r in rows}
    if len({r["label"] for r in rows.values()}) < 2:
        return None
    ids = sorted(rows)
    x = np.array([rows[i]["x"] for i in ids])
    y = np.array([rows[i]["label"] for i in ids], float)
    apart = np.array([hashlib.md5(f"apart:{i}".encode()).digest()[0] % APART == 0 for i in ids])
    return Network().fit(x, y, apart)


def scored(df, labels, sample=SAMPLE):
    """(doc_id, held_out, score, predicted) of each row of ``df`` (doc_id,
    text). Null and empty texts have the score of a document without words.
    Without labels of both kinds to learn from, every score is 0.5. Repeated
    rows come as often as they are given."""
    docs = df.select("doc_id", F.col("text").cast("string").alias("text"))
    context = df.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    network = train(docs, labels, vectors, sample)
    fitted = context.broadcast(network)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        reader, v, net = _reader(), vectors.value, fitted.value
        if net is None:
            return pd.Series(np.full(len(texts), 0.5))
        x = np.array([pool(v, reader.buckets(t)) for t in texts.fillna("")]).reshape(-1, DIMENSIONS)
        return pd.Series(net.score(x))

    # One crc per id: the held-out rows are told by the id alone.
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_random_indexing_quality(spark, sf_dir):
    return scored(table(spark, sf_dir, "documents").select("doc_id", "text"),
                  table(spark, sf_dir, "labels").select("doc_id", "quality"))
