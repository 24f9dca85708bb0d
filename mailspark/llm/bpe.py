"""Byte-level BPE by speculation and verification.

For each new word, greedy longest match against the vocabulary proposes the
tokens. A proposal is what BPE gives exactly when each token can be reached by
the merges and no merge would have joined the two sides of any adjacent pair;
all pairs of a batch of words are tested at once on arrays. Only words that
fail are merged step by step, in the exact order of the merge ranks.
"""

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.llm.common import table

#: Fixed value: how the vocabulary's authors split text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept with their tokens by a worker; beyond it the memory starts anew.
REMEMBERED = 400_000

#: Longer words aren't remembered, so that the memory stays bounded in bytes.
LONG_WORD = 64

_NEVER = np.int64(1) << 40


def byte_letters():
    """The letter that a byte-level vocabulary writes for each byte: printable
    ones stand for themselves, the others are counted up from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def read_vocabulary(path):
    """What the tasks need of a tokenizer file, read on the driver: byte
    strings by id, (left, right, result) ids by merge rank, special tokens.
    Its size is bounded by the vocabulary, so it is broadcast."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    byte = {letter: b for b, letter in byte_letters().items()}
    spell = lambda token: bytes(byte[c] for c in token)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocab = model["vocab"]
    return {
        "tokens": {i: spell(t) for t, i in vocab.items()},
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges],
        "special": {t["content"]: t["id"] for t in data["added_tokens"]},
    }


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary):
        tokens, special = vocabulary["tokens"], vocabulary["special"]
        self.size = 1 + max([*tokens, *special.values()])
        self.spelled = [b""] * self.size
        for i, t in tokens.items():
            self.spelled[i] = t
        for text, i in special.items():
            self.spelled[i] = text.encode()
        self.ids = {t: i for i, t in tokens.items()}
        self.special = special
        self.split_special = regex.compile(
            "(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")"
        ) if special else None
        self.words = regex.compile(PATTERN)
        self.longest = {}
        for t in self.ids:
            self.longest[t[:2]] = max(self.longest.get(t[:2], 0), len(t))
        self.ranks = {(a, b): (r, c) for r, (a, b, c) in enumerate(vocabulary["merges"])}
        # Merge that makes a token: its rank (-1 for a byte) and its sides.
        self.rank = np.full(self.size, -1, np.int64)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        for r, (a, b, c) in enumerate(vocabulary["merges"]):
            self.rank[c], self.left[c], self.right[c] = r, a, b
        pairs = np.array([a * self.size + b for a, b, _ in vocabulary["merges"]], np.int64)
        self.pair_rank = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.pair_rank]
        self.reachable = self._reachable(vocabulary["merges"])
        self.known = {}

    def _merge_rank(self, x, y):
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_rank[at], _NEVER)

    def compatible(self, a, b, before=None):
        """For arrays of tokens: no merge (of a rank below ``before``) joins
        the end of a to the start of b.

        Going back in time, a dissolves into the pieces along its right edge
        and b along its left edge. The pieces x, y that lie side by side at
        some time are joined if their merge comes while both exist. At equal
        ranks the left place merges first: the merge inside a wins over the
        joint, the joint wins over the merge inside b.
        """
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.copy(), b.copy()
        end_x = np.full(len(a), _NEVER) if before is None else before.copy()
        end_y = np.full(len(a), _NEVER - 1) if before is None else before - 1
        while len(at):
            rx, ry = self.rank[x], self.rank[y]
            m = self._merge_rank(x, y)
            joined = (m > rx) & (m > ry) & (m < end_x) & (m <= end_y)
            ok[at[joined]] = False
            go = ~joined & ((rx >= 0) | (ry >= 0))
            at, x, y, rx, ry, end_x, end_y = (v[go] for v in (at, x, y, rx, ry, end_x, end_y))
            back_x = rx >= ry
            end_x, end_y = np.where(back_x, rx, end_x), np.where(back_x, end_y, ry)
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return ok

    def _reachable(self, merges):
        """Tokens that merging their own bytes gives back."""
        made = np.array([c for _, _, c in merges], np.int64)
        good = np.ones(self.size, bool)
        if len(made):
            fits = self.compatible(self.left[made], self.right[made], self.rank[made])
            for c, fit in zip(made.tolist(), fits.tolist()):
                good[c] = fit and good[self.left[c]] and good[self.right[c]]
        return good

    def propose(self, word):
        """Greedy longest match."""
        ids, out, i, n = self.ids, [], 0, len(word)
        whole = ids.get(word)
        if whole is not None:
            return [whole]
        while i < n:
            for end in range(min(n, i + self.longest.get(word[i:i + 2], 1)), i, -1):
                token = ids.get(word[i:end])
                if token is not None:
                    out.append(token)
                    i = end
                    break
        return out

    def merge(self, word):
        """Exact merging by rank, leftmost first; n log n in the word."""
        parts = [self.ids[word[i:i + 1]] for i in range(len(word))]
        n = len(parts)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in self.ranks]
        heap = [(r, i, c, a, b) for r, c, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, c, a, b = heapq.heappop(heap)
            j = nxt[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = c, -1
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for left, right in ((prev[i], i), (i, nxt[i])):
                if left >= 0 and right < n and (found := self.ranks.get((parts[left], parts[right]))):
                    heapq.heappush(heap, (found[0], left, found[1], parts[left], parts[right]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words):
        """Tokens of each of the given different words."""
        spelled = [w.encode() for w in words]
        proposed = [self.propose(w) for w in spelled]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        tokens = np.fromiter(chain.from_iterable(proposed), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(proposed)), counts)
        bad = set(owner[~self.reachable[tokens]].tolist())
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        fits = self.compatible(tokens[inner], tokens[inner + 1])
        bad.update(owner[inner[~fits]].tolist())
        for i in bad:
            proposed[i] = self.merge(spelled[i])
        return proposed

    def encode_batch(self, texts):
        """Token ids of each text, as unsigned 32-bit arrays. Special tokens
        are recognised wherever their text occurs."""
        pieces = []
        for text in texts:
            if self.split_special and any(t in text for t in self.special):
                row = []
                for part in self.split_special.split(text):
                    row.extend([part] if part in self.special else self.words.findall(part))
            else:
                row = self.words.findall(text)
            pieces.append(row)
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        known.update((t, [i]) for t, i in self.special.items())
        new = [w for w in set().union(*pieces) if w not in known] if pieces else []
        fresh = dict(zip(new, self.encode_words(new)))
        known.update(fresh)
        out = [np.fromiter(chain.from_iterable(map(known.__getitem__, row)), np.uint32) for row in pieces]
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return out

    def decode(self, ids):
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.spelled.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODECS = {}


def codec(vocabulary):
    """One codec per worker process and vocabulary (a broadcast)."""
    if vocabulary.id not in _CODECS:
        _CODECS.clear()
        _CODECS[vocabulary.id] = (None, Bpe(vocabulary.value))
    return _CODECS[vocabulary.id][1]


class _Shared:
    """A broadcast with a key that tasks can remember it by."""

    def __init__(self, spark, path):
        vocabulary = read_vocabulary(path)
        self.id = hashlib.sha256(repr(sorted(vocabulary["special"].items())).encode()
                                 + b"".join(vocabulary["tokens"].values())).hexdigest()
        self.data = spark.sparkContext.broadcast(vocabulary)

    @property
    def value(self):
        return self.data.value


def default_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df, path=None, text="text", digests_only=False):
    """The rows with ``n_tokens``, ``ids`` (array of int; left out with
    ``digests_only``), ``ids_sha256`` (over little-endian unsigned 32-bit ids)
    and ``decoded_sha256`` (over the text decoded from the ids).

    Null and empty texts have no tokens. Input columns of these names are
    replaced, other columns stay. Texts are read whole; words are remembered
    up to a bound, so memory doesn't grow with the data.
    """
    vocabulary = _Shared(df.sparkSession, path or default_path())
    made = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType())]
    if not digests_only:
        made.insert(1, T.StructField("ids", T.ArrayType(T.IntegerType())))
    result = T.StructType(made)

    @F.pandas_udf(result)
    def coded(texts: pd.Series) -> pd.DataFrame:
        bpe = codec(vocabulary)
        # A slice at a time, so that the arrays of one batch stay small.
        rows, step, texts = [], 256, texts.fillna("").tolist()
        for start in range(0, len(texts), step):
            for ids in bpe.encode_batch(texts[start:start + step]):
                row = [len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                       hashlib.sha256(bpe.decode(ids).encode()).hexdigest()]
                rows.append(row if digests_only else [row[0], ids.astype(np.int32), *row[1:]])
        return pd.DataFrame(rows, columns=result.names)

    names = [c for c in df.columns if c.lower() not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256")]
    out = df.withColumn("__coded", coded(F.col(f"`{text}`")))
    return out.select(*[F.col(f"`{c}`") for c in names], *[F.col(f"__coded.{c}") for c in result.names])


def decode(df, path=None, ids="ids", name="decoded"):
    """The rows with the text of their ids (null: null)."""
    vocabulary = _Shared(df.sparkSession, path or default_path())

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        bpe = codec(vocabulary)
        return column.map(lambda x: None if x is None else bpe.decode(np.asarray(x, np.int64)))

    return df.withColumn(name, text(F.col(f"`{ids}`")))


def op7_speculative_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, digests_only=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
