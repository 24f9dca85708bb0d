"""Token counts by the whole-token shortcut.

The vocabulary is read once on the driver, where each of its strings that can
stand as a word of its own is merged by the rules: those that end as one token
are proven. In the tasks a text is cut into words; a proven word counts as one
token by a look-up, and only the rest is merged, each distinct word once.

The vocabularies meant are byte-pair encodings with a mark at the end of a
word, over the letters of bytes (``word_bpe_49k.json``).
"""

import hashlib
import heapq
import json
import unicodedata

import pandas as pd
import regex
from pyspark.sql import functions as F

from mailspark.llm.bpe import byte_letters
from mailspark.llm.common import table

#: Tokens beyond which a text is over the limit.
LIMIT = 2048

#: Words that a worker remembers besides the proven ones; beyond it the memory
#: starts anew. Longer words than LONG_WORD are not remembered.
REMEMBERED = 400_000
LONG_WORD = 64

#: Words of a longer text are counted one by one, without a list of them.
LONG_TEXT = 1 << 20


def read_vocabulary(path):
    """What the tasks need of a tokenizer file: ids of letters and merges, the
    pattern of words, special tokens, and the proven words. Its size is
    bounded by the vocabulary, so it is broadcast."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model = data["model"]
    steps = (data["normalizer"] or {}).get("normalizers", [])
    splits = (data["pre_tokenizer"] or {}).get("pretokenizers", [])
    known = (
        [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
        and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["behavior"] == "Removed" and splits[0]["invert"]
        and not splits[1]["use_regex"] and not splits[1]["add_prefix_space"]
        and model["type"] == "BPE" and model.get("end_of_word_suffix")
        and not model.get("continuing_subword_prefix")
        and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]
                    for t in data["added_tokens"]))
    if not known:
        raise ValueError(f"{path} is not a byte-pair vocabulary with word ends")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    vocabulary = {
        "ranks": {pair: rank for rank, pair in enumerate(merges)},
        "end": model["end_of_word_suffix"],
        "pattern": splits[0]["pattern"]["Regex"],
        "special": [t["content"] for t in data["added_tokens"]],
    }
    return vocabulary | {"proven": proven(vocabulary, model["vocab"])}


def merged(vocabulary, letters):
    """Tokens of a word given in letters, merged by rank, leftmost first."""
    ranks, parts = vocabulary["ranks"], [*letters[:-1], letters[-1] + vocabulary["end"]]
    if len(parts) > LONG_WORD:
        return _merged_long(ranks, parts)
    never = len(ranks)
    at = [ranks.get(pair, never) for pair in zip(parts, parts[1:])]
    while at and (best := min(at)) < never:
        i = at.index(best)
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
        del at[i]
        if i:
            at[i - 1] = ranks.get((parts[i - 1], parts[i]), never)
        if i < len(at):
            at[i] = ranks.get((parts[i], parts[i + 1]), never)
    return parts


def _merged_long(ranks, parts):
    """The same by a heap, n log n."""
    n = len(parts)
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = following[i]
        if parts[i] != left or j >= n or parts[j] != right:
            continue
        parts[i], parts[j] = left + right, None
        following[i] = j = following[j]
        if j < n:
            before[j] = i
        for a, b in ((before[i], i), (i, j)):
            if a >= 0 and b < n and (parts[a], parts[b]) in ranks:
                heapq.heappush(heap, (ranks[parts[a], parts[b]], a, parts[a], parts[b]))
    return [p for p in parts if p is not None]


def proven(vocabulary, strings):
    """The words that encode as one token: strings with the end mark whose
    letters spell UTF-8 and merge into that string alone."""
    byte, end = {letter: b for b, letter in byte_letters().items()}, vocabulary["end"]
    found = set()
    for string in strings:
        letters = string.removesuffix(end)
        if not letters or not string.endswith(end) or merged(vocabulary, letters) != [string]:
            continue
        try:
            found.add(bytes(byte[c] for c in letters).decode())
        except UnicodeDecodeError:
            pass
    return found


class _Counts(dict):
    """Tokens of each word; a word not seen yet is merged."""

    def __init__(self, vocabulary):
        super().__init__(dict.fromkeys(vocabulary["proven"], 1))
        self.vocabulary, self.letters = vocabulary, byte_letters()
        self.most = len(self) + REMEMBERED

    def __missing__(self, word):
        letters = "".join(map(self.letters.__getitem__, word.encode()))
        count = len(merged(self.vocabulary, letters))
        if len(word) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
                self.update(dict.fromkeys(self.vocabulary["proven"], 1))
            self[word] = count
        return count


class Counter:
    """Counts the tokens of texts for one vocabulary."""

    def __init__(self, vocabulary):
        self.words = regex.compile(vocabulary["pattern"])
        self.special = vocabulary["special"]
        self.split_special = regex.compile("|".join(
            regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.counts, self.assigned = _Counts(vocabulary), set()
        self.pattern, self.library = vocabulary["pattern"], None

    def split(self, text):
        """Words of a text without special tokens. Texts with code points that
        Unicode tables differ on are normalised and split by the library."""
        if text.isascii():
            return self._found(text.lower())
        if not self._all_assigned(text):
            if self.library is None:
                from tokenizers import Regex, normalizers, pre_tokenizers

                self.library = (
                    normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "),
                                          normalizers.Lowercase()]),
                    pre_tokenizers.Split(Regex(self.pattern), "removed", invert=True))
            normal, split = self.library
            return [w for w, _ in split.pre_tokenize_str(normal.normalize_str(text))]
        # Letters are lowered one by one; str.lower() alone looks around sigmas.
        return self._found(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _all_assigned(self, text):
        """False if this Python knows no character for a code point of the
        text. Libraries with other Unicode tables may take it for a letter."""
        new = set(text) - self.assigned
        good = {c for c in new if unicodedata.category(c) != "Cn"}
        self.assigned |= good
        return len(good) == len(new)

    def _found(self, text):
        if len(text) < LONG_TEXT:
            return self.words.findall(text)
        return (m.group() for m in self.words.finditer(text))

    def count(self, text):
        each = self.counts.__getitem__
        if not any(t in text for t in self.special):
            return sum(map(each, self.split(text)))
        parts = self.split_special.split(text)
        return len(parts) - 1 + sum(sum(map(each, self.split(p))) for p in parts)


_COUNTERS = {}


def counter(shared):
    """One counter per worker process and vocabulary (a broadcast)."""
    if shared.key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[shared.key] = Counter(shared.data.value)
    return _COUNTERS[shared.key]


class _Shared:
    """A broadcast with a key that tasks can remember it by."""

    def __init__(self, spark, path):
        with open(path, "rb") as f:
            self.key = hashlib.sha256(f.read()).hexdigest()
        self.data = spark.sparkContext.broadcast(read_vocabulary(path))


def default_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def count_tokens(df, path=None, limit=LIMIT, text="text"):
    """The rows with ``n_bytes`` (UTF-8), ``n_tokens`` (long) and
    ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have no bytes and no tokens. The strings of special
    tokens count as one token each, wherever they occur. Rows come as often
    as they are given; input columns of the three names are replaced, other
    columns stay. A row is counted by itself: nothing is shuffled, and words
    are remembered up to a bound, so memory doesn't grow with the data.
    """
    shared = _Shared(df.sparkSession, path or default_path())

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        of = counter(shared)
        return pd.Series([of.count(t) for t in texts.fillna("")], dtype="int64")

    made = ("n_bytes", "n_tokens", "over_limit")
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    names = [F.col(f"`{c}`") for c in df.columns if c.lower() not in made]
    return (
        df.select(*names, F.octet_length(whole).cast("long").alias("n_bytes"),
                  tokens(whole).alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )


def op11_whole_token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
