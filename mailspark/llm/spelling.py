"""Spelling variants by dynamic programming over sorted lists.

Two words are near if one inserted, deleted or replaced code point makes one
of the other. To find all near words of a word, a sorted list is scanned: the
banded rows of the edit matrix are kept for the prefix that neighbours in the
list share, and where a prefix is already more than one edit away the scan
skips all words that begin with it.

One list of all words would be scanned by each of them, so lists are made of
words that can be near each other. Words of n and n + 1 letters are cut at n/2;
an edit lies in one of the halves, so the rest is equal: a list holds the words
of one class n that share all but a window of it. A list that grows too long
is keyed anew by the halves of its window. Windows of one letter end that:
what shares all but one letter is at most an alphabet's square.
"""

import re
import zlib
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from mailspark.llm.common import table
from mailspark.session import written

#: Fixed value: letters of a word.
RUN = "[A-Za-zÀ-ÿ]"

LEAST_LENGTH = 6
LEAST_COUNT = 5

#: A near word is a form if it is so many times as frequent.
TIMES = 5

#: One run in so many loses a letter, as the query's contract has it.
LOSES = 199

#: Words of a list that a task holds; longer ones are keyed anew by Spark.
LIST = 4096

#: Words of a list that is scanned; longer ones are cut inside the task.
SCAN = 256

#: Different words that a counting task holds before it passes them on.
HELD = 500_000

#: Letters of a text beyond which its runs are counted without a list of them.
LONG_TEXT = 1 << 20

_LAST = "\U0010ffff"


# ------------------------------------------------------------------- counting


def _counter(loses, least_length):
    """Task code: texts to counts of their words. A run shorter than the least
    length cannot make a word."""

    def run(batches):
        runs = re.compile(RUN + "{%d,}" % least_length)
        total = Counter()
        for batch in batches:
            for doc, text in zip(batch["doc"], batch["text"]):
                # Of UTF-8 bytes, lower() lowers A-Z only.
                text = text.encode().lower().decode()
                found = Counter(runs.findall(text) if len(text) < LONG_TEXT
                                else (m.group() for m in runs.finditer(text)))
                if not loses:
                    total.update(found)
                    continue
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % loses == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                    total[word] += n
            if len(total) > HELD:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total = Counter()
        yield pd.DataFrame({"word": pd.Series(list(total), dtype="object"),
                            "n": pd.Series(list(total.values()), dtype="int64")})

    return run


def vocabulary(df, least_length=LEAST_LENGTH, least_count=LEAST_COUNT, loses=None):
    """(word, n): how often each word occurs, over all whole texts.

    A word is a longest run of letters, A-Z lower-cased, of at least the given
    length and count. With ``loses``, a run whose CRC-32 of ``doc_id:run`` it
    divides loses the letter at crc % length before it is counted. Null and
    empty texts have no words; a null doc_id is the empty text.
    """
    texts = df.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
                      F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return (
        texts.mapInPandas(_counter(loses, least_length), "word string, n long")
        .groupBy("word").agg(F.sum("n").alias("n"))
        .filter((F.col("n") >= least_count) & (F.char_length("word") >= least_length))
    )


# ----------------------------------------------------------------- sorted lists


def _shared(a, b):
    """Length of the common prefix."""
    k, most = 0, min(len(a), len(b))
    while k < most and a[k] == b[k]:
        k += 1
    return k


def scan(query, words, shared):
    """Numbers of the words at one edit from the query, in a sorted list of
    words of its length m or m + 1. ``shared[i]`` is the length of the prefix
    that word i shares with the one before.

    Of row k of the edit matrix the columns k - 1, k, k + 1 are kept, values
    over one as they come; a row without a value of at most one ends its
    prefix.
    """
    m, padded = len(query), "\0" + query + "\0\0\0"
    rows = [(2, 0, 1)] + [None] * (m + 2)
    found, i, depth, count = [], 0, 0, len(words)
    while i < count:
        word = words[i]
        a, b, c = rows[depth]
        k, length = depth, len(word)
        while k < length:
            letter = word[k]
            k += 1
            x = a if padded[k - 1] == letter else a + 1
            if b < x:
                x = b + 1 if b + 1 < x else x
            y = b if padded[k] == letter else b + 1
            if c < y:
                y = c + 1 if c + 1 < y else y
            if x < y:
                y = x + 1 if x + 1 < y else y
            z = c if padded[k + 1] == letter else c + 1
            if y < z:
                z = y + 1 if y + 1 < z else z
            rows[k] = a, b, c = x, y, z
            if x > 1 and y > 1 and z > 1:
                break
        if a > 1 and b > 1 and c > 1:
            after = bisect_left(words, word[:k] + _LAST, i + 1)
            if after < count:
                depth = _shared(word, words[after]) if after > i + 1 else shared[after]
            i = after
            continue
        if (b if length == m else a) == 1:
            found.append(i)
        i += 1
        if i < count:
            depth = shared[i]
    return found


def _near(n, lo, hi, words, add):
    """Passes each pair of near words that differ first inside the window [lo,
    hi) of class n on to ``add``. ``words`` share all but the window. Pairs of
    two words of n + 1 letters are of the next class."""
    if len(words) > SCAN and hi - lo > 1:
        half = (lo + hi) // 2
        for start, end in ((lo, half), (half, hi)):
            parts = {}
            for word in words:
                parts.setdefault((word[:start], word[len(word) - (n - end):]), []).append(word)
            for part in parts.values():
                if len(part) > 1:
                    _near(n, start, end, part, add)
        return
    middles = sorted((word[lo:len(word) - (n - hi)], word) for word in words)
    cut = [x for x, _ in middles]
    shared = [0] + [_shared(x, y) for x, y in zip(cut, cut[1:])]
    for middle, word in middles:
        if len(middle) != hi - lo:
            continue
        for i in scan(middle, cut, shared):
            other, near = middles[i]
            longer = len(other) > len(middle)
            # A letter put in behind the window is found by a later window.
            if longer and hi < n and other.startswith(middle):
                continue
            add(word, near)
            if longer:
                add(near, word)


def _scanner(batches):
    """Task code: rows sorted by list to (word, n_near, best_n, best) of each
    list. One list is held at a time; its words are at most LIST, or share all
    but one letter."""

    def near_words(key, counts):
        best = {}

        def add(word, near):
            n = counts[near]
            had = best.get(word)
            if had is None:
                best[word] = [1, n, near]
                return
            had[0] += 1
            if n > had[1] or n == had[1] and near < had[2]:
                had[1:] = n, near

        if len(counts) > 1:
            _near(*key[:3], list(counts), add)
        return [(word, *b) for word, b in best.items()]

    key, counts, done = None, {}, []
    names = ["word", "n_near", "best_n", "best"]
    for batch in batches:
        for *now, word, n in zip(*(batch[c].tolist() for c in ("size", "lo", "hi", "rest", "word", "n"))):
            if now != key:
                done.extend(near_words(key, counts) if counts else ())
                key, counts = now, {}
            counts[word] = n
        if len(done) > 2000:
            yield pd.DataFrame(done, columns=names)
            done = []
    done.extend(near_words(key, counts) if counts else ())
    yield pd.DataFrame(done, columns=names)


_LISTS = ["size", "lo", "hi", "rest"]


def _listed(rows):
    """Adds what the words of a list share: the letters around the window."""
    return rows.withColumn("rest", F.concat_ws(
        "\n", F.substr("word", F.lit(1), F.col("lo")),
        F.expr("right(word, size - hi)")))


def _lists(words, most=LIST):
    """(size, lo, hi, rest, word, n): each word in the lists it belongs to. A
    word is in the class of its length, and in the class below as the longer
    one; in each class in one list per window."""
    half = F.floor(F.col("size") / 2).cast("int")
    windows = F.inline(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")),
                               F.struct(half.alias("lo"), F.col("size").alias("hi"))))
    rows = words.select("word", "n", F.explode(F.array(
        F.char_length("word"), F.char_length("word") - 1)).alias("size")).filter("size > 0")
    rows, final = _listed(rows.select("*", windows).filter("lo < hi")), None
    while True:
        long = written(
            rows.groupBy(*_LISTS).agg(F.count(F.lit(1)).alias("words"))
            .filter((F.col("words") > most) & (F.col("hi") - F.col("lo") > 1)), "long-lists")
        if long.isEmpty():
            return rows if final is None else final.unionByName(rows)
        cool = rows.join(long.select(*_LISTS), _LISTS, "left_anti")
        final = cool if final is None else final.unionByName(cool)
        middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.inline(F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")),
                                  F.struct(middle.alias("a"), F.col("hi").alias("b"))))
        hot = rows.join(long.select(*_LISTS), _LISTS).select("word", "n", "size", halves)
        rows = written(_listed(hot.withColumnsRenamed({"a": "lo", "b": "hi"})), "halved-lists")


def near_words(words, most=LIST):
    """(word, n_near, best_n, best): of each word that has near words in the
    table (word, n; no empty ones), their number and the most frequent of them, ties going to
    the first in code-point order. Each list reduces its pairs to a row per
    word; no pair leaves a task."""
    lists = _lists(words, most).select(*_LISTS, "word", "n")
    partial = (lists.repartition(*_LISTS).sortWithinPartitions(*_LISTS)
               .mapInPandas(_scanner, "word string, n_near long, best_n long, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best")))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.best").alias("best"))


def _roots(forms):
    """(word, root): the last word that forms lead to. Each round doubles the
    steps; counts grow by ``TIMES`` a step, so there are few."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        now = written(now.join(ahead.hint("shuffle_hash"), F.col("root") == F.col("_at"), "left").select(
            "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.drop("moved")


def variants(words, times=TIMES):
    """A row per word of the table (word, n), each word once: word, form (its
    most frequent near word, if that is at least ``times`` as frequent), root
    (where forms end; the word itself without a form), n, n_near and form_n.
    No words, no rows."""
    found = written(words.join(near_words(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best")).alias("form"),
        F.when(F.col("best_n") >= times * F.col("n"), F.col("best_n")).alias("form_n")), "near-words")
    roots = _roots(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(df, loses=None):
    """``variants`` of the words of a table of documents."""
    return variants(written(vocabulary(df, loses=loses), "vocabulary"))


def op13_sorted_list_variants(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"), loses=LOSES)
