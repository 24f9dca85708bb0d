"""Postings: one row per (message, column, term), made inside each task.

``operators.segments`` stores them as an index that searches read."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.functions import text as X
from mailspark.functions.porter import stem as porter_stem
from mailspark.operators import search as Q
from mailspark.operators.reconcile import narrowed
from mailspark.schema import LOCATION

_POSTING = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("tf", T.LongType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("dl", T.LongType()),
    # True in one column only, so that counting it counts messages.
    T.StructField("first_in_message", T.BooleanType()),
])


def _postings_maker(columns, stemmed, keys):
    def postings(batch):
        size = batch.num_rows
        rows, cols, seats, texts = [], [], [], []
        for number, name in enumerate(columns):
            lists = batch.column(f"_t_{name}")
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
            rows.append(np.repeat(np.arange(size), lengths))
            cols.append(np.full(int(lengths.sum()), number))
            seats.append(np.arange(int(lengths.sum())) - starts)
            texts.append(lists.flatten())
        row, col, seat = map(np.concatenate, (rows, cols, seats))
        tokens = pa.concat_arrays([t.cast(pa.string()) for t in texts]).dictionary_encode()
        vocabulary = tokens.dictionary
        if stemmed:
            vocabulary = pa.array([porter_stem(w) for w in vocabulary.to_pylist()], pa.string())
        codes = vocabulary.dictionary_encode()
        term = np.asarray(codes.indices)[np.asarray(tokens.indices)] if len(row) else row
        order = np.lexsort((seat, col, term, row))
        row, col, seat, term = row[order], col[order], seat[order], term[order]
        same_term = (np.diff(row) == 0) & (np.diff(term) == 0)
        new_term = np.concatenate(([True], ~same_term))[: len(row)]
        start = np.flatnonzero(new_term | np.concatenate(([True], np.diff(col) != 0))[: len(row)])
        ends = np.append(start, len(row))
        length = np.bincount(row, minlength=size)
        pick = pa.array(row[start])
        return pa.RecordBatch.from_arrays(
            [
                *[batch.column(k).take(pick) for k in keys],
                pa.array(list(columns), pa.string()).take(pa.array(col[start])),
                codes.dictionary.take(pa.array(term[start])),
                pa.array(np.diff(ends), pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(seat, pa.int32())),
                pa.array(length[row[start]], pa.int64()),
                pa.array(new_term[start]),
            ],
            names=[*keys, *_POSTING.names],
        )

    return lambda batches: (postings(b) for b in batches if b.num_rows)


def build_index(messages, columns=X.INDEXED, stemmed=True, keys=LOCATION):
    """Postings of all messages, one row per (message, column, term), a message
    being told by its keys. Positions count from 0 within a column; ``dl`` is
    the message length over all columns."""
    columns = tuple(columns)
    tokens = Q.tokenized(messages, columns).select(*keys, *[f"_t_{c}" for c in columns])
    made = T.StructType([tokens.schema[k] for k in keys] + _POSTING.fields)
    return tokens.mapInArrow(_postings_maker(columns, stemmed, keys), made)


#: Groups of documents whose postings are made at a time.
GROUPS = 4


def _whole_groups(batches, group):
    """The batches cut anew, so that the rows of a group of documents come in
    one batch. Documents come in order."""
    held = None
    for batch in batches:
        held = batch if held is None else pa.concat_batches([held, batch])
        if held.num_rows:
            groups = np.asarray(held.column("doc")) // group
            firsts = np.flatnonzero(np.diff(groups)) + 1
            cuts = [0, *firsts[GROUPS - 1::GROUPS], *firsts[-1:]]
            for start, end in zip(cuts, cuts[1:]):
                if start < end:
                    yield held.slice(start, end - start)
            held = held.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield held


def _grouped(term, doc, col, dl, places, group):
    """Rows of one (term, group of documents) each, from postings: a term, a
    document, the number of a column, a message's length and positions."""
    codes = term.dictionary_encode()
    code, tf = np.asarray(codes.indices), np.asarray(places.value_lengths()).astype(np.int64)
    block = doc // group
    order = np.lexsort((col, doc, code, block))
    code, doc, col, dl, tf, block = (x[order] for x in (code, doc, col, dl, tf, block))
    new_row = np.append(True, (np.diff(block) != 0) | (np.diff(code) != 0))
    start, entry = np.flatnonzero(new_row), np.flatnonzero(new_row | np.append(True, np.diff(doc) != 0))
    entry_start = np.searchsorted(entry, start)
    seat = doc % group
    at = np.searchsorted(entry, np.arange(len(doc)), "right") - 1
    at -= np.repeat(entry_start, np.diff(np.append(start, len(doc))))
    times, length = np.add.reduceat(tf, entry), np.maximum.reduceat(dl, entry)
    ends, entry_ends = (pa.array(np.append(a, len(b)), pa.int32()) for a, b in ((start, doc), (entry_start, entry)))

    def lists(values, kind):
        return pa.ListArray.from_arrays(ends, pa.array(values, kind))

    entries = pa.StructArray.from_arrays(
        [pa.array(seat[entry], pa.int32()), pa.array(times), pa.array(length)], names=["seat", "tf", "dl"])
    return pa.RecordBatch.from_arrays(
        [codes.dictionary.take(pa.array(code[start])), pa.array(block[start]),
         pa.array(np.bitwise_or.reduceat(np.uint64(1) << seat.astype(np.uint64), start).view(np.int64)),
         pa.array(np.maximum.reduceat(times, entry_start)), pa.array(np.minimum.reduceat(length, entry_start)),
         pa.ListArray.from_arrays(entry_ends, entries), lists(at, pa.int8()), lists(col, pa.int8()),
         pa.ListArray.from_arrays(ends, places.take(pa.array(order)))],
        names=["term", "block", "bits", "most", "least", "entries", "ats", "cols", "places"])


def build_blocks(texts, columns, stemmed, group, schema):
    """Postings of documents (``doc`` and the columns), put together by term
    and group of documents. A group's documents must lie in one partition, and
    each partition in the order of ``doc``."""
    columns = tuple(columns)
    tokens = Q.tokenized(texts, columns).select("doc", *[f"_t_{c}" for c in columns])
    postings = _postings_maker(columns, stemmed, ["doc"])
    numbers = pa.array(list(columns), pa.string())

    def blocks(batches):
        for made in postings(_whole_groups(batches, group)):
            if made.num_rows:
                yield _grouped(
                    made.column("term"), np.asarray(made.column("doc")),
                    np.asarray(pc.index_in(made.column("column"), numbers)), np.asarray(made.column("dl")),
                    made.column("positions"), group)

    return tokens.mapInArrow(blocks, schema)


def regrouped(group):
    """Function of batches of rows of ``build_blocks`` with ``_to``, the new
    numbers (seat, doc) of the documents on the seats. A document that has none
    is left out, one that has several comes under each. Rows of one term and
    new group may come in pieces."""
    def run(batches):
        for batch in batches:
            ats, entries, to = batch.column("ats"), batch.column("entries"), batch.column("_to")
            rows = np.arange(batch.num_rows)
            row = np.repeat(rows, np.asarray(ats.value_lengths()))
            held = np.asarray(entries.value_lengths())
            entry, entries = (np.cumsum(held) - held)[row] + np.asarray(ats.flatten()), entries.flatten()
            found = to.flatten()
            key = np.repeat(rows, np.asarray(to.value_lengths())) * group + np.asarray(found.field("seat"))
            order = np.argsort(key, kind="stable")
            key, number = key[order], np.asarray(found.field("doc"))[order]
            wanted = row * group + np.asarray(entries.field("seat"))[entry]
            first = np.searchsorted(key, wanted)
            times = np.searchsorted(key, wanted, "right") - first
            left = np.repeat(np.arange(len(wanted)), times)
            if len(left):
                doc = number[first[left] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)]
                col, dl = np.asarray(batch.column("cols").flatten())[left], np.asarray(entries.field("dl"))[entry]
                yield _grouped(batch.column("term").take(pa.array(row[left])), doc, col, dl[left],
                               batch.column("places").flatten().take(pa.array(left)), group)

    return run


def doc_stats(messages, columns=X.INDEXED):
    """Length of each message; one row for every message, empty ones too."""
    return Q.tokenized(messages, columns).select(
        *LOCATION, Q._length(tuple(columns)).alias("dl"))


def term_stats(postings):
    """Messages and occurrences per term."""
    return postings.groupBy("term").agg(
        F.count_if("first_in_message").alias("df"), F.sum("tf").alias("occurrences"))


# ------------------------------------------------------------------ counting


def slots(term):
    """(word, is a prefix) of each token of a term."""
    last = len(term.tokens) - 1
    opened = term.kind in ("prefix", "open phrase")
    return [(w, opened and i == last) for i, w in enumerate(term.tokens)]


def _starts(words, every):
    """Where a phrase starts in one column, from the position lists of its
    words."""
    def at(step, slot):
        return F.transform(F.col(f"_p{every.index(slot)}"), lambda seat: seat - step)

    hits = at(0, words[0])
    for step, slot in enumerate(words[1:], 1):
        hits = F.array_intersect(hits, at(step, slot))
    return hits


def _near_starts(first, second, distance):
    """Column of how many starts of the first phrase have one of the second at
    most ``distance`` words away: it begins after the first one's end, or ends
    before its start. Two sorted lists are walked along each other, so the time
    does not depend on how many pairs are near."""

    def between(lists, low, high):
        return np.searchsorted(lists, high, "right") > np.searchsorted(lists, low, "left")

    @F.pandas_udf(T.LongType())
    def count(ones: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for one, other in zip(ones, others):
            if one is None or other is None or not len(one) or not len(other):
                out.append(0)
                continue
            one, other = (np.sort(np.asarray(x, np.int64)) for x in (one, other))
            hit = between(other, one + len(first), one + len(first) + distance)
            hit |= between(other, one - distance - len(second), one - len(second))
            # A phrase stands near itself.
            out.append(len(one) if first == second else int(hit.sum()))
        return pd.Series(out, dtype="int64")

    return count


def _occurrences(term, every):
    """How often a term occurs in one column."""
    words = slots(term)
    if term.kind != "near":
        return F.coalesce(F.size(_starts(words, every)), F.lit(0)).cast("long")
    a, b = words[:term.first], words[term.first:]
    return _near_starts(a, b, term.distance)(_starts(a, every), _starts(b, every))


def holds(slot):
    """Test of a posting's term."""
    word, opened = slot
    return F.col("term").startswith(word) if opened else F.col("term") == word


def is_plain(term):
    """Whether counts settle the term; otherwise positions or columns do."""
    return term.kind in ("word", "prefix") and term.columns is None


def counts(postings, terms, keys=LOCATION):
    """Per message: its length ``_dl`` and how often each term occurs, as
    ``_n0``, ``_n1``, ... One pass over the postings of the searched words,
    shuffled by message."""
    every = list(dict.fromkeys(s for t in terms for s in slots(t)))
    hits = postings.filter(Q._any(holds(s) for s in every))
    if all(is_plain(t) for t in terms):
        return hits.groupBy(*keys).agg(F.max("dl").alias("_dl"), *[
            F.coalesce(F.sum(F.when(holds(slots(t)[0]), F.col("tf"))), F.lit(0)).alias(f"_n{i}")
            for i, t in enumerate(terms)])
    # A prefix may stand for several terms; their positions are put together.
    seats = [F.flatten(F.collect_list(F.when(holds(s), F.col("positions")))) if s[1]
             else F.max(F.when(holds(s), F.col("positions"))) for s in every]
    per_column = hits.repartition(*keys).groupBy(*keys, "column").agg(
        F.max("dl").alias("_dl"), *[c.alias(f"_p{k}") for k, c in enumerate(seats)])
    found = {}
    for i, t in enumerate(terms):
        here = F.lit(True) if t.columns is None else F.col("column").isin(list(t.columns))
        found[f"_n{i}"] = F.when(here, _occurrences(t, every)).otherwise(F.lit(0).cast("long"))
    return per_column.withColumns(found).groupBy(*keys).agg(
        F.max("_dl").alias("_dl"), *[F.sum(n).alias(n) for n in found])


def compare_index(messages, indexed):
    """Both differences between catalogue and index: rows of either side
    without a partner on the other. Where they agree only digests are compared."""
    rows, keys = narrowed(messages, indexed, LOCATION)
    keys = keys.distinct()
    orphaned = keys.join(rows, list(LOCATION), "left_anti").withColumn("status", F.lit("orphaned"))
    missing = rows.join(keys, list(LOCATION), "left_anti").withColumn("status", F.lit("missing"))
    return orphaned.unionByName(missing)


def repair_index(messages, postings, lengths, columns=X.INDEXED, stemmed=True):
    """Index tables with orphans dropped and missing messages added."""
    keys = messages.select(*LOCATION)
    fresh = messages.join(lengths.select(*LOCATION), list(LOCATION), "left_anti")
    return (
        postings.join(keys, list(LOCATION), "left_semi")
        .unionByName(build_index(fresh, columns, stemmed)),
        lengths.join(keys, list(LOCATION), "left_semi").unionByName(doc_stats(fresh, columns)),
    )
