"""Search over message tables.

Full-text searches take ``index=`` (``operators.segments.open_index``) and then
read the postings of their words only. Without one a search is a narrow pass
over the texts: filters first, then term counts inside each row, then a top-k.
Nothing is shuffled but the k best rows of each task; corpus statistics come
from a scalar subquery."""

import math
import re
from dataclasses import dataclass, replace

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.functions import columns as C
from mailspark.functions import text as X
from mailspark.functions.porter import stem as porter_stem

K1, B = 1.2, 0.75
IDF_FLOOR = 1e-6

RESULT = ("gmail_id", "rfc_message_id", "subject", "from_addr", "to_addr", "date",
          "body_preview", "archive_file", "mbox_offset")
TIES = ("rfc_message_id", "archive_file", "mbox_offset")


# ---------------------------------------------------------------- match forms


@dataclass(frozen=True)
class Match:
    """One search term: a word, a prefix, a phrase, or two words near each
    other, in some or all of the indexed columns."""

    kind: str
    tokens: tuple
    columns: tuple | None = None
    distance: int = 0
    negated: bool = False
    #: Of a near term, how many of the tokens are the first phrase.
    first: int = 1

    def within(self, *names):
        return replace(self, columns=tuple(names))


def word(text):
    return phrase(text)


def _words(text):
    tokens = tuple(X.local_tokens(text))
    if not tokens:
        raise ValueError(f"no word to search in {text!r}")
    return tokens


def phrase(text):
    tokens = _words(text)
    return Match("word" if len(tokens) == 1 else "phrase", tokens)


def prefix(text):
    """Words that start with the text; of several words the last one is open."""
    tokens = _words(text)
    return Match("prefix" if len(tokens) == 1 else "open phrase", tokens)


def near(first, second, distance=10):
    """Two words or phrases with at most ``distance`` words between them."""
    a, b = _words(first), _words(second)
    return Match("near", a + b, distance=distance, first=len(a))


def terms_of(text, columns=None):
    """Words and quoted phrases of a search text, all of which must match. A
    closing ``*`` opens the last word. NULL-like result for malformed text."""
    if text.count('"') % 2:
        return None
    out = []
    for part in re.findall(r'"[^"]*"\*?|[^\s"]+', text):
        if X.local_tokens(part):
            term = prefix(part) if part.endswith("*") else phrase(part)
            out.append(replace(term, columns=columns))
    return out or None


def _count(term, tokens):
    """How often a term matches in one token array."""
    t = term.tokens
    if term.kind == "word":
        return F.size(F.filter(tokens, lambda x: x == t[0]))
    if term.kind == "prefix":
        return F.size(F.filter(tokens, lambda x: x.startswith(t[0])))
    if term.kind == "near":
        # Places of the first phrase with the second one inside the window: it
        # starts at most ``distance`` words after the first one's end, or ends
        # as many before its start.
        a, b = t[:term.first], t[term.first:]

        def stands(words, i):
            return F.slice(tokens, i, len(words)) == F.array(*[F.lit(w) for w in words])

        def hit(i):
            start = F.greatest(i - term.distance - len(b), F.lit(1))
            last = F.least(i + len(a) + term.distance, F.size(tokens) - len(b) + 1)
            window = F.when(last >= start, F.sequence(start, last))
            return stands(a, i) & F.exists(window, lambda j: stands(b, j) & (
                (j >= i + len(a)) | (j + len(b) <= i) | (F.lit(a == b) & (j == i))))

        return F.when(
            F.array_contains(tokens, a[0]) & F.array_contains(tokens, b[0])
            & (F.size(tokens) >= max(len(a), len(b))),
            F.size(F.filter(F.sequence(F.lit(1), F.size(tokens) - len(a) + 1), hit)),
        ).otherwise(F.lit(0))
    open_end = term.kind == "open phrase"
    fixed = t[:-1] if open_end else t
    seats = F.sequence(F.lit(1), F.size(tokens) - F.lit(len(t) - 1))

    def at(i):
        hit = F.slice(tokens, i, len(fixed)) == F.array(*[F.lit(w) for w in fixed])
        if open_end:
            hit = hit & F.element_at(tokens, i + len(fixed)).startswith(t[-1])
        return hit

    return F.when(
        F.array_contains(tokens, t[0]) & (F.size(tokens) >= len(t)),
        F.size(F.filter(seats, at)),
    ).otherwise(F.lit(0))


def _columns(term, columns):
    unknown = set(term.columns or ()) - set(columns)
    if unknown:
        raise ValueError(f"not an indexed column: {', '.join(sorted(unknown))}")
    return term.columns or columns


def _stemmed(term):
    tokens = list(term.tokens)
    keep = len(tokens) - 1 if term.kind in ("prefix", "open phrase") else len(tokens)
    return replace(term, tokens=tuple([porter_stem(w) for w in tokens[:keep]] + tokens[keep:]))


def _heads(term):
    """A stem differs from its word in the last letter at most, so every word
    with this stem starts with the stem's head."""
    return [w[:-1] if len(w) > 1 else w for w in term.tokens]


def _all(tests):
    out = F.lit(True)
    for test in tests:
        out = out & test
    return out


def _any(tests):
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def tokenized(messages, columns=X.INDEXED):
    """Adds the folded text of each indexed column and its token array."""
    folded = messages.withColumns({f"_f_{c}": X.fold(F.col(c)) for c in columns})
    return folded.withColumns({f"_t_{c}": X.words(F.col(f"_f_{c}")) for c in columns})


def _once(rows, **values):
    """Adds columns that are computed exactly once per row: filters on them
    are not pushed below, so costly expressions are not repeated."""
    return rows.select("*", F.inline(F.array(F.struct(
        *[v.alias(k) for k, v in values.items()]))))


def _counted(messages, terms, columns, stemmed):
    """Every message with its length ``_dl`` and one count per term."""
    rows = tokenized(messages, columns)
    length = _length(columns)
    if stemmed:
        terms = [_stemmed(t) for t in terms]
        heads = sorted({h for t in terms for h in _heads(t)})

        def candidate(c):
            return F.exists(c, lambda x: _any(x.startswith(h) for h in heads))

        # Only rows with a word that may have a searched stem go to Python whole.
        may = _any(candidate(F.col(f"_t_{c}")) for c in columns)
        nothing = F.array().cast("array<string>")
        rows = _once(rows, _dl=length, _may=may)
        rows = rows.withColumns({
            f"_t_{c}": X.stem_tokens(
                F.when(F.col("_may"), F.col(f"_t_{c}")).otherwise(nothing))
            for c in columns
        })
        extra = {}
    else:
        extra = {"_dl": length}
    for i, t in enumerate(terms):
        extra[f"_n{i}"] = sum(
            (_count(t, F.col(f"_t_{c}")) for c in _columns(t, columns)), F.lit(0))
    return _once(rows, **extra)


def _length(columns):
    return sum((F.size(f"_t_{c}") for c in columns), F.lit(0)).cast("long")


def corpus_stats(messages, terms, columns=X.INDEXED, stemmed=True, matching=None):
    """One row: messages N, tokens in all of them, messages per term, and how
    many rows pass the ``matching`` test on the counts."""
    test = F.lit(False) if matching is None else matching
    return _counted(messages, terms, tuple(columns), stemmed).agg(
        F.count("*").alias("N"),
        F.sum("_dl").alias("tokens"),
        F.count_if(test).alias("total"),
        *[F.count_if(F.col(f"_n{i}") > 0).alias(f"n{i}") for i in range(len(terms))],
    )


def idf(total, matching):
    return F.greatest(F.log((total - matching + 0.5) / (matching + 0.5)), F.lit(IDF_FLOOR))


def bm25(counts, matching, length, total, tokens):
    """BM25 score of one row; ``counts`` and ``matching`` run in parallel."""
    average = tokens / F.nullif(total, F.lit(0))
    weight = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average)
    return sum(
        (idf(total, n) * tf * F.lit(K1 + 1) / (tf + weight) for tf, n in zip(counts, matching)),
        F.lit(0.0),
    )


def bm25_sql(counts, lengths, matching, total, tokens):
    """The same score as SQL text, where the statistics are known: ``counts``,
    ``lengths`` and ``matching`` run in parallel."""
    average = tokens / total if total else 1.0
    terms = []
    for tf, length, n in zip(counts, lengths, matching):
        weight = max(math.log((total - n + 0.5) / (n + 0.5)), IDF_FLOOR)
        terms.append(f"{weight!r}D * {tf} * {K1 + 1!r}D / ({tf} + {K1!r}D * "
                     f"({1 - B!r}D + {B!r}D * {length} / {average!r}D))")
    return "(" + " + ".join(terms) + ")"


def text_columns(messages):
    """What a search looks at: whole texts where the table has them."""
    return tuple("body" if c == "body_preview" and "body" in messages.columns else c
                 for c in X.INDEXED)


def match_messages(messages, terms, *, columns=None, stemmed=True, where=None, any_of=False,
                   index=None):
    """Messages that match the terms, with ``relevance_score`` and
    ``total_results``. All terms must match, or one of them with ``any_of``;
    negated terms must not match. The score uses statistics of all messages,
    ``where`` only filters the rows. An index settles columns and stems."""
    if index is not None:
        return index.matches(messages, terms, where, any_of)
    columns = tuple(columns or text_columns(messages))
    for t in terms:
        _columns(t, columns)
    wanted = [i for i, t in enumerate(terms) if not t.negated]
    positive = [F.col(f"_n{i}") > 0 for i in wanted]
    absent = [F.col(f"_n{i}") == 0 for i, t in enumerate(terms) if t.negated]
    test = (_any(positive) if any_of else _all(positive)) & _all(absent)
    where = F.lit(True) if where is None else where
    rows = _counted(messages.filter(where), terms, columns, stemmed).filter(test)
    stats = corpus_stats(messages, terms, columns, stemmed, matching=test & where)
    rows = rows.withColumn("_s", stats.select(F.struct("*")).scalar())
    score = bm25(
        [F.col(f"_n{i}") for i in wanted],
        [F.col(f"_s.n{i}") for i in wanted],
        F.col("_dl"), F.col("_s.N"), F.col("_s.tokens"),
    )
    return rows.select(*messages.columns, score.alias("relevance_score"),
                       F.col("_s.total").alias("total_results"))


def any_of(messages, *terms, **options):
    return match_messages(messages, list(terms), any_of=True, **options)


def all_of(messages, *terms, **options):
    return match_messages(messages, list(terms), **options)


def none_of(messages, wanted, unwanted, **options):
    """Messages that match all wanted and none of the unwanted terms."""
    terms = list(wanted) + [replace(t, negated=True) for t in unwanted]
    return match_messages(messages, terms, **options)


# ------------------------------------------------------------------- filters


def _like_literal(text):
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def contains(c, text):
    """Case-insensitive contains; ``%`` and ``_`` stand for themselves."""
    return F.col(c).ilike(f"%{_like_literal(text)}%")


def _instant(value):
    if isinstance(value, str):
        return F.lit(value.strip().replace("/", "-")).try_cast("timestamp_ntz")
    return F.lit(value).cast("timestamp_ntz")


def metadata_filter(from_addr=None, to_addr=None, subject=None, after=None, before=None):
    """AND of contains tests and the half-open range [after, before)."""
    tests = [contains(c, v) for c, v in
             (("from_addr", from_addr), ("to_addr", to_addr), ("subject", subject)) if v]
    if after:
        tests.append(F.col("date") >= _instant(after))
    if before:
        tests.append(F.col("date") < _instant(before))
    return _all(tests)


def filter_messages(messages, from_addr=None, to_addr=None, subject=None, date_start=None,
                    date_end=None, fulltext=None, limit=None, **options):
    """Storage-level filter: addresses are equal, or LIKE patterns if they hold
    a ``%``; both date bounds are inclusive."""
    tests = []
    for c, value in (("from_addr", from_addr), ("to_addr", to_addr)):
        if value:
            tests.append(F.col(c).ilike(value) if "%" in value else F.col(c) == value)
    if subject:
        tests.append(F.col("subject").ilike(f"%{subject}%"))
    if date_start:
        tests.append(F.col("date") >= _instant(date_start))
    if date_end:
        tests.append(F.col("date") <= _instant(date_end))
    if fulltext:
        terms = terms_of(fulltext)
        rows = (match_messages(messages, terms, where=_all(tests), **options)
                .select(*messages.columns) if terms else messages.limit(0))
    else:
        rows = messages.filter(_all(tests))
    return rows if limit is None else rows.orderBy(F.desc("date"), *TIES).limit(limit)


def older_than(messages, age, as_of=None):
    return messages.filter(F.col("date") < C.age_cutoff(age, as_of))


def misplaced():
    """Test of a stored location that cannot be right; never NULL."""
    return (F.coalesce(F.col("mbox_offset") < 0, F.lit(True))
            | F.coalesce(F.col("mbox_length") <= 0, F.lit(True)))


def invalid_offsets(messages, archive_file=None):
    """Rows with such a location, of all archives or of one."""
    rows = messages if archive_file is None else messages.filter(
        F.col("archive_file") == archive_file)
    return rows.filter(misplaced())


def messages_in_archive(messages, archive_file):
    return messages.filter(F.col("archive_file") == archive_file).orderBy("mbox_offset")


def remote_ids_in_archive(messages, archive_file):
    rows = messages.filter((F.col("archive_file") == archive_file) & F.col("gmail_id").isNotNull())
    return rows.select("gmail_id").distinct()


# --------------------------------------------------------------------- pages


def page(rows, order, limit=100, offset=0):
    """One page of the ordered rows, and how many rows there are in all."""
    if "total_results" not in rows.columns:
        rows = rows.withColumn("total_results", rows.agg(F.count("*")).scalar())
    return rows.orderBy(*order).offset(offset).limit(limit)


def _present(rows, limit, offset, ranked):
    if not ranked:
        rows = rows.withColumn("relevance_score", F.lit(None).cast("double"))
    order = ([F.desc("relevance_score")] if ranked else [F.desc("date")]) + list(TIES)
    total = [c for c in rows.columns if c == "total_results"]
    out = page(rows.select(*RESULT, "relevance_score", *total), order, limit, offset)
    return C.default_nulls(out)


def _empty(messages):
    return _present(messages.limit(0), 1, 0, ranked=False)


def search_metadata(messages, from_addr=None, to_addr=None, subject=None, after=None, before=None,
                    limit=100, offset=0):
    test = metadata_filter(from_addr, to_addr, subject, after, before)
    return _present(messages.filter(test), limit, offset, ranked=False)


def search_all(messages, limit=100, offset=0):
    return _present(messages, limit, offset, ranked=False)


def _best(messages, terms, limit, offset, index=None, where=None, **options):
    rows = (match_messages(messages, terms, where=where, **options) if index is None
            else index.page(messages, terms, where, limit=limit, offset=offset))
    return _present(rows, limit, offset, ranked=True)


def search_fulltext(messages, text, fields=None, limit=100, offset=0, **options):
    """Best matches for all words of the text, in the given columns or in all
    indexed ones. Malformed text finds nothing."""
    index = options.get("index")
    columns = index.columns if index else tuple(options.get("columns") or text_columns(messages))
    unknown = set(fields or ()) - set(columns)
    if unknown:
        raise ValueError(f"not an indexed column: {', '.join(sorted(unknown))}")
    terms = terms_of(text, tuple(fields) if fields else None)
    if not terms:
        return _empty(messages)
    return _best(messages, terms, limit, offset, **options)


def search_hybrid(messages, text, from_addr=None, to_addr=None, subject=None, after=None,
                  before=None, limit=100, offset=0, **options):
    """Full text and filters together; a subject becomes a term that must
    match in the subject column."""
    terms = terms_of(text)
    subject_terms = terms_of(subject, ("subject",)) if subject else []
    if terms is None or subject_terms is None:
        return _empty(messages)
    where = metadata_filter(from_addr, to_addr, None, after, before)
    return _best(messages, subject_terms + terms, limit, offset, where=where, **options)


# The operators of a mail-style query.
OPERATORS = ("from", "to", "subject", "after", "before")


def split_query(query):
    """Operators of a mail-style query (the first of each kind counts) and
    the words left over."""
    found, words = {}, []
    for part in query.split():
        name, colon, value = part.partition(":")
        if colon and value and name in OPERATORS:
            found.setdefault(name, value)
        else:
            words.append(part)
    return found, " ".join(words)


def search(messages, query, limit=100, offset=0, **options):
    """Mail-style query: ``from: to: subject: after: before:`` and words."""
    found, text = split_query(query)
    filters = {
        "from_addr": found.get("from"), "to_addr": found.get("to"),
        "subject": found.get("subject"), "after": found.get("after"),
        "before": found.get("before"),
    }
    if text and found:
        return search_hybrid(messages, text, limit=limit, offset=offset, **filters, **options)
    if text:
        return search_fulltext(messages, text, limit=limit, offset=offset, **options)
    if found:
        return search_metadata(messages, limit=limit, offset=offset, **filters)
    return search_all(messages, limit, offset)


def order_results(rows, ascending=False):
    """Rows by date; those without a date are the oldest."""
    key = C.sort_date(F.col("date"))
    return rows.orderBy(key.asc() if ascending else key.desc(), *TIES)


def results_json(rows, with_preview=False):
    """Search results as JSON records, one text column."""
    fields = [
        F.col("gmail_id"), F.col("rfc_message_id"), F.col("date"),
        F.col("from_addr").alias("from"), F.col("to_addr").alias("to"), F.col("subject"),
        F.col("archive_file"), F.col("mbox_offset"), F.col("relevance_score"),
    ]
    if with_preview:
        fields.append(C.truncate_preview(F.col("body_preview")).alias("body_preview"))
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def write_results_json(rows, path, with_preview=False):
    results_json(rows, with_preview).write.mode("errorifexists").text(path)
