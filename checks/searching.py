"""Search, text and column queries."""

from pyspark.sql import functions as F

from checks import TS, kept, msgs, query, unstored, with_msgs
from checks.stemming import stems_sql
from mailspark import views
from mailspark.functions import columns as C
from mailspark.functions import text as X
from mailspark.operators import index as I
from mailspark.operators import search as Q
from mailspark.operators import segments as SG
from mailspark.session import scratch

#: Whole texts are searched, not their previews.
WHOLE = ("subject", "from_addr", "to_addr", "body")
PLAIN = {"columns": WHOLE, "stemmed": False}


# ------------------------------------------------------------------- SQL parts


def tok(c):
    return (f"regexp_extract_all(translate(lower(coalesce({c}, '')), '{X.FOLD_FROM}', "
            f"'{X.FOLD_TO}'), '{X.TOKEN}')")


TOKS_SQL = "toks AS (SELECT *, " + ", ".join(f"{tok(c)} AS t_{c}" for c in WHOLE) + " FROM msgs)"
DL = " + ".join(f"len(t_{c})" for c in WHOLE)


def word_count(w, columns=WHOLE):
    return " + ".join(f"len(list_filter(t_{c}, lambda x: x = '{w}'))" for c in columns)


def prefix_count(w, columns=WHOLE):
    return " + ".join(f"len(list_filter(t_{c}, lambda x: starts_with(x, '{w}')))" for c in columns)


def phrase_count(ws, columns=WHOLE):
    def one(c):
        test = " AND ".join(f"t_{c}[i + {k}] = '{w}'" for k, w in enumerate(ws))
        return f"len(list_filter(range(1, len(t_{c}) + 1), lambda i: {test}))"

    return " + ".join(one(c) for c in columns)


def ranked_sql(counts, match, where="true", extra="", limit=100, score=None, shown=None,
               parts=()):
    """BM25 ranking with the counts as n0, n1, ..."""
    n = len(counts)
    counted = f"c AS (SELECT *, {DL} AS dl, " + ", ".join(
        f"{sql} AS n{i}" for i, sql in enumerate(counts)) + " FROM toks)"
    stats = "s AS (SELECT count(*) AS n_all, sum(dl) AS tokens, " + ", ".join(
        f"count(*) FILTER (WHERE n{i} > 0) AS m{i}" for i in range(n)) + " FROM c)"
    scored = score if score is not None else range(n)
    terms = " + ".join(
        f"greatest(ln((n_all - m{i} + 0.5e0) / (m{i} + 0.5e0)), 1e-6) * n{i} * 2.2e0 / "
        f"(n{i} + 1.2e0 * (0.25e0 + 0.75e0 * dl / (tokens::DOUBLE / n_all)))" for i in scored)
    found = f"f AS (SELECT c.*, {terms} AS score FROM c, s WHERE {match} AND {where})"
    columns = shown or "gmail_id, rfc_message_id, from_addr, to_addr, archive_file, mbox_offset"
    return with_msgs(
        f"SELECT {columns}, round(score, 9) AS relevance_score, "
        f"(SELECT count(*) FROM f) AS total_results FROM f "
        f"ORDER BY score DESC, rfc_message_id, archive_file, mbox_offset LIMIT {limit} {extra}",
        TOKS_SQL, *parts, counted, stats, found)


def found(result):
    return result.select(
        "gmail_id", "rfc_message_id", "from_addr", "to_addr", "archive_file", "mbox_offset",
        F.round("relevance_score", 9).alias("relevance_score"), "total_results")


META = ("gmail_id, rfc_message_id, subject, from_addr, to_addr, "
        f"strftime(date, {TS}) AS date, archive_file, mbox_offset")
BY_DATE = "ORDER BY date DESC, rfc_message_id, archive_file, mbox_offset"


def listed(result, *more):
    return result.select("gmail_id", "rfc_message_id", "subject", "from_addr", "to_addr", "date",
                         "archive_file", "mbox_offset", *more)


def meta_sql(where, limit=100, offset=0):
    return with_msgs(
        f"SELECT {META}, (SELECT count(*) FROM msgs WHERE {where}) AS total_results FROM msgs "
        f"WHERE {where} ORDER BY msgs.date DESC, rfc_message_id, archive_file, mbox_offset "
        f"LIMIT {limit} OFFSET {offset}")


# -------------------------------------------------------------------- queries


@query(ranked_sql([word_count("the"), word_count("and")], "n0 > 0 AND n1 > 0", limit=10))
def search_fulltext(spark, sf_dir):
    return found(Q.search_fulltext(msgs(spark, sf_dir), "the and", limit=10, **PLAIN))


@query(ranked_sql([word_count("de", ("subject",))], "n0 > 0", limit=20))
def search_fulltext_fields(spark, sf_dir):
    return found(Q.search_fulltext(msgs(spark, sf_dir), "de", ["subject"], limit=20, **PLAIN))


@query(ranked_sql(
    [word_count("de", ("subject",)), word_count("la")], "n0 > 0 AND n1 > 0",
    "date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-06-01'", limit=50))
def search_hybrid(spark, sf_dir):
    return found(Q.search(msgs(spark, sf_dir), "subject:de la after:2024-01-05 before:2024-06-01",
                          limit=50, **PLAIN))


@query(meta_sql("from_addr ILIKE '%en@src1%' AND to_addr ILIKE '%list-3%' "
                "AND date >= TIMESTAMP '2024-01-03' AND date < TIMESTAMP '2024-12-01'"))
def search_metadata(spark, sf_dir):
    return listed(Q.search_metadata(
        msgs(spark, sf_dir), from_addr="EN@src1", to_addr="list-3", after="2024-01-03",
        before="2024-12-01"), "total_results")


@query(meta_sql("subject ILIKE '%tion%' AND from_addr ILIKE '%fr@%'", 30))
def search_mail_query(spark, sf_dir):
    return listed(Q.search(msgs(spark, sf_dir), "from:fr@ subject:tion", limit=30),
                  "total_results")


@query(meta_sql("true", 25))
def search_all(spark, sf_dir):
    return listed(Q.search_all(msgs(spark, sf_dir), 25), "total_results")


@query(meta_sql("from_addr ILIKE '%src2%'", 20, 10))
def page(spark, sf_dir):
    return listed(Q.search_metadata(msgs(spark, sf_dir), from_addr="src2", limit=20, offset=10),
                  "total_results")


@query(with_msgs(f"""SELECT {META} FROM msgs WHERE from_addr ILIKE 'de@%' AND
  to_addr = 'list-2@example.com' AND subject ILIKE '%der%'
  AND date >= TIMESTAMP '2024-01-02' AND date <= TIMESTAMP '2024-09-01'"""))
def filter_messages(spark, sf_dir):
    return listed(Q.filter_messages(
        msgs(spark, sf_dir), from_addr="de@%", to_addr="list-2@example.com", subject="der",
        date_start="2024-01-02", date_end="2024-09-01"))


@query(ranked_sql([phrase_count(("in", "the"))], "n0 > 0", limit=100))
def match_phrase(spark, sf_dir):
    return found(Q.search_fulltext(msgs(spark, sf_dir), '"in the"', **PLAIN))


@query(ranked_sql([prefix_count("hea")], "n0 > 0", limit=100))
def match_prefix(spark, sf_dir):
    return found(Q.search_fulltext(msgs(spark, sf_dir), "hea*", **PLAIN))


@query(ranked_sql([word_count("der"), word_count("los")], "(n0 > 0 OR n1 > 0)", limit=100))
def match_any(spark, sf_dir):
    result = Q.any_of(msgs(spark, sf_dir), Q.word("der"), Q.word("los"), **PLAIN)
    order = [F.desc("relevance_score"), *Q.TIES]
    return found(Q.page(result, order, 100))


@query(ranked_sql([word_count("the"), word_count("that")], "n0 > 0 AND n1 = 0", limit=100,
                  score=[0]))
def match_none(spark, sf_dir):
    result = Q.none_of(msgs(spark, sf_dir), [Q.word("the")], [Q.word("that")], **PLAIN)
    return found(Q.page(result, [F.desc("relevance_score"), *Q.TIES], 100))


UNNEST = " UNION ALL ".join(
    f"SELECT archive_file, mbox_offset, '{c}' AS \"column\", unnest(t_{c}) AS term, "
    f"unnest(range(len(t_{c}))) AS pos FROM toks" for c in WHOLE)
NEAR_SQL = f"""u AS ({UNNEST}), hits AS (SELECT archive_file AS f, mbox_offset AS o, count(*) AS n
  FROM (SELECT DISTINCT a.* FROM u a JOIN u b ON a.archive_file = b.archive_file
          AND a.mbox_offset = b.mbox_offset AND a."column" = b."column"
        WHERE a.term = 'the' AND b.term = 'and' AND abs(a.pos - b.pos) <= 3) GROUP BY 1, 2)"""
NEAR_COUNT = "coalesce((SELECT n FROM hits WHERE f = archive_file AND o = mbox_offset), 0)"


@query(ranked_sql([NEAR_COUNT], "n0 > 0", parts=[NEAR_SQL]))
def match_near(spark, sf_dir):
    result = Q.all_of(msgs(spark, sf_dir), Q.near("the", "and", 2), **PLAIN)
    return found(Q.page(result, [F.desc("relevance_score"), *Q.TIES], 100))


@query(with_msgs("SELECT gmail_id, archive_file, mbox_offset FROM msgs "
                 "WHERE date < TIMESTAMP '2024-06-01' - INTERVAL 138 DAY"))
def older_than(spark, sf_dir):
    as_of = F.lit("2024-06-01").cast("timestamp_ntz")
    return Q.older_than(msgs(spark, sf_dir), "138d", as_of).select(
        "gmail_id", "archive_file", "mbox_offset")


@query(with_msgs(f"SELECT gmail_id, strftime(date, {TS}) AS date, archive_file FROM msgs "
                 "ORDER BY msgs.date, rfc_message_id, archive_file, mbox_offset"))
def order_results(spark, sf_dir):
    return Q.order_results(msgs(spark, sf_dir), ascending=True).select(
        "gmail_id", "date", "archive_file")


@query(with_msgs("""SELECT gmail_id, rfc_message_id, archive_file, mbox_offset, mbox_length FROM (
    SELECT * EXCLUDE (mbox_length),
      CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN -1
           ELSE mbox_length END AS mbox_length FROM msgs)
  WHERE mbox_offset < 0 OR mbox_length <= 0"""))
def invalid_offsets(spark, sf_dir):
    return Q.invalid_offsets(spoiled(spark, sf_dir)).select(
        "gmail_id", "rfc_message_id", "archive_file", "mbox_offset", "mbox_length")


def spoiled(spark, sf_dir):
    """Messages whose labelled-toxic rows lost their length."""
    toxic = (views.load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
             .withColumn("_bad", F.lit(True)))
    return msgs(spark, sf_dir).join(toxic, "doc_id", "left").withColumn(
        "mbox_length", F.when(F.col("_bad"), F.lit(-1)).otherwise(F.col("mbox_length"))
    ).drop("_bad")


@query(with_msgs("SELECT gmail_id, rfc_message_id, mbox_offset, mbox_length FROM msgs "
                 "WHERE archive_file = 'src7.mbox' ORDER BY mbox_offset"))
def messages_in_archive(spark, sf_dir):
    return Q.messages_in_archive(msgs(spark, sf_dir), "src7.mbox").select(
        "gmail_id", "rfc_message_id", "mbox_offset", "mbox_length")


@query(with_msgs("SELECT DISTINCT gmail_id FROM msgs WHERE archive_file = 'src3.mbox'"))
def remote_ids_in_archive(spark, sf_dir):
    return Q.remote_ids_in_archive(msgs(spark, sf_dir), "src3.mbox")


# ----------------------------------------------------------------------- text


@query(with_msgs(f"SELECT w AS token, count(*) AS n FROM (SELECT unnest({tok('body')}) AS w "
                 "FROM msgs) GROUP BY w"))
def tokenize(spark, sf_dir):
    tokens = msgs(spark, sf_dir).select(F.explode(X.tokenize(F.col("body"))).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


@query(with_msgs("""SELECT archive_file, mbox_offset, "column", term, count(*) AS tf,
    string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
  FROM u GROUP BY ALL""", TOKS_SQL, f"u AS ({UNNEST})"))
def build_index(spark, sf_dir):
    return I.build_index(msgs(spark, sf_dir), WHOLE, stemmed=False).drop("dl", "first_in_message")


@query(with_msgs("""SELECT term, count(DISTINCT (archive_file, mbox_offset)) AS df,
    count(*) AS occurrences FROM u GROUP BY term""", TOKS_SQL, f"u AS ({UNNEST})"))
def term_stats(spark, sf_dir):
    return I.term_stats(I.build_index(msgs(spark, sf_dir), WHOLE, stemmed=False))


@query(with_msgs(f"SELECT archive_file, mbox_offset, {DL} AS dl FROM toks", TOKS_SQL))
def doc_stats(spark, sf_dir):
    return I.doc_stats(msgs(spark, sf_dir), WHOLE)


def buckets_for(spark, sf_dir):
    """One index bucket per thousand messages, up to the library's default."""
    return min(SG.BUCKETS, max(8, views.load(spark, sf_dir, "documents").count() // 1000))


@kept
def stored_index(spark, sf_dir, stemmed=False):
    """The index of all whole texts, written down."""
    path = scratch(spark, "index")
    SG.create(spark, path, WHOLE, stemmed, buckets_for(spark, sf_dir)).add(unstored(spark, sf_dir))
    return path


@kept
def opened(spark, sf_dir, *stemmed):
    return SG.open_index(spark, stored_index(spark, sf_dir, *stemmed))


def index(spark, sf_dir, stemmed=False):
    return opened(spark, sf_dir, *[True] * stemmed)


def by_index(spark, sf_dir):
    """The catalogue, which has no bodies, and the index of whole texts."""
    return unstored(spark, sf_dir).drop("body"), {"index": index(spark, sf_dir)}


@query(ranked_sql([word_count("the"), word_count("and")], "n0 > 0 AND n1 > 0", limit=10))
def index_fulltext(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    return found(Q.search(m, "the and", limit=10, **options))


@query(ranked_sql([word_count("de", ("subject",))], "n0 > 0", limit=20))
def index_fields(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    return found(Q.search_fulltext(m, "de", ["subject"], limit=20, **options))


@query(ranked_sql(
    [word_count("de", ("subject",)), word_count("la")], "n0 > 0 AND n1 > 0",
    "date >= TIMESTAMP '2024-01-05' AND date < TIMESTAMP '2024-06-01'", limit=50))
def index_hybrid(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    return found(Q.search(m, "subject:de la after:2024-01-05 before:2024-06-01", limit=50, **options))


@query(ranked_sql([phrase_count(("in", "the")), prefix_count("hea")], "n0 > 0 AND n1 > 0",
                  limit="30 OFFSET 20"))
def index_phrase_prefix(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    return found(Q.search_fulltext(m, '"in the" hea*', limit=30, offset=20, **options))


@query(ranked_sql([word_count("der"), word_count("los")], "(n0 > 0 OR n1 > 0)", limit=100))
def index_any(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    result = Q.any_of(m, Q.word("der"), Q.word("los"), **options)
    return found(Q.page(result, [F.desc("relevance_score"), *Q.TIES], 100))


@query(ranked_sql([word_count("the"), word_count("that")], "n0 > 0 AND n1 = 0", limit=100,
                  score=[0]))
def index_none(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    result = Q.none_of(m, [Q.word("the")], [Q.word("that")], **options)
    return found(Q.page(result, [F.desc("relevance_score"), *Q.TIES], 100))


@query(ranked_sql([NEAR_COUNT], "n0 > 0", parts=[NEAR_SQL]))
def index_near(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    result = Q.all_of(m, Q.near("the", "and", 2), **options)
    return found(Q.page(result, [F.desc("relevance_score"), *Q.TIES], 100))


@query(ranked_sql([word_count("the"), word_count("and")], "n0 > 0 AND n1 > 0", limit=50))
def search_index(spark, sf_dir):
    m, options = by_index(spark, sf_dir)
    return found(Q.search_fulltext(m, "the and", limit=50, **options))


HARMLESS = "doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"


@kept
def grown_index(spark, sf_dir):
    """The index made in three additions, without toxic messages."""
    m = unstored(spark, sf_dir)
    index = SG.create(spark, scratch(spark, "index"), WHOLE, False, buckets_for(spark, sf_dir))
    for part in range(3):
        index = index.add(m.filter(F.pmod("doc_id", F.lit(3)) == part))
    toxic = views.load(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id")
    return index.drop(m.join(toxic, "doc_id", "left_semi"))


@query(ranked_sql([word_count("the"), word_count("and")], "n0 > 0 AND n1 > 0", limit=50).replace(
    "FROM msgs)", f"FROM msgs WHERE {HARMLESS})"))
def index_segments(spark, sf_dir):
    """Three segments with tombstones are searched like one index."""
    m = unstored(spark, sf_dir).drop("body")
    return found(Q.search_fulltext(m, "the and", limit=50, index=grown_index(spark, sf_dir)))


@query(with_msgs(f"SELECT archive_file, mbox_offset, {DL} AS dl FROM toks WHERE {HARMLESS}", TOKS_SQL))
def index_merged(spark, sf_dir):
    """The messages of the segments merged into one."""
    merged = grown_index(spark, sf_dir)
    if len(merged.segments) > 1:
        merged = SG.open_index(spark, merged.path).merge(everything=True)
    return merged.docs().select("archive_file", "mbox_offset", "dl")


STEMMED_PARTS = [f"u AS MATERIALIZED ({UNNEST})", stems_sql("u"), """hits AS (
  SELECT archive_file AS f, mbox_offset AS o, count(*) FILTER (WHERE stem = 'the') AS k0,
    count(*) FILTER (WHERE stem = 'and') AS k1 FROM u JOIN stems USING (term) GROUP BY 1, 2)"""]
STEMMED_COUNTS = [f"coalesce((SELECT k{i} FROM hits WHERE f = archive_file AND o = mbox_offset), 0)"
                  for i in (0, 1)]
STEMMED_SQL = ranked_sql(STEMMED_COUNTS, "n0 > 0 AND n1 > 0", limit=20, parts=STEMMED_PARTS)


@query(STEMMED_SQL)
def search_fulltext_stemmed(spark, sf_dir):
    return found(Q.search_fulltext(msgs(spark, sf_dir), "thes ands", limit=20))


@query(STEMMED_SQL)
def index_fulltext_stemmed(spark, sf_dir):
    m = unstored(spark, sf_dir).drop("body")
    return found(Q.search(m, "thes ands", limit=20, index=index(spark, sf_dir, True)))


@query(with_msgs("""SELECT stem AS term, count(DISTINCT (archive_file, mbox_offset)) AS df,
    count(*) AS occurrences FROM u JOIN stems USING (term) GROUP BY 1""", TOKS_SQL,
                 f"u AS MATERIALIZED ({UNNEST})", stems_sql("u")))
def build_index_stemmed(spark, sf_dir):
    postings = I.build_index(msgs(spark, sf_dir), WHOLE, stemmed=True)
    return I.term_stats(postings)


@query(with_msgs(f"""SELECT term AS token, stem, n FROM (SELECT w AS term, count(*) AS n
    FROM (SELECT unnest({tok('body')}) AS w FROM msgs) GROUP BY 1) JOIN stems USING (term)""",
                 f"bodies AS MATERIALIZED (SELECT DISTINCT unnest({tok('body')}) AS term FROM msgs)",
                 stems_sql("bodies")))
def stem_tokens(spark, sf_dir):
    tokens = msgs(spark, sf_dir).select(X.tokenize(F.col("body")).alias("t"))
    both = tokens.select(F.explode(F.arrays_zip(
        F.col("t").alias("token"), X.stem_tokens(F.col("t")).alias("stem"))).alias("p"))
    return both.groupBy("p.token", "p.stem").agg(F.count("*").alias("n"))


# --------------------------------------------------------------------- columns

NOAGE = "TIMESTAMP '2024-03-31 10:00:00'"


@query(with_msgs("""SELECT gmail_id,
    '<' || sha256(concat(coalesce(subject, 'no-subject'), coalesce(date_raw, 'no-date')))
      || '@generated>' AS made_id,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN rfc_message_id
      ELSE '<' || sha256(subject || date_raw) || '@generated>' END AS id FROM msgs"""))
def rfc_message_id(spark, sf_dir):
    from checks import labelled

    m = msgs(spark, sf_dir).join(
        labelled(spark, sf_dir).withColumn("_has", F.lit(True)), "doc_id", "left")
    header = F.when(F.col("_has"), F.concat(F.lit("  "), F.col("rfc_message_id"), F.lit(" ")))
    return m.select(
        "gmail_id",
        C.rfc_message_id(F.lit(" "), F.col("subject"), F.col("date_raw")).alias("made_id"),
        C.rfc_message_id(header, F.col("subject"), F.col("date_raw")).alias("id"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'x' || conv_id
    ELSE '<c' || conv_id || '.0@example.com>' END AS thread_id,
  (SELECT CASE WHEN turn = 0 THEN NULL ELSE '<c' || conv_id || '.0@example.com>' END) AS by_refs
  FROM conversations""")
def thread_id(spark, sf_dir):
    turns = views.load(spark, sf_dir, "conversations")
    conv = F.col("conv_id").cast("string")
    chain = F.array_join(F.transform(
        F.sequence(F.lit(0), F.greatest(F.col("turn") - 1, F.lit(0)).cast("int")),
        lambda i: F.concat(F.lit("<c"), conv, F.lit("."), i.cast("string"),
                           F.lit("@example.com>"))), "\n ")
    header = F.when(F.col("role") == "user", F.concat(F.lit(" x"), conv))
    parents = F.when(F.col("turn") > 0, chain)
    return turns.select(
        "conv_id", "turn", C.thread_id(header, chain).alias("thread_id"),
        C.thread_id(F.lit(None).cast("string"), parents).alias("by_refs"))


@query(with_msgs(f"""SELECT gmail_id, strftime(date, {TS}) AS date,
    strftime(date, '%Y-%m-%d %H:%M') AS short_date, strftime(date, '%Y/%m/%d') AS query_date,
    strftime(date - INTERVAL 90 MINUTE, {TS}) AS zoned FROM msgs"""))
def parse_mail_date(spark, sf_dir):
    raw = F.col("date_raw")
    zoned = F.regexp_replace(raw, r"\+0000", "+0130")
    return msgs(spark, sf_dir).select(
        "gmail_id", C.parse_mail_date(raw).alias("date"), C.short_date(raw).alias("short_date"),
        C.format_query_date(C.parse_mail_date(raw)).alias("query_date"),
        C.parse_mail_date(zoned).alias("zoned"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, "
       "event_type || ',k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS labels FROM events")
def labels(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    listed = F.to_json(F.array(F.col("event_type"), F.concat(F.lit("k"), k)))
    return e.select("event_id", k.cast("long").alias("k"), C.labels(listed).alias("labels"))


@query(f"""SELECT event_id,
  strftime({NOAGE} - to_months(CAST(1 + event_id % 40 AS INTEGER)), {TS}) AS cutoff FROM events""")
def age_cutoff(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    as_of = F.lit("2024-03-31 10:00:00")
    cutoff = F.lit(None).cast("timestamp_ntz")
    for months in range(1, 41):
        cutoff = F.when(F.col("event_id") % 40 == months - 1,
                        C.age_cutoff(f"{months}m", as_of)).otherwise(cutoff)
    return e.select("event_id", cutoff.alias("cutoff"))


@query("""SELECT o_orderkey, CASE
    WHEN b < 1024 THEN printf('%.1f B', b::DOUBLE)
    WHEN b < 1024 ** 2 THEN printf('%.1f KB', b / 1024.0)
    WHEN b < 1024 ** 3 THEN printf('%.1f MB', b / 1024.0 ** 2)
    WHEN b < 1024 ** 4 THEN printf('%.1f GB', b / 1024.0 ** 3)
    WHEN b < 1024 ** 5 THEN printf('%.1f TB', b / 1024.0 ** 4)
    ELSE printf('%.1f PB', b / 1024.0 ** 5) END AS size
  FROM (SELECT o_orderkey, (o_custkey + 3) * CAST(pow(32, o_orderkey % 9) AS BIGINT) AS b
        FROM orders)""")
def format_bytes(spark, sf_dir):
    orders = views.load(spark, sf_dir, "orders")
    size = (F.col("o_custkey") + 3) * F.pow(F.lit(32), F.col("o_orderkey") % 9).cast("long")
    return orders.select("o_orderkey", C.format_bytes(size).alias("size"))


@query("""SELECT conv_id, turn, CASE WHEN length(t) > 200 THEN left(t, 200) || '...' ELSE t END
  AS preview FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t
                   FROM conversations)""")
def truncate_preview(spark, sf_dir):
    turns = views.load(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", C.truncate_preview(F.col("text")).alias("preview"))


@query(r"""SELECT page_id, nullif(CASE WHEN length(f) > 20 THEN
    CASE WHEN contains(f, '.') THEN left(regexp_extract(f, '(?s)^(.*)\.[^.]*$', 1),
        greatest(19 - length(regexp_extract(f, '\.([^.]*)$', 1)), 0)) || '.'
        || regexp_extract(f, '\.([^.]*)$', 1)
      ELSE left(f, 20) END ELSE f END, '') AS name
  FROM (SELECT page_id, trim(regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''),
          '([^/]*)$', 1), '[^\p{L}\p{N}_.-]', '_', 'g'), '. ') AS f FROM pages)""")
def safe_filename(spark, sf_dir):
    pages = views.load(spark, sf_dir, "pages")
    return pages.select("page_id", C.safe_filename(F.col("url"), 20).alias("name"))


@query(with_msgs("""SELECT gmail_id, CASE lang WHEN 'en' THEN 'gzip' WHEN 'fr' THEN 'lzma'
    WHEN 'de' THEN 'zstd' END AS codec FROM msgs"""))
def compression_of(spark, sf_dir):
    lang = F.element_at("labels", 2)
    suffix = (F.when(lang == "en", ".gz").when(lang == "fr", ".XZ").when(lang == "de", ".zst")
              .otherwise(""))
    return msgs(spark, sf_dir).select(
        "gmail_id", C.compression_of(F.concat("archive_file", suffix)).alias("codec"))


@query("""SELECT event_id, coalesce(CASE WHEN event_type = 'error' THEN NULL ELSE event_type END, '')
  AS subject, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS to_addr FROM events""")
def default_nulls(spark, sf_dir):
    e = views.load(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return C.default_nulls(e.select("event_id", kind.alias("subject"), kind.alias("to_addr")))


@query(with_msgs("""SELECT gmail_id, sha256(body) AS checksum,
    CAST(octet_length(encode(body)) AS BIGINT) AS size_bytes,
    left(body, 1000) AS body_preview FROM msgs"""))
def message_measures(spark, sf_dir):
    raw = F.encode("body", "utf-8")
    return msgs(spark, sf_dir).select(
        "gmail_id", C.checksum(raw).alias("checksum"), C.size_bytes(raw).alias("size_bytes"),
        C.body_preview(F.col("body")).alias("body_preview"))


@query(with_msgs("""SELECT gmail_id, rfc_message_id, strftime(date, '%Y-%m-%dT%H:%M:%S') AS date,
    from_addr AS "from", to_addr AS "to", subject, archive_file, mbox_offset,
    NULL::DOUBLE AS relevance_score,
    CASE WHEN length(p) > 200 THEN left(p, 200) || '...' ELSE p END AS body_preview
  FROM (SELECT *, trim(left(body, 1000), ' ' || chr(9) || chr(10) || chr(13)) AS p FROM msgs)"""))
def results_json(spark, sf_dir):
    m = msgs(spark, sf_dir).withColumn("relevance_score", F.lit(None).cast("double"))
    out = Q.results_json(m, with_preview=True)
    record = F.from_json(
        "value", "gmail_id string, rfc_message_id string, date string, `from` string, `to` string, "
                 "subject string, archive_file string, mbox_offset long, relevance_score double, "
                 "body_preview string")
    return out.select(record.alias("r")).select(
        "r.*").withColumn("date", F.left("date", F.lit(19)))
