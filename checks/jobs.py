"""The jobs of a user, end to end."""

from pyspark.sql import functions as F

from checks import TS, kept, labelled, msgs, query, with_msgs
from checks.archives import RAW_SQL, archive, at, misplaced, toxic
from checks.catalogue import COLUMNS, ROW, SIZE, dedup_sql, ranked, runs
from checks.searching import buckets_for
from mailspark.operators import index as I
from mailspark.operators import parse as P
from mailspark.operators import search as Q
from mailspark.plans import workflows as WF
from mailspark.session import scratch, written
from mailspark.sources import archives as IO
from mailspark.sources import mbox
from mailspark.sources import tables as T

TOXIC_SQL = "toxic AS (SELECT doc_id FROM labels WHERE toxic = 1)"


@query(dedup_sql("largest"))
def dedupe_job(spark, sf_dir):
    return WF.dedupe(msgs(spark, sf_dir), "largest", dry_run=False).messages.select(*COLUMNS)


@query(with_msgs(f"""SELECT {ROW}, CASE WHEN rn = 1 THEN 'keep' ELSE 'remove' END AS action FROM r""",
                 ranked("newest")))
def dedupe_plan(spark, sf_dir):
    return WF.dedupe(msgs(spark, sf_dir), "newest").reports["plan"]


@query(with_msgs(f"""SELECT archive_file, count(*) AS messages, CAST(sum({SIZE}) AS BIGINT) AS size_bytes,
    strftime(min(date), {TS}) AS oldest, strftime(max(date), {TS}) AS newest,
    (SELECT count(*) FROM (SELECT 1 FROM events LIMIT 10)) AS latest_runs
  FROM msgs GROUP BY 1"""))
def status_job(spark, sf_dir):
    reports = WF.status(msgs(spark, sf_dir), runs(spark, sf_dir)).reports
    latest = reports["runs"].agg(F.count("*")).scalar()
    return reports["archives"].withColumn("latest_runs", latest)


@kept
def stored(spark, sf_dir):
    """The archive of all messages, read: folder and parsed rows."""
    folder, _ = archive(spark, sf_dir)
    return folder, written(P.parse_messages(mbox.read_mbox(spark, folder), archived_at=at()), "parsed")


@query(with_msgs("""SELECT 'offsets read' AS what, count(*) AS n FROM msgs
  UNION ALL SELECT 'offsets wrong', count(*) FROM msgs WHERE doc_id IN (FROM toxic)
  UNION ALL SELECT 'checksums', count(*) FROM msgs WHERE doc_id IN (FROM toxic)
  UNION ALL SELECT 'issue duplicate_ids', count(*) FROM (
    SELECT 1 FROM msgs GROUP BY rfc_message_id HAVING count(*) > 1) HAVING count(*) > 0
  UNION ALL SELECT 'issue missing_index', count(*) FROM msgs
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id IN (FROM toxic) HAVING count(*) > 0
  UNION ALL SELECT 'issue orphaned_index', count(*) FROM msgs WHERE doc_id IN (FROM toxic)
    HAVING count(*) > 0""", TOXIC_SQL))
def verify_job(spark, sf_dir):
    """A catalogue whose toxic messages stand at wrong places, and an index of
    the labelled ones at their right places."""
    folder, _ = stored(spark, sf_dir)
    _, placed = archive(spark, sf_dir)
    catalogue = misplaced(spark, sf_dir)
    ids = labelled(spark, sf_dir).select(F.concat(F.lit("m"), "doc_id").alias("gmail_id"))
    indexed = placed.join(ids, "gmail_id", "left_semi").select("archive_file", "mbox_offset")
    out = WF.verify(spark, folder, catalogue, indexed, T.discover(spark, folder, "*.mbox")).reports
    accuracy = out["accuracy"].select(F.inline(F.array(
        F.struct(F.lit("offsets read").alias("what"), F.col("total_checked").alias("n")),
        F.struct(F.lit("offsets wrong").alias("what"), F.col("failed_reads").alias("n")))))
    issues = out["integrity"].select(F.concat(F.lit("issue "), "issue").alias("what"),
                                     F.col("found").alias("n"))
    sums = IO.compare_checksums(stored(spark, sf_dir)[1], catalogue).filter("status <> 'ok'").agg(
        F.lit("checksums").alias("what"), F.count("*").alias("n"))
    return accuracy.unionByName(issues).unionByName(sums)


@query(with_msgs("""SELECT (SELECT count(*) FROM msgs WHERE doc_id IN (FROM toxic)) AS spoiled,
    (SELECT count(*) FROM msgs WHERE doc_id IN (FROM toxic)) AS backfilled,
    (SELECT count(*) FROM msgs) AS messages, 0 AS still_wrong""", TOXIC_SQL))
def repair_job(spark, sf_dir):
    """Locations of toxic messages are lost and filled in from the archives."""
    folder, _ = stored(spark, sf_dir)
    _, placed = archive(spark, sf_dir)
    spoiled = placed.join(toxic(spark, sf_dir), "gmail_id", "left").withColumns({
        c: F.when(F.col("_bad"), F.lit(-1)).otherwise(F.col(c)) for c in ("mbox_offset", "mbox_length")})
    rows = spoiled.drop("_bad")
    before = rows.filter(Q.misplaced()).agg(F.count("*")).scalar()
    good = rows.filter(~Q.misplaced())
    outcome = WF.repair(spark, folder, rows, I.build_index(good), I.doc_stats(good), dry_run=False)
    filled = outcome.reports["backfilled"].agg(F.max("backfilled")).scalar()
    return outcome.messages.agg(
        F.count("*").alias("messages"), F.count_if(Q.misplaced()).alias("still_wrong")).select(
        before.alias("spoiled"), filled.alias("backfilled"), "messages", "still_wrong")


@query(with_msgs(f"""SELECT gmail_id, rfc_message_id, archive_file, mbox_offset, subject,
    strftime(date, {TS}) AS date FROM msgs"""))
def upgrade_from_1_1(spark, sf_dir):
    """A catalogue whose dates are still header texts."""
    old = msgs(spark, sf_dir).withColumn("date", F.col("date_raw")).drop(
        "date_raw", "body", "doc_id", "account_id")
    return WF.upgrade_catalogue(spark, old).messages.select(
        "gmail_id", "rfc_message_id", "archive_file", "mbox_offset", "subject", "date")


@query(with_msgs(r"""SELECT rfc_message_id, count(*) AS copies FROM stored
  WHERE len(list_filter(regexp_extract_all(lower(stored_body), '[\p{L}\p{N}]+'), lambda w: w = 'the')) > 0
  GROUP BY 1""", RAW_SQL))
def index_archives_job(spark, sf_dir):
    """A word is searched in an index made of the archives; the catalogue has
    previews only."""
    folder, parsed = stored(spark, sf_dir)
    index = WF.index_archives(spark, folder, scratch(spark, "index"), stemmed=False, buckets=buckets_for(spark, sf_dir))
    hits = Q.all_of(parsed, Q.word("the").within("body"), index=index)
    return hits.groupBy("rfc_message_id").agg(F.count("*").alias("copies"))


@query(with_msgs(f"""SELECT gmail_id, rfc_message_id, strftime(date, {TS}) AS date, from_addr AS "from",
    to_addr AS "to", subject, archive_file, mbox_offset, 1.5::DOUBLE AS relevance_score,
    CASE WHEN length(p) > 200 THEN left(p, 200) || '...' ELSE p END AS body_preview
  FROM (SELECT *, trim(left(body, 1000), ' ' || chr(9) || chr(10) || chr(13)) AS p FROM msgs)"""))
def write_results_json(spark, sf_dir):
    path = scratch(spark, "results")
    rows = msgs(spark, sf_dir).withColumn("relevance_score", F.lit(1.5))
    Q.write_results_json(rows, path, with_preview=True)
    return spark.read.schema(
        "gmail_id string, rfc_message_id string, date timestamp_ntz, `from` string, `to` string, subject string, "
        "archive_file string, mbox_offset long, relevance_score double, body_preview string").json(path)
