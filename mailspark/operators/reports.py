"""Summaries. All are partial aggregates over flagged rows."""

from pyspark.sql import functions as F

from mailspark.functions import columns as C

SEVERITIES = ("OK", "WARNING", "ERROR")


def key_violations(messages):
    """Per key column, how many values occur more than once. NULL remote ids
    count as one value."""
    def repeated(key):
        return (messages.groupBy(key).count().filter("count > 1")
                .agg(F.count("*").alias("violations"))
                .select(F.lit(key).alias("key"), "violations"))

    return repeated("gmail_id").unionByName(repeated("rfc_message_id"))


def import_summary(rows):
    """Per file: imported, skipped and failed rows of an import, and how many
    imported ones have a remote id."""
    imported = F.col("status") == "IMPORTED"
    return rows.groupBy("archive_file").agg(
        F.count_if(imported).alias("imported"),
        F.count_if(F.col("status") == "SKIPPED").alias("skipped"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.count_if(imported & F.col("gmail_id").isNotNull()).alias("gmail_ids_found"),
        F.count_if(imported & F.col("gmail_id").isNull()).alias("gmail_ids_not_found"),
    )


def import_totals(per_file):
    return per_file.agg(
        F.count("*").alias("total_files"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}") for c in
          ("imported", "skipped", "failed", "gmail_ids_found", "gmail_ids_not_found")],
    )


def consolidation_summary(flagged):
    """Totals of a merge whose rows carry ``source_archive`` and ``kept``."""
    return flagged.agg(
        F.count("*").alias("total_messages"),
        F.count_if(~F.col("kept")).alias("duplicates_removed"),
        F.count_if("kept").alias("messages_consolidated"),
        F.count_distinct("source_archive").alias("sources"),
    )


def compression_summary(files):
    """Totals over per-file results: skipped files count with their size but
    without a compressed size."""
    done = ~F.col("skipped")
    before = F.coalesce(F.sum("original_size"), F.lit(0))
    after = F.coalesce(F.sum(F.when(done, F.col("compressed_size"))), F.lit(0))
    return files.agg(
        F.count_if(done).alias("files_compressed"),
        F.count_if("skipped").alias("files_skipped"),
        F.count("*").alias("total_files"),
        before.alias("original_size"),
        after.alias("compressed_size"),
        (before - after).alias("space_saved"),
        F.coalesce(F.try_divide(before, after), F.lit(0.0)).alias("compression_ratio"),
    )


def archive_stats(messages):
    """Messages and archives in the catalogue: one row."""
    per_archive = messages.groupBy("archive_file").agg(F.count("*").alias("n"))
    return per_archive.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_messages"),
        F.count("archive_file").alias("archive_count"),
    )


def archive_list(messages):
    """Each archive with its messages, bytes and the dates they span."""
    return messages.groupBy("archive_file").agg(
        F.count("*").alias("messages"), F.sum(C.effective_size()).alias("size_bytes"),
        F.min("date").alias("oldest"), F.max("date").alias("newest"))


def count_messages(archived, expected):
    """Per archive: messages found and expected. ``expected`` is
    (archive_file, expected)."""
    actual = archived.groupBy("archive_file").agg(F.count("*").alias("actual"))
    both = actual.join(expected, "archive_file", "full_outer")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("actual", "expected")})
    return both.withColumns({
        "count_matches": F.col("actual") == F.col("expected"),
        "not_empty": F.col("actual") > 0,
    })


def offset_accuracy(checked):
    """Totals over checked rows with a ``status``: one row."""
    good = F.count_if(F.col("status") == "ok")
    return checked.agg(
        F.count("*").alias("total_checked"),
        good.alias("successful_reads"),
        (F.count("*") - good).alias("failed_reads"),
        F.round(F.coalesce(F.try_divide(100.0 * good, F.count("*")), F.lit(0.0)), 6)
        .alias("accuracy_percentage"),
    )


def health_rollup(checks):
    """Counts per severity, the worst one, and the fixable checks by name. The
    number of checks is fixed by the report that makes them."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    fixable = F.when(F.col("fixable") & (F.col("severity") != "OK"), F.col("name"))
    return checks.agg(
        F.count_if(F.col("severity") == "OK").alias("checks_passed"),
        F.count_if(F.col("severity") == "WARNING").alias("warnings"),
        F.count_if(F.col("severity") == "ERROR").alias("errors"),
        F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]),
                     F.coalesce(F.max(rank), F.lit(1)).cast("int")).alias("overall_status"),
        F.concat_ws(",", F.sort_array(F.collect_set(fixable))).alias("fixable_issues"),
    )
