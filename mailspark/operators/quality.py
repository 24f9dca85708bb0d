"""Checks of catalogue, archives and text index against each other."""

from pyspark.sql import functions as F

from mailspark import schema
from mailspark.operators import index as I
from mailspark.operators import reconcile as RC
from mailspark.operators import reports as A
from mailspark.operators import search as Q


def _found(rows, label, **tests):
    """Counts of several tests in one pass, one row per test."""
    counts = rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias(label), F.col(name).alias("found")) for name in tests])))


def _status(name):
    return F.col("status") == name


def _union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_archives(messages, present):
    """Archives the catalogue names that a listing (path) lacks."""
    files = present.select(F.col("path").alias("archive_file")).distinct()
    return messages.select("archive_file").distinct().join(files, "archive_file", "left_anti")


def verify_consistency(messages, archived, indexed, by=("archive_file", "rfc_message_id")):
    """One row per check with what was found; passed means nothing was."""
    ids = _found(
        RC.differing_ids(archived, messages, by), "check",
        orphaned_records=_status("orphaned"), missing_records=_status("missing"))
    keys = A.key_violations(messages).select(
        F.concat(F.lit("duplicate_"), "key").alias("check"), F.col("violations").alias("found"))
    index = _found(
        I.compare_index(messages, indexed), "check",
        index_orphaned=_status("orphaned"), index_missing=_status("missing"))
    return _union([ids, keys, index]).withColumn("passed", F.col("found") == 0)


def _issue_counts(messages, indexed, present):
    parts = [
        _found(I.compare_index(messages, indexed), "issue",
               orphaned_index=_status("orphaned"), missing_index=_status("missing")),
        _found(messages, "issue", invalid_offsets=Q.misplaced()),
        _found(messages.groupBy("rfc_message_id").count(), "issue",
               duplicate_ids=F.col("count") > 1),
    ]
    if present is not None:
        parts.append(_found(missing_archives(messages, present), "issue",
                            missing_archives=F.lit(True)))
    return _union(parts)


def check_integrity(messages, indexed, present=None):
    """Issues found and how often. Without a listing of the files at hand,
    missing archives are not looked for."""
    return _issue_counts(messages, indexed, present).filter("found > 0")


def health_report(messages, indexed, present, declared_version=None):
    """Catalogue checks as rows: id, name, severity, found, fixable, message."""
    spark = messages.sparkSession
    version = schema.schema_version(messages, declared_version)
    current = version == schema.CURRENT_VERSION
    schema_row = spark.range(1).select(
        F.lit("schema").alias("id"), F.lit("Database schema").alias("name"),
        F.lit("OK" if current else "WARNING").alias("severity"), F.lit(0).cast("long")
        .alias("found"), F.lit(version in ("1.0", "1.1", "1.2")).alias("fixable"),
        F.lit(f"catalogue version {version}").alias("message"))

    def check(id_, name, rows, fixable, wrong):
        found = rows.agg(F.count("*").alias("found"))
        bad = F.col("found") > 0
        return found.select(
            F.lit(id_).alias("id"), F.lit(name).alias("name"),
            F.when(bad, "WARNING").otherwise("OK").alias("severity"), "found",
            (bad & F.lit(fixable)).alias("fixable"),
            F.when(bad, F.concat(F.col("found").cast("string"), F.lit(f" {wrong}")))
            .otherwise("nothing found").alias("message"))

    keys = indexed.select(*schema.LOCATION).distinct()
    orphans = keys.join(messages.select(*schema.LOCATION), list(schema.LOCATION), "left_anti")
    unplaced = messages.filter(F.col("mbox_offset").isNull() | (F.col("mbox_offset") < 0))
    return _union([
        schema_row,
        check("index", "Text index", orphans, True, "orphaned index records"),
        check("archive_files", "Archive files", missing_archives(messages, present), False,
              "archive files missing"),
        check("offsets", "Mbox offsets", unplaced, True, "invalid offsets"),
    ])


def repair_counts(messages, indexed):
    """What an index repair would remove and add: one row."""
    differing = I.compare_index(messages, indexed)
    return differing.agg(
        F.count_if(F.col("status") == "orphaned").alias("orphaned_removed"),
        F.count_if(F.col("status") == "missing").alias("missing_added"))


#: Repairs by check id.
FIXES = {"index": "repair_index", "offsets": "backfill_offsets", "schema": "upgrade_catalogue"}


def planned_fixes(report):
    """The repair that each failed fixable check asks for."""
    fix = F.create_map(*[F.lit(x) for pair in FIXES.items() for x in pair])
    return report.filter(F.col("fixable") & (F.col("severity") != "OK")).select(
        "id", fix[F.col("id")].alias("fix"), "found")
