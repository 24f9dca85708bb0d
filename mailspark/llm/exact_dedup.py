"""Exact duplicates against a persistent index of text digests.

The index is a table bucketed and sorted by digest. A batch of new documents
is reduced to one row per digest, the digests that the index does not hold yet
are found by a sort-merge anti-join, which reads the buckets as they lie, and
are appended. Texts are equal when they are identical after A-Z are
lower-cased; null counts as empty.
"""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mailspark.llm.common import table, whole_text
from mailspark.session import scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A text is hot when over one row in this many has it; so there are at most
#: this many hot texts, and their rows are joined without a shuffle.
HOT_SHARE = 1000


def normalised(text):
    """A-Z lower-cased. ASCII texts take the fast byte-wise path."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Layout of an index; one of another version is refused.
LAYOUT = 2


def digests(docs):
    """(doc_id, digest) of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.unhex(F.sha2(normalised(whole_text(docs)), 256)).alias("digest"))


class DigestIndex:
    """Index of the texts seen so far, as a table under ``path``. Its layout is
    stored beside it, under ``path`` + ``-layout``."""

    def __init__(self, spark, path, buckets=None):
        """Opens the index, or makes an empty one. ``buckets`` (default: the
        shuffle partitions) is fixed when the index is made; the stored count
        is used from then on, whatever the session's settings, and naming
        another one is an error. So is a table without a stored layout: its
        count is not known, and by a wrong one most entries would be missed."""
        self.spark, self.path = spark, path.rstrip("/")
        stored = self._stored()
        if stored is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        elif stored.layout != LAYOUT or buckets not in (None, stored.buckets):
            raise ValueError(f"{path} has layout {stored.layout} with {stored.buckets} buckets")
        else:
            self.buckets = stored.buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING, rows BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{path}'")
        if stored is None:
            if not self.entries().isEmpty():
                raise ValueError(f"{path} is no index, or one whose layout is lost")
            spark.createDataFrame([(LAYOUT, self.buckets)], "layout int, buckets int").coalesce(1).write.parquet(
                f"{self.path}-layout")

    def _stored(self):
        try:
            return self.spark.read.parquet(f"{self.path}-layout").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def entries(self):
        return self.spark.table(self.name)

    def ingest(self, docs, batch):
        """Deduplicates a batch and appends its new texts.

        Returns a row per document: doc_id, keep_id, group_size (rows of the
        batch with that text, and of the batch that brought it, if known),
        kept, known (the index had the text before) and digest. The largest
        doc_id of a new text stays; of a known text, the document of the
        earlier batch. Rows that repeat the kept doc_id are that document and
        are all marked; ``survivors`` gives one of them. A group of null ids
        only has keep_id null and is marked whole.
        """
        return self.ingest_digests(written(digests(docs), "digests"), batch)

    def ingest_digests(self, slim, batch):
        """``ingest`` of rows (doc_id, digest) that are written down."""
        # Written, since the optimizer would move the anti-join below the
        # aggregate, and shuffle all rows of a hot text to one task.
        groups = written(slim.groupBy("digest").agg(
            F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        fresh = groups.hint("merge").join(self.entries().select("digest"), "digest", "left_anti")
        (fresh.select("digest", F.col("last_id").alias("keep_id"), F.lit(batch).alias("batch"),
                      F.col("group_size").alias("rows"))
         .repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)
        known = F.col("batch") != batch
        settled = (
            groups.hint("merge").join(self.entries(), "digest")
            .select("digest", "keep_id", known.alias("known"),
                    (F.col("group_size") + F.when(known, F.col("rows")).otherwise(0)).alias("group_size"))
        )
        rows = slim.count()
        hot = written(settled.filter(F.col("group_size") * HOT_SHARE > rows), "hot-digests")
        hot_rows = slim.join(F.broadcast(hot), "digest")
        others = slim.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
        return (
            hot_rows.unionByName(others.join(settled, "digest"))
            .withColumn("kept", ~F.col("known") & F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select("doc_id", "keep_id", "group_size", "kept", "known", "digest")
        )

    def compact(self, path):
        """The index in one file per bucket at a new place."""
        fresh = DigestIndex(self.spark, path, self.buckets)
        (self.entries().repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.insertInto(fresh.name))
        self.spark.catalog.refreshTable(fresh.name)
        return fresh


def new_index(spark):
    return DigestIndex(spark, scratch(spark, "digest-index"))


def survivors(docs, index=None, batch="documents"):
    """One whole row of each text that the index did not hold; all columns.

    Rows of a null doc_id are matched by digest like all others. The texts
    move once; the slim side of the join is hashed, so texts aren't sorted.
    """
    index = index or new_index(docs.sparkSession)
    names = docs.columns
    rows = docs.withColumns({
        "__id": F.col("doc_id").cast("long"),
        "__digest": F.unhex(F.sha2(normalised(whole_text(docs)), 256))})
    marks = (
        index.ingest(docs, batch).filter("kept").groupBy("doc_id", "digest")
        .agg(F.count(F.lit(1)).alias("__copies"))
        .select(F.col("doc_id").alias("__keep"), F.col("digest").alias("__mark"), "__copies")
    )
    kept = rows.join(
        marks.hint("shuffle_hash"),
        (F.col("__digest") == F.col("__mark")) & F.col("__id").eqNullSafe(F.col("__keep")))
    single = kept.filter("__copies = 1")
    # Rows of one id and text: the first by their other columns stays.
    others = [F.col(f"`{c}`") for c in names if c != "text"]
    repeated = (
        kept.filter("__copies > 1")
        .groupBy("__id", "__digest")
        .agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.xxhash64(*others)).alias("row"))
        .select("row.*")
    )
    return single.select(*[F.col(f"`{c}`") for c in names]).unionByName(repeated)


def op9_digest_index(spark, sf_dir):
    """The table comes in two batches, the upper half of the ids first, so the
    document of the earlier batch is that of the largest id."""
    slim = written(digests(table(spark, sf_dir, "documents")), "digests")
    middle = slim.agg(F.avg("doc_id")).first()[0]
    later = F.coalesce(F.col("doc_id") > F.lit(middle), F.lit(False))
    index = new_index(spark)
    first = index.ingest_digests(slim.filter(later), "later ids")
    second = written(index.ingest_digests(slim.filter(~later), "earlier ids"), "second-batch")
    # Texts of both batches: what the second one counted holds for the first.
    both = second.filter("known").groupBy("digest").agg(F.max("group_size").alias("total"))
    first = first.join(both, "digest", "left").withColumn("group_size", F.coalesce("total", "group_size"))
    return first.drop("total").unionByName(second).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
