"""Shards that each hold the mixture of the sources.

Proportional stratified interleaving: the rows of a source are shuffled by a
seed and ranked, the fractional rank (rank + 1/2) / rows of the source orders
all rows, and that order is cut into shards of equal row counts. Each stretch
of the order holds every source in proportion, so each shard does.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.llm.common import PIECES, group_key, ranked, shuffled, table

SHARDS = 40
SEED = 20


def interleave(df, shards=SHARDS, source="source", key="doc_id", seed=SEED):
    """The rows with ``shard`` (0 to shards - 1; row counts differ by one at
    most) and ``slot`` (position in the shard, from 0 without gaps).

    Nulls: rows of no source form a stratum; a null key is a key like any
    other. Rows alike in key are ordered by a hash of their other columns;
    rows alike in all are interchangeable. Input columns called shard or slot
    are replaced. An empty table gives an empty table; shards beyond the
    number of rows stay empty.

    Only the ordering columns are read to count; each row moves three times
    at most (rank in source, place in order, write). No source, however
    large, meets in one task.
    """
    keep = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    work = df.select(*[F.col(f"`{c}`") for c in keep]).withColumns(
        {"__group": group_key(F.col(f"`{source}`")), "__order": shuffled(F.col(f"`{key}`"), seed)})
    rows, pieces = ranked(work, "__group", "__order", "__rank", "__size")
    # The ranks of a source are 0 to size - 1, so the rows in each bin of the
    # fractional rank are counted from the pieces alone.
    place = F.expr(f"cast(((2 * __rank + 1) * {PIECES}) div (2 * __size) as int)")
    bins = (
        pieces.select("__size", F.explode(F.expr(
            "sequence(__before, __before + __n - 1)")).alias("__rank"))
        .groupBy(place.alias("__bin")).agg(F.count(F.lit(1)).alias("__n"))
    )
    so_far = W.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
    bins = bins.select(
        "__bin", F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__first"),
        F.sum("__n").over(W.partitionBy()).alias("__all"))
    fraction = (2 * F.col("__rank") + 1) / (2.0 * F.col("__size"))
    order = W.partitionBy("__bin").orderBy(fraction, "__group")
    placed = (
        rows.withColumn("__bin", place).join(bins, "__bin")
        .withColumn("__at", F.row_number().over(order) - 1 + F.col("__first"))
        .withColumn("shard", F.expr(f"cast((__at * {shards}) div __all as int)"))
        .withColumn("slot", F.expr(f"__at - (shard * __all + {shards - 1}) div {shards}"))
    )
    return placed.select(*[F.col(f"`{c}`") for c in keep], "shard", F.col("slot").cast("long"))


def write_shards(interleaved, path, shards=SHARDS):
    """Whole rows as one folder per shard, sorted by slot within each file."""
    (interleaved.repartition(shards, "shard").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def op2_stratified_interleave(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    return interleave(slim).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


OP2_SQL = f"""
WITH RECURSIVE steps AS (
  SELECT i, 0 AS k, i AS c FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END
  FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY source ORDER BY md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null'))) - 1 AS r,
    count(*) OVER (PARTITION BY source) AS n
  FROM documents),
o AS (
  SELECT *, count(*) OVER () AS total,
    row_number() OVER (ORDER BY (2 * r + 1) / (2.0::DOUBLE * n), coalesce('=' || source, 'null')) - 1 AS place
  FROM d),
s AS (SELECT *, (place * {SHARDS}) // total AS shard FROM o),
bytes AS (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'),
    lambda h: ('0x' || h)::BIGINT) AS b FROM d)
SELECT s.doc_id, strlen(text) + 16 AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32,
  'rows' AS law, shard::INTEGER AS shard,
  place - (shard * total + {SHARDS - 1}) // {SHARDS} AS slot, NULL::INTEGER AS grown_shard
FROM s JOIN bytes USING (doc_id), crc
"""
