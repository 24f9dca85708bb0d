"""Prefix trie of conversations by ROLLUP over columns of turn ids.

A conversation becomes a path of turn ids: a digest of role and text, and the
bytes of the text. Paths are cut into blocks of eight positional columns, each
block keyed by the trie node that the block before ends in; that key is a
digest chained along the path, so all blocks of all conversations, however
long, go through one ``ROLLUP (prior, t1, ..., t8)``, and grouping_id tells
the depth of each prefix in its block.

Sums over subtrees need no rounds either. Different paths are ranked in
lexicographic order, in which the members of a node are a range from ``lo`` to
``hi``. The nodes of one ``lo`` are a chain down one path; a node's subtree is
the rest of its chain and all chains that begin inside its range, which is a
difference of two prefix sums.
"""

import hashlib

import pandas as pd
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.llm.common import table
from mailspark.session import written

#: Turn-id columns of one ROLLUP.
BLOCK = 8

#: Ids of one piece of a node's member list: ids are cut into runs of so many.
RUN = 4096

#: Bytes of a turn's digest; its text's length follows in four more.
DIGEST = 16

ROOT = b"\0" * DIGEST
NOTHING = hashlib.sha256(b"").hexdigest()


def _cut(digest_hex):
    return F.unhex(F.substring(digest_hex, 1, 2 * DIGEST))


def turn_ids(df):
    """(conv_id, turn, role, id) of each turn: the id holds the first 16 bytes
    of a SHA-256 of role and text and, in four bytes, the length of the text
    in UTF-8. Null role and text are empty; rows without conv_id are in no
    conversation and left out."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.concat(_cut(F.sha2(whole, 256)), F.unhex(F.lpad(F.hex(F.octet_length(text)), 8, "0"))).alias("id"))


def _gathered(turns, family):
    """(family, conv_id, path): ids of each conversation by turn, null first;
    turns of one number in the order of role, then of id. A row holds one
    conversation, 20 bytes a turn."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "id")))
    return (turns.withColumn("family", family).repartition("family").groupBy("family", "conv_id")
            .agg(F.transform(rows, lambda x: x["id"]).alias("path")))


def paths(turns):
    """(conv_id, path) of each conversation."""
    return _gathered(turns, F.col("conv_id")).select("conv_id", "path")


def rebuilt_paths(turns):
    """(conv_id, path) of each conversation c rebuilt: the first h turns of
    conversation c - c % 5 (``%`` as in SQL), then its own turns after its
    first h, with h = crc32(decimal c) % 9. Up to nine conversations share a
    source and meet in one partition, so all is settled by one shuffle."""
    none = F.array().cast("array<binary>")
    own, source = F.col("path"), F.coalesce(F.col("source"), none)
    keep = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    grafted = F.concat(F.slice(source, F.lit(1), keep),
                       F.slice(own, keep + 1, F.greatest(F.size(own) - keep, F.lit(0))))
    with_source = _gathered(turns, F.col("conv_id") - F.col("conv_id") % 5).withColumn(
        "source", F.max(F.when(F.col("conv_id") == F.col("family"), own)).over(W.partitionBy("family")))
    return with_source.select(
        "conv_id", F.when(F.col("conv_id") == F.col("family"), own).otherwise(grafted).alias("path"))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _marks(column: pd.Series) -> pd.Series:
    """Nodes at the block ends of a path: the root, then a digest of the mark
    before and the ids of the block. The last one is the node of the path."""
    def chain(path):
        marks = [ROOT]
        for at in range(0, len(path), BLOCK):
            marks.append(hashlib.sha256(marks[-1] + b"".join(path[at:at + BLOCK])).digest()[:DIGEST])
        return marks

    return column.map(chain)


def _ranked(convs):
    """(rank, end, path, marks, conv_id, n) of each different path. Ranks grow
    in the order of the paths; they have gaps. Copies of a conversation are
    one row from here on, pre-aggregated in the map tasks."""
    different = convs.groupBy("end").agg(
        F.first("path").alias("path"), F.first("marks").alias("marks"),
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"))
    return written(
        different.repartitionByRange("path").sortWithinPartitions("path")
        .withColumn("rank", F.monotonically_increasing_id()), "trie-paths")


def _nodes(ranked):
    """(node, parent, depth, bytes, conv_id, n_convs, longest, lo, hi) of each
    prefix, by one ROLLUP over the blocks of all paths."""
    columns = [f"t{k}" for k in range(1, BLOCK + 1)]
    length = F.size("path")
    blocks = ranked.select(
        "rank", "path", "marks", "conv_id", "n", length.alias("length"),
        F.explode(F.sequence(F.lit(0), F.greatest(F.floor((length - 1) / BLOCK).cast("int"), F.lit(0)))).alias("block"),
    ).select(
        "rank", "conv_id", "n", "length", "block", F.get("marks", F.col("block")).alias("prior"),
        *[F.get("path", F.col("block") * BLOCK + k).alias(c) for k, c in enumerate(columns)])
    # Level: turn columns that a group has; its grouping_id has a bit per
    # column that it lacks.
    level = sum((F.when(F.col("gid") < (1 << (BLOCK - k)), 1).otherwise(0) for k in range(1, BLOCK + 1)), F.lit(0))
    last = F.element_at(F.array(*columns), F.greatest(F.col("level"), F.lit(1)))
    prefixes = (
        blocks.rollup("prior", *columns).agg(
            F.grouping_id().alias("gid"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"),
            F.max("length").alias("longest"), F.max("block").alias("block"),
            F.min("rank").alias("lo"), F.max("rank").alias("hi"))
        # Neither the total, nor prefixes longer than their conversation, nor
        # the prior node of a block anew. All on the grouping columns, so it
        # is done before the aggregation.
        .filter(F.col("gid") < (1 << BLOCK)).withColumn("level", level)
        .filter(F.when(F.col("level") > 0, last.isNotNull()).otherwise(F.col("prior") == F.lit(ROOT)))
    )

    def node(upto):
        ids = [F.when(F.lit(k) <= upto, F.col(c)).otherwise(F.lit(b"")) for k, c in enumerate(columns, 1)]
        return F.when(upto > 0, _cut(F.sha2(F.concat("prior", *ids), 256))).otherwise(F.col("prior"))

    size = F.conv(F.hex(F.substring(last, DIGEST + 1, 4)), 16, 10).cast("long")
    return prefixes.select(
        node(F.col("level")).alias("node"),
        F.when(F.col("level") > 0, node(F.col("level") - 1)).alias("parent"),
        (F.col("block") * BLOCK + F.col("level")).cast("long").alias("depth"),
        F.when(F.col("level") > 0, size).otherwise(F.lit(0)).alias("bytes"),
        "conv_id", "n_convs", "longest", "lo", "hi")


def _hash_runs(batches):
    """Task code: pieces of member lists, sorted by rank and run, to one hash
    per rank. A rank's list is hashed as it streams by."""
    rank, running = None, None
    for batch in batches:
        done = []
        for r, ids in zip(batch["rank"].tolist(), batch["ids"]):
            if r != rank:
                if running is not None:
                    done.append((rank, running.hexdigest()))
                rank, running = r, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        yield pd.DataFrame(done, columns=["rank", "ends"])
    if running is not None:
        yield pd.DataFrame([(rank, running.hexdigest())], columns=["rank", "ends"])


def _ends(convs, ranked):
    """(rank, ends): SHA-256 of the conv_ids of each path, ascending. Paths of
    one conversation need no list. The others' ids are joined in runs by many
    tasks, then the runs are hashed in their order."""
    one = ranked.filter("n = 1").select("rank", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends"))
    shared = ranked.filter("n > 1").select("rank", F.col("end").alias("_end"))
    members = convs.select("end", "conv_id").join(
        shared.hint("shuffle_hash"), F.col("end") == F.col("_end")).select("rank", "conv_id")
    runs = members.groupBy("rank", F.floor(F.col("conv_id") / RUN).alias("run")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    many = (runs.repartition("rank").sortWithinPartitions("rank", "run").select("rank", "ids")
            .mapInPandas(_hash_runs, "rank long, ends string"))
    return one.unionByName(many)


def _prefix_sums(totals):
    """(lo, leaves_to, saved_to): sums of the chains up to and with each lo.
    Ranks carry the partition they were made in; windows run inside it, and a
    row per partition carries the sums across."""
    part = F.shiftright("lo", 33)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    rows = totals.withColumn("part", part)
    parts = rows.groupBy("part").agg(F.sum("leaves").alias("a"), F.sum("saved").alias("b")).select(
        "part", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a"),
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    inside = W.partitionBy("part").orderBy("lo").rowsBetween(W.unboundedPreceding, 0)
    return rows.join(parts, "part").select(
        "lo", (F.sum("leaves").over(inside) + F.col("a")).alias("leaves_to"),
        (F.sum("saved").over(inside) + F.col("b")).alias("saved_to"))


def prefix_trie(convs):
    """The trie of conversations given as (conv_id, path), one row each.

    A row per node, all long but the last: conv_id (smallest member), depth,
    parent_conv_id (of the root: null), n_convs (members), n_children,
    n_leaves (childless nodes of the subtree, the node included),
    saved_tokens (over the subtree, (n_convs - 1) times the bytes of the last
    text) and ends_sha256 (hex, of the ids that end here, ascending and
    comma-joined). Without conversations there is no node; one without turns
    is a member of the root alone.

    What may be hot: copies of a conversation are one row with a count; a node
    with many children or members is pre-aggregated, or its rows are on the
    streamed side of a join, which adaptive execution splits.
    """
    convs = written(convs.select("conv_id", "path", _marks("path").alias("marks")).withColumn(
        "end", F.element_at("marks", -1)), "conversations")
    ranked = _ranked(convs)
    # Chains from their ends upwards: the next row is the parent, if it is of
    # this chain; sums run over what lies below.
    up = W.partitionBy("lo").orderBy(F.desc("depth"))
    below = up.rowsBetween(W.unboundedPreceding, 0)
    chains = (
        _nodes(ranked)
        .withColumns({
            "leaves": F.sum((F.col("longest") == F.col("depth")).cast("long")).over(below),
            "saved": F.sum((F.col("n_convs") - 1) * F.col("bytes")).over(below),
            "parent_conv_id": F.lead("conv_id").over(up),
            "top": F.lead("conv_id").over(up).isNull(),
            "children": F.when(F.lag("conv_id").over(up).isNull(), 0).otherwise(1).cast("long"),
        })
        .join(_ends(convs, ranked).withColumnRenamed("rank", "lo").hint("shuffle_hash"), "lo", "left")
        .withColumn("ends_sha256", F.when(F.col("children") == 0, F.col("ends")).otherwise(F.lit(NOTHING)))
        .drop("longest", "bytes", "ends")
    )
    chains = written(chains, "trie-chains")
    tops = chains.filter("top AND parent IS NOT NULL")
    # Nodes of several paths: chains that begin below them are added.
    sums = written(_prefix_sums(chains.filter("top").select("lo", "leaves", "saved")), "trie-sums")
    counts = tops.groupBy("parent").agg(F.count(F.lit(1)).alias("more"))
    to_lo = sums.withColumnsRenamed({"leaves_to": "leaves_lo", "saved_to": "saved_lo"})
    to_hi = sums.withColumnsRenamed({"lo": "hi", "leaves_to": "leaves_hi", "saved_to": "saved_hi"})
    shared = (
        chains.filter("hi > lo").join(to_lo, "lo").join(to_hi, "hi")
        .join(counts.withColumnRenamed("parent", "node"), "node", "left")
        .withColumns({
            "leaves": F.col("leaves") + F.col("leaves_hi") - F.col("leaves_lo"),
            "saved": F.col("saved") + F.col("saved_hi") - F.col("saved_lo"),
            "children": F.col("children") + F.coalesce("more", F.lit(0)),
        })
    )
    shared = written(shared.select(*chains.columns), "trie-shared")
    nodes = chains.filter("hi = lo").unionByName(shared)
    # The parent of a chain's top has several paths.
    above = shared.select(F.col("node").alias("_of"), F.col("conv_id").alias("_conv"))
    lifted = (nodes.filter("top AND parent IS NOT NULL")
              .join(above.hint("shuffle_hash"), F.col("parent") == F.col("_of"))
              .withColumn("parent_conv_id", F.col("_conv")).drop("_of", "_conv"))
    return nodes.filter("NOT top OR parent IS NULL").unionByName(lifted).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "ends_sha256")


def op12_rollup_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt_paths(turn_ids(table(spark, sf_dir, "conversations"))))
