"""Near-duplicates by SimHash fingerprints, found with BK-trees.

A BK-tree keeps each child under the integer Hamming distance to its parent; a
search follows only the edges whose distance lies within the radius of the
query's. One tree over all fingerprints would visit most of its nodes per
query, so the trees are sharded by pigeonhole: the 64 bits are cut into
blocks, two fingerprints at most 3 bits apart agree on all but 3 of them, so
each pair of them shares a shard keyed by the remaining blocks. A shard's tree
is shipped by the shuffle to the task that queries it; a broadcast of all
trees would grow with the data.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from mailspark.llm.common import table
from mailspark.llm.components import components
from mailspark.session import written

RADIUS = 3
SHINGLE = 3
SEED = 42

#: Fingerprints in one tree at most. Larger shards are keyed by more bits.
TREE = 4096

#: Times a shard is keyed anew before its trees are paired off instead.
DEPTH = 3

_BITS = 64
_ALL = (1 << _BITS) - 1


def fingerprint(text):
    """SimHash of a whole text: a bit is 1 if set in over half of the XXH64
    values of its three-word shingles (A-Z lower-cased); 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(s, SEED) for s in shingles), np.uint64)
    ones = np.zeros(_BITS, np.int64)
    for at in range(0, len(values), 8192):
        part = values[at:at + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(values), bitorder="little")
    return int(bits.view("<u8")[0])


def _simhash(text):
    """Column of the fingerprint of a text column, as a signed bigint."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        values = [fingerprint(t) for t in texts.fillna("")]
        return pd.Series(np.array(values, np.uint64).view(np.int64))

    return simhash(text)


def fingerprints(df, id_column="doc_id", text="text"):
    """(doc_id, fp): the fingerprint of each whole text as a signed bigint.
    Null and empty texts have 0. Other columns are left out."""
    return df.select(F.col(f"`{id_column}`").alias("doc_id"), _simhash(F.col(f"`{text}`")).alias("fp"))


def _signed(mask):
    return mask - (1 << _BITS) if mask >> (_BITS - 1) else mask


def _blocks(bits, count):
    """The given bit numbers cut into runs of near equal length, as masks."""
    edges = [len(bits) * i // count for i in range(count + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(edges, edges[1:])]


def first_masks(n, radius=RADIUS):
    """Masks of the key bits: every choice of all but ``radius`` blocks. More
    fingerprints are cut into more blocks, so that a shard of evenly spread
    ones stays small; any number of blocks finds every pair."""
    count = radius + 1
    while n > 256 << (_BITS * (count - radius) // count) and count < 2 * radius + 2:
        count += 1
    blocks = _blocks(range(_BITS), count)
    return [sum(c) for c in combinations(blocks, count - radius)]


def finer_masks(mask, radius=RADIUS):
    """Masks that add one of radius + 1 blocks of the bits still free."""
    free = [b for b in range(_BITS) if not mask >> b & 1]
    return [mask | b for b in _blocks(free, radius + 1)]


class BkTree:
    """Values by Hamming distance, children keyed by the distance to their
    parent."""

    def __init__(self):
        self.root = None

    def add(self, value, mark):
        if self.root is None:
            self.root = (value, mark, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ value).bit_count()
            if d not in node[2]:
                node[2][d] = (value, mark, {})
                return
            node = node[2][d]

    def near(self, value, radius):
        """Marks of all values within the radius."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            v, mark, children = todo.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                found.append(mark)
            if children:
                todo.extend([c for e, c in children.items() if d - radius <= e <= d + radius])
        return found


def _forest(values, own, radius):
    """Links between values that join all within the radius, one per value at
    most. Values of ``own`` go into the tree, the others only query it."""
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    tree, links = BkTree(), []
    for i in sorted(range(len(values)), key=lambda i: not own[i]):
        for j in tree.near(values[i], radius):
            a, b = top(i), top(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if own[i]:
            tree.add(values[i], i)
    for i in range(len(values)):
        if top(i) != i:
            links.append((values[i], values[top(i)]))
    return links


def _shard_links(radius):
    """Task code: rows sorted by shard to the links inside each shard. One
    shard is held at a time."""

    def run(batches):
        shard, values, own = None, [], []

        def links():
            if len(values) < 2:
                return pd.DataFrame({"u": [], "v": []}, dtype="int64")
            found = _forest(values, own, radius)
            out = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pd.DataFrame({"u": out[:, 0], "v": out[:, 1]})

        for batch in batches:
            done = []
            rows = zip(batch["mask"].tolist(), batch["key"].tolist(), batch["pair"].tolist(),
                       batch["fp"].tolist(), batch["own"].tolist())
            for mask, key, pair, fp, is_own in rows:
                if (mask, key, pair) != shard:
                    if len(values) > 1:
                        done.append(links())
                    shard, values, own = (mask, key, pair), [], []
                values.append(fp & _ALL)
                own.append(is_own)
            if done:
                yield pd.concat(done)
        yield links()

    return run


def _keyed(rows, masks):
    """The rows once per mask, with the masked bits as key."""
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return rows.withColumn("mask", each).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def links(fps, radius=RADIUS, tree=TREE, depth=DEPTH):
    """Links (u, v) between the distinct fingerprints of ``fps`` (fp) that
    join all pairs within the radius: not each pair, but a spanning forest per
    shard, so rows grow with the fingerprints.

    A shard of more than ``tree`` fingerprints is keyed anew by more of its
    bits, up to ``depth`` times; what is still larger is cut into trees, and
    each pair of trees is a shard of its own. Nothing is capped.
    """
    masks = first_masks(fps.count(), radius)
    final, rows = None, _keyed(fps.select("fp"), masks)
    for level in range(depth + 1):
        rows = written(rows, "shards")
        counts = written(
            rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tree),
            "large-shards")
        cool = rows.join(counts, ["mask", "key"], "left_anti").select(
            "mask", "key", "fp", F.lit("").alias("pair"), F.lit(True).alias("own"))
        final = cool if final is None else final.unionByName(cool)
        if counts.isEmpty():
            break
        hot = rows.join(counts, ["mask", "key"])
        if level == depth:
            pieces = F.ceil(F.col("n") / tree).cast("int")
            home = F.pmod(F.xxhash64("fp"), pieces).cast("int")
            pairs = hot.withColumn("home", home).withColumn("other", F.explode(
                F.sequence(F.lit(0), pieces - 1)))
            final = final.unionByName(pairs.select(
                "mask", "key", "fp",
                F.concat_ws(":", F.least("home", "other"), F.greatest("home", "other")).alias("pair"),
                (F.col("home") <= F.col("other")).alias("own")))
            break
        finer = {m: finer_masks(m, radius) for m in masks}
        children = F.create_map(*[x for m, f in finer.items() for x in (
            F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in f]))])
        rows = hot.select("fp", F.explode(children[F.col("mask")]).alias("mask"))
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({c for f in finer.values() for c in f})
    return (
        final.repartition("mask", "key", "pair").sortWithinPartitions("mask", "key", "pair", "fp")
        .mapInPandas(_shard_links(radius), "u long, v long")
    )


def _labelled(df, id_column, text, radius):
    """(doc_id, fp, label, component_id) for each row; the label tells all
    components apart, those of null ids too."""
    docs = written(fingerprints(df, id_column, text), "fingerprints")
    fps = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    labels = components(links(fps, radius))
    linked = fps.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("label", "fp").alias("label"))
    least = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = linked.join(least, "label").select("fp", "label", "component_id")
    return docs.join(classes.hint("shuffle_hash"), "fp").select("doc_id", "fp", "label", "component_id")


def near_duplicates(df, id_column="doc_id", text="text", radius=RADIUS):
    """(doc_id, fp, component_id) for each row: its fingerprint and the least
    doc_id that can be reached over links of at most ``radius`` bits, its own
    included. Texts without words have fingerprint 0 and are linked like any
    other. A null doc_id is no candidate for the least one; it is the result
    where a component has no other. Repeated rows are given as often as they
    come.

    Documents are reduced to distinct fingerprints first, so exact copies
    cost nothing later; they are joined back by fingerprint, streamed, where
    adaptive execution splits a hot one.
    """
    return _labelled(df, id_column, text, radius).drop("label")


def survivors(df, radius=RADIUS):
    """One whole row of each component: that of its least doc_id. Where rows
    of the component repeat that id, or all have none, it is that of the least
    fingerprint, then the first by the other columns.

    Ids that one row has are joined back by id alone. Rows of repeated and null
    ids are joined back by id and fingerprint, made anew for those rows only.
    """
    names = df.columns
    found = written(_labelled(df, "doc_id", "text", radius).withColumn(
        "leads", F.col("doc_id").eqNullSafe(F.col("component_id"))), "components")
    ids = found.groupBy("doc_id").agg(
        F.max("leads").alias("leads"), (F.count(F.lit(1)) > 1).alias("__repeated")).filter("leads").select(
        F.col("doc_id").alias("__keep"), "__repeated")
    kept = df.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__keep")))
    # A fingerprint is in one component: a row per component, by fingerprint.
    marks = found.filter("leads").groupBy("label").agg(
        F.min("fp").alias("__mark"), F.first("doc_id").alias("__leader")).drop("label")
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    repeated = (
        kept.filter("__repeated").withColumn("__fp", _simhash(F.col("text")))
        # Null-safe, though none is null: else the fingerprint's not being null
        # would be tested on all rows, before the join.
        .join(marks.hint("shuffle_hash"), F.col("__fp").eqNullSafe(F.col("__mark"))
              & F.col("doc_id").eqNullSafe(F.col("__leader")))
        .groupBy("__mark").agg(F.min_by(row, F.xxhash64(*[F.col(f"`{c}`") for c in names])).alias("row"))
        .select("row.*")
    )
    return kept.filter("NOT __repeated").select(*[F.col(f"`{c}`") for c in names]).unionByName(repeated)


def op4_simhash_bktree(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
