"""An order that mixes sources by target weights (Pfair scheduling).

Each source's rows, in a seeded order, are cut into blocks. While all sources
last, block i of a source of weight w (of all weights) has a release time
floor(i / w) and a deadline ceil((i + 1) / w), counted in blocks; at each time
the released block with the earliest deadline is taken. When a source would run
out at its weight, the others share its part by theirs from then on, so that
each source has a share that is due to it at each time; releases and deadlines
follow from that share. At every point of the order, each source has less than
one block more or less than what is due to it.

Weights are exact fractions, and every source has its own. Each decision rests
on those before, so one task makes the table of blocks; it holds a few numbers
per source, no rows and no blocks. All else is spread.
"""

import heapq
from bisect import bisect_left
from fractions import Fraction
from functools import reduce
from math import floor, gcd, lcm

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.llm.common import group_key, ranked, shuffled, table
from mailspark.session import written

#: Rows of a block.
BLOCK = 8

#: Parts of whole weights, where they are asked for.
RESOLUTION = 1000

#: Without given targets, a source weighs its rows to this power.
TEMPERATURE = 0.7

SEED = 8


def parts(weights, resolution=RESOLUTION):
    """Weights by name as whole parts: largest remainders, one part at least,
    divided by their common divisor."""
    total = sum(map(Fraction, weights.values()))
    if not weights or total <= 0 or min(weights.values()) <= 0:
        raise ValueError("target weights must be positive")
    exact = {s: Fraction(w) * resolution / total for s, w in weights.items()}
    out = {s: max(1, floor(x)) for s, x in exact.items()}
    by_rest = sorted(exact, key=lambda s: (floor(exact[s]) - exact[s], s))
    for s in by_rest[:max(0, resolution - sum(out.values()))]:
        out[s] += 1
    common = reduce(gcd, out.values())
    return {s: n // common for s, n in out.items()}


def taken(blocks, weights):
    """The (source, block) taken at each time: earliest deadline first.

    ``blocks`` and ``weights`` are by source. Up to the fluid time v a source is
    due the lesser of weight * v and its blocks; the blocks due of all sources
    are the time. Whole numbers throughout, so nothing adds up.
    """
    names = sorted(s for s, n in blocks.items() if n)
    exact = [Fraction(weights[s]) for s in names]
    if exact and min(exact) <= 0:
        raise ValueError("target weights must be positive")
    scale = lcm(*[x.denominator for x in exact])
    w, n = [int(x * scale) for x in exact], [int(blocks[s]) for s in names]
    # Sources in the order they run out; blocks and weights before and after.
    ends = sorted(range(len(names)), key=lambda s: (Fraction(n[s], w[s]), s))
    gone, active = [0], [sum(w)]
    for s in ends:
        gone.append(gone[-1] + n[s])
        active.append(active[-1] - w[s])
    at, done = [0] * len(names), [0] * len(names)

    def due(s, x):
        """Time at which x blocks of a source are due, down and up."""
        k = at[s]
        if n[ends[k]] * w[s] < x * w[ends[k]]:
            k = at[s] = bisect_left(ends, True, lo=k, key=lambda e: n[e] * w[s] >= x * w[e])
        return gone[k] + x * active[k] // w[s], gone[k] - (-x * active[k] // w[s])

    waiting, ready = [(0, s) for s in range(len(names))], []
    deadline, release = [0] * len(names), [0] * len(names)
    for s in range(len(names)):
        release[s], deadline[s] = due(s, 1)
    for time in range(sum(n)):
        while waiting and waiting[0][0] <= time:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (deadline[s], s))
        last, s = heapq.heappop(ready)
        assert time < last
        yield names[s], done[s]
        done[s] += 1
        if done[s] < n[s]:
            heapq.heappush(waiting, (release[s], s))
            release[s], deadline[s] = due(s, done[s] + 1)


def period(quotas):
    """The time of each block, by source, where the weights are the blocks."""
    return schedule(quotas, quotas)[0]["times"]


def schedule(blocks, weights):
    """The whole order as one segment: a dict of ``start``, ``length``,
    ``repeats`` and, by source, the ``times`` of its blocks."""
    times = {s: [] for s, n in blocks.items() if n}
    for time, (s, _) in enumerate(taken(blocks, weights)):
        times[s].append(time)
    return [{"start": 0, "length": sum(blocks.values()), "repeats": 1, "times": times}] if times else []


def _placed(weigh, block, size=1 << 16):
    """Task code: rows (group, rows) of all sources to the table of blocks:
    group, block and the position of its first row."""

    def run(batches):
        rows = {g: int(n) for batch in batches for g, n in zip(batch["__group"], batch["__rows"])}
        found, start = [], 0
        for g, i in taken({g: -(-n // block) for g, n in rows.items()}, weigh(rows)):
            found.append((g, i, start))
            start += min(block, rows[g] - i * block)
            if len(found) == size:
                yield pd.DataFrame(found, columns=["__of", "__number", "__start"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=["__of", "__number", "__start"])

    return run


def mix(df, targets=None, block=BLOCK, source="source", key="doc_id", seed=SEED,
        resolution=None, strata=None):
    """The rows with ``stratum`` (source; null for rows of no source and of
    sources that share a weight), ``block`` (number within the stratum) and
    ``position`` (0-based, without gaps) in the mixed order.

    ``targets`` gives weights by source; sources that it doesn't name share
    the weight ``targets[None]``, or as much as the least of the named ones.
    Without targets each source, and the rows of none, weighs its rows to the
    power of 0.7. Every row comes once. Rows alike in key follow a hash of
    their other columns. Input columns of the result's names are replaced;
    empty tables give empty ones.

    On request only, weights are rounded to whole parts of ``resolution``, and
    the smallest sources beyond ``strata`` share a weight.

    Rows are ranked in pieces, so a hot source is spread, and joined with the
    table of blocks, a row for each block.
    """
    keep = [c for c in df.columns if c.lower() not in ("stratum", "block", "position")]
    name = group_key(F.col(f"`{source}`"))
    if targets is not None:
        own = [f"={s}" for s in targets if s is not None]
        named = {g: Fraction(targets[g[1:]]) for g in own}
        others = Fraction(targets.get(None, min(targets.values())))
        if min([others, *named.values()]) <= 0:
            raise ValueError("target weights must be positive")
        stratum = F.when(name.isin(own), name).otherwise("null") if own else F.lit("null")
    elif strata is not None:
        top = [r[0] for r in df.groupBy(name.alias("g")).count()
               .orderBy(F.desc("count"), "g").limit(strata).collect()]
        own = [g for g in (top if len(top) < strata else top[:-1]) if g != "null"]
        stratum = F.when(name.isin(own), name).otherwise("null") if own else F.lit("null")
    else:
        stratum = name

    def weigh(rows):
        if targets is None:
            found = {g: Fraction(n ** TEMPERATURE) for g, n in rows.items()}
        else:
            found = {g: named.get(g, others) for g in rows}
        return parts(found, resolution) if resolution and found else found

    work = df.select(*[F.col(f"`{c}`") for c in keep]).withColumns(
        {"__group": stratum, "__order": shuffled(F.col(f"`{key}`"), seed)})
    rows, _ = ranked(work, "__group", "__order", "__rank", "__size")
    counts = work.groupBy("__group").agg(F.count(F.lit(1)).alias("__rows"))
    plan = counts.repartition(1).mapInPandas(
        _placed(weigh, block), "__of string, __number long, __start long")
    return (
        rows.withColumn("__block", F.expr(f"__rank div {block}"))
        .join(plan.hint("shuffle_hash"),
              (F.col("__group") == F.col("__of")) & (F.col("__block") == F.col("__number")))
        .select(*[F.col(f"`{c}`") for c in keep],
                F.when(F.col("__of") != "null", F.expr("substring(__of, 2)")).alias("stratum"),
                F.col("__block").alias("block"),
                (F.col("__start") + F.col("__rank") % block).cast("long").alias("position"))
    )


def in_order(mixed, partitions=None, rows=None):
    """The mixed rows, without the columns of the schedule, laid out in order:
    each partition holds a run of positions, sorted; files follow by number."""
    spark = mixed.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = mixed.count() if rows is None else rows
    place = F.expr(f"cast((position * {partitions}) div {max(rows, 1)} as int)")
    return (mixed.repartitionById(partitions, place).sortWithinPartitions("position")
            .drop("stratum", "block", "position"))


def numbered(df):
    """The rows of a table of files, as it was read, with ``position``: their
    place (0-based, without gaps) in the order of the files, by number, and of
    the rows in each. What is no such table is written first."""
    try:
        rows = df.withColumns({"__file": F.col("_metadata.file_name"), "__row": F.col("_metadata.row_index")})
    except AnalysisException:
        return numbered(written(df, "in-order"))
    number = [F.regexp_extract("__file", e, 1).cast("long") for e in (r"part-(\d+)", r"-c(\d+)")]
    so_far = W.orderBy(*number, "__file").rowsBetween(W.unboundedPreceding, -1)
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n")).select(
        F.col("__file").alias("__of"), F.coalesce(F.sum("__n").over(so_far), F.lit(0)).alias("__first"))
    return (rows.join(F.broadcast(files), F.col("__file") == F.col("__of"))
            .withColumn("position", F.col("__first") + F.col("__row")).drop("__file", "__row", "__of", "__first"))


def op8_pfair_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source")).select(
        "doc_id", "source", "stratum", "block", "position")
