"""URL filter: host rules, and a ratio of character language models.

URLs that a rule decides train two variable-order Markov models of characters,
one of the accepted and one of the rejected. The probability of a character
after a context is that context's, smoothed by the next shorter one's, down to
an even one; a context never seen leaves the shorter one's as it is, so the
order varies with what the data knows. URLs without a rule are judged by the
difference of the log-likelihoods per character, calibrated on URLs that were
left out of the counts.

The models are tables: each URL gives its character n-grams, which are counted
once, shorter n-grams are sums of longer ones, and the probability of each
n-gram is joined back. Rows of n-grams carry the number of their URL, so bytes
grow with its length. Nothing is pruned; the tables grow with the corpus and are
joined by a shuffle, but for the n-grams that are more than 1 in ``OFTEN`` of all
(fewer than ``OFTEN``, whatever the data), which are broadcast: those that every
URL has make no hot key.
"""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mailspark.llm.common import table
from mailspark.session import written

#: Characters of context at most.
ORDER = 4

#: Weight of the shorter context, in counts.
SMOOTHING = 2.0

#: Probability of a character that no context knows.
EVEN = 1.0 / 256

#: One labelled URL in this many calibrates and is not counted for that.
HELD_OUT = 5

#: Width of the bins of scores that the calibration reads.
BIN = 0.01

#: n-grams that make up more than one in this many are joined by broadcast.
OFTEN = 1000

PAD, END = "\x02", "\x03"

#: Rules as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def split_url(url):
    """Host and path columns of a URL column; both empty without "://"."""
    url = F.coalesce(url, F.lit(""))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)


def ruled(df, url="url", rules=RULES):
    """Adds host, path, rule and decided (allow, block or null): the longest
    rule that fits, of equally long ones the first by text."""
    host, path = split_url(F.col(f"`{url}`"))
    out = df.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return out.withColumns({"rule": rule, "decided": verdict})


def _grams(urls, *keep):
    """One row per character of a URL, its end included: the columns to keep,
    and the n-gram of the character and the ``ORDER`` before it."""
    # One array of characters a URL: taking the i-th out of a text would walk
    # it from its start each time.
    letters = F.split(F.concat(F.lit(PAD * ORDER), "url", F.lit(END)), "")
    grams = F.transform(F.sequence(F.lit(1), F.size("letters") - ORDER),
                        lambda i: F.array_join(F.slice("letters", i, ORDER + 1), ""))
    return urls.select(*keep, letters.alias("letters")).select(*keep, F.explode(grams).alias("gram"))


def gram_ratios(urls):
    """(gram, seen, fitted, full): in how many places of different URLs a gram
    is, and the log ratio of the probability of its last character in rejected
    against accepted URLs; ``fitted`` from the counts without the held-out
    URLs, ``full`` from all. ``urls`` is (url, n, decided, held)."""
    weights = {}
    for kind in ("allow", "block"):
        mine = F.col("decided").eqNullSafe(kind)
        weights[f"{kind}_full"] = F.sum(F.when(mine, F.col("n")).otherwise(0))
        weights[f"{kind}_fitted"] = F.sum(F.when(mine & ~F.col("held"), F.col("n")).otherwise(0))
    names = list(weights)
    counts = written(
        _grams(urls, "n", "decided", "held").groupBy("gram").agg(
            F.count(F.lit(1)).alias("seen"), *[w.cast("long").alias(c) for c, w in weights.items()]), "grams")
    levels = [counts]
    for k in range(ORDER, 0, -1):
        levels.append(levels[-1].groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(
            *[F.sum(c).alias(c) for c in names]))
    shorter = None
    for k, level in enumerate(reversed(levels)):
        # A context has at most as many rows as the alphabet has characters.
        context = W.partitionBy(F.expr(f"left(gram, {k})"))
        level = level.withColumns({f"all_{c}": F.sum(c).over(context) for c in names})
        if shorter is None:
            before = {c: F.lit(EVEN) for c in names}
        else:
            level = level.withColumn("suffix", F.expr(f"right(gram, {k})")).join(shorter, "suffix")
            before = {c: F.col(f"shorter_{c}") for c in names}
        made = {c: (F.col(c) + SMOOTHING * before[c]) / (F.col(f"all_{c}") + SMOOTHING) for c in names}
        if k < ORDER:
            shorter = level.select(F.col("gram").alias("suffix"),
                                   *[p.alias(f"shorter_{c}") for c, p in made.items()])
        else:
            return level.select("gram", "seen", *[
                F.log(made[f"block_{v}"] / made[f"allow_{v}"]).alias(v) for v in ("fitted", "full")])


def url_scores(urls, ratios):
    """(number, fitted, full): means of the ratios of each URL's grams. ``urls``
    is (number, url), ``ratios`` as made by ``gram_ratios``."""
    grams = _grams(urls, "number")
    total = ratios.agg(F.sum("seen")).first()[0] or 0
    often = ratios.filter(F.col("seen") * OFTEN > total)
    rest = grams.join(F.broadcast(often.select("gram")), "gram", "left_anti").join(ratios.hint("merge"), "gram")
    often = grams.join(F.broadcast(often), "gram")
    parts = [d.select("number", "fitted", "full") for d in (often, rest)]
    return parts[0].unionByName(parts[1]).groupBy("number").agg(
        F.avg("fitted").alias("fitted"), F.avg("full").alias("full"))


def calibrated(bins):
    """(slope, offset) of the probability of rejection by score, fitted by
    Newton's method to rows (score, rejected, n); classes weigh the same. With
    one class only, (0, its side)."""
    rejected = sum(n for _, r, n in bins if r)
    accepted = sum(n for _, r, n in bins if not r)
    if not rejected or not accepted:
        return 0.0, 1.0 if rejected else -1.0
    share = {True: 0.5 / rejected, False: 0.5 / accepted}
    a, b = 1.0, 0.0
    for _ in range(60):
        ga, gb, haa, hab, hbb = 1e-4 * (a - 1), 0.0, 1e-4, 0.0, 1e-9
        for s, r, n in bins:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * s + b))))
            w, e = n * share[bool(r)], p - bool(r)
            ga, gb = ga + w * e * s, gb + w * e
            v = w * p * (1 - p)
            haa, hab, hbb = haa + v * s * s, hab + v * s, hbb + v
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        step = min(1.0, 5 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def judged(df, id_column="page_id", url="url", rules=RULES):
    """(page_id, host, path, rule, verdict, score) of each row.

    A URL with a rule gets the rule's verdict. Others are blocked if the
    calibrated probability of rejection is over one half. ``score`` is the
    log-likelihood difference per character, rejected minus accepted. A null
    URL is scored as an empty one. Without any URL that a rule decides, or
    with one kind only, all others are judged as that kind (none: allowed).
    Repeated rows come as often as they are given.
    """
    pages = ruled(df.select(F.col(f"`{id_column}`").alias("page_id"),
                            F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")).alias("url")), "url", rules)
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    # Numbered before they are written, so that the numbers stay.
    urls = written(pages.groupBy("url", "decided").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"held": held & F.col("decided").isNotNull(), "number": F.monotonically_increasing_id()}), "urls")
    ratios = written(gram_ratios(urls), "gram-ratios")
    scored = written(urls.join(url_scores(urls, ratios), "number"), "url-scores")
    # The scores of the held-out URLs, in bins: bounded by the range of scores.
    bins = scored.filter("held").groupBy(
        F.round(F.col("fitted") / BIN).alias("bin"), (F.col("decided") == "block").alias("rejected")
    ).agg(F.sum("n").alias("n")).orderBy("bin", "rejected").collect()
    slope, offset = calibrated([(r["bin"] * BIN, r["rejected"], r["n"]) for r in bins])
    verdict = F.coalesce(F.col("decided"), F.when(
        slope * F.round("full", 9) + offset > 0, F.lit("block")).otherwise("allow"))
    scores = scored.select(F.col("url").alias("__url"), "full")
    return (
        pages.join(scores, F.col("url") == F.col("__url"), "left")
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("full", 9).alias("score"))
    )


def op6_url_language_models(spark, sf_dir):
    return judged(table(spark, sf_dir, "pages").select("page_id", "url")).select(
        "page_id", "host", "path", "rule", "verdict")
