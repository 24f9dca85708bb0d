"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document. The ledger stores the measurements
and one bit per failed rule; policies are versioned masks over the bits, so a
new policy, and what each of its rules costs (ablation), is computed from the
ledger by bit operations, without reading a text again.
"""

from pyspark.sql import functions as F

from mailspark.llm.common import GAPS, table, whole_text

WINDOW = 5

#: Measurements, in the ledger's order.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_upper", "n_echoes")

#: Rules in bit order: name and condition under which a document fails. A
#: rule keeps its bit for good; new rules are added at the end.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("capitals", "2 * n_upper > word_chars"),
    ("short_or_long_words", "10 * word_chars < 25 * n_words OR word_chars > 12 * n_words"),
    ("echoes", "100 * n_echoes > 30 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Policies by version: a document is rejected when it fails any of the rules.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(name for name, _ in RULES),
}
CURRENT = "v2"


def mask(policy):
    return sum(BIT[name] for name in POLICIES[policy])


def measured(df, id_columns=("doc_id",)):
    """The measurements of each whole text, next to the id columns.

    Words are runs other than space and tab to carriage return. Null and empty
    texts measure 0 throughout. n_repeat_words counts the words that lie in a
    window of five words found twice or more in the text; windows are told
    apart by a 64-bit hash of their words. All work is per row; repeated
    windows are found by sorting the hashes of a text, so a long text costs
    n log n.
    """
    at = F.get
    text = whole_text(df)
    out = df.select(*id_columns, text.alias("__text"))
    out = out.select(
        *id_columns, "__text",
        F.array_remove(F.split("__text", GAPS), "").alias("__words"),
        F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    words = F.col("__words")
    out = out.select(
        *id_columns, "__words",
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.regexp_replace("__text", GAPS, "")).cast("long").alias("word_chars"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", "[#*$%&|<>]+", "")))
        .cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.char_length("__text") - F.char_length(F.regexp_replace("__text", r"\p{Lu}+", "")))
        .cast("long").alias("n_upper"),
        F.when(F.size("__words") >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size("__words") - WINDOW),
            lambda i: F.xxhash64(*[at(words, i + k) for k in range(WINDOW)]))).alias("__windows"))
    windows = F.col("__windows")
    rest = [c for c in out.columns if c not in ("__words", "__windows")]
    out = out.select(
        *rest,
        F.size(F.filter(words, lambda w, i: w == at(words, i + 1))).cast("long").alias("n_echoes"),
        F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(
            F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        ).alias("__sorted"))
    pairs = F.col("__sorted")
    rest = [c for c in out.columns if c != "__sorted"]
    out = out.select(*rest, F.sort_array(F.transform(
        F.filter(pairs, lambda p, j: (p["h"] == at(pairs, j + 1)["h"])
                 | ((j > 0) & (p["h"] == at(pairs, F.greatest(j - 1, F.lit(0)))["h"]))),
        lambda p: p["i"])).alias("__starts"))
    # A repeated window adds its words up to the next repeated window.
    starts = F.col("__starts")
    steps = F.transform(starts, lambda s, j: F.least(
        F.lit(WINDOW), F.coalesce(at(starts, j + 1) - s, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(*rest, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")) \
        .select(*id_columns, *MEASURES)


def ledger(df, id_columns=("doc_id",)):
    """Id columns, measurements and ``failed``, the bits of the failed rules."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    # Adding nothing by the row number, which only Spark's optimizer cannot
    # know, keeps a later filter above the ledger; moved below, it would
    # evaluate the measurements anew inside each other.
    nothing = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    return measured(df, id_columns).withColumn("failed", (total + nothing).cast("long"))


def passes(policy=CURRENT):
    """Condition on a ledger row: the policy keeps the document."""
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablation(rows, policy=CURRENT):
    """What each rule of a policy does, from the ledger alone: ``fails`` (rows
    that fail it), ``alone`` (rows that only this rule rejects: those that
    come back without it) and ``kept`` (rows kept by the policy without it).
    The ledger is reduced to counts of bit patterns first."""
    m = mask(policy)
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(m)).alias("bits")).agg(
        F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).alias("bit")) for name in POLICIES[policy]]))
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        patterns.select("bits", "n", rules.alias("r")).groupBy("r.rule").agg(
            count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)("fails"),
            count(F.col("bits") == F.col("r.bit"))("alone"),
            count((F.col("bits") == 0) | (F.col("bits") == F.col("r.bit")))("kept"))
    )


def op3_rule_ledger(spark, sf_dir):
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return ledger(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), passes().alias("kept"), "failed")


def filtered(df):
    """The whole rows that the current policy keeps, with their columns only."""
    names = df.columns
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "text")
    return ledger(rows, ("__row",)).filter(passes()).select("__row.*")


MEASURED_SQL = r"""
t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, list_slice(words, i, i + 4) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5)),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g), range(5) r(k)
  WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
    length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
    len(list_filter(words, lambda w, i: w = words[i + 1])) AS n_echoes
  FROM t LEFT JOIN repeated USING (doc_id)),
f AS (SELECT *, """ + " + ".join(
    f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES) + """ AS failed FROM m)
"""

OP3_SQL = f"""
WITH {MEASURED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed & {mask('base')} <> 0 AS base_failed, failed & {mask(CURRENT)} = 0 AS kept, failed
FROM f
"""
