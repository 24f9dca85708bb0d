"""Small tables with the cases that every operator must stand."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, "
          "block string, position string, stratum string, ids string, n_tokens string, failed string, "
          "kept string, fp string, label string, score string, digest string, `a b` string")
CLASHES = 19 - 5

LONG = " ".join(f"w{i % 977}x{i % 83}" for i in range(60_000))

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today.", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today.", "a"),
    (3, "THE QUICK brown fox jumps over the lazy dog near the old river bank today.", "a"),
    (4, None, "b"),
    (5, "", None),
    (6, "  \t\n ", "b"),
    (None, "A row without an id, and with quite a few words in its only line of text.", "b"),
    (None, "A row without an id, and with quite a few words in its only line of text.", "b"),
    (7, "spam spam spam spam spam spam spam spam spam spam spam spam", "c"),
    (8, "Ünïcode ÄÖÜ straße 😀 日本語 text İ with some more words to be long enough here.", None),
    (9, LONG, "a"),
    (9, LONG, "a"),
    (10, "one <|endoftext|> two\r\nthree four five", "d"),
    (11, "line one is here\nline one is here\nline one is here\nand a last line of words", "a"),
]


def documents(spark, rows=TEXTS):
    made = [(i, t, "en", s, None if t is None else len(t), *["x"] * CLASHES) for i, t, s in rows]
    return spark.createDataFrame(made, SCHEMA)


def skewed(spark, rows=600):
    """A third of all rows with the same text and source."""
    made = [(i, "the same text again and again in a third of the rows" if i % 3 == 0 else
             f"text number {i} with words {i * 7} and {i * 11} of its own kind",
             "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(rows)]
    return documents(spark, made)
