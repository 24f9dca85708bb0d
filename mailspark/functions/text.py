"""Tokens of mail text: lower-cased unicode words without diacritics, stemmed
on request. Tokenizing stays in the JVM; stemming is an Arrow function that
sees each distinct word of a batch once."""

import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailspark.functions.porter import stem

#: Columns of the text index.
INDEXED = ("subject", "from_addr", "to_addr", "body_preview")

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _fold_table():
    """(from, to) for ``translate``: lower-case letters that decompose into
    one ASCII letter and one mark lose the mark; bare marks vanish."""
    source, target = [], []
    for code in [*range(0x80, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            source.append(chr(code))
            target.append(parts[0])
    source.extend(chr(code) for code in range(0x300, 0x332))
    return "".join(source), "".join(target)


FOLD_FROM, FOLD_TO = _fold_table()


def fold(c):
    """Lower case without diacritics."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), FOLD_FROM, FOLD_TO)


def words(folded):
    return F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))


def tokenize(c):
    return words(fold(c))


def local_tokens(text):
    """Tokens of a search text, by the same rules."""
    table = {ord(a): b for a, b in zip(FOLD_FROM, FOLD_TO)}
    table.update({ord(a): None for a in FOLD_FROM[len(FOLD_TO):]})
    out, word = [], ""
    for ch in text.lower().translate(table) + " ":
        if unicodedata.category(ch)[0] in "LN" or unicodedata.category(ch) == "Co":
            word += ch
        elif word:
            out.append(word)
            word = ""
    return out


def _stem_lists(lists: pa.Array) -> pa.Array:
    flat = lists.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in flat.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    ends = pc.cumulative_sum(lengths.cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, stems.take(flat.indices))


def stem_tokens(tokens):
    """Stemmed copy of an array of tokens."""

    return F.arrow_udf(_stem_lists, T.ArrayType(T.StringType()))(tokens)
