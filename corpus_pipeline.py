"""From raw documents to a deduplicated, mixed and tokenized corpus."""

from mailspark.llm import bpe, exact_dedup, mixing, quality_rules, simhash
from mailspark.llm.common import table
from mailspark.session import configure, written


def quality(spark, docs, sf_dir):
    """Documents that the current quality policy keeps."""
    configure(spark)
    return quality_rules.filtered(docs)


def exact(spark, docs, sf_dir):
    """One document of each text: that of the largest doc_id."""
    return exact_dedup.survivors(docs)


def near(spark, docs, sf_dir):
    """One document of each SimHash component: that of the least doc_id."""
    return simhash.survivors(docs)


def mixed(spark, docs, sf_dir):
    """All documents, laid out in the order of the mixture: files follow by
    number, and every run of them holds the sources by weight."""
    return mixing.in_order(mixing.mix(docs), rows=docs.count())


def tokens(spark, docs, sf_dir):
    """Token ids of each document, next to its id, language, source and its
    position in the mixture: its place in the files that the stage before has
    laid out."""
    return bpe.encode(mixing.numbered(docs)).drop("text", "n_chars")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources to target weights", mixed),
    ("BPE encoding and decoding", tokens),
]

#: XXH64, the schedule and the tokenizer are beyond SQL; tests compare the
#: stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages one after another over documents; each reads the table that
    the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{number}")
    return docs
