"""A corpus pipeline in five stages over ``documents``: quality rules, exact deduplication, near
deduplication, mixing to target weights, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; every stage but the last
returns the columns of documents.
"""

from __future__ import annotations

from shelfmate.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules
from shelfmate.llm.common import read_table, through_table


def good_documents(spark, docs, sf_dir):
    """Documents that no quality rule rejects."""
    return quality_rules.keep_good(docs)


def without_exact_copies(spark, docs, sf_dir):
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark, docs, sf_dir):
    """One document of each class of near-duplicates."""
    return near_dedup.drop_near_copies(docs)


def mixed_sources(spark, docs, sf_dir):
    """Every document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def token_ids(spark, docs, sf_dir):
    """doc_id, ids, n_tokens, and digests of the ids and of the text they decode to; a row per copy. Workers stay for the
    stages of the next run, so no more than one a task is started here."""
    return bpe.tokenized(docs, stored=True)


STAGES = [
    ("quality_rules", good_documents),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("mix_sources", mixed_sources),
    ("byte_bpe", token_ids),
]

#: Near-duplicates, the mix and the tokens cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = through_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
