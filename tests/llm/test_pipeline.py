"""The pipeline against the operators' own results, stage by stage."""

import re

import corpus_pipeline
from shelfmate.llm import bpe, exact_dedup, mixing, near_dedup, quality_rules

from .helpers import SF_DIR, awkward, documents, nothing


def test_stages_take_effect(spark):
    docs, columns = documents(spark), documents(spark).columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF_DIR).cache()
        after[name] = docs
        if name == "quality_rules":
            kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(before)).where("kept").collect()}
            assert {r.doc_id for r in docs.collect()} == kept
        elif name == "exact_dedup":
            texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in docs.collect()]
            assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in before.collect()})
            assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in exact_dedup.exact_groups(before).where("kept").collect()}
        elif name == "near_dedup":
            assert {r.doc_id for r in docs.collect()} == {r.class_id for r in near_dedup.near_classes(before).collect()}
        elif name == "mix_sources":
            copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
            found = [r.doc_id for r in docs.collect()]
            assert all(found.count(k) == n for k, n in copies.items())
        else:
            assert sorted(r.doc_id for r in docs.collect()) == sorted(r.doc_id for r in before.collect())
            assert {r.ids_sha256 for r in docs.collect()} == {r.ids_sha256 for r in bpe.tokenized(before).collect()}
        if name != "byte_bpe":
            assert docs.columns == columns


def test_awkward_and_empty(spark):
    for docs in (awkward(spark), nothing(spark)):
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF_DIR)
            assert name == "byte_bpe" or docs.columns == awkward(spark).columns
        docs.count()


def test_tokens_take_one_python_worker_a_task(spark):
    """Ids are decoded in another stage than they are made in."""
    docs = documents(spark)
    got = corpus_pipeline.token_ids(spark, docs, SF_DIR)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert sorted(got.collect()) == sorted(bpe.tokenized(docs).collect())
