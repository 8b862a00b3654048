"""BPE, quality rules, quality network, language model."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from shelfmate.llm import bpe, log_bilinear, quality_net, quality_rules

from .helpers import SF_DIR, awkward, documents, nothing

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def entries():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(entries):
    ranks = {entry: i for i, entry in enumerate(entries)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal(entries):
    made = bpe.PerfectHash(entries)
    assert sorted(made.lookup(entries).tolist()) == list(range(len(entries)))
    assert made.lookup(entries).tolist() == list(range(len(entries)))


def test_bpe_equals_library(entries, library):
    draw = random.Random(4)
    letters = " \t\n\r\x0b\x1c\x85\xa0　abcXYZ'strell0129٣Ⅷé́ñ中文😀‍!?.$%|<>ʰͅ"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(1500)]
    texts += ["", "a" * 5000, " " * 3000, "é" * 4000, "<|endoftext|>", "it's we'll 'S"]
    encoder = bpe.Encoder(entries, public_tokenizers.PATTERN)
    ids, counts = encoder.encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, mine in zip(texts, parts):
        assert mine.tolist() == library.encode_ordinary(text)


def test_bpe_round_trip(spark, library):
    for docs in (documents(spark).select("doc_id", "text"), awkward(spark).drop("ids")):
        coded = bpe.encode(docs, PATH, public_tokenizers.PATTERN)
        for r in bpe.decode(coded, PATH).collect():
            assert r.ids == library.encode_ordinary(r.text or "")
            assert bytes(r.bytes) == (r.text or "").encode()
    assert bpe.tokenized(awkward(spark)).count() == awkward(spark).count()
    assert bpe.tokenized(nothing(spark)).count() == 0


def test_decode_null_and_unknown(spark):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [15496])], "k int, ids array<int>")
    got = {r.k: r.bytes for r in bpe.decode(frame, PATH).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and bytes(got[3]) == b"Hello"
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.createDataFrame([([99999],)], "ids array<int>"), PATH).collect()


def test_rules_awkward(spark):
    docs = awkward(spark)
    book = quality_rules.ledger(docs).collect()
    assert len(book) == docs.count()
    empty = [r for r in book if r.n_words == 0]
    assert len(empty) == 4 and all(r.failures & quality_rules.mask(["few_words"]) and r.word_chars == 0 for r in empty)
    lines = next(r for r in book if r.doc_id == 12)
    assert lines.n_dup_lines == 118 and lines.n_repeat_words == lines.n_words == 120
    wide = next(r for r in book if r.doc_id == 11)
    assert wide.word_chars == len("Ünïcödé中文😀cafénaïve")
    left = quality_rules.keep_good(docs)
    assert left.columns == docs.columns and left.count() == sum(r.failures == 0 for r in book)
    assert quality_rules.ledger(nothing(spark)).count() == 0


def test_repeated_words_by_hand():
    draw = random.Random(2)
    for _ in range(300):
        words = [draw.choice("abc") for _ in range(draw.randint(0, 40))]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_policies_and_ablation(spark):
    book = quality_rules.ledger(documents(spark)).cache()
    rows = book.collect()
    for version, names in quality_rules.POLICIES.items():
        mask = quality_rules.mask(names)
        kept = {r.doc_id for r in quality_rules.apply_policy(book, version).where("kept").collect()}
        assert kept == {r.doc_id for r in rows if not r.failures & mask}
        for r in quality_rules.ablation(book, version).collect():
            bit = quality_rules.mask([r.rule])
            assert r.failed == sum(bool(x.failures & bit) for x in rows)
            assert r.failed_alone == sum(x.failures & mask == bit for x in rows)


def test_rules_spare_documents_labelled_good(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = quality_rules.apply_policy(quality_rules.ledger(docs)).join(labels, "doc_id").collect()
    assert all(r.kept for r in judged if r.quality == 1 and not r.failures & quality_rules.mask(quality_rules.POLICIES["base"]))
    bad = [r for r in judged if r.quality == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_network_gradients():
    texts = [b"hello world " * 60, b"", b"x", bytes(range(256)) * 6]
    y = np.array([1, 0, 1, 0], np.float32)
    net = quality_net.new_net(3, 0.5)
    laid = quality_net.lay_out(texts)
    grads, _ = quality_net.gradients(net, laid, y)
    draw = np.random.default_rng(0)
    for part, grad in zip(net.parts(), grads):
        flat, slope = part.reshape(-1), np.asarray(grad).reshape(-1)
        for i in draw.choice(len(flat), min(6, len(flat)), replace=False).tolist() + [int(np.abs(slope).argmax())]:
            before, values = flat[i], []
            for step in (1e-2, -1e-2):
                flat[i] = before + step
                values.append(quality_net.gradients(net, laid, y)[1])
            flat[i] = before
            assert (values[0] - values[1]) / 2e-2 == pytest.approx(slope[i], abs=2e-2 * max(1, abs(slope[i])))


def test_network_sees_the_last_byte():
    net = quality_net.new_net(5, 0.5)
    one, other = quality_net.scores(net, [b"a" * 99_999 + b"b", b"a" * 100_000])
    assert one != other
    together = quality_net.scores(net, [b"zz", b"a" * 700, b""])
    assert together.tolist() == pytest.approx([quality_net.scores(net, [t])[0] for t in (b"zz", b"a" * 700, b"")], abs=1e-5)


def test_network_held_out(spark):
    got = quality_net.query(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) >= 0.92 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_network_awkward(spark):
    net = quality_net.fit([], [])
    assert quality_net.score_documents(awkward(spark), net).count() == awkward(spark).count()
    assert quality_net.score_documents(nothing(spark), net).count() == 0
    assert quality_net.scores(quality_net.fit([b"only"], [1]), [b""])[0] > 0.5


def language_by_hand(rows):
    texts = [(k, (t or "").encode().lower().split() + [b"</s>"]) for k, t in rows]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2
    counts = Counter(w for k, words in texts if not held(k) for w in words)
    n, v = sum(counts.values()), len(counts)
    return sorted(
        (k is None, k or 0, held(k), len(words), sum(counts[w] > 0 for w in words), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 5))
        for k, words in texts
    )


def test_language_base_by_hand(spark):
    for docs in (documents(spark).select("doc_id", "text"), awkward(spark)):
        for options in ({}, {"short": 5, "frequent": 0.01}):  # all words listed, or most of them joined
            got = log_bilinear.score(docs, **options).collect()
            mine = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got)
            assert mine == language_by_hand([(r.doc_id, r.text) for r in docs.collect()])
    assert log_bilinear.score(nothing(spark)).count() == 0


def test_language_model_beats_unigram(spark):
    got = [r for r in log_bilinear.query(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


@pytest.mark.parametrize("short", [5, 1500, 3000])
def test_language_pairs_with_any_number_of_classes(short):
    """Pairs added up in a task's table or handed on by piece: the same counts as a loop, whatever the number of classes."""
    from types import SimpleNamespace

    import pyarrow as pa

    texts = ["the cat sat", None, "", "The cat  ran off", "one"] * 30
    words = [b"the", b"cat", b"sat", b"ran"] + [b"w%d" % i for i in range(short)]
    ids = np.append(log_bilinear.hashes(words[:short]), log_bilinear.hashes([log_bilinear.END]))
    classes = log_bilinear.Classes(ids)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    got = Counter()
    for part in log_bilinear._count_pairs(SimpleNamespace(value=classes))(iter([batch])):
        for cell, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            got[cell] += n
    want = Counter()
    for text in texts:
        line = log_bilinear.tokens((text or "").encode())
        of = classes.of(line, log_bilinear.hashes(line)).tolist()
        for before, after in zip([classes.place[log_bilinear._END_HASH], *of], of):
            want[before * classes.size + after] += 1
    assert got == want


def test_language_table_is_normalised():
    draw = np.random.default_rng(0)
    counts = draw.poisson(3, (40, 40)) * np.add.outer(np.arange(40) % 2, np.arange(40) % 2).astype(float)
    table = log_bilinear.log10_table(*log_bilinear.train(counts, dimensions=8))
    assert (10.0**table).sum(1) == pytest.approx(np.ones(40), abs=1e-4)
    unigram = np.log10((counts.sum(0) + 1e-9) / counts.sum())
    assert (counts * table).sum() > (counts * unigram).sum()


def test_smallest_tables_score_all(spark):
    assert log_bilinear.query(spark, SF_DIR).count() == documents(spark).count()
