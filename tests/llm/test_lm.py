from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import lm
from panelspark.llm.lm import CLASSES, FREQUENT, LogBilinear, Vocabulary, count_tokens, language_scores, score_documents, tokens_of, vocabulary

from .rows import documents, frame


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


@pytest.mark.parametrize("head", [1 << 16, 30])
def test_counts_and_base_scores_equal_brute_force(spark, head):
    rows = documents(30)
    docs = frame(spark, rows).cache()
    train = Counter(t for i, text, *_ in rows if zlib.crc32(str(i).encode()) % 10 for t in tokens(text))
    total, distinct = sum(train.values()), len(train)
    got = {r.doc_id: r for r in language_scores(docs, head_tokens=head, frequent_tokens=20).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        t, r = tokens(text), got[i]
        base = sum(math.log10((train[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(t), sum(train[w] > 0 for w in t), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        assert r.score < 0


def test_probabilities_sum_to_one(spark):
    rng = random.Random(0)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(30)) for _ in range(200)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    words = vocabulary(count_tokens(docs))
    model = lm.train(docs, words, epochs=1)
    near, far, bias, norm = model.tables()
    for one, two in ((0, 1), (5, 900), (FREQUENT, 3)):
        assert abs(np.exp(near[one].astype(float) + far[two] + bias - norm[one, two]).sum() - 1) < 1e-3
    # inside a class: all known tokens and one share for the unknown
    keys, classes, _, _ = tokens_of(pa.array(texts))
    rare = {(int(k), int(c)) for k, c in zip(keys, classes) if words.symbol_of(np.array([k]), np.array([c]))[0][0] >= FREQUENT}
    inside = np.full(CLASSES, 0.1)
    for k, c in rare:
        inside[c] += words.counts[np.searchsorted(words.keys, np.uint64(k))] + 0.1
    assert np.allclose(inside, words.class_totals)


def test_training_learns_what_follows():
    """Two alternating words are foreseen almost surely by their predecessors."""
    rng = np.random.default_rng(2)
    symbols = np.tile([3, 7], 20000)
    counts = np.zeros(FREQUENT + CLASSES)
    counts[[3, 7]] = 20000
    model = LogBilinear.start(counts)
    log_noise = np.log((counts + 0.1) / (counts + 0.1).sum()).astype(np.float32)
    for _ in range(300):
        at = rng.integers(2, len(symbols), lm.BATCH)
        noise = rng.choice([3, 7], lm.NOISE)
        model.step(symbols[at - 1], symbols[at - 2], symbols[at], noise, log_noise, lm.RATE)
    near, far, bias, norm = model.tables()
    assert np.exp(near[3, 7] + far[7, 7] + bias[7] - norm[3, 7]) > 0.9


def test_model_beats_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = [r for r in language_scores(docs).collect() if r.held_out]
    score, base, n = (sum(r[c] for r in held) for c in ("score", "base_score", "n_tokens"))
    assert score / n > base / n + 0.05


def test_odd_rows(spark):
    rows = [(None, "a b", "x"), (1, None, "x"), (1, "", "x"), (2, "A b", "x"), (2, "a b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6), r.held_out) for r in language_scores(docs).collect())
    assert [g[:2] for g in got] == [("1", 1), ("1", 1), ("2", 3), ("2", 3), ("None", 3)] and got[2] == got[3]
    empty = frame(spark, [], partitions=1)
    assert language_scores(empty).collect() == []
    untrained = score_documents(docs, docs.where("false")).collect()
    assert len(untrained) == 5 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in untrained)
    assert isinstance(vocabulary(count_tokens(empty)), Vocabulary)
