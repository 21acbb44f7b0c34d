from __future__ import annotations

import hashlib
import random
import re

import pytest

from panelspark.llm.substrings import prefix_plan, remove_repeats

from .rows import documents, frame


def brute_force(rows, size=13):
    words = {k: re.findall(r"[^\x20\x09-\x0D]+", t or "") for k, (_, t, *_) in enumerate(rows)}
    least = {}
    for k, w in words.items():
        for i in range(len(w) - size + 1):
            key = tuple(w[i:i + size])
            least[key] = min(least.get(key, rows[k][0]), rows[k][0])
    out = []
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if least[tuple(w[i:i + size])] < rows[k][0]:
                gone.update(range(i, i + size))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((rows[k][0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out)


def hot_rows():
    """One passage in most documents, a text that repeats itself, exact copies."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(14)]
    rows = []
    for i in range(120):
        words = ["of", "the"] * rng.randint(0, 4) + [f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 60))]
        if i % 3:
            at = rng.randint(0, len(words))
            words[at:at] = passage
        rows.append((i * 7 % 1000, " ".join(words), "en", "s"))
    rows += [(5000 + i, rows[4][1], "en", "s") for i in range(30)]
    return rows + [(3, " ".join(["x y z"] * 20), "en", "s"), (2, " ".join(["x y z"] * 9), "en", "s")]


@pytest.mark.parametrize("make", [documents, hot_rows])
@pytest.mark.parametrize("group", [1 << 20, 64])
def test_removed_words_equal_brute_force(spark, make, group):
    rows = make()
    got = remove_repeats(frame(spark, rows, partitions=5), group_suffixes=group).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute_force(rows)
    for r in got:
        assert sum(s.n_words for s in r.spans) == r.n_removed and all(s.n_words >= 13 for s in r.spans)


@pytest.mark.parametrize("make", [documents, hot_rows])
def test_bounded_plan_and_buckets_equal_brute_force(spark, make):
    rows = make()
    docs = frame(spark, rows, partitions=5)
    plan = prefix_plan(docs.selectExpr("doc_id as id", "text"), 13, 64, 4)
    assert plan.splits > 1 and plan.groups <= 8
    assert plan.text_bytes == sum(len((t or "").encode()) for _, t, *_ in rows)
    got = remove_repeats(docs, group_suffixes=64, most_groups=4, bucket_bytes=500).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got) == brute_force(rows)


def test_rows_without_an_id_are_spread(spark):
    rows = [(None, f"a{i} b", "en", "s") for i in range(200)] + [(1, "a b", "en", "s")]
    got = remove_repeats(frame(spark, rows, partitions=3), detail=False).collect()
    assert len(got) == 201 and all(r.n_removed == 0 and r.n_words == 2 for r in got)


def test_plan_splits_what_is_too_large(spark):
    rows = [(i, " ".join(["the of"] * 30 + [f"w{i}"] * 3), "en", "s") for i in range(50)]
    docs = frame(spark, rows).selectExpr("doc_id as id", "text")
    plan = prefix_plan(docs, 13, 40)
    assert len(plan.levels) == 13 and plan.groups > 1


def test_odd_rows(spark):
    text = " ".join(f"a{i}" for i in range(13))
    rows = [(None, text, 1, "x"), (4, text, 1, "x"), (4, text, 1, None), (9, text + " b", 1, "x"), (1, None, 1, "x")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, id int, found string"), detail=False).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in got) == [(-1, 13, 0), (1, 0, 0), (4, 13, 0), (4, 13, 0), (9, 14, 13)]
    assert remove_repeats(frame(spark, [], partitions=1)).collect() == []
