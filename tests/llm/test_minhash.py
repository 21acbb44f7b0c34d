from __future__ import annotations

import random
import re

import numpy as np
import pytest

from panelspark.llm import minhash
from panelspark.llm.components import components
from panelspark.llm.minhash import bands, drop_near_duplicates, near_duplicates, signature

from .rows import documents, frame


def brute_force(rows, percent):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            common = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if c == old else c for i, c in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def chain(rng):
    """Texts of which each is near its neighbours only."""
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    out = []
    for i in range(12):
        words = [f"v{rng.randrange(10**6)}" if j == i * 9 + 4 else w for j, w in enumerate(words)]
        out.append(" ".join(words))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    texts = chain(rng)
    rows = documents() + [(1000 + i, t, "en", "s") for i, t in enumerate(rng.sample(texts, len(texts)))]
    expected = brute_force(rows, 85)
    assert any(c != i for i, (_, c) in expected.items())
    got = near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_members_of_a_bucket_that_are_far_from_its_centre(spark):
    # many copies of one text with own changes: pairs are near or not, whatever the smallest id is
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(40):
        words = list(base)
        for j in rng.sample(range(150), rng.choice((0, 1, 2, 3, 5))):
            words[j] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "s"))
    expected = brute_force(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()} == expected


def test_a_group_that_is_not_linked_with_its_smallest_ids_costs_no_square_of_its_pairs(spark, monkeypatch):
    # the smallest ids share buckets with a group of near copies, but are linked with none of them
    rng = random.Random(9)
    base = [f"b{i}" for i in range(400)]

    def changed(at):
        return " ".join(f"z{rng.randrange(10**6)}" if j in at else w for j, w in enumerate(base))

    far = [changed(set(range(i % 20, 400, 20))) for i in range(32)]
    near = [changed({rng.randrange(400)}) for _ in range(80)]
    rows = [(i, t, "en", "s") for i, t in enumerate(far + near)]
    sizes, store = {}, minhash.store
    monkeypatch.setattr(minhash, "store", lambda df, name: (out := store(df, name), sizes.update({name: out.count()}))[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_force(rows, 85)
    assert {c for i, (_, c) in got.items() if i >= len(far)} == {len(far)}
    pairs = {name: n for name, n in sizes.items() if name.startswith("pairs")}
    assert len(pairs) == 3 and pairs["pairs-across"] < 2 * len(rows) and sum(pairs.values()) < len(near) ** 2 / 2, pairs


def test_odd_rows_and_clashing_columns(spark):
    schema = "doc_id long, text string, id long, bucket string, node long"
    rows = [(None, "a b c d e f", 1, "x", 2), (3, None, 1, "x", 2), (4, "a b c d e f", 1, None, 2), (4, "a b c d e f", 1, "x", 2), (9, "A b c d e f", None, "x", 2), (5, "", 1, "x", 2)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()}
    assert got == {(None, 2, None, True), (3, 0, 3, True), (4, 2, 4, True), (9, 2, 4, False), (5, 0, 5, True)}
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]


def test_dropping_judges_rows_not_ids(spark):
    """Different texts under one id, copies without id, columns named like the operator's own."""
    a, b, c = "one two three four five six seven", "other words are in this second text here", "a third one that has nothing at all in common"
    rows = [(1, a, 7, "x"), (1, b, 7, "x"), (1, b, 7, "y"), (None, a, 7, "x"), (None, c, 8, "x"), (None, c, 9, "x"), (2, None, 7, "x"), (2, None, 7, "x"), (0, b, 1, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long, row string").repartition(4)
    got = drop_near_duplicates(df)
    assert got.columns == df.columns
    found = [tuple(r) for r in got.collect()]
    assert sorted((str(r[0]), r[1] or "") for r in found) == sorted([("1", a), ("0", b), ("None", c), ("2", ""), ("2", "")])
    assert all(r in rows for r in found)


def test_empty_table(spark):
    df = frame(spark, [], partitions=1)
    assert near_duplicates(df).collect() == [] and drop_near_duplicates(df).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(500, 400), (7, 7), (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 201)} | {400: 400, 500: 400}


@pytest.mark.parametrize("jaccard", [0.5, 0.9])
def test_minima_and_maxima_agree_as_often_as_the_sets_overlap(jaccard):
    rng = np.random.default_rng(1)
    common = int(2000 * jaccard)
    pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    rest = (2000 - common) // 2
    a, b = pool[:common + rest], np.concatenate([pool[:common], pool[common + rest:common + 2 * rest]])
    keys = bands(signature(np.concatenate([a, b]), np.array([0, len(a)]), 1500), 1)
    share = (keys[0] == keys[1]).mean()
    assert abs(share - common / (common + 2 * rest)) < 0.03
