from __future__ import annotations

import random
import re
from fractions import Fraction

import numpy as np
import pytest

from panelspark.llm.mixing import mix_sources, prefix_sums
from panelspark.llm.queries import QUERIES

from .rows import SCHEMA, SF, documents, frame


def targets_of(size_of, weights=(3, 1, 2), share=Fraction(3, 2), most=2):
    """The reshares of the excess, in fractions."""
    order = sorted(size_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, Fraction(0))
    excess, open_ = share * sum(size_of.values()), set(order)
    while excess > 0 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += excess * weight[s] / total
        excess = Fraction(0)
        for s in list(open_):
            if target[s] >= most * size_of[s]:
                excess += target[s] - most * size_of[s]
                target[s] = Fraction(most * size_of[s])
                open_.discard(s)
    return target


def check(got, rows):
    """rows: (doc_id, text, source). The contract's facts, and the selection as a prefix of the drawn order."""
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    size_of, largest = {}, {}
    for (_, _, s), n in zip(rows, sizes):
        size_of[s] = size_of.get(s, 0) + n
        largest[s] = max(largest.get(s, 0), n)
    want = targets_of(size_of)
    assert sorted((str(r.doc_id), r.size, str(r.source)) for r in got) == sorted((str(i), n, str(s)) for (i, _, s), n in zip(rows, sizes))
    taken = dict.fromkeys(size_of, 0)
    for r in got:
        assert r.source_size == size_of[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)
        assert r.taken == r.epochs * r.size and 0 <= r.epochs <= 2
        taken[r.source] += r.taken
    for s in size_of:
        assert abs(taken[s] - want[s]) <= Fraction(largest[s], 2) + Fraction(1, 1000)
        epochs = {r.epochs for r in got if r.source == s}
        assert max(epochs) - min(epochs) <= 1
    return taken


def hot_rows():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 90))), rng.choice(("hot", "hot", "a", "b", "ü", None))) for i in range(700)]
    rows += [(9, "the same text", "hot")] * 150 + [(None, "no id here", "z")] * 40 + [(3, None, "only nulls"), (4, "one large text " * 400, "a")]
    return rows


def test_mix_meets_its_targets(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df.repartition(7)).collect()
    check(got, rows)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(df.repartition(3)).collect()))  # reruns and other partitionings agree
    assert sorted(map(str, got)) != sorted(map(str, mix_sources(df, seed=12).collect()))


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check(QUERIES["op11_source_mix"](spark, SF).collect(), rows)


def test_first_taken_follow_their_weights(spark):
    """Among documents of equal size the share taken grows with the weight as in successive draws."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * 20) + f" {i}" if i % 2 else " ".join(f"w{rng.randrange(10**6)}" for _ in range(21)), "a") for i in range(4000)]
    got = mix_sources(frame(spark, [(i, t, "en", s) for i, t, s in rows]), percent=20).collect()
    share = [np.mean([r.epochs for r in got if r.doc_id % 2 == k]) for k in (0, 1)]
    low = {round(r.weight, 6) for r in got if r.doc_id % 2}.pop()
    # exponential race: 1 - share = exp(-weight * t) for one t
    assert np.log(1 - share[1]) / np.log(1 - share[0]) == pytest.approx(low, rel=0.25)


def test_prefix_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "a", "a", "b", None)), rng.randrange(1000), i, rng.randrange(50)) for i in range(3000)]
    got = prefix_sums(spark.createDataFrame(rows, "g string, k int, i int, v int").repartition(6), "g", ["k", "i"], "v").collect()
    want, sums = {}, {}
    for g, k, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want[i] = sums.get(g, 0)
        sums[g] = want[i] + v
    assert {r.i: r.before for r in got} == want and len(got) == len(rows)


def test_odd_rows(spark):
    assert mix_sources(frame(spark, [], partitions=1)).collect() == []
    blank = mix_sources(frame(spark, [(1, None, "en", "a"), (None, " ", "en", None)])).collect()
    assert sorted((r.size, r.source_size, r.target, r.taken) for r in blank) == [(0, 0, 0.0, 0)] * 2
    rows = documents(20)
    clash = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], SCHEMA + ", size int, key double, group string")
    check(mix_sources(clash).collect(), [(r[0], r[1], r[3]) for r in rows])
