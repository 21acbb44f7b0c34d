from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from panelspark.llm.ntt import PRIME, backward, forward
from panelspark.llm.periodic import find_runs, looped_tails, periodic_runs
from panelspark.llm.queries import QUERIES

from .rows import SF, documents, frame


def runs_of(w):
    """Every maximal run, by comparing all words with all later ones."""
    found, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, size = i, j - i + q
            smallest = next(p for p in range(1, q + 1) if all(w[k] == w[k + p] for k in range(s, s + size - p)))
            if smallest == q and size >= max(6, 4 * q):
                found.append((s, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_force(doc_id, text, rewrite=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if rewrite and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_of(w)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    left = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left.encode()).hexdigest())


def cases():
    rng = random.Random(11)
    out = [[], [1], [1] * 5, [1] * 6, [1] * 400, [1, 2] * 3, [1, 2] * 4, [1, 2, 1] * 5, [1] * 30 + [2] + [1] * 30, list(range(90)) * 4, list(range(90)) * 4 + [0, 1, 7]]
    for k in range(400):
        words = []
        for _ in range(rng.randint(1, 6)):
            part = [rng.randrange(rng.choice((1, 2, 3, 50))) for _ in range(rng.randint(1, rng.choice((3, 12, 40))))]
            words += part * rng.choice((1, 1, 2, 4, 5, 9)) + part[:rng.randrange(len(part) + 1)]
        out.append(words)
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    return [*out, fib[-1], fib[-2] * 4]


def test_transform_is_exact():
    rng = np.random.default_rng(1)
    for points in (2, 8, 64):
        a, b = rng.integers(0, PRIME, (2, points, 3)).astype(np.uint64)
        got = backward(forward(a.copy()) * forward(b.copy()) % np.uint64(PRIME))
        for c in range(3):
            want = [sum(int(a[i, c]) * int(b[(k - i) % points, c]) for i in range(points)) % PRIME for k in range(points)]
            assert got[:, c].tolist() == want


@pytest.mark.parametrize("together", [True, False])
def test_runs_equal_brute_force(together):
    texts = cases()
    hashes = np.random.default_rng(3).integers(0, 1 << 63, 1000).astype(np.uint64)
    for group in [texts] if together else [[t] for t in texts]:
        first = np.concatenate([[0], np.cumsum([len(t) for t in group])]).astype(np.int64)
        row, start, length, period = find_runs(hashes[np.array(sum(group, []), np.int64)], first)
        for r, t in enumerate(group):
            own = row == r
            assert list(zip(start[own].tolist(), length[own].tolist(), period[own].tolist())) == runs_of(t)


def test_zero_modulo_the_prime_alone_is_no_occurrence():
    """Words that differ by a multiple of the prime."""
    a, b, shift = np.uint64(5), np.uint64(9), np.uint64(PRIME)
    h = np.array([a, b] * 5 + [a + shift, b] * 5 + [a, b] * 2, np.uint64)
    row, start, length, period = find_runs(h, np.array([0, len(h)]))
    assert list(zip(start.tolist(), length.tolist(), period.tolist())) == [(0, 10, 2), (9, 11, 2)]


def test_operator_equals_brute_force(spark):
    rows = documents(30) + [(1000 + i, " ".join(map(str, t)), "en", "s") for i, t in enumerate(cases())] + [(None, "x y " * 9, "en", "s"), (7, "a " * 9, "en", "s"), (7, "a " * 9, "en", "s")]
    rows = [r for r in rows if r[1] is None or len(r[1]) < 20_000]
    got = [tuple(r) for r in periodic_runs(frame(spark, rows), rewrite=looped_tails, detail=False).collect()]
    want = [brute_force(r[0], r[1]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str) and sum(w[1] > 0 for w in want) > 100


def test_registered_query(spark):
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert len(got) == len(rows)
    short = [r for r in rows if len(r[1] or "") < 6000]
    for doc_id, text in short:
        assert got[doc_id] == brute_force(doc_id, text)
    assert sum(got[i][1] > 0 for i, _ in short) > 5


def test_detail_and_odd_rows(spark):
    rows = [(1, None, 5, "x"), (2, " \t\n", 5, "x"), (None, "go go go go go go stop", 5, "x"), (3, "é ü " * 4 + "end", 5, "x")]
    got = periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs int, start string")).collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_runs, by[1].start, by[1].collapsed, by[2].collapsed) == (0, None, "", "")
    assert by[None].collapsed == "go stop" and [tuple(x) for x in by[None].runs] == [(0, 6, 1)] and by[None].exponent_milli == 6000
    assert by[3].collapsed == "é ü end" and (by[3].start, by[3].length, by[3].period) == (0, 8, 2)
    assert periodic_runs(frame(spark, [], partitions=1)).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(2)
    loop = [f"w{rng.randrange(9000)}" for _ in range(40_000)]
    rows = [(1, " ".join(loop * 4 + loop[:3]), "en", "s"), (2, "a " * 200_000, "en", "s"), (3, "a " * 99_999 + "b " + "a " * 99_999, "en", "s")]
    by = {r.doc_id: r for r in periodic_runs(frame(spark, rows, partitions=1)).collect()}
    assert [tuple(x) for x in by[1].runs] == [(0, 160_003, 40_000)]
    assert [tuple(x) for x in by[2].runs] == [(0, 200_000, 1)]
    assert [tuple(x) for x in by[3].runs] == [(0, 99_999, 1), (100_000, 99_999, 1)] and by[3].collapsed == "a b a"
