from __future__ import annotations

import hashlib
import random
import re

from panelspark.llm import decontam
from panelspark.llm.decontam import build_index, contamination, drop_contaminated, match

from .rows import documents, frame

ITEMS = "item_id long, text string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute_force(rows, items, size=10):
    out = []
    for doc, text, *_ in rows:
        w, hit, found = words_of(text), set(), set()
        for item, t in items:
            q = words_of(t)
            n = min(size, len(q))
            for i in range(len(q) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == q[i:i + n]:
                        hit.update(range(at, at + n))
                        found.add(str(item))
        names = ",".join(sorted(found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def planted():
    rng = random.Random(3)
    rows = documents(25)
    rows = [r for r in rows if len(r[1] or "") < 20000]
    items = []
    for k in range(12):
        w = words_of(rng.choice([r for r in rows if len(words_of(r[1])) > 20])[1])
        a = rng.randrange(len(w) - 12)
        items.append((k * 9, "..." + "! ".join(w[a:a + rng.choice((3, 9, 10, 12))]).upper()))
    items += [(200, None), (201, ""), (202, "--- !!"), (11, items[0][1]), (11, items[0][1]), (12, "the"), (300, " ".join(f"q{i}" for i in range(30)))]
    # a phrase over the end of a document is no phrase
    rows += [(9000, "q0 q1 q2 q3 q4", "en", "s"), (9001, "q5 q6 q7 q8 q9", "en", "s"), (9002, "The q0 Q1 q2,q3 q4 q5 q6 q7 q8 q9 q10 x q11 q0 q1 q2 q3 q4 q5 q6 q7 q8 q9", "en", "s")]
    return rows, items


def test_hits_equal_brute_force(spark, monkeypatch):
    rows, items = planted()
    benchmark = spark.createDataFrame(items, ITEMS)
    docs = frame(spark, rows)
    expected = brute_force(rows, items)
    assert sum(e[5] for e in expected) > 5
    assert sorted(map(tuple, contamination(docs, benchmark).collect()), key=str) == expected
    monkeypatch.setattr(decontam, "TEST_BLOCK_BYTES", 100)  # the same in several blocks of test items
    assert sorted(map(tuple, contamination(docs, benchmark).collect()), key=str) == expected
    kept = drop_contaminated(docs.withColumnRenamed("source", "items"), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(e[0] for e in expected if not e[5])
    assert kept.columns == ["doc_id", "text", "lang", "items"]


def test_odd_rows(spark):
    benchmark = spark.createDataFrame([(1, "a b c"), (None, "d")], ITEMS)
    rows = [(None, "x a b c", "e", "s"), (2, None, "e", "s"), (2, "A-B-C d", "e", "s"), (2, "A-B-C d", "e", "s")]
    got = sorted(((r.doc_id, r.n_words, r.n_hit) for r in contamination(frame(spark, rows), benchmark).collect()), key=str)
    assert got == sorted([(None, 4, 3), (2, 0, 0), (2, 4, 3), (2, 4, 3)], key=str)
    assert contamination(frame(spark, [], partitions=1), benchmark).collect() == []
    assert all(not r.contaminated for r in contamination(frame(spark, rows), spark.createDataFrame([], ITEMS)).collect())
    assert [r.text for r in drop_contaminated(frame(spark, rows), benchmark).collect()] == [None]
    clash = spark.createDataFrame([(1, "x y z", 3, 4), (1, "so a b c", 3, 4), (None, "so a b c", 3, 4), (None, "fine", 3, 4)], "doc_id long, text string, __bad long, id long")
    kept = drop_contaminated(clash, benchmark)  # rows of one id are judged each by its own text
    assert kept.columns == clash.columns and sorted(r.text for r in kept.collect()) == ["fine", "x y z"]


def test_very_long_texts(spark):
    """A text over several blocks' size, and one whose words are all the same."""
    filler = " ".join(f"f{i % 977}" for i in range(1_200_000))
    phrase = " ".join(f"k{i}" for i in range(12))
    rows = [(1, filler + " " + phrase + " " + filler, "e", "s"), (2, "same " * 300_000, "e", "s"), (3, phrase, "e", "s")]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in contamination(frame(spark, rows), spark.createDataFrame([(5, phrase), (6, "same " * 10)], ITEMS)).collect()}
    assert got == {1: (2_400_012, 12, 1), 2: (300_000, 300_000, 1), 3: (12, 12, 1)}


def test_proximity(spark):
    rows = [(1, "alpha x x beta y gamma", "e", "s"), (2, "gamma alpha beta", "e", "s"), (3, "alpha " + "x " * 30 + "beta gamma", "e", "s"), (4, "alpha beta", "e", "s")]
    benchmark = spark.createDataFrame([(1, "alpha beta gamma")], ITEMS)
    index = build_index(frame(spark, rows))
    near = {r.id: r.items for r in match(index, benchmark, slop=6).collect()}
    assert near == {1: ["1"], 2: ["1"], 3: [], 4: []}
    assert all(not r.items for r in match(index, benchmark).collect())
