"""Documents for the tests: a slice of the smallest tables and rows that are odd in some way."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"

ODD = [None, "", "   \t\n ", "one", "Two words", " a  b c   d", "café ÉTÉ naïve 日本語 \U0001f389 x▁y",
       "x" * 5000, "0" * 4000 + " 1.2.3.4 ", "same words here now ok yes", "Same WORDS here now ok yes", "tab\tand\nnew line\r\nand\x0bvt\x1cfs",
       "mail a.b+c@d-e.co.uk, 255.255.255.255 256.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 +1 (555) 010-9999 +12 x@y a@b.c@d.e",
       "<|endoftext|> don't  we'll   see\n\n\nthe end "]


def documents(n: int = 60, seed: int = 4) -> list[tuple]:
    """(doc_id, text, lang, source): near copies, shared passages, odd rows and a long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    texts = list(ODD)
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        if i % 4 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(10):rng.randint(20, 40)]
        texts.append(" ".join(words))
        if i % 3 == 0:
            near = list(words)
            for _ in range(rng.choice((0, 1, 1, 3))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            texts.append("  ".join(near) + rng.choice(("", " ", ".")))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(30_000)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [(i, t, "en", "src0") for i, t in zip(ids, texts)]


SCHEMA = "doc_id long, text string, lang string, source string"


def frame(spark, rows, schema: str = SCHEMA, partitions: int = 3):
    return spark.createDataFrame(rows, schema).repartition(partitions)
