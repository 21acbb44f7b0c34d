from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm.crc32c import crc32c
from panelspark.llm.words import NOT_ALNUM, SPACES, Words, blocks, grams, windows

from .rows import ODD, documents

TEXTS = [t for _, t, *_ in documents(10)] + ODD


@pytest.mark.parametrize("pattern, separators", [(r"[^\x20\x09-\x0D]+", SPACES), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", NOT_ALNUM)])
def test_words_are_those_of_the_pattern(pattern, separators):
    lowered = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in TEXTS]
    words = Words(pa.array(TEXTS, pa.string()).slice(0), separators, lower=True)
    raw = words.data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(words.starts[x:y], words.ends[x:y])] for x, y in zip(words.first[:-1], words.first[1:])]
    assert got == [re.findall(pattern, t) for t in lowered]


def test_equal_words_and_only_those_have_equal_hashes():
    words = Words(pa.array(TEXTS, pa.string()))
    raw = words.data.tobytes()
    by_hash = {}
    for a, b, h in zip(words.starts, words.ends, words.hashes()):
        assert by_hash.setdefault(h, raw[a:b]) == raw[a:b]
    assert len(by_hash) == len({raw[a:b] for a, b in zip(words.starts, words.ends)})


def test_windows_stay_inside_a_row():
    words = Words(pa.array(["a b c", None, "d e", "f g h i"]))
    assert windows(words, 3).tolist() == [0, 5, 6]
    assert len(grams(words.hashes(), 3)) == 7


def test_blocks_cover_all_rows_once():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 50, 3, 3)]})
    parts = list(blocks(iter([batch]), limit=10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) >= 3


def test_checksum_of_known_strings():
    data = b"123456789" + bytes(32) + b"123456789" * 300
    offsets = np.array([0, 9, 41, 41 + 2700])
    got = crc32c(np.frombuffer(data, np.uint8), offsets)
    assert got[0] == 0xE3069283 and got[1] == 0x8A9136AA
    state = 0xFFFFFFFF
    for byte in b"123456789" * 300:
        state ^= byte
        for _ in range(8):
            state = (state >> 1) ^ (0x82F63B78 if state & 1 else 0)
    assert got[2] == state ^ 0xFFFFFFFF
