from __future__ import annotations

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelspark.llm.files import resolve
from panelspark.llm.records import TextEncoder, open_frames, read_index, read_records, read_shuffled, write_records

from .rows import ODD, documents, frame

FILE = public_tokenizers.path("byte_bpe_50k.json")
WHITE = ["a  b", "a  b  c　　 d", "x \u0085 y", "a\x1c b \x1f", "  z", "  ", "don't 'll  's 1 22 333", "\n\n  \n a", "a" + " " * 50 + "b", "“q” — ‘r’ … s"]


def test_pieces_give_the_ids_of_whole_texts():
    texts = [t or "" for t in ODD + WHITE] + [t or "" for _, t, *_ in documents(20)]
    tokenizer, encoder = Tokenizer.from_file(FILE), TextEncoder(open(FILE).read())
    for _ in range(2):  # the second time from the memo
        ids, bounds = encoder(pa.array(texts))
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_files_hold_every_document_in_order(spark):
    rows = documents(30)
    files = write_records(frame(spark, rows), FILE)
    tokenizer, at, expected = Tokenizer.from_file(FILE), 0, {}
    for doc, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        expected[doc] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32, r.ids) for r in read_records(files, with_ids=True).collect()} == expected
    shuffled = read_shuffled(files, seed=1, partitions=2).collect()
    assert {r.id: r.ids for r in shuffled} == {k: v[3] for k, v in expected.items()}
    assert [r.id for r in shuffled] != sorted(expected)
    last = None
    for f in sorted(files.collect(), key=lambda f: f.part):
        index = read_index(f.path)
        assert len(index) == f.records and (np.diff(index[:, 0]) > 0).all() and (last is None or index[0, 0] > last)
        last = index[-1, 0]
        system, path = resolve(f.path + ".records")
        with system.open_input_file(path) as stream:
            raw = bytearray(stream.read())
        n = struct.unpack_from("<Q", raw, 0)[0]
        assert n == index[0, 2] and len(raw) == index[:, 2].sum() + 16 * len(index)
        for spot in (3, 9, 20, 12 + n + 1):
            raw[spot] ^= 1
            with pytest.raises(ValueError):
                open_frames(bytes(raw), index)
            raw[spot] ^= 1
        assert len(open_frames(bytes(raw), index)[0]) == f.records


def test_repeats_nulls_and_empty_table(spark):
    least = -(1 << 63)
    rows = [(7, "b", "x", 1), (7, "a", "x", 1), (7, "b", "x", 1), (2, None, "x", 1), (None, "b", "x", 1), (None, None, "x", 1), (least, "a", "x", 1)]
    files = write_records(spark.createDataFrame(rows, "doc_id long, text string, path string, part int"), FILE)
    got = read_records(files).orderBy("start").collect()
    assert [(r.id, r.start) for r in got] == [(least, 0), (2, 2), (7, 3), (7, 5), (7, 7), (None, got[5].start), (None, got[6].start)]
    assert [r.n_tokens for r in got[:5]] == [2, 1, 2, 2, 2] and sorted(r.n_tokens for r in got[5:]) == [1, 2] and got[5].start == 9
    assert sorted(str(r.id) for r in read_shuffled(files, seed=3).collect()) == sorted(str(r[0]) for r in rows)
    assert read_records(write_records(frame(spark, [], partitions=1), FILE)).collect() == []
