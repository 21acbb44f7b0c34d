from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from panelspark.llm.pieces import Encoder, _merged, compatible, decode, decode_pieces, encode_pieces, load_pieces, round_trips

from .rows import ODD, documents, frame

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return load_pieces(FILE)


def ids_of(pieces, texts):
    ids, bounds = Encoder(pieces)(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def texts_of(spark, sf):
    return [r.text or "" for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("text").collect()]


def test_ids_are_the_models(spark, pieces):
    """Id for id what the library gives, for the documents and for texts that are odd in some way."""
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = random.Random(3)
    parts = ["th", "on", "er", "é", "ñ", "Z", "!", "日", "本", "\U0001f389", "\n", "qx", "ing", " ", "  ", "   ", "a", "aa", "=", "==", "ß", "0", "1", "Ω"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(1, 400))) for _ in range(300)]  # long chunks
    texts += ["x" * 5000, "ab" * 3000, " " * 100 + "a", "the" * 999, "日本語" * 700, "é" * 4001 + "\n", "", " ", "international", "the house is green"]
    texts += [t.replace("▁", "_") for t in [x or "" for x in ODD] + [t or "" for _, t, *_ in documents(30)]] + texts_of(spark, "sf0.01")
    for text, own, want in zip(texts, ids_of(pieces, texts), model.encode(texts)):
        assert own == want, text[:200]


def test_compatible_pairs_equal_merging_their_text(pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    rng = np.random.default_rng(4)
    known = np.concatenate([ids for _, ids in pieces.by_length.values()])
    left = rng.choice(known, 20_000)
    near = known[np.argsort(rng.random(len(known)))]
    right = np.where(rng.random(len(left)) < 0.5, rng.choice(known, len(left)), rng.choice(near[:300], len(left)))
    text = lambda i: pieces.pool[pieces.bounds[i]:pieces.bounds[i + 1]].tobytes().decode()
    order = {text(i): r for i, r in enumerate(pieces.rank.tolist()) if r >= 0}
    ok = compatible(pieces, left, right)
    assert 0.05 < ok.mean() < 0.995
    for a, b, good in zip(left.tolist(), right.tolist(), ok.tolist()):
        assert (_merged(text(a) + text(b), order)[0] == [text(a), text(b)]) == good, (text(a), text(b))
    assert len(known) > 31_000 and model.vocab_size() == len(pieces.rank)


def test_very_long_chunk_takes_linear_time(pieces):
    import time

    def took(n):
        start = time.process_time()
        assert sum(ids_of(pieces, ["xy" * n])[0]) > 0
        return time.process_time() - start

    took(100)
    assert took(40_000) < 12 * max(took(8_000), 0.05)


def test_other_models_are_refused(tmp_path):
    with open(FILE, "rb") as f:
        spec = proto.ModelProto.FromString(f.read())
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    (tmp_path / "unigram.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError, match="merges"):
        load_pieces(str(tmp_path / "unigram.model"))


def test_decoding_gives_every_text_back(pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    texts = [t or "" for t in ODD] + [t or "" for _, t, *_ in documents(10)]
    for text, ids in zip(texts, ids_of(pieces, texts)):
        assert decode(pieces, np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode() == text
        assert model.decode(ids) == text
    assert ids_of(pieces, ["a▁b"])[0] != ids_of(pieces, ["a b"])[0]


def test_columns(spark, pieces):
    rows = documents(10)
    df = frame(spark, [(i, t, s, [1]) for i, t, _, s in rows], "doc_id long, text string, row string, ids array<int>")
    encoded = encode_pieces(df, FILE)
    back = decode_pieces(encoded, FILE)
    assert back.columns == ["doc_id", "text", "row", "ids", "piece_ids", "decoded"]
    for r in back.collect():
        assert r.decoded == (r.text or "") and r.ids == [1] and r.piece_ids == ids_of(pieces, [r.text])[0]
    assert all(r.round_trip and r.n_pieces == len(ids_of(pieces, [dict((i, t) for i, t, *_ in rows)[r.doc_id]])[0]) for r in round_trips(df, FILE).collect())
    flagged = encode_pieces(df, FILE, round_trip="row")
    assert flagged.columns == ["doc_id", "text", "ids", "piece_ids", "row"] and all(r.row is True and r.piece_ids == ids_of(pieces, [r.text])[0] for r in flagged.collect())
    empty = frame(spark, [], partitions=1)
    assert decode_pieces(encode_pieces(empty, FILE), FILE).collect() == [] and round_trips(empty, FILE).collect() == []
    assert decode_pieces(spark.createDataFrame([(None,), ([],)], "piece_ids array<int>"), FILE).collect()[0].decoded == ""
