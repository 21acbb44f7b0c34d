from __future__ import annotations

import hashlib
import io
import tarfile
import zlib

from panelspark.llm.files import resolve
from panelspark.llm.media import HEADER_BYTES, from_png, media_facts, media_features, media_metadata, media_payloads, png_header, to_png, write_media
from panelspark.llm.words import store

from .rows import documents, frame


def padded(text):
    raw = (text or "").encode()
    return raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))


def test_png_round_trip():
    for n in (1, 2, 7, 9, 300):
        samples = bytes(range(192)) * n
        media = to_png(samples)
        assert from_png(media) == samples
        assert png_header(media[:HEADER_BYTES]) == {"width": 64, "height": n, "bits": 8, "channels": 3}


def test_payloads_come_back(spark):
    rows = documents(20)
    rows += [(5000 + i, t, la, s) for i, t, la, s in rows[:10]]
    places = store(write_media(frame(spark, rows)), "places")
    at = {r.id: r for r in places.collect()}
    assert len(at) == len(rows)
    features = {r.media_sha256: r for r in media_features(places).collect()}
    payloads = {r.media_sha256: bytes(r.payload) for r in media_payloads(places).collect()}
    heads = {r.media_sha256: r for r in media_metadata(places).collect()}
    for doc, text, *_ in rows:
        want, row = padded(text), at[doc]
        seen = features[row.media_sha256]
        assert payloads[row.media_sha256] == want and row.n_bytes == len((text or "").encode())
        assert (seen.payload_bytes, seen.payload_sha256, seen.tail_crc32) == (len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert heads[row.media_sha256].height * 192 == len(want)
    by_payload = {}
    for doc, text, *_ in rows:
        place = (at[doc].media_sha256, at[doc].shard, at[doc].offset, at[doc].length)
        assert by_payload.setdefault(padded(text), place) == place  # one address for one content
    for shard in {r.shard for r in at.values()}:
        system, path = resolve(shard)
        with system.open_input_file(path) as f, tarfile.open(fileobj=io.BytesIO(f.read())) as tar:
            for member in tar:
                assert hashlib.sha256(tar.extractfile(member).read()).hexdigest() + ".png" == member.name


def test_hot_digests_keep_all_rows(spark):
    rows = [(i, "" if i % 3 else f"text {i}", "en", "s") for i in range(1500)] + [(7, None, "en", "s"), (1, "x" * 100000, "en", "s")]
    places = store(write_media(frame(spark, rows, partitions=4)), "places")
    got = media_facts(places).collect()
    want = [(i, len((t or "").encode()), hashlib.sha256(padded(t)).hexdigest(), len(padded(t)) // 192) for i, t, *_ in rows]
    assert sorted((r.id, r.n_bytes, r.payload_sha256, r.height) for r in got) == sorted(want)
    assert len({(r.media_sha256, r.shard, r.offset) for r in got}) == len({r.media_sha256 for r in got})


def test_empty_table_and_null_id(spark):
    assert write_media(frame(spark, [], partitions=1)).collect() == []
    assert media_facts(store(write_media(frame(spark, [], partitions=1)), "places")).collect() == []
    one = write_media(spark.createDataFrame([(None, None, "x", 1)], "doc_id long, text string, shard string, offset int")).collect()
    assert [(r.id, r.n_bytes) for r in one] == [(None, 0)]
