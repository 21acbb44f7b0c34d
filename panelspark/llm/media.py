"""Media columns: payloads as PNG members of tar shards, addressed by content digest, offset and length."""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import scratch_dir

from .files import Output, Ranges, attempt_name
from .words import blocks, store, text_bytes

ROW_BYTES = 192
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Digests that hold more than one in so many rows are hot; there are fewer than this.
MOST_HOT = 1024
_PLACES = "id long, n_bytes long, media_sha256 string, shard string, offset long, length long"


def payload(text: bytes) -> bytes:
    """The text filled up with bytes 32 to a positive multiple of 192."""
    return text.ljust(max(1, -(-len(text) // ROW_BYTES)) * ROW_BYTES, b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(samples: bytes, level: int = 6) -> bytes:
    """Samples as rows of 64 RGB pixels of 8 bits, every row stored unfiltered."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, ROW_BYTES)
    lines = np.zeros((len(rows), ROW_BYTES + 1), np.uint8)
    lines[:, 1:] = rows
    header = struct.pack(">IIBBBBB", ROW_BYTES // 3, len(rows), 8, 2, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> dict[str, int]:
    """Width, height, bits and channels from the first 33 bytes."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    return {"width": width, "height": height, "bits": bits, "channels": {0: 1, 2: 3, 6: 4}[colour]}


def from_png(data: bytes) -> bytes:
    """The samples of a PNG that ``to_png`` wrote; every chunk's checksum is verified."""
    shape = png_header(data[:HEADER_BYTES])
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at:at + 8])
        body = data[at + 8:at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + n:at + 12 + n])[0]:
            raise ValueError("PNG chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape["height"], -1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:].tobytes()


def feature(samples: bytes, shape: dict[str, int]) -> str:
    """Shape, mean of each channel and a 64-bit average hash: is a cell of an 8 x 8 grid at least as bright as the image?"""
    pixels = np.frombuffer(samples, np.uint8).reshape(shape["height"], shape["width"], shape["channels"])
    means = "/".join(f"{m:.3f}" for m in pixels.reshape(-1, shape["channels"]).mean(0))
    grey = pixels.sum(2, dtype=np.int64)
    edges = (np.arange(8) * shape["height"]) // 8
    cells = np.add.reduceat(np.add.reduceat(grey, np.arange(0, shape["width"], shape["width"] // 8), axis=1), edges, axis=0)
    heights = np.maximum(np.diff(np.append(edges, shape["height"])), 1)
    bright = cells * grey.size >= grey.sum() * (heights[:, None] * (shape["width"] // 8))
    return f"{shape['width']}x{shape['height']}x{shape['channels']}:{means}:{np.packbits(bright).tobytes().hex()}"


def _write(folder: str, level: int):
    """One shard for each task; a payload that the task has met before is not stored again, its first place is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, places = "", None, {}
        for block in blocks(batches):
            data, offsets = text_bytes(block.column("text"))
            rows = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                if out is None:
                    shard = f"{folder}/{attempt_name('shard')}.tar"
                    out = Output(shard)
                samples = payload(data[a:b].tobytes())
                key = hashlib.sha256(samples).digest()
                if key not in places:
                    media = to_png(samples, level)
                    digest = hashlib.sha256(media).hexdigest()
                    member = tarfile.TarInfo(f"{digest}.png")
                    member.size = len(media)
                    out.write(member.tobuf(tarfile.GNU_FORMAT))
                    at = out.write(media)
                    out.write(b"\0" * (-len(media) % 512))
                    places[key] = (digest, at, len(media))
                rows.append((b - a, *places[key]))
            n_bytes, digests, at, length = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(n_bytes, pa.int64()), pa.array(digests, pa.string()), pa.array([shard] * len(rows), pa.string()),
                 pa.array(at, pa.int64()), pa.array(length, pa.int64())], ["id", "n_bytes", "media_sha256", "shard", "offset", "length"])
        if out is not None:
            out.write(b"\0" * 1024)
            out.close()
    return run


def beside(rows: DataFrame, facts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the facts of their digests; ``facts`` makes one row for each ``media_sha256`` of the rows it is given.

    Rows of a digest that holds more than a share of 1 / MOST_HOT of all rows (empty texts, mass copies) meet their facts by broadcast, of
    fewer than MOST_HOT rows of fixed size; only the others are dealt by digest, so no task gets one digest's rows. ``rows`` is
    a stored table.
    """
    counts = rows.groupBy("media_sha256").agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(store(counts.where(F.col("n") * MOST_HOT > rows.count()).select("media_sha256"), "hot-digests"))
    few, many = rows.join(hot, "media_sha256", "left_anti"), rows.join(hot, "media_sha256", "left_semi")
    return few.join(facts(few), "media_sha256").unionByName(many.join(F.broadcast(facts(many)), "media_sha256"))


def write_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", folder: str | None = None, level: int = 6) -> DataFrame:
    """Store every text as a PNG member of a tar shard; return ``id, n_bytes, media_sha256, shard, offset, length``, one row per row.

    Each task streams its rows into one tar of its own under ``folder`` (the shared folder if not given), so no payload is
    shuffled and a repeated task writes a fresh file. Within a shard a payload is stored once; across shards the index
    names, for each digest, the smallest (shard, offset), and every row points there; copies in other shards are
    members that nothing points to, at most one for each shard and payload. Null texts are empty (192 spaces); repeated rows and
    ids are rows of their own with equal places; a very long text is one member. A digest that very many rows share is not dealt to
    one task (``beside``).
    """
    folder = folder or scratch_dir(docs.sparkSession, "media")
    rows = store(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(_write(folder, level), _PLACES.replace("id long", f"id {docs.schema[id_column].dataType.simpleString()}")), "media-rows")
    def index(part: DataFrame) -> DataFrame:
        return part.groupBy("media_sha256").agg(F.min(F.struct("shard", "offset", "length")).alias("place"))

    return beside(rows, index).select("id", "n_bytes", "media_sha256", "place.*")


def _read(columns: dict[str, pa.DataType], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500).to_pylist()
                for row in rows:
                    media = ranges.read(row["shard"], row["offset"], row["length"] if whole else min(HEADER_BYTES, row["length"]))
                    row |= png_header(media[:HEADER_BYTES])
                    if whole:
                        if hashlib.sha256(media).hexdigest() != row["media_sha256"]:
                            raise ValueError(f"{row['shard']} at {row['offset']}: not the content of its address")
                        samples = from_png(media)
                        row |= {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]),
                                "feature": feature(samples, row), "payload": samples}
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in columns.items()], list(columns))
    return run


def _contents(places: DataFrame) -> DataFrame:
    """One row for each stored payload that rows point to, dealt by place so that a task reads a shard in order."""
    once = places.groupBy("media_sha256").agg(F.min("shard").alias("shard"), F.min("offset").alias("offset"), F.min("length").alias("length"))
    return once.repartition("shard", F.col("offset").bitwiseAND(F.lit(~0xFFFFFF))).sortWithinPartitions("shard", "offset")


def media_metadata(places: DataFrame) -> DataFrame:
    """``media_sha256, width, height, bits, channels`` of each payload, from range reads of 33 bytes."""
    columns = {"media_sha256": pa.string(), **dict.fromkeys(("width", "height", "bits", "channels"), pa.int64())}
    return _contents(places).mapInArrow(_read(columns, False), "media_sha256 string, width long, height long, bits long, channels long")


def media_features(places: DataFrame) -> DataFrame:
    """``media_sha256, payload_bytes, payload_sha256, tail_crc32, feature`` of each payload, from its stored bytes."""
    columns = {"media_sha256": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "feature": pa.string()}
    return _contents(places).mapInArrow(_read(columns, True), "media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")


def media_facts(places: DataFrame) -> DataFrame:
    """The stored table ``places`` with the columns of ``media_features`` and ``media_metadata``."""
    return beside(places, lambda part: media_features(part).join(media_metadata(part), "media_sha256"))


def media_payloads(places: DataFrame) -> DataFrame:
    """``media_sha256, payload`` (binary), read back from the shards."""
    return _contents(places).mapInArrow(_read({"media_sha256": pa.string(), "payload": pa.binary()}, True), "media_sha256 string, payload binary")
