"""Token ids as length-delimited binary records with masked checksums and a separate offset index.

A record is ``length`` (8 bytes), its masked CRC-32C (4), the data and the data's masked CRC-32C (4), little-endian: the
framing that record readers of training frameworks share. The data is one serialized sequence: the document id (8
bytes), the bytes of one id (2 or 4, with the highest bit set where the document has no id), then the ids. The index file has (document id,
offset, data length) as three 8-byte integers for each record; without an id the smallest integer stands for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.session import scratch_dir

from .crc32c import crc32c, masked
from .files import Output, Ranges, attempt_name, resolve
from .memo import PieceMemo
from .words import SPACES, blocks, shuffle_partitions, store, text_bytes

HEAD, TAIL, META = 12, 4, 9
READ_BYTES = 4 << 20
#: The bit beside a record's id width, and the integer in the id's place, where a document has no id.
NO_ID, NO_ID_MARK = 0x80, -(1 << 63)
#: Bytes 0x1C-0x1F and the white space beyond ASCII: rows with any of it are not cut into pieces.
_ODD_SPACE = np.zeros(256, bool)
_ODD_SPACE[[*range(0x1C, 0x20)]] = True


def _odd_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with white space other than the six ASCII characters."""
    odd = _ODD_SPACE[data]
    at = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if len(at):
        a, b, c = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
        odd[at] |= ((a == 0xC2) & ((b == 0x85) | (b == 0xA0))) | ((a == 0xE1) & (b == 0x9A)) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))
        odd[at] |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))) | ((b == 0x81) & (c == 0x9F)))
    return np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1)


class TextEncoder:
    """Encodes texts with the tokenizers library, each distinct piece once.

    A byte-level pre-tokenizer never joins a character with white space that follows it, so a text may be cut before
    every run of white space: its ids are those of its pieces.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.memo = PieceMemo(self._encode)

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after the other, and the n + 1 bounds of the rows."""
        data, offsets = text_bytes(column)
        cut = SPACES[data]
        cut[1:] &= ~cut[:-1]
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        for r in _odd_rows(data, offsets).tolist():
            cut[offsets[r] + 1:offsets[r + 1]] = False
        starts = np.flatnonzero(cut)
        ids, sizes = self.memo(data, starts, np.append(starts[1:], len(data))[:len(starts)])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]


def _frames(doc_ids: np.ndarray, nameless: np.ndarray, ids: np.ndarray, bounds: np.ndarray, end_id: int, width: int) -> tuple[bytes, np.ndarray]:
    """The framed records of a block and the data length of each."""
    kind = np.uint16 if width == 2 else np.uint32
    data = []
    for doc, no_id, a, b in zip(doc_ids.tolist(), nameless.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        data.append(doc.to_bytes(8, "little", signed=True) + bytes([width | NO_ID * no_id]) + np.append(ids[a:b], end_id).astype(kind).tobytes())
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    whole = np.frombuffer(b"".join(data), np.uint8)
    body = masked(crc32c(whole, np.concatenate([[0], np.cumsum(lengths)]))).astype("<u4").tobytes()
    heads = lengths.astype("<u8").tobytes()
    crcs = masked(crc32c(np.frombuffer(heads, np.uint8), np.arange(len(data) + 1) * 8)).astype("<u4").tobytes()
    parts = []
    for i, record in enumerate(data):
        parts += [heads[8 * i:8 * i + 8], crcs[4 * i:4 * i + 4], record, body[4 * i:4 * i + 4]]
    return b"".join(parts), lengths


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str) -> TextEncoder:
    """One encoder for all tasks of a worker, with the pieces it has met."""
    return TextEncoder(tokenizer_json)


def _write(tokenizer_json: str, folder: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = out = index = None
        records = tokens = 0
        for block in blocks(batches, limit=2 << 20):
            if encoder is None:
                encoder = _encoder(tokenizer_json)
                path = f"{folder}/{attempt_name('ids')}"
                out, index = Output(path + ".records"), Output(path + ".index")
            ids, bounds = encoder(block.column("text"))
            nameless = block.column("id").is_null().to_numpy(zero_copy_only=False)
            doc_ids = block.column("id").fill_null(NO_ID_MARK).to_numpy(zero_copy_only=False)
            frames, lengths = _frames(doc_ids, nameless, ids, bounds, end_id, width)
            sizes = lengths + HEAD + TAIL
            at = out.write(frames) + np.cumsum(sizes) - sizes
            index.write(np.stack([doc_ids, at, lengths], 1).astype("<i8").tobytes())
            records, tokens = records + len(lengths), tokens + int(((lengths - META) // width).sum())
        if out is not None:
            out.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "path": [path], "records": pa.array([records], pa.int64()),
                                              "tokens": pa.array([tokens], pa.int64())})
    return run


def write_records(docs: DataFrame, tokenizer_file: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end_id`` and write record files in ascending id order; return the table of files.

    The rows are range-partitioned by id (one shuffle of the texts); part p's file holds smaller ids than part p + 1's.
    The table has ``part, path`` (to which .records and .index are added), ``records, tokens`` and ``first_token``, the
    tokens of all files before. The tokenizer's file (``tokenizer_file``) is read on the driver and travels with the task. A null
    text is empty; rows with a null id come last, in records that say so; rows with equal ids stay together, in the order of their texts' hashes.
    """
    folder = folder or scratch_dir(docs.sparkSession, "records")
    source = Path(tokenizer_file).read_text(encoding="utf-8")
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_str(source).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    order = (F.asc_nulls_last("id"), F.xxhash64("text"))
    ordered = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    parts = store(ordered.mapInArrow(_write(source, folder, end_id, width), "part long, path string, records long, tokens long"), "record-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return store(parts.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0))), "record-table")


def read_index(path: str) -> np.ndarray:
    """The rows (id, offset, data length) of a file's offset index."""
    system, name = resolve(path + ".index")
    with system.open_input_file(name) as f:
        return np.frombuffer(f.read(), "<i8").reshape(-1, 3)


def open_frames(raw: bytes, index: np.ndarray) -> tuple[list[np.ndarray], list[bool]]:
    """The id sequences of consecutive records and which have no document id; lengths, checksums and document ids are verified."""
    buffer = np.frombuffer(raw, np.uint8)
    at, lengths = index[:, 1] - index[0, 1], index[:, 2]
    heads = np.ascontiguousarray(buffer[at[:, None] + np.arange(HEAD)])
    data = buffer[np.repeat(at + HEAD - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
    ends = np.cumsum(lengths)
    stored = np.ascontiguousarray(buffer[(at + HEAD + lengths)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    good = (np.ascontiguousarray(heads[:, :8]).view("<i8")[:, 0] == lengths) & (stored == masked(crc32c(data, np.concatenate([[0], ends]))))
    good &= np.ascontiguousarray(heads[:, 8:]).view("<u4")[:, 0] == masked(crc32c(np.ascontiguousarray(heads[:, :8]).ravel(), np.arange(len(at) + 1) * 8))
    if not good.all():
        raise ValueError(f"record at {index[~good][0, 1]}: damaged")
    out, nameless = [], []
    for doc, a, b in zip(index[:, 0].tolist(), (ends - lengths).tolist(), ends.tolist()):
        record = data[a:b].tobytes()
        if int.from_bytes(record[:8], "little", signed=True) != doc:
            raise ValueError(f"record of {record[:8]!r} under id {doc}")
        out.append(np.frombuffer(record, "<u2" if record[8] & ~NO_ID == 2 else "<u4", offset=META))
        nameless.append(bool(record[8] & NO_ID))
    return out, nameless


def _read(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        for batch in batches:
            for row in batch.to_pylist():
                index = read_index(row["path"])
                at, first = row["first_token"], 0
                while first < len(index):
                    last = max(first + 1, int(np.searchsorted(index[:, 1], index[first, 1] + READ_BYTES)))
                    part = index[first:last]
                    begin, end = int(part[0, 1]), int(part[-1, 1] + part[-1, 2] + HEAD + TAIL)
                    sequences, nameless = open_frames(ranges.read(row["path"] + ".records", begin, end - begin), part)
                    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
                    columns = {"id": pa.array(part[:, 0], pa.int64(), mask=np.array(nameless)), "start": pa.array(at + np.cumsum(sizes) - sizes), "n_tokens": pa.array(sizes),
                               "ids_crc32": pa.array([zlib.crc32(s.astype("<u4").tobytes()) for s in sequences], pa.int64())}
                    if with_ids:
                        columns["ids"] = pa.array([s.astype(np.int32) for s in sequences], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(columns)
                    at, first = at + int(sizes.sum()), last
    return run


def read_records(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` (and ``ids``) of every record, read sequentially, one file for a task."""
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    dealt = files.repartition(shuffle_partitions(files.sparkSession), "part")
    return dealt.mapInArrow(_read(with_ids), schema)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            index = read_index(row["path"])
            yield pa.RecordBatch.from_pydict({"path": pa.array([row["path"]] * len(index), pa.string()), "id": pa.array(index[:, 0]), "offset": pa.array(index[:, 1]),
                                              "length": pa.array(index[:, 2])})


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranges = Ranges(32)
    for batch in batches:
        for row in batch.to_pylist():
            one = np.array([[row["id"], row["offset"], row["length"]]])
            (ids,), (no_id,) = open_frames(ranges.read(row["path"] + ".records", row["offset"], row["length"] + HEAD + TAIL), one)
            yield pa.RecordBatch.from_pydict({"id": pa.array([None if no_id else row["id"]], pa.int64()), "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))})


def read_shuffled(files: DataFrame, seed: int, partitions: int | None = None) -> DataFrame:
    """``id, ids`` of every record in an order that only the seed decides: the index rows are shuffled, the records are range reads."""
    n = partitions or shuffle_partitions(files.sparkSession)
    places = files.mapInArrow(_list, "path string, id long, offset long, length long")
    order = F.xxhash64("id", "offset", F.lit(seed))
    return places.repartition(n, order).sortWithinPartitions(order).mapInArrow(_fetch, "id long, ids array<int>")
