"""SentencePiece encoding and decoding with the model's own ids: a batched Viterbi table in numpy.

The model file builds pieces by merges: of all neighbouring symbols whose concatenation is a piece, those with the best score are joined, leftmost
first, until nothing can be joined. What merges give is a segmentation in which every two neighbours are compatible: merging their
joint text gives the two again. So it can be found like the best path of a Viterbi search, with one best last piece for each place: a piece
may end at a place only if it is compatible with the last piece at its beginning, and exactly one is.

A text gets a leading space and is cut wherever no piece holds the two characters at the cut, because no merge can cross it: before spaces
and beside unknown characters among others. Distinct chunks are encoded once. Chunks of similar length advance together, place by place: the
hashes of all substrings of a length probe the sorted keys of the pieces of that length, compatibility is looked up in a sorted table
of pairs, and a vectorised maximum over the compatible pieces stores the backpointer. A character that is no piece is
written as its byte pieces; so is a literal U+2581, which the model file uses for the space, so that decoding gives every text back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memo import PieceMemo
from .words import PrefixHash, blocks, text_bytes

SPACE_MARK = "▁"
#: Cells of one table of places.
TABLE_CELLS = 1 << 20


@dataclass
class Pieces:
    """A model's ordinary pieces and what merging them needs.

    ``by_length``: byte length -> sorted keys and ids. ``rank``: the order in which a piece is merged (-1: a character). ``parts``: the two
    pieces that its last merge joins. ``joins``: sorted ``left * n + right`` of all pairs that make a piece, ``joined``: its rank.
    ``letters``: character -> number among those of the pieces; ``beside``: may the two stand beside each other in a piece?
    """

    by_length: dict[int, tuple[np.ndarray, np.ndarray]]
    rank: np.ndarray
    parts: np.ndarray
    joins: np.ndarray
    joined: np.ndarray
    letters: np.ndarray
    beside: np.ndarray
    byte_ids: np.ndarray
    pool: np.ndarray
    bounds: np.ndarray


def _merged(text: str, order: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The symbols that merging a short text leaves, and the two that were joined last."""
    symbols, last = list(text), None
    while len(symbols) > 1:
        ranks = [order.get(a + b, np.inf) for a, b in zip(symbols, symbols[1:])]
        k = int(np.argmin(ranks)) if len(ranks) > 8 else min(range(len(ranks)), key=ranks.__getitem__)
        if ranks[k] == np.inf:
            break
        last = (symbols[k], symbols[k + 1])
        symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
    return symbols, last


def load_pieces(model_file: str) -> Pieces:
    """Read a model of merges that has byte pieces, a dummy prefix and identity normalization (refused otherwise).

    Also refused: models in which merging a piece's text doesn't give the piece, or gives it before its parts.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(model_file, "rb") as f:
        raw = f.read()
    spec = proto.ModelProto()
    spec.ParseFromString(raw)
    rules = spec.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not spec.trainer_spec.byte_fallback:
        raise ValueError("only models with byte pieces, a dummy prefix and identity normalization")
    if spec.trainer_spec.model_type != proto.TrainerSpec.BPE:
        raise ValueError("only models of merges")
    model = sentencepiece.SentencePieceProcessor(model_proto=raw)
    n = model.vocab_size()
    texts, ids, byte_ids = [""] * n, {}, np.zeros(256, np.int32)
    stored = [b""] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            stored[i] = bytes([int(piece[3:5], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            texts[i] = piece.replace(SPACE_MARK, " ")
            stored[i] = texts[i].encode()
            ids[texts[i]] = i
    order = {t: -model.get_score(i) for t, i in ids.items() if len(t) > 1}
    rank, parts = np.full(n, -1.0), np.full((n, 2), -1, np.int32)
    joins = {}
    for t, i in ids.items():
        if len(t) == 1:
            continue
        left, last = _merged(t, order)
        if len(left) > 1 or any(order.get(x, -1.0) > order[t] for x in last):
            raise ValueError(f"merging doesn't give the piece {t!r} after its parts")
        rank[i], parts[i] = order[t], [ids[x] for x in last]
        for k in range(1, len(t)):
            if t[:k] in ids and t[k:] in ids:
                joins[ids[t[:k]] * n + ids[t[k:]]] = order[t]
    keys = np.array(sorted(joins), np.int64)
    sizes = np.fromiter(map(len, stored), np.int64, n)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    pool = np.frombuffer(b"".join(stored), np.uint8)
    known = np.array(sorted(ids.values()))
    hashes = PrefixHash(pool).of(bounds[known], bounds[known + 1])
    by_length = {}
    for size in np.unique(sizes[known]).tolist():
        same = np.flatnonzero(sizes[known] == size)
        same = same[np.argsort(hashes[same])]
        by_length[size] = (hashes[same], known[same].astype(np.int32))
    alphabet = sorted({ord(c) for t in ids for c in t})
    letters = np.zeros(0x110000, np.int32)
    letters[alphabet] = np.arange(1, len(alphabet) + 1)
    beside = np.zeros((len(alphabet) + 1,) * 2, bool)
    for t in ids:
        numbers = letters[[ord(c) for c in t]]
        beside[numbers[:-1], numbers[1:]] = True
    return Pieces(by_length, rank, parts, keys, np.array([joins[k] for k in keys.tolist()]), letters, beside, byte_ids, pool, bounds)


def compatible(pieces: Pieces, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Does merging the joint text of two pieces give the two again? For all pairs at once.

    The merges inside both are undone from the last one back. At each state the symbols that touch may be joined, if they make a piece: that
    happens before the left one's own next merge if its rank is lower, and before the right one's if it is not higher (of equal ranks the
    leftmost comes first). ``limit``: the rank of a symbol's own next merge.
    """
    n = len(pieces.rank)
    ok = np.ones(len(left), bool)
    a, b = left.astype(np.int64), right.astype(np.int64)
    limit_a, limit_b = np.full(len(a), np.inf), np.full(len(a), np.inf)
    live = np.arange(len(a))
    while len(live):
        key = a[live] * n + b[live]
        at = np.minimum(np.searchsorted(pieces.joins, key), len(pieces.joins) - 1)
        rank = np.where(pieces.joins[at] == key, pieces.joined[at], np.inf)
        crossed = (rank < limit_a[live]) & (rank <= limit_b[live])
        ok[live[crossed]] = False
        rank_a, rank_b = pieces.rank[a[live]], pieces.rank[b[live]]
        go = ~crossed & ((rank_a >= 0) | (rank_b >= 0))
        live, rank_a, rank_b = live[go], rank_a[go], rank_b[go]
        first = rank_a > rank_b
        x, y = live[first], live[~first]
        limit_a[x], a[x] = rank_a[first], pieces.parts[a[x], 1]
        limit_b[y], b[y] = rank_b[~first], pieces.parts[b[y], 0]
    return ok


class PairTable:
    """Which pairs of pieces are compatible, as sorted keys, filled with the pairs that are asked for."""

    def __init__(self, pieces: Pieces):
        self.pieces, self.keys, self.ok = pieces, np.zeros(0, np.int64), np.zeros(0, bool)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        n = len(self.pieces.rank)
        key = left.astype(np.int64) * n + right
        at = np.searchsorted(self.keys, key)
        there = np.minimum(at, max(0, len(self.keys) - 1))
        new = self.keys[there] != key if len(self.keys) else np.ones(len(key), bool)
        if new.any():
            fresh = np.unique(key[new])
            place = np.searchsorted(self.keys, fresh)
            self.keys, self.ok = np.insert(self.keys, place, fresh), np.insert(self.ok, place, compatible(self.pieces, fresh // n, fresh % n))
            there = np.searchsorted(self.keys, key)
        return self.ok[there]


def _characters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the characters of UTF-8 bytes begin, and their code points."""
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[heads].astype(np.int32)
    if not len(lead) or int(lead.max()) < 0x80:
        return heads, lead
    size = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(size == 1, lead, lead & (0xFF >> (size + 1)))
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        code[more] = (code[more] << 6) | (data[heads[more] + k] & 0x3F)
    return heads, code


def _tables(pieces: Pieces, pairs: PairTable, hashes: PrefixHash, starts: np.ndarray, sizes: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chunks that advance together: (chunk, place) tables of the last piece up to a place (-1: an unknown character) and where it begins.

    ``alone``: chunks that are one unknown character.
    """
    n, longest = len(starts), int(sizes.max())
    piece, back = np.full((n, longest + 1), -1, np.int32), np.full((n, longest + 1), -1, np.int32)
    back[:, 0] = 0
    rows, begins, ends, found = [], [], [], []
    for length, (known, ids) in pieces.by_length.items():
        if length > longest:
            continue
        row, begin = np.nonzero(np.arange(longest - length + 1) + length <= sizes[:, None])
        at = starts[row] + begin
        keys = hashes.of(at, at + length)
        place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        hit = known[place] == keys
        rows.append(row[hit])
        begins.append(begin[hit])
        ends.append(begin[hit] + length)
        found.append(ids[place[hit]])
    row, begin, end, found = (np.concatenate(x) for x in (rows, begins, ends, found))
    order = np.argsort(end, kind="stable")
    row, begin, end, found = row[order], begin[order], end[order], found[order]
    cut = np.searchsorted(end, np.arange(longest + 2))
    for place in range(1, longest + 1):
        here = slice(cut[place], cut[place + 1])
        r, b, p = row[here], begin[here], found[here]
        before = piece[r, b]
        good = back[r, b] >= 0  # a place inside a character is no end of a prefix
        behind = good & (b > 0)
        good[behind] = pairs(before[behind], p[behind])
        # of the pieces that may end here one is compatible; the largest beginning among them is its beginning
        best = np.full(n, -1, np.int32)
        np.maximum.at(best, r[good], b[good].astype(np.int32))
        chosen = good & (best[r] == b)
        piece[r[chosen], place], back[r[chosen], place] = p[chosen], b[chosen]
    back[alone, sizes[alone]] = 0
    return piece, back


def segment(pieces: Pieces, pairs: PairTable, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of chunks ``data[starts:ends]``, one after the other, and how many each has."""
    hashes = PrefixHash(data)
    sizes = ends - starts
    lead = data[starts] if len(starts) else np.zeros(0, np.uint8)
    # chunks of one character that is no piece
    alone = sizes == 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    for length in np.unique(sizes[alone]).tolist():
        at = np.flatnonzero(alone & (sizes == length))
        known = pieces.by_length[length][0] if length in pieces.by_length else np.zeros(0, np.uint64)
        alone[at] = ~np.isin(hashes.of(starts[at], ends[at]), known)
    parts: list[np.ndarray] = []  # rows of (chunk, id, start, end)
    classes = np.where(sizes <= 32, sizes, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    for size in np.unique(classes).tolist():
        members = np.flatnonzero(classes == size)
        step = max(1, TABLE_CELLS // (int(sizes[members].max()) + 1))
        for k in range(0, len(members), step):
            chunks = members[k:k + step]
            piece, back = _tables(pieces, pairs, hashes, starts[chunks], sizes[chunks], alone[chunks])
            rows, at = np.arange(len(chunks)), sizes[chunks].copy()
            while len(rows):
                begin = back[rows, at].astype(np.int64)
                base = starts[chunks[rows]]
                parts.append(np.stack([chunks[rows], piece[rows, at].astype(np.int64), base + begin, base + at], 1))
                rows, at = rows[begin > 0], begin[begin > 0]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64)
    table = np.concatenate(parts)
    table = table[np.lexsort((table[:, 2], table[:, 0]))]
    unknown = table[:, 1] < 0
    width = np.where(unknown, table[:, 3] - table[:, 2], 1)
    ids = np.repeat(table[:, 1], width)
    byte_at = np.repeat(table[:, 2] - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
    spelled = np.repeat(unknown, width)
    ids[spelled] = pieces.byte_ids[data[byte_at[spelled]]]
    return ids.astype(np.int32), np.bincount(table[:, 0], width, len(starts)).astype(np.int64)


class Encoder:
    def __init__(self, pieces: Pieces):
        pairs = PairTable(pieces)
        self.pieces = pieces
        self.memo = PieceMemo(lambda data, starts, ends: segment(pieces, pairs, data, starts, ends), slots=1 << 20)

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, one after the other, and the n + 1 bounds of the rows."""
        data, offsets = text_bytes(column)
        lengths = np.diff(offsets)
        shift = np.cumsum(lengths > 0)
        padded = np.full(len(data) + int(shift[-1] if len(shift) else 0), 32, np.uint8)  # a space in front of every text
        padded[np.arange(len(data)) + np.repeat(shift, lengths)] = data
        offsets = offsets + np.concatenate([[0], shift])
        heads, code = _characters(padded)
        letter = self.pieces.letters[code]
        cut = np.ones(len(heads), bool)
        cut[1:] = ~self.pieces.beside[letter[:-1], letter[1:]]
        cut[np.searchsorted(heads, offsets[:-1][offsets[:-1] < len(padded)])] = True
        starts = heads[cut]
        ids, sizes = self.memo(padded, starts, np.append(starts[1:], len(padded))[:len(starts)])
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]


_encoders: dict[bytes, Encoder] = {}


def shared_encoder(pieces: Pieces) -> Encoder:
    """One encoder for all tasks of a worker that use the same model, with the chunks it has met."""
    key = hashlib.sha256(pieces.pool.tobytes() + pieces.byte_ids.tobytes()).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(pieces)
    return _encoders[key]


def decode(pieces: Pieces, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of each row's ids, without the leading space."""
    sizes = pieces.bounds[ids + 1] - pieces.bounds[ids]
    ends = np.cumsum(sizes)
    raw = pieces.pool[np.repeat(pieces.bounds[ids] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
    edges = np.concatenate([[0], ends])[bounds].tolist()
    return [raw[a + 1:b] if raw[a:a + 1] == b" " else raw[a:b] for a, b in zip(edges[:-1], edges[1:])]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of 2 MB of the last column."""
    for batch in batches:
        yield from blocks([batch], batch.schema.names[-1], 2 << 20)


def _encode(pieces: Pieces, checked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(pieces)
        for block in _rows(batches):
            column = block.column(block.num_columns - 1)
            ids, bounds = encoder(column)
            made = {"ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))}
            if checked:
                data, offsets = text_bytes(column)
                raw = data.tobytes()
                back = decode(pieces, ids.astype(np.int64), bounds)
                made["same"] = pa.array([raw[a:b] == t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), back)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*block.columns[:-1], *made.values()], [*block.schema.names[:-1], *made])
    return run


def _decode(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                lists = part.column(part.num_columns - 1)
                values, bounds = np.asarray(lists.flatten(), np.int64), np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0), np.int64))])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([t.decode() for t in decode(pieces, values, bounds)], pa.string())], [*part.schema.names[:-1], "decoded"])
    return run


def _append(df: DataFrame, source: str, task, made: dict[str, tuple[str, T.DataType]]) -> DataFrame:
    """``df`` with the columns ``made`` (target -> name and type in the task) of ``source``; the other columns travel in one
    struct, whatever their names."""
    packed = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), F.col(source).alias("source"))
    out = packed.mapInArrow(task, T.StructType([packed.schema["row"], *[T.StructField(name, kind) for name, kind in made.values()]]))
    return out.select(*[F.col("row").getField(c).alias(c) for c in df.columns if c not in made], *[F.col(name).alias(target) for target, (name, _) in made.items()])


def encode_pieces(df: DataFrame, model_file: str, text_column: str = "text", target: str = "piece_ids", round_trip: str | None = None) -> DataFrame:
    """``df`` with the piece ids (array of int) of every whole text; null and empty texts have none.

    With ``round_trip`` a column of that name says whether the ids decode to the text. The model is read on the driver and
    travels with the tasks (its size is that of the vocabulary). No shuffle. Columns already named so are replaced.
    """
    made = {target: ("ids", T.ArrayType(T.IntegerType()))} | ({round_trip: ("same", T.BooleanType())} if round_trip else {})
    return _append(df, text_column, _encode(load_pieces(model_file), round_trip is not None), made)


def decode_pieces(df: DataFrame, model_file: str, ids_column: str = "piece_ids", target: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for; null and empty lists give the empty text."""
    return _append(df, ids_column, _decode(load_pieces(model_file)), {target: ("decoded", T.StringType())})


def _summary(pieces: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(pieces)
        for block in blocks(batches, limit=2 << 20):
            ids, bounds = encoder(block.column("text"))
            data, offsets = text_bytes(block.column("text"))
            raw = data.tobytes()
            back = decode(pieces, ids.astype(np.int64), bounds)
            same = [raw[a:b] == t for a, b, t in zip(offsets[:-1].tolist(), offsets[1:].tolist(), back)]
            crcs = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            is_byte = np.zeros(len(pieces.bounds), bool)
            is_byte[pieces.byte_ids] = True
            yield pa.RecordBatch.from_pydict({
                "id": block.column("id"), "n_pieces": pa.array(np.diff(bounds)), "n_byte_pieces": pa.array(np.diff(np.concatenate([[0], np.cumsum(is_byte[ids])])[bounds])),
                "ids_crc32": pa.array(crcs, pa.int64()), "decoded_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in back], pa.string()), "round_trip": pa.array(same, pa.bool_())})
    return run


def round_trips(docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_pieces, n_byte_pieces, ids_crc32, decoded_sha256, round_trip`` of every row: encoded, decoded again and compared.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian unsigned 32-bit integers. A null text counts as empty.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_summary(load_pieces(model_file)), f"id {kind}, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean").withColumnRenamed("id", "doc_id")
