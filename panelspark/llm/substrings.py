"""Repeated passages from suffixes partitioned by word prefixes of variable length.

The suffixes of all documents are split by word prefixes: a prefix whose suffixes would not fit in memory is extended by a
word. Each memory-sized group of prefixes is one table in memory. No tree is built inside it: of the suffix tree only the nodes
at window depth are held, as sorted 64-bit hashes of windows, and every one that suffixes of two documents reach is a repeat.
Adjacent repeats of a document join to its maximal repeats. Words are 64-bit hashes, a prefix is known by leading bits of
its words' hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Words, blocks, grams, shuffle_partitions, windows

WINDOW = 13
#: Suffixes that one group may hold (8 bytes each and as much again for their documents).
GROUP_SUFFIXES = 1 << 20
#: Groups of prefixes that the plan names at most. Beyond GROUP_SUFFIXES times this many suffixes a group of prefixes is dealt
#: to several tables by the hash of the window, so that these keep their size and the plan stays bounded.
MOST_GROUPS = 4096
#: Bytes of text that meet their repeats in one table.
BUCKET_BYTES = 128 << 20
BLOCK = 4 << 20
_BYTES = -1
_FIRST_BITS, _NEXT_BITS = 12, 8


class Plan:
    """The tree of prefixes: for each depth a table from (node, code of the next word) to a group, or to -1 - a deeper node."""

    def __init__(self, levels: list[np.ndarray], groups: int, splits: int = 1, text_bytes: int = 0):
        self.levels, self.groups, self.splits, self.text_bytes = levels, groups, splits, text_bytes

    def part(self, groups: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The table of a leaf: its group, and where groups are dealt to several tables, a share of the windows' hashes."""
        return groups.astype(np.int64) * self.splits + (node % np.uint64(self.splits)).astype(np.int64)

    def place(self, words: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        """The group (or -1 - node, where the plan ends) of the suffixes that start at ``starts``."""
        at = np.full(len(starts), -1, np.int64)
        for depth, table in enumerate(self.levels[:size]):
            deeper = np.flatnonzero(at < 0) if depth else np.arange(len(starts))
            if not len(deeper):
                break
            at[deeper] = table[cell(words[starts[deeper] + depth], -1 - at[deeper], depth)]
        return at


def cell(word: np.ndarray, node: np.ndarray, depth: int) -> np.ndarray:
    if depth == 0:
        return (word >> np.uint64(64 - _FIRST_BITS)).astype(np.int64)
    return (node << _NEXT_BITS) + (word >> np.uint64(64 - _NEXT_BITS)).astype(np.int64)


def _counts(plan: Plan, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, total = len(plan.levels), {}
        for block in blocks(batches):
            words = Words(block.column("text"))
            if not depth:
                total[_BYTES] = total.get(_BYTES, 0) + len(words.data)
            if not len(words.doc):
                continue
            hashes, starts = words.hashes(), windows(words, size)
            node = np.zeros(len(starts), np.int64)
            if depth:
                place = plan.place(hashes, starts, size)
                starts, node = starts[place < 0], -1 - place[place < 0]
            cells, n = np.unique(cell(hashes[starts + depth], node, depth), return_counts=True)
            for c, k in zip(cells.tolist(), n.tolist()):
                total[c] = total.get(c, 0) + k
        yield pa.RecordBatch.from_pydict({"cell": pa.array(list(total), pa.int64()), "n": pa.array(list(total.values()), pa.int64())})
    return run


def prefix_plan(docs: DataFrame, size: int = WINDOW, group_suffixes: int = GROUP_SUFFIXES, most_groups: int = MOST_GROUPS) -> Plan:
    """Count the suffixes below each prefix, one pass for each prefix length, and extend the prefixes that are too large.

    What comes to the driver are counts of prefix cells: 4096 for one word, 256 for each prefix that is extended, of which
    there are ``most_groups`` at most at every depth. A prefix as deep as a window is one node and not extended. The first
    pass also counts the bytes of all texts.
    """
    levels: list[np.ndarray] = []
    leaves: list[tuple[tuple, int, int, int]] = []
    paths: list[tuple] = [()]
    most, text_bytes = group_suffixes, 0
    while paths and len(levels) < size:
        depth = len(levels)
        found = docs.select("text").mapInArrow(_counts(Plan(levels, 0), size), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        table = np.zeros((1 << _FIRST_BITS) if depth == 0 else len(paths) << _NEXT_BITS, np.int64)
        if depth == 0:
            text_bytes = sum(r.n for r in found if r.cell == _BYTES)
            found = [r for r in found if r.cell != _BYTES]
            most = max(group_suffixes, -(-sum(r.n for r in found) // most_groups))
        deeper: list[tuple] = []
        for r in sorted(found):
            path = (*paths[r.cell >> _NEXT_BITS if depth else 0], r.cell)
            if r.n > most and depth + 1 < size:
                table[r.cell] = -1 - len(deeper)
                deeper.append(path)
            else:
                leaves.append((path, depth, r.cell, r.n))
        levels.append(table)
        paths = deeper
    group = held = 0
    for _, depth, c, n in sorted(leaves):  # neighbouring prefixes share a group as long as they fit
        if held and held + n > most:
            group, held = group + 1, 0
        levels[depth][c] = group
        held += n
    return Plan(levels, group + 1, -(-most // group_suffixes), text_bytes)


def _first_of(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (node, document) leaves, and the smallest document below each one's node."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    head = np.ones(len(keys), bool)
    head[1:] = keys[1:] != keys[:-1]
    new = head.copy()
    new[1:] |= docs[1:] != docs[:-1]
    return keys[new], docs[new], docs[np.flatnonzero(head)][np.cumsum(head) - 1][new]


def _pack(groups: np.ndarray, docs: np.ndarray, keys: np.ndarray, local: bool) -> dict[str, list]:
    """One row for each group: its documents (ascending), the number of nodes of each, the nodes."""
    order = np.lexsort((docs, groups))
    groups, docs, keys = groups[order], docs[order], keys[order]
    out: dict[str, list] = {"part": [], "local": [], "docs": [], "counts": [], "keys": []}
    edges = np.flatnonzero(np.diff(groups)) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(groups)]):
        if b > a:
            own, n = np.unique(docs[a:b], return_counts=True)
            out["part"].append(int(groups[a]))
            out["local"].append(local)
            out["docs"].append(np.diff(own, prepend=0).tobytes())
            out["counts"].append(n.astype(np.uint32).tobytes())
            out["keys"].append(keys[a:b].tobytes())
    return out


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    docs = np.cumsum(np.frombuffer(row["docs"], np.int64))
    return np.repeat(docs, np.frombuffer(row["counts"], np.uint32)), np.frombuffer(row["keys"], np.uint64)


_PACKED = pa.schema([("part", pa.int64()), ("local", pa.bool_()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
_PACKED_DDL = "part long, local boolean, docs binary, counts binary, keys binary"
_FOUND = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids ^ (ids >> 11) ^ (ids >> 23)) % buckets


def bucket_of(doc_id: Column, buckets: int) -> Column:
    """The bucket of a document in which its text and the repeats found in it meet (``_bucket`` as a column)."""
    return F.pmod(doc_id.bitwiseXOR(F.shiftright(doc_id, 11)).bitwiseXOR(F.shiftright(doc_id, 23)), F.lit(buckets))


def _suffixes(plan: Plan, size: int):
    """A block's suffixes by group. Of a node that several documents of the block reach only the smallest document's leaf
    travels; the others are repeats already."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK):
            words = Words(block.column("text"))
            starts = windows(words, size)
            if not len(starts):
                continue
            hashes = words.hashes()
            ids = np.asarray(block.column("id"), np.int64)[words.doc[starts]]
            node = grams(hashes, size)[starts]
            place = plan.place(hashes, starts, size).astype(np.int32)
            del words, hashes, starts  # the block's largest arrays
            by_node = np.argsort(node, kind="stable")
            keys, docs, least = _first_of(node, ids)
            groups = place[by_node][np.searchsorted(node[by_node], keys)]
            del node, ids, place, by_node
            first = docs == least
            parts = plan.part(groups, keys)
            parts[~first] = docs[~first] % (plan.groups * plan.splits)
            for part, where in ((_pack(parts[first], docs[first], keys[first], False), first), (_pack(parts[~first], docs[~first], keys[~first], True), ~first)):
                if where.any():
                    yield pa.RecordBatch.from_pydict(part, _PACKED)
    return run


def _subtrees(buckets: int):
    """The repeats of a group: leaves below nodes that a smaller document reaches too, one row for each bucket of documents."""
    def run(table: pa.Table) -> pa.Table:
        docs, keys, known = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], []
        for row in table.to_pylist():
            d, k = _unpack(row)
            if row["local"]:
                known.append((d, k))
            else:
                docs.append(d)
                keys.append(k)
        k, d, least = _first_of(np.concatenate(keys), np.concatenate(docs))
        known.append((d[d > least], k[d > least]))
        d, k = np.concatenate([x for x, _ in known]), np.concatenate([x for _, x in known])
        packed = _pack(_bucket(d, buckets), d, k, False)
        return pa.Table.from_pydict({"bucket": packed["part"], **{c: packed[c] for c in ("docs", "counts", "keys")}}, _FOUND)
    return run


def repeats(docs: DataFrame, buckets: int, plan: Plan, size: int = WINDOW) -> DataFrame:
    """``bucket, docs, counts, keys``: by bucket of documents, packed hashes of the windows whose words also start in a document
    with a smaller id. ``docs`` has ``id`` (not null) and ``text``.
    """
    leaves = docs.mapInArrow(_suffixes(plan, size), _PACKED_DDL)
    return leaves.groupBy("part").applyInArrow(_subtrees(buckets), "bucket long, docs binary, counts binary, keys binary")


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64())]))


def _runs(gone: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """The maximal runs of removed words of each row."""
    head = np.zeros(len(gone) + 1, bool)
    head[first] = True
    here, before = np.append(gone, False), np.insert(gone, 0, False)
    begin, end = np.flatnonzero(here & (head | ~before)), np.flatnonzero(before & (head | ~here))
    cut = np.searchsorted(begin, first)
    return [[{"first_word": int(x - first[r]), "n_words": int(y - x)} for x, y in zip(begin[cut[r]:cut[r + 1]], end[cut[r]:cut[r + 1]])] for r in range(len(first) - 1)]


def _strip(size: int, detail: bool):
    def strip(batches: Iterator[pa.RecordBatch], found: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"))
            covered = np.zeros(len(words.doc) + 1, np.int64)
            ids = block.column("id").to_pylist()
            if any(i in found for i in ids):
                node = grams(words.hashes(), size)
                starts = windows(words, size)
                row_starts = np.searchsorted(starts, words.first)
                for r, i in enumerate(ids):
                    if i in found:
                        own = starts[row_starts[r]:row_starts[r + 1]]
                        hit = own[np.isin(node[own], found[i])]
                        covered[hit] += 1
                        covered[hit + size] -= 1
            gone = np.cumsum(covered[:-1]) > 0
            kept = np.flatnonzero(~gone)
            sizes = (words.ends - words.starts)[kept]
            source = np.repeat(words.starts[kept] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            joined = np.full(int(sizes.sum()) + len(kept), 32, np.uint8)
            joined[np.arange(len(source)) + np.repeat(np.arange(len(kept)), sizes)] = words.data[source]
            ends = np.concatenate([[0], np.cumsum(sizes + 1)])[np.searchsorted(kept, words.first)]
            raw = joined.tobytes()
            texts = [raw[a:max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            columns = {"id": block.column("id"), "n_words": pa.array(words.counts.astype(np.int64)), "n_removed": pa.array(removed.astype(np.int64)),
                       "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
            if detail:
                columns |= {"kept_text": pa.array([t.decode() for t in texts], pa.string()), "spans": pa.array(_runs(gone, words.first), _SPANS)}
            yield pa.RecordBatch.from_pydict(columns)

    def run(texts: pa.Table, replies: pa.Table) -> pa.Table:
        docs, keys = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for row in replies.to_pylist():
            d, k = _unpack(row)
            docs.append(d)
            keys.append(k)
        docs, keys = np.concatenate(docs), np.concatenate(keys)
        order = np.argsort(docs, kind="stable")
        own, first = np.unique(docs[order], return_index=True)
        found = dict(zip(own.tolist(), np.split(keys[order], first[1:]))) if len(own) else {}
        schema = pa.schema(_DETAIL if detail else _DETAIL[:4])
        return pa.Table.from_batches(strip(iter(texts.to_batches()), found), schema)
    return run


_DETAIL = [("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("spans", _SPANS)]


def remove_repeats(docs: DataFrame, size: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", detail: bool = True, group_suffixes: int = GROUP_SUFFIXES,
                   most_groups: int = MOST_GROUPS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` and, with ``detail``, ``kept_text, spans`` of every row.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window is ``size`` consecutive words of one document. Every word covered by a
    window whose words also start in a document with a smaller id is removed; windows are judged on the input. ``spans`` are
    the removed maximal runs (word number, length), ``kept_text`` the kept words joined by one space.

    What travels: one leaf (8 bytes and its document) for each distinct window of a block of whole documents, by group; the
    found windows and the texts, by bucket of documents: as many as shuffle partitions, and more where a bucket would hold over
    ``bucket_bytes`` of text. A passage that very many documents share costs one leaf for each block, not for each document, so no
    group grows with the number of copies in a block. Groups hold ``group_suffixes`` suffixes or one node, whatever the input.

    Null and blank texts: no words, nothing removed. Shorter documents than a window keep all. Rows without an id are neither
    judged nor a source and are spread over all buckets. Rows that repeat an id are one document: a row's windows are removed if a smaller id has them.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    known = docs.where("id is not null")
    plan = prefix_plan(known, size, group_suffixes, most_groups)
    buckets = max(shuffle_partitions(docs.sparkSession), -(-plan.text_bytes // bucket_bytes))
    found = repeats(known, buckets, plan, size)
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<struct<first_word: long, n_words: long>>" * detail
    texts = docs.withColumn("bucket", F.coalesce(bucket_of(F.col("id"), buckets), F.pmod(F.monotonically_increasing_id(), F.lit(buckets))))
    stripped = texts.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(_strip(size, detail), schema)
    return stripped.withColumnRenamed("id", "doc_id")
