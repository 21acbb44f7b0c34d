"""Benchmark decontamination on a positional inverted index of the training tokens.

The index is dealt by document: a shard holds the postings of a block of whole documents, as sorted term hashes, the
bounds of each term's list and the list itself: positions in the shard, ascending, with a gap between documents so
that no phrase runs over a document's end. Test windows are looked up shard by shard: lists are intersected from the
rarest term on, each shifted by its offset in the window.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import scratch_dir

from .files import Output, attempt_name, resolve
from .words import NOT_ALNUM, Words, blocks, shuffle_partitions, store

WINDOW = 10
#: Test texts are looked up in blocks of at most so many bytes (one item at least), so what travels to the tasks is bounded.
TEST_BLOCK_BYTES = 8 << 20
_SHARD = "shard string, gap int, ids binary, first binary, terms binary, bounds binary, postings binary"
_MATCH = "id long, n_words long, n_hit long, items array<string>, hit_words array<int>"


def _index(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"), NOT_ALNUM, lower=True)
            first = words.first + gap * np.arange(words.rows + 1)
            at = np.arange(len(words.doc)) + gap * words.doc
            hashes = words.hashes()
            order = np.argsort(hashes, kind="stable")
            terms, starts = np.unique(hashes[order], return_index=True)
            bounds = np.append(starts, len(order))
            yield pa.RecordBatch.from_pydict({
                "shard": [uuid.uuid4().hex], "gap": pa.array([gap], pa.int32()),
                "ids": pa.array([np.asarray(block.column("id").fill_null(-(1 << 63)), np.int64).tobytes()], pa.binary()),
                "first": pa.array([first.astype(np.int64).tobytes()], pa.binary()), "terms": pa.array([terms.tobytes()], pa.binary()),
                "bounds": pa.array([bounds.astype(np.uint32).tobytes()], pa.binary()), "postings": pa.array([at[order].astype(np.uint32).tobytes()], pa.binary())})
    return run


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", gap: int = 64) -> DataFrame:
    """The stored index: one row for each shard of about 4 MB of whole texts, no shuffle.

    Terms are words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. ``gap`` positions lie between
    two documents; phrases and proximity reach over less than that. A null text has no words.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return store(rows.mapInArrow(_index(gap), _SHARD), "positional-index")


class Shard:
    """Lookups in one row of the index."""

    def __init__(self, row: dict):
        self.gap = row["gap"]
        self.ids, self.first = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["first"], np.int64)
        self.terms, self.bounds = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["bounds"], np.uint32)
        self.postings = np.frombuffer(row["postings"], np.uint32)

    def counts(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each term and its number of postings (0: not in the shard)."""
        place = np.minimum(np.searchsorted(self.terms, terms), max(len(self.terms) - 1, 0))
        if not len(self.terms):
            return place, np.zeros(len(terms), np.int64)
        return place, np.where(self.terms[place] == terms, self.bounds[place + 1] - self.bounds[place], 0).astype(np.int64)

    def list_of(self, place: int) -> np.ndarray:
        return self.postings[self.bounds[place]:self.bounds[place + 1]].astype(np.int64)

    def rows_at(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, positions, "right") - 1


def _among(values: np.ndarray, postings: np.ndarray) -> np.ndarray:
    """Which values are in an ascending list."""
    at = np.minimum(np.searchsorted(postings, values), len(postings) - 1)
    return postings[at] == values


def phrase_starts(shard: Shard, places: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions at which a window's terms follow each other: lists are met from the rarest on."""
    order = np.argsort(counts, kind="stable")
    starts = shard.list_of(places[order[0]]) - order[0]
    for j in order[1:]:
        starts = starts[_among(starts + j, shard.list_of(places[j]))]
        if not len(starts):
            break
    return starts


def near_positions(shard: Shard, places: np.ndarray, counts: np.ndarray, slop: int) -> np.ndarray:
    """The positions of the rarest term that have every other term of the window within ``slop`` words, in any order."""
    order = np.argsort(counts, kind="stable")
    centres = shard.list_of(places[order[0]])
    for j in order[1:]:
        other = shard.list_of(places[j])
        right = np.searchsorted(other, centres)
        near = (right < len(other)) & (other[np.minimum(right, len(other) - 1)] - centres <= slop)
        near |= (right > 0) & (centres - other[np.maximum(right - 1, 0)] <= slop)
        centres = centres[near]
        if not len(centres):
            break
    return centres


class Tests:
    """The distinct windows of some items by length, and the items of each window."""

    def __init__(self, ids: list[str], texts: list[str], size: int = WINDOW):
        words = Words(pa.array(texts, pa.large_string()), NOT_ALNUM, lower=True)
        hashes = words.hashes()
        windows: dict[tuple, list[str]] = {}
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            for start in range(a, max(a + 1, b - size + 1)) if b > a else ():
                windows.setdefault(tuple(hashes[start:min(start + size, b)].tolist()), []).append(ids[i])
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        for n in sorted({len(w) for w in windows}):
            same = [w for w in windows if len(w) == n]
            self.by_length[n] = (np.array(same, np.uint64), [sorted(set(windows[w])) for w in same])


def _cut_items(folder: str):
    """The items of a partition in blocks of bounded size, each a file in the shared folder; its path is the row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def written() -> pa.RecordBatch:
            path = f"{folder}/{attempt_name('items')}.arrow"
            out = Output(path)
            table = pa.table({"item": pa.array(ids, pa.string()), "text": pa.array(texts, pa.large_string())})
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            out.write(sink.getvalue().to_pybytes())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                if held and held + len(text) > TEST_BLOCK_BYTES:
                    yield written()
                    ids, texts, held = [], [], 0
                ids.append(item)
                texts.append(text)
                held += len(text)
        if ids:
            yield written()
    return run


def _read_items(path: str, size: int) -> Tests:
    system, name = resolve(path)
    with system.open_input_file(name) as f:
        table = pa.ipc.open_stream(f.read()).read_all()
    return Tests(table.column("item").to_pylist(), table.column("text").to_pylist(), size)


def _lookup(paths: list[str], size: int, slop: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = path_of = None
        for batch in batches:
            shards = [Shard(row) for row in batch.to_pylist()]
            hits = [np.zeros(int(s.first[-1]) + 1, bool) for s in shards]
            owners_of: list[dict[int, set[str]]] = [{} for _ in shards]
            for path in paths:  # one block of items in memory; every shard of the batch meets it
                if path_of != path:
                    tests, path_of = _read_items(path, size), path
                for shard, hit, items in zip(shards, hits, owners_of):
                    _meet(shard, tests, slop, hit, items)
            for shard, hit, items in zip(shards, hits, owners_of):
                yield _judged(shard, hit, items)
    return run


def _meet(shard: Shard, tests: Tests, slop: int | None, hit: np.ndarray, items: dict[int, set[str]]) -> None:
    """Mark the words of a shard inside occurrences of the windows, and note the items by row."""
    for n, (windows, owners) in tests.by_length.items():
        places, counts = shard.counts(windows.ravel())
        places, counts = places.reshape(-1, n), counts.reshape(-1, n)
        for w in np.flatnonzero(counts.min(1) > 0).tolist():
            if slop is None:
                at = phrase_starts(shard, places[w], counts[w])
                for j in range(n):
                    hit[at + j] = True
            else:
                at = near_positions(shard, places[w], counts[w], slop)
                hit[at] = True
            for r in np.unique(shard.rows_at(at)).tolist():
                items.setdefault(r, set()).update(owners[w])


def _judged(shard: Shard, hit: np.ndarray, items: dict[int, set[str]]) -> pa.RecordBatch:
    where = np.flatnonzero(hit)
    bounds = np.searchsorted(where, shard.first)
    n_words = np.diff(shard.first) - shard.gap
    out = {"id": [], "n_words": [], "n_hit": [], "items": [], "hit_words": []}
    for r, doc in enumerate(shard.ids.tolist()):
        own = where[bounds[r]:bounds[r + 1]] - shard.first[r]
        out["id"].append(None if doc == -(1 << 63) else doc)
        out["n_words"].append(int(n_words[r]))
        out["n_hit"].append(len(own))
        out["items"].append(sorted(items.get(r, ())))
        out["hit_words"].append(own.astype(np.int32))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})


def match(index: DataFrame, benchmark: DataFrame, item_column: str = "item_id", text_column: str = "text", size: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``id, n_words, n_hit, items, hit_words`` of every document in the index.

    A window is ``size`` consecutive words of an item; an item with fewer, but not none, is one window. Without ``slop``,
    windows are exact phrases: ``hit_words`` are the word numbers inside any occurrence. With ``slop``, a window matches where
    all its terms lie within ``slop`` words of an occurrence of its rarest term, whose word numbers are given; ``slop``
    has to be smaller than the index's gap. ``items`` are the items (as strings) with a matching window. The items are a
    stated query set: tasks write them to the shared folder in blocks of at most ``TEST_BLOCK_BYTES`` (one item at least), and every
    task of the index reads block after block for its shards. The driver sees the blocks' paths only. Items without words or
    id never match; an item given twice counts once.
    """
    tests = benchmark.select(F.col(item_column).cast("string").alias("item"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).where("item is not null")
    folder = scratch_dir(index.sparkSession, "benchmark-items")
    paths = sorted(r.path for r in store(tests.coalesce(shuffle_partitions(index.sparkSession)).mapInArrow(_cut_items(folder), "path string"), "benchmark-blocks").collect())
    return index.mapInArrow(_lookup(paths, size, slop), _MATCH)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs`` (doc_id, text)."""
    found = match(build_index(docs), benchmark)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark window; all columns stay.

    Contamination is a matter of the text alone, so the index knows texts by their 64-bit hash: null and repeated ids don't matter, rows
    with equal texts go or stay together. (Of a billion texts one is taken for a contaminated one with a chance of about one in a
    million for every twenty contaminated texts.)
    """
    texts = docs.select(F.xxhash64(text_column).alias("doc_id"), F.col(text_column).alias("text"))
    bad = contamination(texts, benchmark).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.xxhash64(docs[text_column]) == bad["__bad"], "left_anti")
