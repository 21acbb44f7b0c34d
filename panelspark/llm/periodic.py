"""Periodic runs of words: maximal stretches in which words one period apart are identical.

A run of period q and at least four periods holds, for the power of two B with B <= q < 2B, a whole block of B words aligned to a
multiple of B that occurs again q words later. So at each dyadic scale B every aligned block is laid over the 2B words that follow it:
the sums of squared differences at all distances from B to 2B - 1 come from one convolution, done as an integer transform modulo
a prime. A zero is an occurrence without mismatch; consecutive blocks with the same distance form a chain, and the distance of a
chain seeds the extension, word by word, to the left and right, which also confirms the zero on the words' full 64-bit hashes.

Two tests spare work without losing a zero: a block is laid out only if three of its words each recur at some distance of the
scale, and a block whose whole window lies inside a run already found at a smaller scale can only repeat that run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ntt import PRIME, backward, forward, remainder
from .words import Words, blocks

#: A run has this many words and this many periods at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Array elements that a step of the search handles at once.
_STEP = 1 << 19


def _ragged(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size, one after another."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _rows(h: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(h, width)[starts]


def _parts(n: int, width: int) -> Iterator[slice]:
    step = max(1, _STEP // width)
    return (slice(i, min(n, i + step)) for i in range(0, n, step))


def _recur(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Does the word at each place occur again ``size`` to ``2 * size - 1`` words later?"""
    out = np.zeros(len(at), bool)
    for part in _parts(len(at), size):
        here = at[part]
        out[part] = (_rows(h, here + size, size) == h[here][:, None]).any(axis=1)
    return out


def _occurrences(h: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (block start, distance from ``size`` to ``2 * size - 1``) whose squared differences sum to zero modulo the prime."""
    prime = np.uint64(PRIME)
    found_at, found_distance = [], []
    for part in _parts(len(starts), 2 * size):
        here = starts[part]
        words = remainder(_rows(h, here, 3 * size))
        squares = np.cumsum(np.pad(remainder(words * words), ((0, 0), (1, 0))), axis=1)
        own = remainder(squares[:, size])
        later = remainder(squares[:, 2 * size:3 * size] - squares[:, size:2 * size])
        points = 2 * size
        block = np.zeros((points, len(here)), np.uint64)
        block[-np.arange(size)] = words[:, :size].T
        products = backward(remainder(forward(block) * forward(np.ascontiguousarray(words[:, size:].T))))[:size].T
        zero = remainder(later + own[:, None] + 2 * (prime - products)) == 0
        row, distance = np.nonzero(zero)
        found_at.append(here[row])
        found_distance.append(distance + size)
    return np.concatenate([np.zeros(0, np.int64), *found_at]), np.concatenate([np.zeros(0, np.int64), *found_distance])


def _chains(at: np.ndarray, distance: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the pairs by distance and place, the first pair of each chain and the number of pairs in it."""
    order = np.lexsort((at, distance))
    a, d, r = at[order], distance[order], row[order]
    linked = (a[1:] == a[:-1] + size) & (d[1:] == d[:-1]) & (r[1:] == r[:-1])
    heads = np.flatnonzero(np.concatenate([[True], ~linked])) if len(a) else np.zeros(0, np.int64)
    return order, heads, np.diff(np.append(heads, len(a)))


def _matching(h: np.ndarray, places: np.ndarray, inside: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """How many of each row's places, from the first on, lie inside and equal the word ``distance`` later."""
    places = np.where(inside, places, 0)
    same = inside & (h[places] == h[np.where(inside, places + distance[:, None], 0)])
    return np.where(same.all(axis=1), same.shape[1], same.argmin(axis=1))


def _extended(h: np.ndarray, low: np.ndarray, high: np.ndarray, distance: np.ndarray, first: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Grow the places ``low`` to ``high`` that equal the word ``distance`` later as far as that holds, by less than a block each way."""
    low, high = low.copy(), high.copy()
    for part in _parts(len(low), size):
        step = np.arange(size)
        left = low[part, None] - 1 - step
        right = high[part, None] + step
        low[part] -= _matching(h, left, left >= first[part, None], distance[part])
        high[part] += _matching(h, right, right + distance[part, None] < end[part, None], distance[part])
    return low, high


def find_runs(h: np.ndarray, first: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, start, length, period`` of every maximal run of the rows whose word hashes ``h`` start at ``first`` (n + 1 offsets).

    ``start`` counts from the row's first word. The period is the smallest one. Ordered by row, start and period.
    ``least_periods`` is 4 or more: only then every run holds an aligned block together with its next occurrence.
    """
    if least_periods < 4:
        raise ValueError("least_periods is 4 or more")
    counts = np.diff(first)
    longest = int(counts.max(initial=0))
    h = np.concatenate([h, np.zeros(longest + 3, np.uint64)])
    reach = np.zeros(len(h), np.int64)  # the end of the runs that start at a place or before it
    kept: list[np.ndarray] = []
    size = 1
    while least_periods * size <= longest:
        rows = np.flatnonzero(counts >= max(least_words, least_periods * size))
        many = counts[rows] // size - 1
        row = np.repeat(rows, many)
        at = first[row] + size * _ragged(many)
        end = first[row + 1]
        open_ = reach[at] < np.minimum(at + 3 * size, end)
        row, at, end = row[open_], at[open_], end[open_]
        for word in dict.fromkeys((0, size - 1, size // 2)):
            again = _recur(h, at + word, size)
            row, at, end = row[again], at[again], end[again]
        start, distance = _occurrences(h, at, size)
        which = np.searchsorted(at, start)
        row, end = row[which], end[which]
        good = (start + distance + size <= end) & (reach[start] < start + distance + size)
        start, distance, row = start[good], distance[good], row[good]
        while True:  # again only where a zero turns out to be one modulo the prime alone
            order, heads, length = _chains(start, distance, row, size)
            period = distance[order][heads]
            enough = length * size + 2 * (size - 1) >= np.maximum(least_periods * period, least_words) - period
            order = order[np.repeat(enough, length)]
            start, distance, row = start[order], distance[order], row[order]
            true = np.ones(len(start), bool)
            for part in _parts(len(start), size):
                true[part] = (_rows(h, start[part], size) == _rows(h, start[part] + distance[part], size)).all(axis=1)
            if true.all():
                break
            start, distance, row = start[true], distance[true], row[true]
        length = length[enough]
        heads = np.cumsum(length) - length
        low, period, row = start[heads], distance[heads], row[heads]
        low, high = _extended(h, low, low + length * size, period, first[row], first[row + 1], size)
        words = high - low + period
        good = (words >= np.maximum(least_words, least_periods * period)) & (reach[low] < low + words)
        if good.any():
            kept.append(np.stack([row, low, words, period])[:, good])
            np.maximum.at(reach, low[good], (low + words)[good])
            np.maximum.accumulate(reach, out=reach)
        size *= 2
    found = np.unique(np.concatenate([np.zeros((4, 0), np.int64), *kept], axis=1), axis=1)
    row, start, words, period = found[:, np.lexsort((found[3], found[1]))]
    return row, start - first[row], words, period


def looped_tails(ids: list[int | None], counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word that stands at each place once every tenth document's tail repeats a part of it, by the checksum of its id.

    With h the CRC-32 of the decimal id and g = h // 10: where h % 10 = 0, word i >= a becomes word a + (i - a) % p for a = g % n and
    p = 1 + (n - a) // (3 + g % 8). Rows without an id or without words stay as they are.
    """
    places = np.arange(int(first[-1]))
    for r, i in enumerate(ids):
        n = int(counts[r])
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            tail = np.arange(n - a)
            places[first[r] + a:first[r + 1]] = first[r] + a + tail % p
    return places


Rewrite = Callable[[list, np.ndarray, np.ndarray], np.ndarray]

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FACTS = "id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
_DETAIL = ", runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _joined(words: Words, which: np.ndarray, cut: np.ndarray) -> list[bytes]:
    """The chosen words of each row joined by one space; ``cut``: n + 1 offsets of the rows in ``which``."""
    sizes = (words.ends - words.starts)[which]
    inside = _ragged(sizes)
    joined = np.full(int(sizes.sum()) + len(which), 32, np.uint8)
    joined[np.arange(len(inside)) + np.repeat(np.arange(len(which)), sizes)] = words.data[np.repeat(words.starts[which], sizes) + inside]
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])[cut].tolist()
    raw = memoryview(joined.tobytes())
    return [raw[a:max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]


def _report(rewrite: Rewrite | None, detail: bool):
    nothing = hashlib.sha256(b"").hexdigest()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"))
            first, n = words.first, words.rows
            places = np.arange(len(words.doc)) if rewrite is None else rewrite(block.column("id").to_pylist(), words.counts, first)
            row, start, length, period = find_runs(words.hashes()[places], first)
            change = np.zeros(len(places) + 1, np.int64)
            np.add.at(change, first[row] + start + period, 1)
            np.add.at(change, first[row] + start + length, -1)
            left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
            collapsed = _joined(words, places[left], np.searchsorted(left, first))
            cut = np.searchsorted(row, np.arange(n + 1))
            best = np.lexsort((period, start, -length, row))
            has = cut[1:] > cut[:-1]
            best = best[np.minimum(cut[:-1], max(0, len(best) - 1))] if len(best) else np.zeros(n, np.int64)
            texts = [f"{s},{l},{p}\n" for s, l, p in zip(start.tolist(), length.tolist(), period.tolist())]
            columns = {"id": block.column("id"), "n_runs": pa.array(np.diff(cut))}
            for name, values in (("start", start), ("length", length), ("period", period), ("exponent_milli", 1000 * length // np.maximum(period, 1))):
                columns[name] = pa.array(values[best] if len(values) else np.zeros(n, np.int64), pa.int64(), mask=~has)
            columns["runs_sha256"] = pa.array([hashlib.sha256("".join(texts[a:b]).encode()).hexdigest() if b > a else nothing for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())], pa.string())
            columns["collapsed_sha256"] = pa.array([hashlib.sha256(t).hexdigest() for t in collapsed], pa.string())
            if detail:
                runs = [{"start": int(s), "length": int(l), "period": int(p)} for s, l, p in zip(start, length, period)]
                columns["runs"] = pa.array([runs[a:b] for a, b in zip(cut[:-1], cut[1:])], _RUNS)
                columns["collapsed"] = pa.array([bytes(t).decode() for t in collapsed], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return report


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rewrite: Rewrite | None = None, detail: bool = True) -> DataFrame:
    """``doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256`` and, with ``detail``, ``runs, collapsed``.

    Words are `[^\\x20\\x09-\\x0D]+`, numbered from 0. A run is a stretch of consecutive words with smallest period q, of
    max(6, 4 q) words at least, that no neighbouring word extends. ``start``, ``length``, ``period`` and
    ``exponent_milli`` (1000 * length / period, rounded down) are those of the longest run (ties: smallest start, then
    period); null where there is none. ``runs`` lists all, by start and period; ``runs_sha256`` is the digest of their lines
    `start,length,period`. A word is dropped if any run contains it after that run's first period; ``collapsed`` are the
    words left, joined by one space. ``rewrite`` says which word of a document stands at each of its places.

    One pass over the texts in blocks of whole documents, no shuffle; a task's memory is bounded by its block, which is one document
    where that is longer, times a constant. Null and blank texts have no words, no runs and an empty collapsed text. Rows are
    judged one by one: null ids, repeated ids and repeated texts each give their own row, columns beside id and text don't matter.
    """
    schema = _FACTS + _DETAIL * detail
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return docs.mapInArrow(_report(rewrite, detail), schema).withColumnRenamed("id", "doc_id")
