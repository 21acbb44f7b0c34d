"""Trailing windows of whole Arrow batches: what a moving row frame of ``rolling.py`` gives, without an aggregate for each row.

``rolled`` deals the panel by entity, sorts it by date and adds any number of trailing columns in one pass; a column may be taken from one
that was named before it. A batch holds many entities; the rows of one entity, one for each date, stay together. A window is a line
of a strided view, so a task holds a block of windows and nothing that grows with the panel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .packed import codes
from .rolling import default_min_obs

#: Entries of the block of windows that is worked on at a time.
_BLOCK = 1 << 18


class Roll(NamedTuple):
    """One trailing column: the kind, its inputs, the window and the values it needs."""

    kind: str
    inputs: tuple[str, ...]
    w: int
    need: int


def roll(kind: str, x, w: int = 1, min_obs: int | None = None) -> Roll:
    """``kind``: sum, mean, min, max, var, std, skew, median, corr (two inputs), drawdown, delay (``w`` rows back).

    ``less`` and ``ratio`` take two columns of one row (``w`` is 1): the difference, and the quotient that is missing for a zero below.
    """
    return Roll(kind, (x,) if isinstance(x, str) else tuple(x), w, default_min_obs(w) if min_obs is None else min_obs)


def rolled(df: DataFrame, entity: str = "entity", date: str = "date", **columns: Roll) -> DataFrame:
    """``df`` with trailing columns over each entity's rows by date (doubles, missing as their operators in ``rolling.py`` say)."""
    kept = [f for f in df.schema.fields if f.name not in columns]
    schema = T.StructType([*kept, *[T.StructField(c, T.DoubleType()) for c in columns]])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_entities(batches, entity):
            yield _with_columns(t, entity, names, columns)

    rows = df.select(*[f"`{c}`" for c in df.columns])
    return rows.repartition(entity).sortWithinPartitions(entity, date).mapInArrow(run, schema)


def _whole_entities(batches: Iterator[pa.RecordBatch], entity: str) -> Iterator[pa.RecordBatch]:
    """Batches cut where the entity changes; the last entity of a batch waits for the next one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        t = pa.Table.from_batches(held)
        code = codes(t[entity])
        cut = np.flatnonzero(code[1:] != code[:-1])
        if len(cut):
            end = int(cut[-1]) + 1
            yield t.slice(0, end).combine_chunks().to_batches()[0]
            held = t.slice(end).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _with_columns(b: pa.RecordBatch, entity: str, names: list[str], columns: dict[str, Roll]) -> pa.RecordBatch:
    code = codes(b.column(entity))
    n = len(code)
    first = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1))
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    found: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def of(name: str):
        if name not in found:
            c = b.column(name).cast(pa.float64())
            found[name] = (c.fill_null(0.0).to_numpy(zero_copy_only=False), ~c.is_null().to_numpy(zero_copy_only=False))
        return found[name]

    for out, r in columns.items():
        found[out] = _column(r, [of(x) for x in r.inputs], first, group)
    made = [pa.array(found[c][0], mask=~found[c][1]) for c in columns]
    return pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *made], names=[*names, *columns])


def _column(r: Roll, inputs, first: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and their presence. Entities are set apart by empty rows, so that no window reaches into another entity."""
    has = np.logical_and.reduce([m for _, m in inputs])
    if r.kind == "less":
        return np.where(has, inputs[0][0] - inputs[1][0], 0.0), has
    if r.kind == "ratio":
        below = np.where(has & (inputs[1][0] != 0), inputs[1][0], 1.0)
        return np.where(has, inputs[0][0], 0.0) / below, has & (inputs[1][0] != 0)
    n, gap = len(group), r.w if r.kind == "delay" else r.w - 1
    place = np.arange(n) + gap * (group + 1)
    seen = np.zeros(n + gap * len(first) + 1, bool)
    seen[place] = has
    values = []
    for v, _ in inputs:
        padded = np.zeros(len(seen))
        padded[place] = np.where(has, v, 0.0)
        values.append(padded)
    if r.kind == "delay":
        return values[0][place - r.w], seen[place - r.w]
    out, ok = np.zeros(n), np.zeros(n, bool)
    at = lambda a: np.lib.stride_tricks.sliding_window_view(a, r.w)
    m, xs, start = at(seen), [at(v) for v in values], place - gap
    step = max(1, _BLOCK // r.w)
    with np.errstate(all="ignore"):
        for i in range(0, n, step):
            s = start[i:i + step]
            out[i:i + step], ok[i:i + step] = _windows(r, m[s], [x[s] for x in xs])
    return np.where(ok, out, 0.0), ok


def _extremes(x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of each window, NaN above all others."""
    low = np.fmin.reduce(np.where(m, x, np.inf), axis=1)
    nothing = ~(m & ~np.isnan(x)).any(axis=1)
    return np.where(nothing & m.any(axis=1), np.nan, low), np.where(m, x, -np.inf).max(axis=1)


def _lines(x: np.ndarray, m: np.ndarray):
    """The windows' first values, then their second ones and so on, with their presence."""
    for k in range(x.shape[1]):
        yield np.ascontiguousarray(x[:, k]), np.ascontiguousarray(m[:, k])


def _total(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sums in row order, as Spark adds them up."""
    total = np.zeros(len(x))
    for v, has in _lines(x, m):
        total = np.where(has, total + v, total)
    return total


def _moments(x: np.ndarray, m: np.ndarray, third: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Centred second (and third) moments, value by value like Spark's aggregates, so that equal windows give equal bits."""
    n, mean, m2, m3 = (np.zeros(len(x)) for _ in range(4))
    for v, has in _lines(x, m):
        after = n + 1.0
        d = v - mean
        dn = d / after
        new = m2 + d * (d - dn)
        if third:
            m3 = np.where(has, m3 - 3.0 * dn * new + d * (d * d - dn * dn), m3)
        n, mean, m2 = np.where(has, after, n), np.where(has, mean + dn, mean), np.where(has, new, m2)
    return m2, m3


def _comoment(x: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    n, mx, my, c = (np.zeros(len(x)) for _ in range(4))
    for (v, has), (u, _) in zip(_lines(x, m), _lines(y, m), strict=True):
        after = n + 1.0
        dx = v - mx
        ny = my + (u - my) / after
        c = np.where(has, c + dx * (u - ny), c)
        n, mx, my = np.where(has, after, n), np.where(has, mx + dx / after, mx), np.where(has, ny, my)
    return c


def _windows(r: Roll, m: np.ndarray, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    count = m.sum(axis=1)
    ok, n, x = (count >= r.need) & (count > 0), count.astype(float), xs[0]
    if r.kind == "sum":
        return _total(x, m), ok
    if r.kind == "mean":
        return _total(x, m) / n, ok
    if r.kind in ("min", "max"):
        return _extremes(x, m)[r.kind == "max"], ok
    if r.kind == "median":
        s = np.sort(np.where(m, x, np.nan), axis=1)
        row, half = np.arange(len(s)), np.maximum(count - 1, 0)
        lo, hi = s[row, half // 2], s[row, (half + 1) // 2]
        return np.where(half % 2 == 0, lo, lo * 0.5 + hi * 0.5), ok
    if r.kind == "drawdown":
        path = np.cumsum(x, axis=1)
        return np.exp(path[:, -1] - np.maximum(path.max(axis=1), 0.0)) - 1.0, count == r.w
    if r.kind in ("var", "std"):
        v = _moments(x, m)[0] / (n - 1.0)
        return (np.sqrt(v) if r.kind == "std" else v), ok & (count > 1)
    if r.kind == "skew":
        square, cube = _moments(x, m, third=True)
        g = np.sqrt(n) * cube / np.sqrt(square * square * square)
        return g * np.sqrt(n * (n - 1.0)) / (n - 2.0), (count >= max(3, r.need)) & (square != 0)
    if r.kind == "corr":
        varies = np.ones(len(n), bool)
        for v in xs:
            low, high = _extremes(v, m)
            varies &= (high > low) | (np.isnan(high) & ~np.isnan(low))
        scale = np.sqrt(_moments(x, m)[0] / n) * np.sqrt(_moments(xs[1], m)[0] / n)
        return _comoment(x, xs[1], m) / n / scale, (count >= max(2, r.need)) & varies & (scale != 0)
    raise ValueError(f"unknown kind {r.kind!r}")
