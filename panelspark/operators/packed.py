"""Order statistics of several columns over groups of any size, without a shuffle of wide rows for each column.

A piece is what one task holds of one group; its row of the packed table has the columns as arrays. For ranks, a piece's distinct values travel
once, as sorted arrays with their counts, and their facts come back in the same order; the rows themselves are dealt once. A group's values are
dealt to ranges, ties of a piece are one value. For quantiles only the values around the wanted places travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize_columns

#: Rows that a task packs or sums up at a time, values of a range (one task orders them), and values that an entry of a summary stands for.
BLOCK_ROWS, RANGE_VALUES, STEP = 1 << 18, 1_000_000, 32

#: Columns of these types have an order as 64-bit integers.
ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)

_LOW_BITS = np.int64(0x7FFFFFFFFFFFFFFF)

#: Of a column's values: which rows have one, and for these the values below, the ties (the own included) and the values of the group.
Facts = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def order_keys(values: pa.Array) -> np.ndarray:
    """Integers in the order of values that are all there: both zeros are one, NaN is one value, the highest."""
    if not pa.types.is_floating(values.type):
        return values.cast(pa.int64()).to_numpy(zero_copy_only=False)
    v = values.cast(pa.float64()).to_numpy(zero_copy_only=False) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return bits ^ ((bits >> 63) & _LOW_BITS)


def key_values(keys: np.ndarray) -> np.ndarray:
    """The doubles that have these keys."""
    return (keys ^ ((keys >> 63) & _LOW_BITS)).view(np.float64)


def _blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def codes(column) -> np.ndarray:
    """A number for each different entry, missing ones included."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode(null_encoding="encode")
    return np.asarray(coded.indices) if isinstance(coded, pa.DictionaryArray) else np.asarray(coded.combine_chunks().indices)


def _group_codes(b: pa.RecordBatch, by: list[str]) -> np.ndarray:
    code = np.zeros(b.num_rows, np.int64)
    for k in by:
        own = codes(b.column(k))
        code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
    return code


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _lists(starts: np.ndarray, values) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def pack(df: DataFrame, by: list[str]) -> DataFrame:
    """Stored rows of pieces: ``by``, ``_piece`` (its number), ``_rows``, and every other column as an array."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    others = [c for c in df.columns if c not in by]
    schema = T.StructType([*[T.StructField(k, fields[k]) for k in by], T.StructField("_piece", T.LongType()), T.StructField("_rows", T.LongType()),
                           *[T.StructField(c, T.ArrayType(fields[c])) for c in others]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId() << 40
        for b in _blocks(batches, BLOCK_ROWS):
            code = _group_codes(b, by)
            order = np.argsort(code, kind="stable")
            first = _starts(code[order])
            b = b.take(pa.array(order))
            keys = [b.column(k).take(pa.array(first)) for k in by]
            numbers = [pa.array(piece + np.arange(len(first))), pa.array(np.diff(np.append(first, len(order))))]
            out = pa.RecordBatch.from_arrays([*keys, *numbers, *[_lists(first, b.column(c)) for c in others]], names=schema.names)
            piece += len(first)
            yield from (out.slice(i, 256) for i in range(0, len(first), 256))

    return materialize_columns(df.mapInArrow(run, schema))


class _Entries:
    """A column's values in some pieces, in the order of (piece, class, value), and the distinct ones of each piece and class."""

    def __init__(self, b: pa.RecordBatch, x: str, group: str | None):
        values = b.column(x).flatten()
        piece = np.repeat(np.arange(b.num_rows), b.column(x).value_lengths().to_numpy(zero_copy_only=False))
        self.has = values.is_valid().to_numpy(zero_copy_only=False)
        self.classes = None
        if group is not None:
            own = b.column(group).flatten()
            self.has = self.has & own.is_valid().to_numpy(zero_copy_only=False)
            own = own.filter(pa.array(self.has))
            self.classes = own.unique().sort()
        keys, piece = order_keys(values.filter(pa.array(self.has))), piece[self.has]
        code = np.zeros(len(keys), np.int64) if group is None else self.code(own)
        order = np.lexsort((keys, code, piece))
        keys, piece, code = keys[order], piece[order], code[order]
        at = _starts(piece, code, keys) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.piece, self.class_code, self.counts = keys[at], piece[at], code[at], np.diff(np.append(at, len(keys)))
        #: for each value that is there, in the order of the rows, its place among the distinct ones
        self.place = np.empty(len(keys), np.int64)
        self.place[order] = np.repeat(np.arange(len(at)), self.counts)

    def code(self, own: pa.Array) -> np.ndarray:
        return pc.index_in(own, value_set=self.classes).to_numpy(zero_copy_only=False).astype(np.int64)


def _messages(packed: DataFrame, by: list[str], specs: list[tuple[str, bool]], group: str | None, cuts: dict) -> DataFrame:
    """Rows of (``by``, column, class, range, piece) with the distinct values in order, their counts and what is known of the range."""
    fields = {f.name: f.dataType for f in packed.schema.fields}
    kind = fields[group].elementType if group else T.LongType()
    many = T.ArrayType(T.LongType())
    schema = T.StructType([*[T.StructField(k, fields[k]) for k in by], T.StructField("_x", T.IntegerType()), T.StructField("_class", kind), T.StructField("_range", T.LongType()),
                           T.StructField("_piece", T.LongType()), T.StructField("_v", many), T.StructField("_c", many)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (x, inside) in enumerate(specs):
                e = _Entries(b, x, group if inside else None)
                if not len(e.keys):
                    continue
                part = np.zeros(len(e.keys), np.int64)
                if cuts:
                    run_at = _starts(e.piece, e.class_code)
                    for s, t in zip(run_at, np.append(run_at[1:], len(e.keys)), strict=True):
                        name = e.classes[int(e.class_code[s])].as_py() if inside else None
                        found = cuts.get((*[b.column(k)[int(e.piece[s])].as_py() for k in by], i, name))
                        if found is not None:
                            part[s:t] = np.searchsorted(found, e.keys[s:t], side="right")
                at = _starts(e.piece, e.class_code, part)
                piece = pa.array(e.piece[at])
                yield pa.RecordBatch.from_arrays([
                    *[b.column(k).take(piece) for k in by], pa.array(np.full(len(at), i, np.int32)),
                    e.classes.take(pa.array(e.class_code[at])) if inside else pa.nulls(len(at), own_type(b)), pa.array(part[at]),
                    b.column("_piece").take(piece), _lists(at, e.keys), _lists(at, e.counts)], names=schema.names)

    def own_type(b: pa.RecordBatch) -> pa.DataType:
        return b.column(group).type.value_type if group else pa.int64()

    columns = dict.fromkeys([*by, "_piece", *[x for x, _ in specs], *([group] if group else [])])
    return packed.select(*columns).mapInArrow(run, schema)


def _range_cuts(packed: DataFrame, by: list[str], specs, group: str | None) -> dict:
    """Where the values of a large group are cut into ranges: (by, column, class) -> first values of the second range and so on.

    Each piece gives some of its values in order, evenly spaced; what the driver gets is one value for each range of a million.
    """
    most = packed.groupBy(*by).agg(F.sum("_rows").alias("n")).agg(F.max("n")).first()[0]
    if most is None or most <= RANGE_VALUES:
        return {}
    rows = _messages(packed, by, specs, group, {})
    keys = [*by, "_x", "_class"]
    size = F.aggregate("_c", F.lit(0).cast("bigint"), lambda a, c: a + c)
    large = rows.groupBy(*keys).agg(F.sum(size).alias("_n")).where(F.col("_n") > RANGE_VALUES)
    large = materialize_columns(large.select(*[F.col(k).alias(f"{k}__r") for k in keys]))
    cond = [F.col(k).eqNullSafe(F.col(f"{k}__r")) for k in keys]
    whole = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType([*whole, T.StructField("_cuts", T.ArrayType(T.LongType()))])

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = b.column("_v").value_lengths().to_numpy(zero_copy_only=False)
            values, counts = b.column("_v").flatten().to_numpy(), b.column("_c").flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), lengths)
            done = np.cumsum(counts) - counts
            at = _starts(row, done // STEP)
            some = np.flatnonzero(np.isin(np.arange(b.num_rows), row[at]))
            yield pa.RecordBatch.from_arrays([*[b.column(k).take(pa.array(some)) for k in keys], _lists(_starts(row[at]), values[at]),
                                              _lists(_starts(row[at]), np.add.reduceat(counts, at))], names=[*keys, "_v", "_c"])

    def cut(t: pa.Table) -> pa.Table:
        v, c = pc.list_flatten(t["_v"]).to_numpy(), pc.list_flatten(t["_c"]).to_numpy()
        order = np.argsort(v, kind="stable")
        v, done = v[order], np.cumsum(c[order])
        at = np.flatnonzero((done[1:] // RANGE_VALUES) != (done[:-1] // RANGE_VALUES)) + 1
        return t.select(keys).slice(0, 1).append_column("_cuts", pa.array([np.unique(v[at])], pa.list_(pa.int64())))

    thinned = T.StructType([*whole, T.StructField("_v", T.ArrayType(T.LongType())), T.StructField("_c", T.ArrayType(T.LongType()))])
    found = rows.join(large, cond, "left_semi").select(*keys, "_v", "_c").mapInArrow(thin, thinned).groupBy(*keys).applyInArrow(cut, schema).collect()
    return {tuple(r[k] for k in keys): np.array(r["_cuts"], np.int64) for r in found if r["_cuts"]}


def _counted(packed: DataFrame, by: list[str], specs, group: str | None, cuts: dict) -> dict:
    """(by, column, class) -> values before each range, and all values."""
    keys = [*by, "_x", "_class"]
    size = F.aggregate("_c", F.lit(0).cast("bigint"), lambda a, c: a + c)
    rows = _messages(packed, by, specs, group, cuts).groupBy(*keys, "_range").agg(F.sum(size).alias("n")).collect() if cuts else []
    found: dict = {}
    for r in rows:
        key = tuple(r[k] for k in keys)
        if key in cuts:
            found.setdefault(key, np.zeros(len(cuts[key]) + 1, np.int64))[r["_range"]] = r["n"]
    return {k: (np.cumsum(n) - n, int(n.sum())) for k, n in found.items()}


def ranked(packed: DataFrame, by: list[str], specs: list[tuple[str, bool]], finish: Callable[[dict[tuple[str, bool], Facts]], dict[str, pa.Array]],
           new: list[T.StructField], group: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The packed rows one by one with the columns ``new``, which ``finish`` makes of the facts of the values.

    ``specs``: columns, each among the rows of its group, or (True) inside the rows' classes ``group``. ``keep``: columns that the rows bring along.
    """
    cuts = _range_cuts(packed, by, specs, group)
    offsets = _counted(packed, by, specs, group, cuts)
    rows = _messages(packed, by, specs, group, cuts)
    kinds = {f.name: f for f in rows.schema.fields}
    many = T.ArrayType(T.LongType())
    facts_schema = T.StructType([kinds["_piece"], kinds["_x"], kinds["_class"], kinds["_range"], T.StructField("_lt", many), T.StructField("_eq", many), T.StructField("_n", T.LongType())])

    def merge(t: pa.Table) -> pa.Table:
        v, c = t["_v"].combine_chunks(), t["_c"].combine_chunks()
        v, c = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (v, c))
        lengths = v.value_lengths().to_numpy(zero_copy_only=False)
        distinct, place = np.unique(v.flatten().to_numpy(), return_inverse=True)
        eq = np.zeros(len(distinct), np.int64)
        np.add.at(eq, place, c.flatten().to_numpy())
        before, n = offsets.get((*[t[k][0].as_py() for k in by], t["_x"][0].as_py(), t["_class"][0].as_py()), (None, int(eq.sum())))
        lt = np.cumsum(eq) - eq + (0 if before is None else before[t["_range"][0].as_py()])
        starts = np.cumsum(lengths) - lengths
        return pa.Table.from_arrays([t["_piece"], t["_x"], t["_class"], t["_range"], _lists(starts, lt[place]), _lists(starts, eq[place]), pa.array(np.full(len(lengths), n))],
                                    names=facts_schema.names)

    facts = rows.groupBy(*by, "_x", "_class", "_range").applyInArrow(merge, facts_schema)
    facts = facts.groupBy("_piece").agg(F.collect_list(F.struct("_x", "_class", "_range", "_lt", "_eq", "_n")).alias("_facts"))
    fields = {f.name: f for f in packed.schema.fields}
    others = [c for c in packed.columns if c not in (*by, "_piece", "_rows")] if keep is None else keep
    made = {f.name for f in new}
    out = [c for c in others if c not in made]
    schema = T.StructType([*[fields[k] for k in by], *[T.StructField(c, fields[c].dataType.elementType) for c in out], *new])
    reads = dict.fromkeys([*by, "_piece", "_rows", *out, *[x for x, _ in specs], *([group] if group else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column("_facts")
            owner = np.repeat(np.arange(b.num_rows), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            x, kind, part, lt, eq, n = lists.flatten().flatten()
            x, part, n = (a.to_numpy(zero_copy_only=False) for a in (x, part, n))
            known = {}
            for i, (name, inside) in enumerate(specs):
                e = _Entries(b, name, group if inside else None)
                mine = np.flatnonzero(x == i)
                code = e.code(kind.take(pa.array(mine))) if inside else np.zeros(len(mine), np.int64)
                mine = pa.array(mine[np.lexsort((part[mine], code, owner[mine]))])
                own = lt.take(mine)
                all_n = np.repeat(n[mine.to_numpy()], own.value_lengths().to_numpy(zero_copy_only=False))
                known[name, inside] = (e.has, *[v[e.place] for v in (own.flatten().to_numpy(), eq.take(mine).flatten().to_numpy(), all_n)])
            columns = finish(known)
            row = pa.array(np.repeat(np.arange(b.num_rows), b.column("_rows").to_numpy(zero_copy_only=False)))
            whole = pa.RecordBatch.from_arrays([*[b.column(k).take(row) for k in by], *[b.column(c).flatten() for c in out], *[columns[f.name] for f in new]], names=schema.names)
            yield from (whole.slice(i, 1 << 15) for i in range(0, whole.num_rows, 1 << 15))

    return packed.select(*reads).join(facts, "_piece", "left").mapInArrow(run, schema)


def spread(has: np.ndarray, values: np.ndarray) -> pa.Array:
    """The values at the rows that have one, missing elsewhere."""
    whole = np.zeros(len(has), values.dtype)
    whole[has] = values
    return pa.array(whole, mask=~has)


def _summaries(stored: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    """Rows of (``by``, column) with the first and last value and the number of short runs of a block's values in order."""
    fields = {f.name: f for f in stored.schema.fields}
    many = T.ArrayType(T.LongType())
    schema = T.StructType([*[fields[k] for k in by], T.StructField("_x", T.IntegerType()), *[T.StructField(c, many) for c in ("_first", "_last", "_c")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, 2 * BLOCK_ROWS):
            code = _group_codes(b, by)
            for i, x in enumerate(xs):
                has = np.flatnonzero(b.column(x).is_valid().to_numpy(zero_copy_only=False))
                if not len(has):
                    continue
                keys, own = order_keys(b.column(x).take(pa.array(has))), code[has]
                order = np.lexsort((keys, own))
                keys, own = keys[order], own[order]
                first = _starts(own)
                inside = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
                at = _starts(own, inside // STEP)
                ends = np.append(at[1:], len(own))
                starts = _starts(own[at])
                row = pa.array(has[order][first])
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(row) for k in by], pa.array(np.full(len(first), i, np.int32)), _lists(starts, keys[at]), _lists(starts, keys[ends - 1]),
                                                  _lists(starts, ends - at)], names=schema.names)

    return stored.select(*by, *[F.col(x).cast("double").alias(x) for x in xs]).mapInArrow(run, schema)


def value_brackets(stored: DataFrame, by: list[str], xs: list[str], probs: list[float]) -> DataFrame:
    """(by, _x, _n, _lo, _hi): for each column and each of ``probs`` two values that surely hold the wanted places between them."""
    rows = _summaries(stored, by, xs)
    ends = T.ArrayType(T.DoubleType())
    schema = T.StructType([f for f in rows.schema.fields if f.name in (*by, "_x")] + [T.StructField("_n", T.LongType()), T.StructField("_lo", ends), T.StructField("_hi", ends)])

    def run(t: pa.Table) -> pa.Table:
        first, last, c = (pc.list_flatten(t[k]).to_numpy() for k in ("_first", "_last", "_c"))
        n = int(c.sum())
        order = np.argsort(first, kind="stable")
        low, at = np.unique(first[order], return_index=True)
        maybe_below = (np.cumsum(c[order]) - c[order])[at]
        order = np.argsort(last, kind="stable")
        high, at = np.unique(last[order][::-1], return_index=True)
        surely_within = np.cumsum(c[order])[len(last) - 1 - at]
        lo, hi = [], []
        for p in probs:
            pos = (n - 1) * float(p)
            lo.append(low[np.flatnonzero(maybe_below <= np.floor(pos))[-1]])
            hi.append(high[np.flatnonzero(surely_within >= np.ceil(pos) + 1)[0]])
        ends = [pa.array([key_values(np.array(v, np.int64))], pa.list_(pa.float64())) for v in (lo, hi)]
        return pa.Table.from_arrays([*[t[k].slice(0, 1) for k in (*by, "_x")], pa.array([n]), *ends], names=schema.names)

    return rows.groupBy(*by, "_x").applyInArrow(run, schema)
