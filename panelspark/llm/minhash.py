"""Near-duplicate documents by min-max hashing with banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .words import SPACES, Words, blocks, grams, mix, signed, store, windows

SHINGLE = 5
PERMUTATIONS = 48
BAND_ROWS = 4
#: So many smallest hashes of a set decide which members of a bucket, beyond its star, are confirmed on full sets.
SMALLEST = 192
#: About so many further centres are tried in a bucket of many members before its pairs across components are tested.
CENTRES = 4


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes row after row, and the n + 1 bounds of the rows.

    A row with fewer words than ``k`` has its whole sequence as one shingle; a row without words has none.
    """
    h = words.hashes()
    at = windows(words, k)
    sets, owner = grams(h, k)[at] if len(h) >= k else np.zeros(0, np.uint64), words.doc[at]
    for n in range(1, k):
        short = np.flatnonzero(words.counts == n)
        if len(short):
            sets = np.concatenate([sets, grams(h, n)[words.first[short]]])
            owner = np.concatenate([owner, short])
    order = np.argsort(owner, kind="stable")
    sets, owner = sets[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(words.rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        sets[a:b].sort()
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (owner[1:] != owner[:-1])
    return sets[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def signature(sets: np.ndarray, starts: np.ndarray, permutations: int) -> np.ndarray:
    """For each set (column) the minima, then the maxima, under every permutation.

    A permutation is ``(x ^ b) * a`` on mixed 64-bit hashes. Its minimum and its maximum each agree between two sets
    with probability J, so one evaluation gives two signature entries.
    """
    rng = np.random.default_rng(7)
    multiply = rng.integers(1, 1 << 63, permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(1, 1 << 63, permutations, dtype=np.uint64)
    out = np.empty((2 * permutations, len(starts)), np.uint64)
    for p in range(permutations):
        v = sets ^ flip[p]
        v *= multiply[p]
        out[p] = np.minimum.reduceat(v, starts)
        out[permutations + p] = np.maximum.reduceat(v, starts)
    return out


def bands(entries: np.ndarray, rows: int) -> np.ndarray:
    """One key for each set and band of ``rows`` signature entries: bands of minima, then bands of maxima."""
    out = np.empty((len(entries) // rows, entries.shape[1]), np.uint64)
    for band in range(len(out)):
        key = np.full(entries.shape[1], band + 1, np.uint64)
        for row in range(rows):
            key = mix(key * np.uint64(0x9FB21C651E98DF25) + entries[band * rows + row])
        out[band] = key
    return out.T


def sketch(entries: np.ndarray) -> np.ndarray:
    """Two bits of each signature entry, thirty-two to a word."""
    low = np.zeros((entries.shape[1], -(-len(entries) // 32) * 32), np.uint64)
    low[:, :len(entries)] = (mix(entries) & np.uint64(3)).T
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce(low.reshape(len(low), -1, 32) << shifts, axis=2)


def _agreements(a: Column, b: Column, entries: int) -> Column:
    """How many signature entries have equal sketches. A few operations a word, so that the join's generated code stays
    small enough to be compiled.
    """
    differ = F.lit(0)
    for i in range(-(-entries // 32)):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(x)
    return F.lit(entries) - differ


def smallest(sets: np.ndarray, bounds: np.ndarray, most: int) -> pa.Array:
    """The leading 32 bits of the ``most`` smallest hashes of each set."""
    take = np.minimum(np.diff(bounds), most)
    ends = np.cumsum(take)
    at = np.repeat(bounds[:-1] - (ends - take), take) + np.arange(int(ends[-1]) if len(ends) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array((sets[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)))


def _lists(values: np.ndarray, full: np.ndarray, rows: int) -> pa.Array:
    """Row i of ``values`` as the list of the i-th full row; other rows have none."""
    ends = np.zeros(rows + 1, np.int32)
    ends[1:][full] = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.cumsum(ends).astype(np.int32)), signed(np.ascontiguousarray(values).ravel()))


def _signatures(k: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets, bounds = shingles(Words(block.column("text"), SPACES, lower=True), k)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            digests = np.zeros((2, len(size)), np.uint64)
            keys, marks = np.zeros((0, 1), np.uint64), np.zeros((0, 1), np.uint64)
            if len(full):
                starts = bounds[:-1][full]
                for i, seed in enumerate((0x51ED270B7A3C9D11, 0xC2B2AE3D27D4EB4F)):
                    digests[i, full] = np.add.reduceat(mix(sets ^ np.uint64(seed)), starts)
                entries = signature(sets, starts, permutations)
                keys, marks = bands(entries, rows), sketch(entries)
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(size.astype(np.int64)), signed(digests[0]), signed(digests[1]), _lists(keys, full, len(size)), _lists(marks, full, len(size)),
                 smallest(sets, bounds, SMALLEST)], ["id", "n_shingles", "set_a", "set_b", "bands", "sketch", "smallest"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            sets, bounds = shingles(Words(block.column("text"), SPACES, lower=True), k)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), signed(sets))
            yield pa.RecordBatch.from_arrays([block.column("id"), lists], ["id", "shingles"])
    return run


def _confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``a, b`` of the pairs that are links, from the full shingle sets of its two texts."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().hint("merge")  # one plan at every size
    sets = docs.join(ids, "id", "left_semi").mapInArrow(_sets(k), "id long, shingles array<long>")
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
            .select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("common")))
    union = F.col("na") + F.col("nb") - F.col("common")
    return both.where(100 * F.col("common") >= percent * union).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 85, id_column: str = "doc_id", text_column: str = "text", k: int = SHINGLE,
                    permutations: int = PERMUTATIONS, band_rows: int = BAND_ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased; a document's set holds its distinct ``k``-word
    shingles. Two documents are linked if 100 * intersection >= percent * union, confirmed on the full sets; components
    are the linked sets' closure and named after their smallest id. Documents are linked candidates if a band of
    ``band_rows`` minima or maxima agrees (2 * permutations / band_rows bands; a pair at J = 0.85 is missed by all 24
    bands with a chance of 2e-8, at J = 0.8 with 3e-6) and the whole signatures agree about as often (``_Likely``).

    Equal sets collapse first, so groups of exact copies are one node. In a bucket every member is compared with the
    bucket's smallest id only (a star). Buckets of many members that still lie in several components get further stars, about
    ``CENTRES`` members drawn by hash. Buckets whose members are then apart are completed: their pairs across components are
    tested in the join by size and signature, and only likely links are emitted and confirmed. So no link between components is
    lost and a group of m copies costs about m pairs, also if many of its texts are linked but few with the smallest id.

    Null, empty or blank text: n_shingles 0, a component of its own. Null id: component_id null, kept true. Rows that
    repeat an id are one document. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    signed_rows = store(docs.mapInArrow(_signatures(k, permutations, band_rows),
                                        "id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>, smallest array<int>"), "signatures")
    classes = store(signed_rows.where("n_shingles > 0 and id is not null").groupBy("set_a", "set_b", "n_shingles")
                    .agg(F.min("id").alias("node"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    likely = _Likely(classes.select("node", "n_shingles", "sketch"), percent, permutations)
    members = classes.select("node", F.posexplode("bands").alias("band", "bucket"))
    centres = members.groupBy("bucket").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = store(members.join(centres, "bucket"), "shared-buckets")
    pairs = shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = store(_confirmed(store(likely.of(pairs), "pairs"), docs, k, percent), "links")
    labels = components(links)

    # a bucket of two is decided; in others, members that are still apart are tested too, in large ones with a few centres first
    lists = signed_rows.select(F.col("id").alias("node"), "smallest")
    mixed = store(_mixed(shared.where("m > 2"), labels), "mixed-buckets")
    crowded = mixed.where(F.col("m") > 8 * CENTRES)
    drawn = F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("m") < CENTRES << 20  # mostly the same members in all their buckets
    stars = store(likely.stars(crowded, drawn, lists), "pairs-centres")
    if not stars.isEmpty():
        links = store(links.union(_confirmed(stars, docs, k, percent)), "links-centres")
        labels = components(links)
        mixed = store(_mixed(mixed.drop("component"), labels), "mixed-buckets")
    across = store(likely.across(mixed, classes.select("node", "bands"), lists), "pairs-across")
    if not across.isEmpty():
        labels = components(links.union(_confirmed(across, docs, k, percent)))

    # classes meet their components before rows do: rows are dealt once, and copies of one set beyond a task's share are split (AQE)
    nodes = classes.select("set_a", "set_b", "n_shingles", "node").join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    result = signed_rows.select("id", "n_shingles", "set_a", "set_b").join(nodes, ["set_a", "set_b", "n_shingles"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "node", "id"))
    return result.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``bucket, band, node, m, component`` of the members (bucket, band, node, m) of buckets that hold more than one component."""
    placed = (members.select("bucket", "band", "node", "m").join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    apart = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    return placed.join(apart, "bucket", "left_semi")


class _Likely:
    """Pairs that may be links by set sizes (exact) and by the share of agreeing signature entries.

    Two bits of an entry agree with probability J + (1 - J) / 4, so the agreements are a binomial count; six standard
    deviations below the linking share are let through, so a link is lost with a chance of about 1e-9.
    """

    def __init__(self, traits: DataFrame, percent: int, permutations: int):
        self.traits, self.percent, self.entries = traits, percent, 2 * permutations
        share = 0.25 + 0.75 * percent / 100
        self.least = int(self.entries * share - 6 * (self.entries * share * (1 - share)) ** 0.5)

    def _side(self, name: str) -> DataFrame:
        return self.traits.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col("sketch").alias(f"s{name}"))

    def _test(self) -> Column:
        sizes = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        return sizes & (_agreements(F.col("sa"), F.col("sb"), self.entries) >= self.least)

    def of(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self._side("a"), "a").join(self._side("b"), "b").where(self._test()).select("a", "b")

    def _overlap(self) -> Column:
        """Do the smallest hashes overlap as those of linked sets do?

        A link has percent / (100 + percent) of both sizes together in common, so at least the share ``s`` of either set. Of
        sets that are held whole the overlap decides (one is granted for equal leading bits). Otherwise every smallest hash
        of the set whose list ends first that is in the other set is in its list too; of ``SMALLEST`` such, a binomial count
        with share ``s`` is in common, of which six standard deviations are granted.
        """
        common = F.size(F.array_intersect("la", "lb"))
        needed = F.lit(self.percent / (100 + self.percent)) * (F.col("na") + F.col("nb"))
        s = F.least(needed / F.greatest("na", "nb"), F.lit(1.0))
        drawn = s * SMALLEST - 6 * F.sqrt(SMALLEST * s * (1 - s)) - 1
        return common >= F.when(F.greatest("na", "nb") <= SMALLEST, needed - 1).otherwise(drawn)

    def _met(self, name: str, members: DataFrame, lists: DataFrame) -> DataFrame:
        """One side of a join of members (bucket, node, component and more), with all that its tests read."""
        own = members.join(lists, "node").withColumnsRenamed({"node": name, "component": f"c{name}", "smallest": f"l{name}"})
        return own.join(self._side(name), name).withColumnRenamed("bucket", f"bucket_{name}")

    def stars(self, members: DataFrame, drawn: Column, lists: DataFrame) -> DataFrame:
        """Of members (bucket, node, component), the likely pairs of a bucket that lie in two components and have a ``drawn`` member as ``a``."""
        members = members.select("bucket", "node", "component", drawn.alias("drawn"))
        x, y = self._met("a", members.where("drawn").drop("drawn"), lists), self._met("b", members.drop("drawn"), lists)
        apart = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("ca") != F.col("cb"))
        return x.join(y, apart & self._test() & self._overlap()).select("a", "b").distinct()

    def across(self, members: DataFrame, bands: DataFrame, lists: DataFrame) -> DataFrame:
        """Of members (bucket, band, node, component), the likely pairs of a bucket that lie in two components.

        ``bands`` and ``lists`` have the band keys and the smallest hashes of each node's set. All tests are part of the join, the
        cheap ones first, so only likely links become rows, each in the first bucket that the two share.
        """
        members = members.select("bucket", "band", "node", "component").join(bands, "node").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band"))).drop("band", "bands")
        x, y = (self._met(name, members.withColumnRenamed("earlier", f"e{name}"), lists) for name in "ab")
        apart = (F.col("ca") != F.col("cb")) & (F.col("a") < F.col("b"))
        return x.join(y, (F.col("bucket_a") == F.col("bucket_b")) & apart & self._test() & ~F.arrays_overlap("ea", "eb") & self._overlap()).select("a", "b").distinct()


def drop_near_duplicates(docs: DataFrame, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; all columns stay.

    Rows are judged by their own texts, whatever their ids: they are written once with a number of their own, and the numbers are what is
    compared. Of a group the row with the smallest id stays (null ids last; of equal ids the first number), so null and repeated ids neither
    escape nor stand for each other. Rows without words are linked with nothing and stay.
    """
    number = next(n for n in ("__row", "__row_", "__row__") if n not in docs.columns)
    rows = store(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    judged = store(near_duplicates(rows.select(F.col(number).alias("id"), F.col(text_column).alias("text")), percent, "id", "text"), "judged")
    ids = rows.select(F.col(number).alias("row"), F.col(id_column).alias("id"))
    named = judged.where("n_shingles > 0").select(F.col("doc_id").alias("row"), "component_id").join(ids, "row")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias("__stays")).union(judged.where("n_shingles = 0").select("doc_id"))
    return rows.join(stay, rows[number] == stay["__stays"], "left_semi").drop(number)
