"""Mixing sources to target weights by weighted sampling without replacement.

Every document draws an exponential key scaled by its quality weight (Efraimidis and Spirakis: the smallest keys of a source are a sample without
replacement in proportion to the weights). A source's target in words is met by complete epochs first; what is left of it goes to the
documents with the smallest keys, up to the place where their sizes, summed in the order of the keys, come nearest to it.

The order is one range-partitioned sort by (source, key), whatever the sources' shares, so a source that holds a third of all rows is
spread over a third of the tasks; running sums inside a range are made whole by the totals of the ranges before it. Texts do not travel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import Words, blocks, grams, mix, shuffle_partitions, store

#: What the sources weigh, in their order, again and again.
SOURCE_WEIGHTS = (3, 1, 2)
#: The mix holds this percentage of all words, and this many times a source's words at most.
SHARE_PERCENT, MOST_EPOCHS = 150, 2
#: Quality of a document without variety; one all of whose words differ has 1.
LEAST_QUALITY = 0.1


def _drawn(seed: int):
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            words = Words(block.column("text"))
            h = words.hashes()
            order = np.lexsort((h, words.doc))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (words.doc[order][1:] != words.doc[order][:-1])
            distinct = np.bincount(words.doc[order][new], minlength=words.rows)
            size = words.counts.astype(np.int64)
            weight = LEAST_QUALITY + (1 - LEAST_QUALITY) * distinct / np.maximum(size, 1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(grams(h, 1) + np.arange(len(h), dtype=np.uint64) - np.repeat(words.first[:-1], size).astype(np.uint64)))])
            ids = pc.fill_null(block.column("id"), -1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            bits = mix(mix(ids + np.uint64(seed)) + sums[words.first[1:]] - sums[words.first[:-1]])
            uniform = ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            yield pa.RecordBatch.from_pydict({"id": block.column("id"), "source": block.column("source"), "size": size, "weight": weight, "key": -np.log(uniform) / weight})
    return drawn


def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``before`` to the rows of one sorted range: the sum of ``value`` over the earlier rows of the same group in this range."""
    last, carried = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        group, value = batch.column("group"), batch.column("value").to_numpy(zero_copy_only=False)
        codes = group.dictionary_encode(null_encoding="encode")
        code = codes.indices.to_numpy(zero_copy_only=False)
        head = np.concatenate([[True], code[1:] != code[:-1]])
        sums = np.cumsum(value) - value
        before = sums - np.repeat(sums[head], np.diff(np.append(np.flatnonzero(head), n)))
        names = codes.dictionary.to_pylist()
        if last is not None and names[code[0]] == last[0]:
            before[: n if head.sum() == 1 else int(np.flatnonzero(head)[1])] += carried
        last, carried = (names[code[-1]],), int(before[-1] + value[-1])
        yield batch.append_column("before", pa.array(before, pa.int64()))


def prefix_sums(rows: DataFrame, group: str, order: list[str], value: str, name: str = "before", facts: DataFrame | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` (long) over the earlier rows of the same ``group`` (string, null is a group), in the order of ``order``.

    One sort by ranges of (group, order), stored; the sums of earlier ranges come from the totals of each group in each range (no more rows than
    groups and ranges together). ``facts`` (one row for each group, in a column ``group``) adds its columns at that grain, so that the join back to
    the rows is one by (range, group) and a hot group is no hot key. Rows that tie in all of ``order`` stand in any order.
    """
    spark = rows.sparkSession
    kept = [F.col(c) for c in rows.columns]
    plain = rows.select(*kept, F.col(group).alias("group"), F.col(value).cast("long").alias("value"))
    ranges = plain.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("group"), *order).sortWithinPartitions(F.asc_nulls_last("group"), *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema) + ", before long"
    inner = store(ranges.mapInArrow(running, schema).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = inner.groupBy("range", "group").agg(F.sum("value").alias("total")).withColumn("offset", F.coalesce(F.sum("total").over(earlier), F.lit(0)))
    added = []
    if facts is not None:
        added = [F.col(c) for c in facts.columns if c != "group"]
        ends = ends.join(facts.withColumnRenamed("group", "of_group"), F.col("group").eqNullSafe(F.col("of_group")), "left")
    ends = store(ends.select(F.col("range").alias("in_range"), F.col("group").alias("in_group"), "offset", *added), "range-ends")
    out = inner.join(ends, (F.col("range") == F.col("in_range")) & F.col("group").eqNullSafe(F.col("in_group")))
    return out.select(*kept, *added, (F.col("before") + F.col("offset")).alias(name))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = SOURCE_WEIGHTS, percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, source_size``: one row for each source.

    Sources in code point order, null last, take the weights in turn. They share ``percent`` of all words by weight; a target stops
    at ``most`` times its source's words and the excess is shared anew by weight among the others, until none is above. Each round is one aggregate
    over the sources in whole numbers, so reruns agree; a round stops at least one more source, and rounds end when none is new.
    """
    alike = sizes.select("source", "source_size", F.col("source").isNull().alias("last"), F.lit("").alias("all"), F.lit(1).alias("one"))
    ranked = prefix_sums(alike, "all", ["last", "source"], "one", "place")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    sources = store(ranked.select("source", "source_size", turn.cast("long").alias("weight")), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # in words times 100: a source is stopped where weight / open_weight of what is open is at least its bound
    open_share, open_weight, stopped = percent * total, None, -1
    while True:
        full = F.lit(False) if open_weight is None else F.col("weight").cast("decimal(38,0)") * open_share >= F.col("source_size").cast("decimal(38,0)") * (100 * most) * open_weight
        state = sources.agg(F.count(F.when(full, 1)), F.sum(F.when(full, F.col("source_size"))), F.sum(F.when(~full, F.col("weight")))).first()
        if state[0] == stopped:
            break
        stopped, open_share, open_weight = state[0], percent * total - 100 * most * (state[1] or 0), state[2] or 1
    share = F.lit(float(open_share)) * F.col("weight") / (100.0 * open_weight)
    return sources.withColumn("target", F.when(full, F.col("source_size") * float(most)).otherwise(share))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = SOURCE_WEIGHTS,
                percent: int = SHARE_PERCENT, most: int = MOST_EPOCHS, seed: int = 11) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, epochs, weight`` of every document: the words that the mix takes of it.

    Size: words `[^\\x20\\x09-\\x0D]+` of the text (null: 0). A source's ``target`` is its share of the mix (``source_targets``). ``epochs`` is how often the
    mix takes the document: the complete epochs of its source, and once more for the documents whose keys come first, as many as bring the sum
    of their sizes nearest to what is left of the target (whole documents, so a source ends within half a document of its target).
    ``taken = epochs * size`` is never more than ``most`` times the size.

    The key is -log(u) / weight with u drawn from the seed, the id and the text, the weight the share of distinct words of the text between
    0.1 and 1: reruns and other partitionings agree. Rows with equal id and text tie; which of them is taken makes no difference to the rows
    returned. Null ids are an id, null sources a source (the last), empty texts have size 0 and count in no target. An empty table gives no rows.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), F.col(source_column).cast("string").alias("source"))
    drawn = store(plain.mapInArrow(_drawn(seed), "id long, source string, size long, weight double, key double"), "keys")
    totals = store(drawn.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = source_targets(totals, weights, percent, most).select(F.col("source").alias("group"), "source_size", "target")
    ordered = prefix_sums(drawn, "source", ["key", "id", "size"], "size", facts=targets)
    full = F.coalesce(F.floor(F.when(F.col("target") >= F.col("source_size") * most, float(most)).otherwise(F.col("target") / F.col("source_size"))), F.lit(0))
    left = F.col("target") - F.col("source_size") * F.col("full")
    more = F.when((F.col("full") < most) & (2 * F.col("before") + F.col("size") <= 2 * left), 1).otherwise(0)
    out = ordered.withColumn("full", full).withColumn("epochs", (F.col("full") + more).cast("long"))
    return out.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("epochs") * F.col("size")).alias("taken"), "source", "epochs", "weight")
