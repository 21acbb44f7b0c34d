"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation, in numpy, on the whole corpus.

Symbols are the ``FREQUENT`` (1024) commonest training tokens and ``CLASSES`` classes of the others (by their last two bytes). The
model predicts the next symbol from the two before: the sum of their vectors, each weighted by its position, times the
candidate's vector, plus its bias. Inside a class a token has its share of the class's training counts, with 0.1 added to
each known token's count and 0.1 for all unknown ones, so the probabilities of a context sum to one.

Training passes over all training texts: every task runs stochastic gradient steps over its rows from the same start and
the results are averaged, weighted by tokens. Scoring needs the exact normaliser of each of the (symbols)^2 contexts; as
the score of a candidate is a sum over the two context words, all normalisers are one matrix product.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .quality import fold_of
from .words import Words, blocks, mix, store

FREQUENT, CLASSES = 1024, 256
#: Counts of so many tokens travel to every task; those of the rest are joined.
HEAD_TOKENS = 1 << 16
SIZE, NOISE, BATCH, EPOCHS, RATE = 16, 64, 2048, 2, 0.3
END_KEY = np.uint64(0x5E0D5E0D5E0D5E0D)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Keys and classes of all tokens (words with A-Z lower-cased, then one end for each row), the n + 1 bounds of the rows, the rows."""
    words = Words(column, lower=True)
    keys = np.full(len(words.doc) + words.rows, END_KEY, np.uint64)
    classes = np.zeros(len(keys), np.int64)
    at = np.arange(len(words.doc)) + words.doc
    if len(at):
        keys[at] = words.hashes()
        last = words.data[words.ends - 1].astype(np.uint64)
        before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
        classes[at] = (mix(last * np.uint64(256) + before + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)
    return keys, classes, words.first + np.arange(words.rows + 1), words.rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        keys, classes, _, _ = tokens_of(block.column("text"))
        distinct, first, n = np.unique(keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_pydict({"key": pa.array(distinct.view(np.int64)), "class": pa.array(classes[first].astype(np.int32)), "n": pa.array(n)})


def count_tokens(docs: DataFrame) -> DataFrame:
    """``key, class, n``: how often each token occurs in all of ``docs`` (``text``)."""
    counts = docs.select("text").mapInArrow(_count, "key long, class int, n long")
    return store(counts.groupBy("key", "class").agg(F.sum("n").alias("n")), "token-counts")


@dataclass
class Vocabulary:
    """The counts of the commonest tokens (sorted by key), their symbols (or -1), and the totals."""

    keys: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    class_totals: np.ndarray
    symbol_counts: np.ndarray
    tokens: int
    distinct: int
    frequent: int

    @property
    def end(self) -> int:
        return int(self.symbol_of(np.array([END_KEY]), np.zeros(1, np.int64))[0][0])

    def symbol_of(self, keys: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's symbol and its place among the commonest (-1: not one of them)."""
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        own = np.where(known, self.symbols[at] if len(self.keys) else -1, -1)
        return np.where(own >= 0, own, self.frequent + classes), np.where(known, at, -1)


def vocabulary(counts: DataFrame, head_tokens: int = HEAD_TOKENS, frequent_tokens: int = FREQUENT) -> Vocabulary:
    """From the counts: the ``head_tokens`` commonest (ties by key) and sums of all; bounded however many tokens there are."""
    head = counts.orderBy(F.desc("n"), "key").limit(head_tokens).collect()
    end = int(END_KEY.astype(np.int64))
    if not any(r.key == end for r in head):
        head += counts.where(F.col("key") == end).limit(1).collect() or [Row(key=end, n=0)]
    first = [r.key for r in head[:frequent_tokens]]
    if end not in first:  # the end always has a symbol of its own
        first[frequent_tokens - 1:] = [end]
    frequent = {key: i for i, key in enumerate(first)}
    whole = counts.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("distinct")).first()
    rare = counts.where(~F.col("key").isin(list(frequent))).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    class_n, class_v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in rare:
        class_n[r["class"]], class_v[r["class"]] = r.n, r.v
    head = sorted(((np.uint64(r.key % (1 << 64)), r.n, frequent.get(r.key, -1)) for r in head), key=lambda r: r[0])
    symbol_counts = np.zeros(frequent_tokens + CLASSES)
    for _, n, s in head:
        if s >= 0:
            symbol_counts[s] = n
    symbol_counts[frequent_tokens:] = class_n
    return Vocabulary(np.array([k for k, _, _ in head], np.uint64), np.array([n for _, n, _ in head], np.int64), np.array([s for _, _, s in head], np.int64),
                      class_n + 0.1 * (class_v + 1), symbol_counts, int(whole.tokens or 0), int(whole.distinct), frequent_tokens)


class LogBilinear:
    """Vectors of context words (``r``), of candidates (``q``), position weights (``c``) and biases (``b``)."""

    names = ("r", "q", "c", "b")

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays = {k: arrays[k].astype(np.float32) for k in self.names}

    @classmethod
    def start(cls, symbol_counts: np.ndarray, seed: int = 23) -> LogBilinear:
        rng = np.random.default_rng(seed)
        share = (symbol_counts + 0.1) / (symbol_counts + 0.1).sum()
        shape = (len(symbol_counts), SIZE)
        return cls({"r": rng.normal(0, 0.1, shape), "q": rng.normal(0, 0.1, shape), "c": np.ones((2, SIZE)), "b": np.log(share)})

    @classmethod
    def unpack(cls, flat: np.ndarray) -> LogBilinear:
        symbols = (len(flat) - 2 * SIZE) // (2 * SIZE + 1)
        shapes = ((symbols, SIZE), (symbols, SIZE), (2, SIZE), (symbols,))
        edges = np.cumsum([0, *map(np.prod, shapes)])
        return cls({k: flat[a:b].reshape(s) for k, a, b, s in zip(cls.names, edges[:-1], edges[1:], shapes)})

    def pack(self) -> np.ndarray:
        return np.concatenate([self.arrays[k].ravel() for k in self.names]).astype(np.float64)

    def step(self, before: np.ndarray, before2: np.ndarray, target: np.ndarray, noise: np.ndarray, log_noise: np.ndarray, rate: float) -> None:
        """One noise-contrastive gradient step; all tokens of the batch share the noise samples."""
        r, q, c, b = (self.arrays[k] for k in self.names)
        r1, r2 = r[before], r[before2]
        context = r1 * c[0] + r2 * c[1]
        k = np.float32(np.log(len(noise)))
        own = np.einsum("ij,ij->i", context, q[target]) + b[target] - (k + log_noise[target])
        other = context @ q[noise].T + (b[noise] - (k + log_noise[noise]))
        from_own = 1 / (1 + np.exp(np.clip(own, -30, 30)))            # 1 - P(data)
        with np.errstate(over="ignore"):
            from_other = -1 / (1 + np.exp(-other))                    # - P(data)
        by_context = from_own[:, None] * q[target] + from_other @ q[noise]
        scale = np.float32(rate)
        _scatter(q, np.concatenate([target, noise]), np.concatenate([from_own[:, None] * context, from_other.T @ context]), scale)
        _scatter(b[:, None], np.concatenate([target, noise]), np.concatenate([from_own, from_other.sum(0)])[:, None], scale)
        by_c = np.stack([np.einsum("ij,ij->j", by_context, r1), np.einsum("ij,ij->j", by_context, r2)])
        _scatter(r, np.concatenate([before, before2]), np.concatenate([by_context * c[0], by_context * c[1]]), scale)
        c += scale * by_c / len(target)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What each (context word, candidate) adds for the word before and the one before that, the biases, and the log normaliser of each context."""
        r, q, c, b = (self.arrays[k] for k in self.names)
        near, far = (r * c[0]) @ q.T, (r * c[1]) @ q.T
        top_near, top_far, top_b = near.max(1), far.max(1), b.max()
        by_near, by_far = np.exp(near - top_near[:, None]) * np.exp(b - top_b), np.exp(far - top_far[:, None])
        norm = np.empty((len(r), len(r)), np.float32)
        for a in range(0, len(r), 256):  # sums of positive terms: rows of the product at double precision
            total = by_near[a:a + 256].astype(np.float64) @ by_far.T.astype(np.float64)
            norm[a:a + 256] = np.log(total) + top_near[a:a + 256, None] + top_far[None, :] + top_b
        return near, far, b, norm


def _scatter(table: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: np.float32) -> None:
    """Move each row by the sum of its gradients over the root of their number, which keeps frequent symbols stable."""
    rows = rows.astype(np.uint16)  # symbols are few; sixteen bits are sorted by their digits
    order = np.argsort(rows, kind="stable")
    sorted_rows = rows[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
    n = np.diff(np.append(at, len(rows)))
    table[sorted_rows[at]] += rate * np.add.reduceat(gradient[order], at, axis=0) / np.sqrt(n)[:, None].astype(np.float32) / np.float32(np.sqrt(BATCH))


def _contexts(symbols: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before; before a row's first token the end symbol stands."""
    before, before2 = np.empty_like(symbols), np.empty_like(symbols)
    before[1:], before2[2:] = symbols[:-1], symbols[:-2]
    starts = bounds[:-1]
    before[starts] = end
    before2[starts] = end
    second = starts + 1
    before2[second[second < bounds[1:]]] = end
    return before, before2


def _train(vocabulary: Vocabulary, start: np.ndarray, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, steps = LogBilinear.unpack(start), 0, 0
        share = (vocabulary.symbol_counts + 0.1) / (vocabulary.symbol_counts + 0.1).sum()
        log_noise, edges = np.log(share).astype(np.float32), np.cumsum(share)
        rng = np.random.default_rng(seed)
        for block in blocks(batches):
            keys, classes, bounds, rows = tokens_of(block.column("text"))
            if not rows:
                continue
            symbols = vocabulary.symbol_of(keys, classes)[0]
            before, before2 = _contexts(symbols, bounds, vocabulary.end)
            order = rng.permutation(len(symbols))
            for a in range(0, len(order), BATCH):
                part = order[a:a + BATCH]
                noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), len(share) - 1)
                steps += 1
                model.step(before[part], before2[part], symbols[part], noise, log_noise, rate / np.sqrt(1 + steps / 200))
            seen += len(symbols)
        if seen:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId()], pa.int64()), "weight": pa.array([float(seen)]), "weighted": pa.array([(model.pack() * seen).tobytes()], pa.binary())})
    return run


#: Models of tasks are added up in groups of tasks, then of groups, so that the last step sees so many sums at most.
SUMMED_IN = (1024, 32)


def _added(table: pa.Table) -> pa.Table:
    """The sum of some models."""
    total = np.zeros(len(table.column("weighted")[0].as_py()) // 8)
    for flat in table.column("weighted"):
        total += np.frombuffer(flat.as_buffer(), np.float64)
    return pa.table({"slot": pa.array([table.column("slot")[0].as_py()], pa.int64()), "weight": pa.array([float(np.sum(table.column("weight").to_numpy()))]), "weighted": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, words: Vocabulary, epochs: int = EPOCHS, rate: float = RATE) -> LogBilinear:
    """Train on all of ``docs`` (``text``): a task's model is one row, rows are added up in Spark, and the driver sees at most 32 sums an epoch."""
    model = LogBilinear.start(words.symbol_counts)
    for epoch in range(epochs):
        parts = docs.select("text").mapInArrow(_train(words, model.pack(), rate / (1 + 2 * epoch), epoch), "slot long, weight double, weighted binary")
        for width in SUMMED_IN:
            parts = parts.withColumn("slot", F.col("slot") % width).groupBy("slot").applyInArrow(_added, "slot long, weight double, weighted binary")
        sums = parts.orderBy("slot").collect()
        if not sums:
            break
        model = LogBilinear.unpack(sum(np.frombuffer(r.weighted, np.float64) for r in sums) / sum(r.weight for r in sums))
    return model


_SCORED = "row long, id long, n_tokens long, head_known long, head_base double, model double, rare_keys array<long>, rare_n array<int>"


_known_tables: dict[bytes, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables_of(model: LogBilinear) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One set of tables for all tasks of a worker that score with the same model."""
    key = hashlib.sha256(model.pack().tobytes()).digest()
    if key not in _known_tables:
        _known_tables.clear()
        _known_tables[key] = model.tables()
    return _known_tables[key]


def _score(words: Vocabulary, model: LogBilinear):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far, bias, norm = _tables_of(model)
        end = words.end
        log_counts = np.append(np.log10(words.counts + 0.1), 0.0)
        log_totals = np.log10(words.class_totals)
        row = TaskContext.get().partitionId() << 36  # numbers of the stored rows; the rows of a task count on
        for block in blocks(batches):
            keys, classes, bounds, rows = tokens_of(block.column("text"))
            symbols, place = words.symbol_of(keys, classes)
            before, before2 = _contexts(symbols, bounds, end)
            log_p = (near[before, symbols] + far[before2, symbols] + bias[symbols] - norm[before, before2]).astype(np.float64) / np.log(10)
            rare_class = symbols >= words.frequent
            own = log_counts[place]  # 0 outside the head; joined later
            log_p += np.where(rare_class, own - log_totals[classes], 0.0)
            doc = np.repeat(np.arange(rows), np.diff(bounds))
            out = np.flatnonzero(place < 0)
            order = out[np.lexsort((keys[out], doc[out]))]
            k, d = keys[order], doc[order]
            head = np.ones(len(k), bool)
            head[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            at = np.flatnonzero(head)
            n = np.diff(np.append(at, len(k)))
            edges = pa.array(np.searchsorted(d[at], np.arange(rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(row + np.arange(rows)), block.column("id"), pa.array(np.diff(bounds)), pa.array(np.bincount(doc, (place >= 0) & (words.counts[place] > 0), rows).astype(np.int64)),
                pa.array(np.bincount(doc, own, rows)), pa.array(np.bincount(doc, log_p, rows)),
                pa.ListArray.from_arrays(edges, pa.array(k[at].view(np.int64))), pa.ListArray.from_arrays(edges, pa.array(n.astype(np.int32)))],
                [c.split()[0] for c in _SCORED.split(", ")])
            row += rows
    return run


def score_documents(docs: DataFrame, train_docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", epochs: int = EPOCHS,
                    head_tokens: int = HEAD_TOKENS, frequent_tokens: int = FREQUENT) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``, learnt from ``train_docs``.

    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))) with the counts of all training tokens;
    ``score`` the model's log10 probability of the text and its end. Counts of the commonest ``head_tokens`` travel to the
    tasks, those of all other tokens are joined by key, so nothing that grows is broadcast. Null texts are empty (one token,
    the end); repeated rows score alike; without training texts every count is 0.
    """
    train_docs = train_docs.select(F.col(text_column).alias("text"))
    counts = count_tokens(train_docs)
    words = vocabulary(counts, head_tokens, frequent_tokens)
    model = train(train_docs, words, epochs)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    scored = store(rows.mapInArrow(_score(words, model), _SCORED), "scored-rows")
    rare = scored.select("row", F.explode(F.arrays_zip("rare_keys", "rare_n")).alias("token")).select("row", F.col("token.rare_keys").alias("key"), F.col("token.rare_n").alias("m"))
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = (rare.join(counts.select("key", "n"), "key", "left").groupBy("row")
            .agg(F.sum(F.col("m") * F.log10(c + F.lit(0.1))).alias("rare_log"), F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("rare_known")))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    floor = float(np.log10(words.tokens + 0.1 * (words.distinct + 1)))
    return scored.drop("rare_keys", "rare_n").join(sums, "row", "left").select(
        F.col("id").alias("doc_id"), "n_tokens", (F.col("head_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("head_base") + rare_log - F.col("n_tokens") * F.lit(floor)).alias("base_score"), (F.col("model") + rare_log).alias("score"))


def language_scores(docs: DataFrame, **options) -> DataFrame:
    """Scores of all ``docs`` by a model of those whose id's CRC-32 modulo 10 is not 0 (``held_out`` marks the others)."""
    held_out = F.coalesce(fold_of(F.col("doc_id"), 10) == 0, F.lit(False))
    scores = score_documents(docs, docs.where(~held_out), **options)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
