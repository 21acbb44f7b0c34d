"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are enough: a small network is fitted to the non-negative unbiased risk
(du Plessis et al., Kiryo et al.), whose class prior is estimated from the same two samples. Inputs of the network are
measures of a text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, blocks, grams

#: Bounds of the samples a classifier is fitted on.
MOST_POSITIVE, MOST_UNLABELLED = 20_000, 40_000
THRESHOLD = 0.7
HIDDEN = 24
_MARKS = b"#$%&*|!?.,;:\"'()[]{}<>/\\=+-_@~^`"
_CLASSES = np.zeros((256,), np.int64)
_CLASSES[[*range(65, 91)]] = 1
_CLASSES[[*range(97, 123)]] = 2
_CLASSES[[*range(48, 58)]] = 3
_CLASSES[[*range(128, 256)]] = 4
_CLASSES[32] = 5
_CLASSES[10] = 6
for _i, _c in enumerate(_MARKS):
    _CLASSES[_c] = 7 + _i
_N_CLASSES = 7 + len(_MARKS)


def _distinct_share(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, the share of distinct values and the share of the commonest."""
    n = np.bincount(owner, minlength=rows)
    distinct, most = np.zeros(rows), np.zeros(rows)
    if len(values):
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        head = np.ones(len(v), bool)
        head[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(head)
        runs = np.diff(np.append(at, len(v)))
        distinct = np.bincount(o[at], minlength=rows).astype(float)
        np.maximum.at(most, o[at], runs)
    return distinct / np.maximum(n, 1), most / np.maximum(n, 1)


def features(column: pa.Array) -> np.ndarray:
    """One row of measures for each text: lengths, shares of character classes, repetition of words, word pairs and lines."""
    words = Words(column)
    rows, data = words.rows, words.data
    n_bytes = np.diff(words.offsets)
    owner = np.repeat(np.arange(rows), n_bytes)
    shares = np.bincount(owner * _N_CLASSES + _CLASSES[data], minlength=rows * _N_CLASSES).reshape(rows, _N_CLASSES) / np.maximum(n_bytes, 1)[:, None]
    n = np.maximum(words.counts, 1)
    h = words.hashes() if len(words.doc) else np.zeros(0, np.uint64)
    pair_starts = np.flatnonzero(words.doc[1:] == words.doc[:-1]) if len(h) > 1 else np.zeros(0, np.int64)
    pairs = grams(h, 2)[pair_starts] if len(h) > 1 else h
    lines = Words(column, _LINE_ENDS)
    line_hashes = lines.hashes() if len(lines.doc) else np.zeros(0, np.uint64)
    sizes = words.ends - words.starts
    last = _CLASSES[data[words.ends - 1]] if len(h) else np.zeros(0, np.int64)
    first = _CLASSES[data[words.starts]] if len(h) else last
    mean = lambda x: np.bincount(words.doc, x, rows) / n
    letters = shares[:, 1] + shares[:, 2] + shares[:, 4]
    same = np.bincount(words.doc[pair_starts], (h[pair_starts] == h[pair_starts + 1]).astype(float), rows) / n if len(h) > 1 else np.zeros(rows)
    out = [np.log1p(n_bytes), np.log1p(words.counts), np.log1p(lines.counts), mean(sizes), mean(sizes * sizes), shares[:, 1] / np.maximum(letters, 1e-9), letters,
           mean(last >= 7), mean(last == 2), mean(first == 1), mean(first >= 7), mean(sizes == 1), mean(sizes > 20), same,
           *_distinct_share(h, words.doc, rows), *_distinct_share(pairs, words.doc[pair_starts], rows), *_distinct_share(line_hashes, lines.doc, rows)]
    return np.concatenate([np.stack(out, 1), np.sqrt(shares)], 1).astype(np.float32)


_LINE_ENDS = np.zeros(256, bool)
_LINE_ENDS[[10, 13]] = True


class Network:
    """One hidden layer of tanh units on standardised inputs."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.weights = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def inputs(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, z: np.ndarray) -> np.ndarray:
        w, b, v, c = self.weights
        return np.tanh(z @ w + b) @ v + c[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.inputs(x)), -30, 30)))

    def gradient(self, z: np.ndarray, by_logit: np.ndarray) -> list[np.ndarray]:
        w, b, v, _ = self.weights
        hidden = np.tanh(z @ w + b)
        back = np.outer(by_logit, v) * (1 - hidden * hidden)
        return [z.T @ back, back.sum(0), hidden.T @ by_logit, by_logit.sum(keepdims=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(net: Network, step_gradient, steps: int, rate: float, decay: float = 1e-4) -> None:
    """Adam."""
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for t in range(1, steps + 1):
        for i, g in enumerate(step_gradient()):
            g = g + decay * net.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            net.weights[i] = net.weights[i] - rate * (first[i] / (1 - 0.9 ** t)) / (np.sqrt(second[i] / (1 - 0.999 ** t)) + 1e-8)


def estimate_prior(mean: np.ndarray, scale: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, steps: int = 600, batch: int = 512, seed: int = 11) -> float:
    """The share of positives among the unlabelled (raw measures), estimated from the two samples alone.

    A network is told the samples apart on one half of each and ranks the other half. Where no negative ranks, the share
    of the unlabelled above a cut is the prior times the positives' share; any negative above only raises the quotient. So
    it is taken at cuts that keep a half to nine tenths of the positives, over both halves, and the least is the estimate.
    """
    rng = np.random.default_rng(seed)
    quotients = np.zeros(len(_KEPT))
    side_p, side_u = rng.permutation(len(positive)) % 2, rng.permutation(len(unlabelled)) % 2
    for side in (0, 1):
        net = Network(mean, scale, 17 + side)
        p, u = net.inputs(positive), net.inputs(unlabelled)
        train_p, train_u = (p[side_p == side], u[side_u == side]) if min(len(p), len(u)) > 1 else (p, u)
        test_p, test_u = (p[side_p != side], u[side_u != side]) if min(len(p), len(u)) > 1 else (p, u)

        def gradient() -> list[np.ndarray]:
            z = np.concatenate([train_p[rng.integers(0, len(train_p), batch)], train_u[rng.integers(0, len(train_u), batch)]])
            return net.gradient(z, (_sigmoid(net.logits(z)) - np.repeat([1.0, 0.0], batch)) / (2 * batch))

        _descend(net, gradient, steps, 5e-3, 1e-3)
        cuts = np.quantile(net.logits(test_p), 1 - _KEPT)
        ranks = net.logits(test_u)
        quotients += np.array([(ranks >= c).mean() for c in cuts]) / _KEPT / 2
    return float(np.clip(quotients.min(), 0.02, 0.98))


_KEPT = np.array([0.5, 0.6, 0.7, 0.8, 0.9])


def _fit_at(mean: np.ndarray, scale: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int, batch: int, seed: int) -> Network:
    net = Network(mean, scale)
    p, u = net.inputs(positive), net.inputs(unlabelled)
    rng = np.random.default_rng(seed)

    def gradient() -> list[np.ndarray]:
        zp, zu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), batch)]
        gp, gu = net.logits(zp), net.logits(zu)
        rest = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        on_p, on_u = -prior * _sigmoid(gp), _sigmoid(gu)  # of the second term
        if rest < 0:
            by_p, by_u = -on_p, -on_u
        else:
            by_p, by_u = prior * (_sigmoid(gp) - 1) + on_p, on_u
        return net.gradient(np.concatenate([zp, zu]), np.concatenate([by_p, by_u]) / batch)

    _descend(net, gradient, steps, 3e-3)
    return net


def fit(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 1500, batch: int = 1024, seed: int = 3) -> tuple[Network, float]:
    """The network of least non-negative unbiased risk, and the prior used.

    The risk is prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) with the logistic loss; where the second term of
    a batch is negative its gradient is turned round, so that the network doesn't fit the positives out of the unlabelled.

    The minimiser reacts strongly to a prior that is a little too high and hardly to one that is a little too low, so ``MARGIN`` is
    taken off the estimate. No labelled negative is used, neither for the risk nor for the prior.
    """
    everything = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = everything.mean(0), everything.std(0) + 1e-3
    prior = max(estimate_prior(mean, scale, positive, unlabelled) - MARGIN, 0.02)
    return _fit_at(mean, scale, positive, unlabelled, prior, steps, batch, seed), prior


#: What is taken off the estimated class prior.
MARGIN = 0.02


def fold_of(doc_id, folds: int):
    """The CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        measures = pa.array([r.tobytes() for r in features(block.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([block.column("kind"), block.column("doc_id").cast(pa.int64()), measures], ["kind", "doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Network | None:
    """Fit on documents (``doc_id``, ``text``) whose id's CRC-32 modulo 4 is not 2; None without a positive among them.

    Trusted positives are the labelled ids of ``quality`` 1 (and never 0), the ``most_positive`` with the smallest hashes;
    unlabelled are the ``most_unlabelled`` ids with the smallest hashes, whatever their label. Only the measures of these bounded
    samples come to the driver, one row for each id (of the rows that repeat an id the one with the least measures); their ids
    travel to the scan.
    """
    learnable = fold_of(F.col("doc_id"), 4) != 2
    judged = labels.where(learnable).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")

    def sample(ids: DataFrame, most: int, kind: str) -> DataFrame:
        return ids.orderBy(F.xxhash64("doc_id", F.lit(kind)), "doc_id").limit(most).select("doc_id", F.lit(kind).alias("kind"))

    chosen = sample(judged.where("lo = 1"), most_positive, "positive").union(
        sample(docs.select("doc_id").where(learnable).distinct(), most_unlabelled, "unlabelled"))
    measured = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_features_of, "kind string, doc_id long, x binary")
    rows = measured.groupBy("kind", "doc_id").agg(F.min("x").alias("x")).collect()
    raw = {kind: sorted(bytes(r.x) for r in rows if r.kind == kind) for kind in ("positive", "unlabelled")}
    if not raw["positive"] or not raw["unlabelled"]:
        return None
    tables = {kind: np.frombuffer(b"".join(x), np.float32).reshape(len(x), -1) for kind, x in raw.items()}
    return fit(tables["positive"], tables["unlabelled"])[0]


def _score(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            scores = net.scores(features(block.column("text"))) if net else np.ones(block.num_rows)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(scores.astype(np.float64))], ["id", "score"])
    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs`` (``doc_id``, ``text``); ``labels`` has ``doc_id, quality``.

    The score is the estimated probability of quality 1, from the whole text alone; null counts as the empty text.
    Without any trusted positive every score is 1. A null id is not held out. Repeated rows get equal scores; an id
    labelled both ways is no trusted positive.
    """
    net = train(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(_score(net), "id long, score double")
    return scored.select(F.col("id").alias("doc_id"), F.coalesce(fold_of(F.col("id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def _keep(net: Network | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks([batch]):
                good = net.scores(features(block.column("text"))) >= threshold if net else np.ones(block.num_rows, bool)
                yield pa.RecordBatch.from_arrays([block.column("row")], ["row"]).filter(pa.array(good))
    return run


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score below ``threshold``; all columns stay, no shuffle."""
    from pyspark.sql import types as T

    net = train(docs, labels)
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text")
    kept = packed.mapInArrow(_keep(net, threshold), T.StructType([packed.schema["row"]]))
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
