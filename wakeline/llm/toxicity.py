"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; texts of the whole table, labels unseen, are
the unlabelled. A linear model in numpy minimises the class-prior-corrected risk
``prior * risk(P, +1) + max(0, risk(U, -1) - prior * risk(P, -1))``; where the second
term turns negative its gradient is followed upwards, which keeps the model from
memorising the positives.

Features are words and word beginnings of the text, present or absent. The class
prior is counted over all training labels; the fit uses at most ``max_positive`` and
``max_unlabelled`` training rows, taken by a hash of their distinct identifiers, one row
each (the text that hashes lowest), and at most ``max_features`` features. Scoring is row by row over all texts.

Cases: a null or empty text has no features and gets the score of the intercept;
null labels are left out, repeated ones count once (toxic if any says so); a null
identifier is scored and never used for training; without any positive the score is
0 everywhere; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wakeline.llm.common import durable, held_out, id_text, text_batches

WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5, 6)
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    max_positive: int = 4000
    max_unlabelled: int = 12000
    max_features: int = 1024
    least_positive: int = 5  # positives that must hold a feature
    least_gain: float = 4.5
    steps: int = 1500
    batch: int = 512
    rate: float = 0.02
    decay: float = 1e-5
    seed: int = 7


def features_of(word: str) -> list[str]:
    """The word, and its beginnings marked by a star."""
    return [word, *[word[:k] + "*" for k in BEGINNINGS if len(word) > k]]


def text_features(text: str) -> set[str]:
    return {f for word in set(WORD.findall(text.lower())) for f in features_of(word)}


def _count(batches):
    """(feature, positives, unlabelled) with counts combined inside the task, flushed at a bounded size."""
    counts: dict[str, list[int]] = {}

    def flush():
        keys = list(counts)
        out = pa.RecordBatch.from_pydict({
            "feature": pa.array(keys, pa.string()),
            "pos": pa.array([counts[k][0] for k in keys], pa.int64()),
            "unl": pa.array([counts[k][1] for k in keys], pa.int64()),
        })
        counts.clear()
        return out

    for batch in batches:
        for text, positive in zip(batch.column("text"), batch.column("positive")):
            side = 0 if positive.as_py() else 1
            for f in text_features(text.as_py()):
                counts.setdefault(f, [0, 0])[side] += 1
            if len(counts) > 300_000:
                yield flush()
    yield flush()


def _indices(names: list[str]):
    at = {f: k for k, f in enumerate(names)}

    def find(text: str, memo: dict) -> list[int]:
        found: set[int] = set()
        for word in set(WORD.findall(text.lower())):
            own = memo.get(word)
            if own is None:
                own = tuple(at[f] for f in features_of(word) if f in at)
                if len(memo) > 300_000:
                    memo.clear()
                memo[word] = own
            if own:
                found.update(own)
        return sorted(found)

    return find


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    bias: float

    def score(self, rows: list[list[int]]) -> np.ndarray:
        z = np.array([self.bias + self.weights[r].sum() for r in rows], float)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and intercept of a linear model on 0/1 rows (bytes), logistic loss, Adam."""
    rng = np.random.default_rng(s.seed)
    k = positive.shape[1]
    w = np.zeros(k + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    rounds = max(1, -(-len(unlabelled) // s.batch))
    share = max(1, min(len(positive), s.batch))
    for step in range(1, s.steps + 1):
        r = (step - 1) % rounds
        if r == 0:
            order = rng.permutation(len(unlabelled))
        u = unlabelled[order[r * s.batch : (r + 1) * s.batch]].astype(np.float32)
        p = positive[rng.integers(0, len(positive), share)].astype(np.float32)
        zu, zp = u @ w[:-1] + w[-1], p @ w[:-1] + w[-1]
        up = 1.0 / (1.0 + np.exp(-np.clip(zu, -40, 40)))  # d/dz of log(1 + e^z)
        pp = 1.0 / (1.0 + np.exp(-np.clip(zp, -40, 40)))
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        grad_u = np.append(up @ u, up.sum()) / len(u) - prior * np.append(pp @ p, pp.sum()) / len(p)
        grad_p = prior * np.append((pp - 1) @ p, (pp - 1).sum()) / len(p)
        grad = grad_p + grad_u if negative_risk >= 0 else -grad_u
        grad[:-1] += s.decay * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w -= s.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on training rows only (crc32 of the identifier modulo 4 is not 2)."""
    s = settings
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"), 4))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or not toxic:
        return None
    prior = min(max(toxic / n, 1e-4), 0.9)
    order = F.xxhash64(F.lit(s.seed), "doc_id")
    chosen = known.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(s.max_positive)
    rows = id_text(docs)
    some = rows.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 4))
    some = some.distinct().orderBy(order, "doc_id").limit(s.max_unlabelled)
    # Both lists are bounded by the settings, so they may be broadcast; an identifier gives one row,
    # whose text hashes lowest, so that the sample is bounded too.
    ids = chosen.withColumn("positive", F.lit(True)).unionByName(some.withColumn("positive", F.lit(False)))
    sample = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "positive").agg(
        F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = durable(sample.select("text", "positive"))
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_pos, n_unl = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_unl:
        return None
    counted = sample.mapInArrow(_count, "feature string, pos bigint, unl bigint")
    counted = counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl"))
    p, u = F.col("pos") / F.lit(float(n_pos)), (F.col("unl") + 1) / F.lit(float(n_unl + 2))
    # Signed root of the likelihood ratio of a feature's share among positives against its share in all texts.
    gain = F.when(p > u, F.sqrt(2.0 * n_pos * F.greatest(F.lit(0.0), p * F.log(p / u) + (1 - p) * F.log(
        F.greatest(1 - p, F.lit(1e-12)) / F.greatest(1 - u, F.lit(1e-12)))))).otherwise(0.0)
    best = counted.filter(F.col("pos") >= s.least_positive).select("feature", gain.alias("gain"))
    names = [r["feature"] for r in best.filter(F.col("gain") > s.least_gain).orderBy(F.desc("gain"), "feature").limit(s.max_features).collect()]
    find = _indices(names)

    def index(batches):
        memo: dict = {}
        for batch in batches:
            found = [np.array(find(t.as_py(), memo), "<i2").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_pydict({"positive": batch.column("positive"), "found": pa.array(found, pa.binary())})

    indexed = sample.mapInArrow(index, "positive boolean, found binary").orderBy("positive", "found").toArrow()
    sides = {True: np.zeros((n_pos, len(names)), np.uint8), False: np.zeros((n_unl, len(names)), np.uint8)}
    filled = {True: 0, False: 0}
    for positive, found in zip(indexed["positive"].to_pylist(), indexed["found"].to_pylist()):
        sides[positive][filled[positive], np.frombuffer(found, "<i2")] = 1
        filled[positive] += 1
    weights, bias = fit_nnpu(sides[True], sides[False], prior, s)
    return Model(names, weights, bias)


def score_with(model: Model | None, docs: DataFrame) -> DataFrame:
    """doc_id and score for every row."""
    if model is None:
        return id_text(docs).select("doc_id", F.lit(0.0).alias("score"))
    find = _indices(model.names)

    def run(batches):
        memo: dict = {}
        for ids, texts in text_batches(batches):
            scores = model.score([find(t.as_py(), memo) for t in texts])
            yield pa.RecordBatch.from_arrays([ids, pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_text(docs).mapInArrow(run, "doc_id bigint, score double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score_with(train(docs, labels, settings), docs)
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The input's rows and columns without texts predicted toxic; no row is shuffled."""
    model = train(docs, labels, settings)
    if model is None:
        return docs
    find = _indices(model.names)
    at = docs.columns.index("text")

    def run(batches):
        memo: dict = {}
        for batch in batches:
            texts = batch.column(at)
            rows = [find(t.as_py() or "", memo) for t in texts]
            yield batch.filter(pa.array(model.score(rows) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
