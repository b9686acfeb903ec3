"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target texts (labelled as of good
quality) and one of all texts, give each text a log weight; a text is kept if its
weight plus Gumbel noise is among the k greatest, which draws k texts without
replacement in proportion to their weights.

N-grams are words, word pairs and pairs of word shapes (case, marks, length, whether
the word repeats the one before). The weight is the mean log ratio over a text's
n-grams times ``strength``, so that it doesn't depend on length. k is the share of
good texts among the labels, times the number of rows. The raw model counts every text;
the target model uses at most ``max_target`` labelled texts, taken by a hash of the
identifier.

Cases: a null or empty text has no n-grams and the weight of a text without evidence
(0 before the noise); null labels are left out, repeated ones count once (good if all
say so); a null identifier gets noise of its own; rows that tie at the k-th key are all
kept; without any label every row is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wakeline.llm.common import durable, id_text, text_batches, unused
from wakeline.llm.hashing import mix, windows, words

FAMILIES = 3  # words, word pairs, shape pairs


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15  # of each family
    max_target: int = 20_000
    strength: float = 100.0
    seed: int = 11


def _shapes(data: np.ndarray, starts: np.ndarray, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A small number for the shape of each word."""
    sums = lambda mask: np.add.reduceat(mask.astype(np.int64), starts)
    capital = sums((data >= 65) & (data <= 90))
    small = sums(((data >= 97) & (data <= 122)) | (data >= 128))
    digit = sums((data >= 48) & (data <= 57))
    mark = sums((data > 32) & (data < 128)) - capital - digit - sums((data >= 97) & (data <= 122))
    length = capital + small + digit + mark
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[offsets[:-1][offsets[:-1] < len(hashes)]] = False
    case = np.where(small == 0, np.where(capital > 1, 3, 2), np.where(capital > 0, 1, 0))
    return (((np.minimum(length, 40) // 4) * 4 + case) * 4 + np.minimum(mark, 3)) * 4 + np.minimum(digit, 1) * 2 + same


def ngrams(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each n-gram of the texts, families in separate ranges."""
    hashes, offsets, starts = words(texts)
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    shapes = _shapes(np.frombuffer(b" ".join(texts) + b" ", np.uint8), starts, hashes, offsets)
    size = np.uint64(buckets)
    inside = owner[1:] == owner[:-1]
    pairs = (windows(hashes, 2) % size).astype(np.int64)[inside] + buckets
    forms = (mix(shapes[:-1].astype(np.uint64) * np.uint64(8192) + shapes[1:].astype(np.uint64)) % size).astype(np.int64)
    return (
        np.concatenate([owner, owner[1:][inside], owner[1:][inside]]),
        np.concatenate([(hashes % size).astype(np.int64), pairs, forms[inside] + 2 * buckets]),
    )


def _count(buckets: int):
    def run(batches):
        total = np.zeros((2, FAMILIES * buckets), np.int64)
        for batch in batches:
            wanted = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            at = 0
            for _, texts in text_batches([batch]):
                rows, found = ngrams([t.as_buffer().to_pybytes() for t in texts], buckets)
                good = wanted[at : at + len(texts)]
                at += len(texts)
                total[0] += np.bincount(found, minlength=total.shape[1])
                total[1] += np.bincount(found[good[rows]], minlength=total.shape[1])
        seen = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(seen.astype(np.int32)), "raw": pa.array(total[0][seen]), "target": pa.array(total[1][seen])
        })

    return run


def fit_ratios(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> np.ndarray | None:
    """Log ratio of the target's and the raw probability of each bucket (a bounded array)."""
    s = settings
    known = good_labels(labels).filter("good = 1").select("doc_id")
    chosen = known.orderBy(F.xxhash64(F.lit(s.seed), "doc_id"), "doc_id").limit(s.max_target)
    chosen = chosen.withColumn("target", F.lit(True))  # bounded by max_target
    rows = id_text(docs).join(F.broadcast(chosen), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")
    )
    counted = rows.mapInArrow(_count(s.buckets), "bucket int, raw bigint, target bigint")
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    counts = np.zeros((2, FAMILIES, s.buckets))
    at = table["bucket"].to_numpy()
    counts.reshape(2, -1)[:, at] = [table["raw"].to_numpy(), table["target"].to_numpy()]
    if counts[1].sum() == 0:
        return None
    # The raw model is the prior of the target model, so unseen buckets have ratio 1.
    raw = (counts[0] + 1) / (counts[0] + 1).sum(axis=1, keepdims=True)
    weight = 5.0
    smooth = counts[1] + weight * raw * s.buckets / 64
    return np.log(smooth / smooth.sum(axis=1, keepdims=True) / raw).astype(np.float32).ravel()


def good_labels(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("doc_id is not null and quality is not null")
    return known.groupBy("doc_id").agg(F.min("quality").alias("good"))


def log_weights(docs: DataFrame, ratios: np.ndarray, settings: Settings = Settings()) -> DataFrame:
    """doc_id, mark (a hash of the text) and log_weight for every row."""
    s = settings

    def run(batches):
        for batch in batches:
            at = 0
            for ids, texts in text_batches([batch]):
                rows, found = ngrams([t.as_buffer().to_pybytes() for t in texts], s.buckets)
                family = found // s.buckets
                total = np.zeros(len(texts))
                for k in range(FAMILIES):  # the mean over each family, so that none outweighs another
                    own = family == k
                    sums = np.bincount(rows[own], ratios[found[own]], minlength=len(texts))
                    total += sums / np.maximum(np.bincount(rows[own], minlength=len(texts)), 1)
                marks = batch.column("mark").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays(
                    [ids, marks, pa.array(s.strength * total)], ["doc_id", "mark", "log_weight"]
                )

    rows = id_text(docs).withColumn("mark", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id bigint, mark bigint, log_weight double")


def gumbel(seed: int, *keys: Column | str) -> Column:
    """Gumbel noise fixed by a hash of the keys."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(uniform))


def sortable(value: Column) -> Column:
    """A bigint with the order of a double, in steps of 2^-20."""
    return F.round(F.greatest(F.least(value, F.lit(4e9)), F.lit(-4e9)) * F.lit(float(1 << 20))).cast("bigint")


def kth_greatest(keys: DataFrame, name: str, k: int) -> int | None:
    """The k-th greatest bigint, digit by digit: each round counts at most 2^16 groups, no sort of rows."""
    lift = 1 << 62  # keys are smaller than this in size
    column = F.col(name) + F.lit(lift)
    found, left = 0, k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(column, shift).bitwiseAND(F.lit(0xFFFF))
        inside = keys.filter(F.shiftright(column, shift + 16) == F.lit(found >> (shift + 16))) if shift < 48 else keys
        sizes = inside.groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(sizes, key=lambda r: -r["digit"]):
            if left <= row["n"]:
                found |= int(row["digit"]) << shift
                break
            left -= row["n"]
        else:
            return None  # fewer than k rows
    return found - lift


def resample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per document: doc_id, mark, log_weight, gumbel_key, kept."""
    s = settings
    ratios = fit_ratios(docs, labels, s)
    if ratios is None:
        rows = id_text(docs).withColumn("mark", F.xxhash64("text")).withColumn("log_weight", F.lit(0.0))
    else:
        rows = log_weights(docs, ratios, s)
    key = F.col("log_weight") + gumbel(s.seed, "doc_id", "mark")
    keyed = durable(rows.select("doc_id", "mark", "log_weight", key.alias("gumbel_key"), sortable(key).alias("_key")))
    n = keyed.count()
    share = good_labels(labels).join(keyed.select("doc_id").distinct(), "doc_id").agg(F.avg("good")).first()[0]
    bound = kth_greatest(keyed, "_key", -int(-n * share // 1)) if ratios is not None and share and n else None
    kept = F.lit(True) if bound is None else F.col("_key") >= F.lit(bound)
    return keyed.select("doc_id", "mark", "log_weight", "gumbel_key", kept.alias("kept"))


def keep_sampled(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The input's rows and columns that the resampling keeps."""
    mark, key, other = (unused(docs, name) for name in ("_mark", "_drawn_id", "_drawn_mark"))
    drawn = resample(docs, labels, settings).filter("kept").select(
        F.col("doc_id").alias(key), F.col("mark").alias(other)
    ).distinct()
    marked = docs.withColumn(mark, F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.col(mark) == F.col(other))
    return marked.join(drawn, same, "left_semi").drop(mark)
