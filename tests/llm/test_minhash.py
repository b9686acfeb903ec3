"""MinHash near duplicates against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import minhash_bayes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["class", "key", "name", "signature", "kept", "u", "v", "part", "hub", "text_"]


def shingles(text, size):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(found) < size:
        return {tuple(found)} if found else set()
    return {tuple(found[k : k + size]) for k in range(len(found) - size + 1)}


def plain(rows, size=3, percent=85):
    sets = [shingles(t, size) for _, t in rows]
    part = list(range(len(rows)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                part[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[k] else i
        out.append((i, len(sets[k]), least, i == least))
    return sorted(out, key=str)


def edited(words, n, rng):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def group_rows():
    """Exact copies, a chain, edits about the threshold, and a group that is alike but mostly not linked."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.choice([5, 12, 60, 150]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(6):
            rows.append((len(rows), edited(base, min(len(base), rng.choice([0, 0, 1, 1, 2, 3, 5])), rng)))
    base = [word() for _ in range(200)]
    rows += [(5000 + k, edited(base, 6 + k % 9, rng)) for k in range(150)]
    chain = [word() for _ in range(120)]
    for k in range(30):
        chain[(7 * k) % 120] = word()
        rows.append((9000 - k, " ".join(chain)))
    rows += [
        (20_000, None), (20_001, ""), (20_002, " \n\t"), (20_003, "one"), (20_004, "ONE"), (20_005, "one two"),
        (None, rows[0][1]), (None, rows[8][1]), (None, "alone without a name"), (0, rows[0][1]), (1, rows[0][1].upper()), (None, None),
        (20_006, "same " * 3000), (20_007, "same " * 3100), (0, "another text with a used name"),
    ]
    return rows


@pytest.mark.parametrize("block", [512, 16])
def test_components(spark, block, monkeypatch):
    monkeypatch.setattr(minhash_bayes, "BLOCK", block)
    rows = group_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    found = minhash_bayes.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_other_parameters_and_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(minhash_bayes, "BROADCAST_ROWS", 0)
    rows = group_rows()[:150]
    found = minhash_bayes.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 90)
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows, 5, 90)


def test_empty_and_unlinked_tables(spark):
    kinds = "doc_id bigint, text string"
    assert minhash_bayes.near_duplicates(spark.createDataFrame([], kinds)).count() == 0
    rows = [(None, None), (3, " "), (4, "a b c d"), (5, "e f g h")]
    found = minhash_bayes.near_duplicates(spark.createDataFrame(rows, kinds))
    assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_a_text_above_the_batch_size(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(700_000)]
    rows = [(1, " ".join(words)), (2, edited(words, 9000, rng)), (3, edited(words, 60_000, rng)), (4, "short one here")]
    found = {r["doc_id"]: r["component_id"] for r in minhash_bayes.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4}


def test_pruning_keeps_to_the_chosen_chance():
    """The cut is the last number of matches whose exact posterior chance is at most the miss."""
    from fractions import Fraction
    from math import comb

    t = Fraction(85, 100)
    chance = lambda n, m: sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m + 1))
    for n, need in minhash_bayes.least_matches():
        assert chance(n, need) > minhash_bayes.MISS >= chance(n, need - 1)
    assert [n for n, _ in minhash_bayes.least_matches()] == [32, 64, 96, 128]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    left, right = np.unique(tokens[:900]), np.unique(tokens[100:])
    a, b = minhash_bayes.signatures([left, right])
    assert abs((a == b).mean() - 0.8) < 0.12
    assert (minhash_bayes.signatures([right])[0] == b).all()
    at, matches = minhash_bayes.survivors(np.stack([a, a]), np.stack([b, ~a]), minhash_bayes.least_matches())
    assert at.tolist() == [0] and matches.tolist() == [(a == b).sum()]


def test_long_buckets_are_found_over_batches():
    import pyarrow as pa

    keys = np.sort(np.r_[np.repeat(5, 7), 6, 7, np.repeat(8, 3), 9, 9, 10, 11, 11, 12])
    rows = [(5, k) for k in range(7)] + [(8, k) for k in (9, 10, 11)] + [(9, 12), (9, 13), (11, 15), (11, 16), (12, 17)]
    for step in (1, 2, 3, 5, 50):
        batches = [pa.RecordBatch.from_pydict({"key": keys[k : k + step], "class": np.arange(len(keys))[k : k + step]})
                   for k in range(0, len(keys), step)]
        out = [x for b in minhash_bayes._shared(iter(batches)) for x in zip(b["key"].to_pylist(), b["class"].to_pylist())]
        assert out == rows, step
