"""The text operators against plain Python on a small table with awkward rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import (
    byte_bpe, components, exact_dedup, licenses, line_dedup, lm_scoring, packing, quality_rules, resampling,
    similarity_join, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ["n_words", "kept", "score", "_sha", "_mark", "node", "row", "length", "u", "head", "lang"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base_text(seed, n=120):
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(60))
                    for _ in range(n))


def awkward_rows():
    a, b = base_text(1), base_text(2)
    near = a.split()
    near[7] = "changed"
    passage = "\n".join(f"shared line {k} {base_text(40 + k, 4)}" for k in range(4))
    rows = [
        (1, a), (2, b), (3, a), (4, " ".join(near)), (5, a.replace(" ", "  \t")), (6, None), (7, ""), (8, " \n\t "),
        (9, "one"), (10, "one"), (11, "two three"), (12, "Ünïcode ñ\x1c\x1d wörds here 東京 \U0001f600 don't  'll"),
        (13, "x" * 50_000), (14, base_text(3, 6000)), (15, "ha " * 400), (16, passage + "\nown end"),
        (17, "own start\n" + passage + "\n\nother"), (18, passage), (19, "SHOUT!! LOUD!! " * 60),
        (20, "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC 4.0"),
        (21, "# SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\nunder the mit license under the mit license"),
        (22, "<|endoftext|> text  with | pipes # and * marks"), (23, a), (None, a), (None, "no id"), (None, None),
        (1, a), (24, "line\nline\nline\n\nline"), (25, " ".join(near[:-1])), (26, b.upper()),
    ]
    return rows + [(100 + k, base_text(100 + k, 60 + k)) for k in range(20)]


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return frame.select("*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])


@pytest.fixture(scope="module")
def labels(spark, rows):
    found = [(i, 0 if t and ("SHOUT" in t or "ha ha" in t) else 1, int(i is not None and i >= 110)) for i, t in rows]
    return spark.createDataFrame([*found, (1, None, None), (None, 1, 1), (999, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_empty_tables(nothing, labels):
    none = labels.limit(0)
    for found in (
        quality_rules.quality_verdicts(nothing), licenses.license_scan(nothing), line_dedup.delete_repeated_runs(nothing),
        packing.pack_documents(nothing), similarity_join.similar_components(nothing), byte_bpe.round_trip(nothing),
        toxicity.toxicity_scores(nothing, none), lm_scoring.score_documents(nothing), exact_dedup.exact_groups(nothing),
        resampling.resample(nothing, none), toxicity.keep_clean(nothing, none), resampling.keep_sampled(nothing, none),
        exact_dedup.drop_exact_copies(nothing), similarity_join.keep_one_of_each(nothing),
    ):
        assert found.count() == 0


def test_filters_keep_the_columns(docs, labels):
    for found in (
        toxicity.keep_clean(docs, labels), resampling.keep_sampled(docs, labels),
        exact_dedup.drop_exact_copies(docs), similarity_join.keep_one_of_each(docs),
    ):
        assert found.columns == docs.columns
        assert 0 < found.count() <= docs.count()


def test_quality_rules(docs, rows):
    def plain(text):
        words = WORD.findall(text or "")
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {p + k for p, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        n = len(words)
        return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
                len(covered), n < 50 or 100 * len(covered) > 50 * n)

    found = quality_rules.quality_verdicts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    assert sorted(map(tuple, found), key=str) == sorted([(i, *plain(t)) for i, t in rows], key=str)


def test_policies_and_ablations(docs):
    rows = quality_rules.ledger(docs).cache()
    verdicts = quality_rules.apply_policies(rows, [quality_rules.BASE, quality_rules.FULL]).collect()
    for r in verdicts:
        assert r["full_v1"] == (r["failed"] == 0)
        assert r["base_v1"] == (r["failed"] & 3 == 0)
    table = {r["rule"]: r for r in quality_rules.ablations(rows, quality_rules.FULL).collect()}
    bits = [r["failed"] for r in verdicts]
    for name, bit in quality_rules.BITS.items():
        assert table[name]["fail"] == sum(b & bit != 0 for b in bits)
        assert table[name]["fail_only_this"] == sum(b == bit for b in bits)
        assert table[name]["kept_without"] == sum(b & ~bit == 0 for b in bits)
        assert table[name]["kept_with"] == sum(b == 0 for b in bits)


def test_license_base(docs, rows):
    phrases = {tuple(p.split()): label for p, label in licenses.BASE_PHRASES.items()}

    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        hits = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        places = [k for k, _ in hits]
        return (len(words), len(hits), min(places, default=None), max(places, default=None),
                ",".join(sorted({label for _, label in hits})))

    found = licenses.license_scan(docs).collect()
    assert sorted([tuple(r[:6]) for r in found], key=str) == sorted([(i, *plain(t)) for i, t in rows], key=str)
    for r in found:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    tagged = next(r for r in found if r["doc_id"] == 21)
    assert tagged["labels"] == "apache-2,gpl-2,mit" and tagged["n_base"] == 2 and tagged["permission"] == 1.0


@pytest.mark.parametrize("text, names, level", [
    ("mit or gpl-3.0-only and foo", {"mit", "gpl-3", "foo"}, 1.0), ("(mit or gpl-3.0-only) and gpl-2.0-only", {"mit", "gpl-3", "gpl-2"}, 0.3),
    ("gpl-2.0-only with classpath-exception-2.0 or cc-by-nc-4.0", {"gpl-2", "cc-by-nc"}, 0.3),
    ("mit and", {"mit"}, None), ("", set(), None), ("lgpl-2.1+ and mit", {"lgpl-2.1", "mit"}, 0.6),
])
def test_license_expressions(text, names, level):
    assert licenses.read_expression(text) == (names, level)


def plain_repeats(rows):
    """Later repeats of the shortest runs with 50 words or 3 lines, by content."""
    order = sorted({(i is None, i or 0, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    seen, dead = set(), collections.defaultdict(set)
    for none, i, text in order:
        lines = [(k, line, len(WORD.findall(line))) for k, line in enumerate(text.split("\n")) if WORD.search(line)]
        for a in range(len(lines)):
            for b in range(a + 1, min(a + 3, len(lines)) + 1):
                run = lines[a:b]
                if len(run) == 3 or sum(n for *_, n in run) >= 50:
                    key = tuple(line for _, line, _ in run)
                    if key in seen:
                        dead[none, i, text] |= {k for k, *_ in run}
                    seen.add(key)
                    break
    return dead


def test_line_dedup(docs, rows):
    rows = [r for r in rows if r[0] is not None]  # texts of null identifiers have no order among themselves
    dead = plain_repeats(rows)
    found = line_dedup.delete_repeated_runs(docs.filter("doc_id is not null")).collect()
    expected = []
    for i, t in rows:
        gone = dead[False, i, t] if t is not None else set()
        lines = [] if t is None else t.split("\n")
        expected.append((i, None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert next(r for r in found if r["doc_id"] == 17)["n_deleted"] == 4


def test_packing(docs, rows, spark):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(packing.tokenizer_file(packing.VOCABULARY))
    packed = packing.pack_documents(docs).cache()
    expected = collections.Counter()
    for i, t in rows:
        ids = model.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 if len(ids) > 2048 else len(ids)
        cuts = [0, *range(first, len(ids), 2048)] if first else list(range(0, len(ids), 2048))
        for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)])):
            expected[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    found = packed.collect()
    assert collections.Counter(tuple(r)[:5] for r in found) == expected
    groups = collections.defaultdict(list)
    for r in found:
        groups[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in groups.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *[n for _, n in parts]])[:-1])
        assert sum(n for _, n in parts) <= 2048
    total = sum(r["length"] for r in found)
    assert len(groups) <= -(-total // 2048) + 1
    filled = packing.sequences(docs, packed).collect()
    assert sum(len(r["ids"]) for r in filled) == total and len(filled) == len(groups)


def test_packing_program():
    rng = random.Random(4)
    counts = collections.Counter(min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(20_000))
    program = packing.covering_program(dict(counts), 2048)
    for length, n in counts.items():
        assert sum(found.get(length, 0) * amount for found, amount in program) >= n * (1 - 1e-9)
    assert all(sum(k * v for k, v in found.items()) <= 2048 for found, _ in program)
    lower_bound = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert packing.make_plan(dict(counts)).sequences <= lower_bound * 1.01 + 1


def test_similar_components(docs, rows):
    def shingles(text):
        w = WORD.findall(lower(text or ""))
        return frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    expected = [(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)]
    found = similarity_join.similar_components(docs).collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert dict((r[0], r[2]) for r in found)[4] == 1


def test_similar_components_of_chains(spark):
    """Groups whose members differ from each other more than from their neighbours."""
    rng = random.Random(9)
    rows = []
    for group in range(6):
        words = base_text(500 + group, 150).split()
        for k in range(40):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([1, 1, 2, 4, 9])):
                words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    sets = [set(zip(w, w[1:], w[2:], w[3:])) for w in (t.split() for _, t in rows)]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = {r["doc_id"]: r["component_id"] for r in similarity_join.similar_components(docs).collect()}
    assert found == {k: root(k) for k in range(len(rows))}


def test_block_links():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 80, replace=False)
    sets = []
    for k in range(60):
        own = base.copy()
        own[rng.choice(80, rng.integers(0, 14), replace=False)] = rng.integers(10**6, 10**7, 1)[0] + k
        sets.append((k, k % 7, np.unique(own).astype(np.uint64)))
    queries, block = sets[:25], sets
    linked = set()
    for a, p, s in queries:
        for b, q, t in block:
            both = len(set(s.tolist()) & set(t.tolist()))
            if p != q and 100 * both >= 85 * (len(s) + len(t) - both):
                linked.add((min(p, q), max(p, q)))
    counts = collections.Counter(t for _, _, s in sets for t in s.tolist())
    levels = np.zeros(similarity_join.PLACES, np.uint8)
    for token, n in counts.items():
        at = token % similarity_join.PLACES
        levels[at] = max(levels[at], sum(n >= least for least in similarity_join.LEVELS))
    found = similarity_join.block_links(queries, block, similarity_join.Order(levels))
    assert {tuple(sorted((a % 7, b % 7))) for a, b in found.values()} == linked == set(found)
    postings = similarity_join._Postings([s for _, _, s in block])
    for _, _, s in queries:
        assert postings.overlaps(s).tolist() == [len(np.intersect1d(s, t)) for _, _, t in block]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert found == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100}


def test_byte_bpe(docs, rows):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = []
    for i, t in rows:
        ids = model.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, byte_bpe.round_trip(docs).collect()), key=str) == sorted(expected, key=str)
    some = docs.filter("doc_id < 13")
    encoded = byte_bpe.encode_documents(some)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()}[12] == model.encode_ordinary(dict(rows)[12])
    assert {r["doc_id"]: bytes(r["data"]) for r in byte_bpe.decode_documents(encoded).collect()}[12] == dict(rows)[12].encode()


def test_byte_bpe_random_merges():
    import public_tokenizers
    import tiktoken

    own = byte_bpe.codec(public_tokenizers.path(byte_bpe.VOCABULARY))
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng, tokens = random.Random(2), list(own.ranks)
    for _ in range(1500):
        text = b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 8))).decode("utf-8", "ignore")
        assert own.encode(text) == model.encode_ordinary(text)
    old, byte_bpe.STREAM_CHARS = byte_bpe.STREAM_CHARS, 10
    try:
        assert own.encode("streamed words in pieces") == model.encode_ordinary("streamed words in pieces")
    finally:
        byte_bpe.STREAM_CHARS = old


def toxic_table(spark):
    rng = random.Random(6)
    rows, marks = [], []
    for i in range(1200):
        words = base_text(1000 + i, 40).split()
        toxic = rng.random() < 0.15
        if toxic:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["vileword", "nastyword", "foulword"])
        rows.append((i, " ".join(words)))
        if rng.random() < 0.6:
            marks.append((i, 1, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id bigint, text string"),
            spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), dict(rows))


def test_toxicity_held_out(spark):
    docs, labels, texts = toxic_table(spark)
    hits = collections.Counter()
    for r in toxicity.toxicity_scores(docs, labels).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["held_out"]:
            hits[bool(re.search("vileword|nastyword|foulword", texts[r["doc_id"]])), r["predicted"]] += 1
    assert hits[True, 1] >= 0.9 * (hits[True, 0] + hits[True, 1]) and hits[False, 1] == 0 and hits[False, 0] > 100


def test_toxicity_learns_from_training_labels_only(spark):
    docs, labels, _ = toxic_table(spark)
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.toxicity_scores(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def plain_risk_steps(positive, unlabelled, prior, s):
    """The non-negative risk's gradient steps written out, one row at a time."""
    rng = np.random.default_rng(s.seed)
    k = positive.shape[1]
    w, first, second = [0.0] * k + [math.log(prior / (1 - prior))], [0.0] * (k + 1), [0.0] * (k + 1)
    rounds, share = max(1, -(-len(unlabelled) // s.batch)), max(1, min(len(positive), s.batch))
    for step in range(1, s.steps + 1):
        r = (step - 1) % rounds
        if r == 0:
            order = rng.permutation(len(unlabelled))
        lots = {"u": unlabelled[order[r * s.batch : (r + 1) * s.batch]], "p": positive[rng.integers(0, len(positive), share)]}
        loss, up, down = {}, {}, {}
        for name, rows in lots.items():
            loss[name], up[name], down[name] = 0.0, [0.0] * (k + 1), [0.0] * (k + 1)
            for row in rows:
                x = [*map(float, row), 1.0]
                z = sum(a * b for a, b in zip(x, w))
                chance = 1 / (1 + math.exp(-z))
                loss[name] += math.log1p(math.exp(z)) / len(rows)
                for j in range(k + 1):
                    up[name][j] += chance * x[j] / len(rows)
                    down[name][j] += (chance - 1) * x[j] / len(rows)
        for j in range(k + 1):
            negative = up["u"][j] - prior * up["p"][j]
            g = prior * down["p"][j] + negative if loss["u"] - prior * loss["p"] >= 0 else -negative
            g += s.decay * w[j] if j < k else 0.0
            first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.999 * second[j] + 0.001 * g * g
        for j in range(k + 1):
            w[j] -= s.rate * (first[j] / (1 - 0.9**step)) / (math.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return w


@pytest.mark.parametrize("prior", [0.1, 0.7])
def test_toxicity_risk_equals_plain_steps(prior):
    """Also where the negative part turns below zero and is followed upwards."""
    rng = np.random.default_rng(1)
    positive = (rng.random((20, 4)) < [0.9, 0.2, 0.5, 0.1]).astype(np.uint8)
    unlabelled = (rng.random((50, 4)) < [0.3, 0.2, 0.5, 0.4]).astype(np.uint8)
    s = toxicity.Settings(steps=120, batch=16, rate=0.1)
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, prior, s)
    assert np.allclose([*weights, bias], plain_risk_steps(positive, unlabelled, prior, s), atol=1e-4)


def test_toxicity_sample_is_bounded_by_rows(spark):
    """One identifier with thousands of rows adds one row, and doesn't crowd the others out."""
    bad, good = "vile nasty awful words here", "calm kind gentle words here"
    base = [(k, f"{bad if k % 5 == 0 else good} {k}") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    s = toxicity.Settings(max_positive=40, max_unlabelled=100, steps=50)
    kinds = "doc_id long, text string"
    one = toxicity.train(spark.createDataFrame(base, kinds), labels, s)
    many = toxicity.train(spark.createDataFrame(base + [base[0], base[1], base[5], base[7]] * 3000, kinds), labels, s)
    assert one.names == many.names and one.names and np.allclose(one.weights, many.weights) and one.bias == many.bias


def test_toxicity_awkward_rows(docs, rows, labels):
    found = toxicity.toxicity_scores(docs, labels)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == len(rows)


def test_lm_scoring(docs, rows):
    found = lm_scoring.score_documents(docs).collect()
    words = [WORD.findall(lower(t or "")) for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    counts = collections.Counter(w for ws, h in zip(words, held) if not h for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for (i, _), ws, h in zip(rows, words, held):
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None])
        expected.append((i, h, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(base, 6)))
    assert sorted([(*r[:5], round(r["base_score"], 6)) for r in found], key=str) == sorted(expected, key=str)
    assert all(r["score"] < 0 for r in found)


def test_lm_joins_rare_words(docs, rows):
    few = lm_scoring.score_documents(docs, settings=lm_scoring.Settings(head_words=3)).collect()
    many = lm_scoring.score_documents(docs).collect()
    key = lambda r: (str(r["doc_id"]), r["n_tokens"], r["n_known"])
    for a, b in zip(sorted(few, key=key), sorted(many, key=key)):
        assert key(a) == key(b) and a["base_score"] == pytest.approx(b["base_score"], rel=1e-9)


def small_model(**changes):
    rng = np.random.default_rng(0)
    classes = lm_scoring.make_classes(rng.integers(0, 100, 50257), np.zeros(50257, np.int64), 20)
    settings = lm_scoring.Settings(width=4, overlap=3, stride=5, batch=8, **changes)
    return lm_scoring.Attention(settings, classes, rng.standard_normal((36, 36)).astype(np.float32))


def test_lm_gradients():
    model = small_model()
    model.weights = {k: w.astype(float) for k, w in model.weights.items()}
    x, y, _ = model.windows([np.random.default_rng(2).integers(0, 50000, 23).astype(np.int32)])
    grads, n = model.gradients(x, y)
    for name, w in model.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), w.shape)
        ends = []
        for step in (1e-5, -2e-5):
            w[at] += step
            ends.append(-model.log_probability(x, y).sum() / n)
        w[at] += 1e-5
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=1e-3)


def test_lm_windows_score_each_id_once():
    model = small_model()
    ids = [np.arange(k, dtype=np.int32) for k in (0, 1, 4, 5, 6, 17)]
    _, y, numbers = model.windows(ids)
    at = 0
    for text, n in zip(ids, numbers):
        mine = y[at : at + n].ravel()
        assert mine[mine >= 0].tolist() == [*text.tolist(), lm_scoring.END_ID]
        at += n
    # Batches don't change a score, and later ids don't change the score of earlier ones.
    x, y, _ = model.windows([np.arange(40, dtype=np.int32)])
    assert np.allclose(model.log_probability(x, y), np.concatenate([model.log_probability(x[k : k + 1], y[k : k + 1]) for k in range(len(x))]), atol=1e-4)
    sums = np.exp(model._forward(x)[5]).sum(axis=2)
    assert np.isfinite(sums).all()


def test_exact_groups(docs, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    for parts in (1, 7):
        found = exact_dedup.exact_groups(docs, parts).collect()
        expected = []
        for (i, _), t in zip(rows, norm):
            known = [k for k in groups[t] if k is not None]
            expected.append((i, min(known, default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()))
        assert sorted([(r[0], r[1], r[2], r[4]) for r in found], key=str) == sorted(expected, key=str)
        kept = collections.Counter(r["text_sha256"] for r in found if r["kept"])
        assert set(kept.values()) == {1} and len(kept) == len(groups)
        assert all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])


def test_exact_groups_across_ranges(spark):
    """One text holds most rows, so it spans several ranges."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id % 10 = 0, concat('t', id), 'same  text') as text")
    found = exact_dedup.exact_groups(docs, 9)
    assert found.filter("kept").count() == 301
    assert {tuple(r) for r in found.filter("doc_id % 10 <> 0").select("keep_id", "group_size").distinct().collect()} == {(1, 2700)}


def test_resampling(docs, labels, rows):
    found = resampling.resample(docs, labels).collect()
    assert len(found) == len(rows)
    good = {}
    for r in labels.collect():
        if r["doc_id"] is not None and r["quality"] is not None:
            good[r["doc_id"]] = min(r["quality"], good.get(r["doc_id"], 1))
    ids = {i for i, _ in rows if i is not None}
    share = sum(good[i] for i in ids) / len(ids)
    k = math.ceil(len(rows) * share - 1e-9)
    keys = sorted((r["gumbel_key"] for r in found), reverse=True)
    assert {r["gumbel_key"] for r in found if r["kept"]} == set(keys[:k])
    weights = {r["doc_id"]: r["log_weight"] for r in found}
    assert max(weights[15], weights[19]) < min(weights[k] for k in range(100, 120))


def test_kth_greatest(spark):
    values = [random.Random(k).randrange(-(2**50), 2**50) for k in range(500)] + [5] * 30
    frame = spark.createDataFrame([(v,) for v in values], "v bigint")
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 77, 300, 530):
        assert resampling.kth_greatest(frame, "v", k) == ranked[k - 1]
    assert resampling.kth_greatest(frame, "v", 531) is None


def test_class_pairs_cover_all_training_texts(docs, rows, monkeypatch):
    """The bigram table counts every training text, also on tables too small for the shares."""
    path = lm_scoring.tokenizer_file(lm_scoring.VOCABULARY)
    codes = lm_scoring.Subwords(path)
    ids = [codes.texts([lm_scoring.text_words((t or "").encode())])[0] for _, t in rows]
    training = [x for x, (i, _) in zip(ids, rows) if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    seen = {}
    found, taught = lm_scoring.class_pairs, []
    monkeypatch.setattr(lm_scoring, "class_pairs", lambda t, classes, *a: seen.setdefault("pairs", (found(t, classes, *a), classes))[0])
    scored = lm_scoring.id_text(docs).filter(~lm_scoring.held_out(F.col("doc_id"), 7))
    model = lm_scoring.fit(scored, lm_scoring.word_counts(scored), path)
    pairs, classes = seen["pairs"]
    expected = np.zeros((classes.number, classes.number))
    for x in training:
        chain = classes.of[[lm_scoring.END_ID, *x, lm_scoring.END_ID]]
        np.add.at(expected, (chain[:-1], chain[1:]), 1)
    assert (pairs == expected).all()
    # A single text trains too, whatever its share.
    for i in range(6):
        one = scored.limit(0).unionByName(scored.sparkSession.createDataFrame([(i, "a few words of one text")], "doc_id bigint, text string"))
        small = lm_scoring.fit(one, lm_scoring.word_counts(one), path)
        fresh = lm_scoring.Attention(small.settings, small.classes, small.bigram)
        taught.append((small.bigram.std() > 0.1, not np.allclose(small.weights["out"], fresh.weights["out"])))
    assert taught == [(True, True)] * 6
    assert not np.allclose(model.weights["out"], lm_scoring.Attention(model.settings, classes, model.bigram).weights["out"])


def test_lm_rounds_train_on_every_text(spark, monkeypatch):
    """The targets that the rounds train on are all subword ids of the training texts and their ends, at any size."""
    texts = [(i, " ".join(f"word{i * k % 97}" for k in range(1, 3 + i % 60))) for i in range(300)] + [(None, "no name"), (7, "")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    path = lm_scoring.tokenizer_file(lm_scoring.VOCABULARY)
    codes = lm_scoring.Subwords(path)
    whole = sum(len(codes.texts([lm_scoring.text_words(t.encode())])[0]) + 1 for _, t in texts)
    summed, sums = lm_scoring._summed, []
    monkeypatch.setattr(lm_scoring, "_summed", lambda *a: (sums.append(summed(*a)), sums[-1])[1])
    for least, rounds, seen in ((5, 2, 1), (5, 3, 1), (1_000, 2, 2)):
        sums.clear()
        settings = lm_scoring.Settings(least_texts=least, rounds=rounds)
        lm_scoring.fit(docs, lm_scoring.word_counts(docs), path, settings)
        assert sum(v[-1] for v in sums[-rounds:]) == seen * whole


def test_lm_each_round_trains_on_all_texts_of_a_large_table(spark, monkeypatch):
    """With 2,400 training texts each of the query's rounds sees every target, as with a few."""
    docs = spark.range(2_400).selectExpr("id as doc_id", "concat('word', id % 97, ' and word', id % 31) as text").repartition(2)
    path = lm_scoring.tokenizer_file(lm_scoring.VOCABULARY)
    codes = lm_scoring.Subwords(path)
    whole = sum(len(i) + 1 for i in codes.texts([lm_scoring.text_words(r.text.encode()) for r in docs.collect()]))
    summed, sums = lm_scoring._summed, []
    monkeypatch.setattr(lm_scoring, "_summed", lambda *a: (sums.append(summed(*a)), sums[-1])[1])
    lm_scoring.fit(docs, lm_scoring.word_counts(docs), path)
    assert [v[-1] for v in sums[1:]] == [whole] * lm_scoring.Settings().rounds


def test_lm_codes_give_the_windows_and_scores_of_ids():
    model = small_model()
    ids = [np.random.default_rng(k).integers(0, 50257, k).astype(np.int32) for k in (0, 1, 4, 5, 6, 17, 300)]
    x, y, numbers = model.windows(ids)
    coded = [model.classes.code(i) for i in ids]
    x2, t, numbers2 = model.code_windows([c for c, _ in coded])
    assert (x == x2).all() and (t == model.targets(y)).all() and (numbers == numbers2).all()
    starts = np.cumsum(numbers) - numbers
    found = np.add.reduceat(model.class_log_probability(x2, t), starts) + [inside for _, inside in coded]
    assert np.allclose(found, np.add.reduceat(model.log_probability(x, y), starts), rtol=1e-6)


def test_lm_classes_and_context():
    """112 frequent ids stand alone, 24 earlier ids at least are read, and the scores are those of the forward pass."""
    counts = np.arange(50257, 0, -1)
    classes = lm_scoring.make_classes(counts, np.zeros(50257, np.int64), lm_scoring.Settings().single_ids)
    assert len(set(classes.of[:112].tolist())) == 112 and not set(classes.of[:112].tolist()) & set(classes.of[112:].tolist())
    model = lm_scoring.Attention(lm_scoring.Settings(), classes, np.zeros((classes.number, classes.number), np.float32))
    text = np.arange(100, dtype=np.int32)
    x, y, _ = model.windows([text])
    stride = model.settings.stride
    assert len(x) == 3
    for k in (1, 2):  # the first scored id of a later window
        one = x[k : k + 1].copy()
        one[0, model.settings.overlap - 24] = 111
        target = np.full_like(y[:1], -1)
        target[0, 0] = y[k, 0]
        assert x[k, model.settings.overlap - 24] == classes.of[k * stride - 25]
        assert model.log_probability(one, target)[0] != model.log_probability(x[k : k + 1], target)[0]
    logits = model._forward(x)[5].astype(np.float64)
    logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
    safe = np.maximum(y, 0)
    each = np.take_along_axis(logits, classes.of[safe].astype(np.int64)[..., None], 2)[..., 0] + classes.inside[safe]
    assert np.allclose(model.log_probability(x, y), np.where(y >= 0, each, 0).sum(axis=1), atol=1e-3)


def test_lm_new_words_are_coded_together(monkeypatch):
    """Words join in one call of the tokenizer and keep their ids, also beside spaces of other kinds."""
    codes = lm_scoring.Subwords(lm_scoring.tokenizer_file(lm_scoring.VOCABULARY))
    rng = random.Random(3)
    plain = ["a", "\u00e9", "'s", "1", "!", "\ud55c", "\u200b", "\U0001f600", "\0", "it's", "re"]
    make = lambda parts: [w.encode() for w in sorted({"".join(rng.choices(parts, k=rng.randint(1, 6))) for _ in range(900)})]
    word, calls = codes.model.encode_ordinary, []
    monkeypatch.setattr(codes.model, "encode_ordinary", lambda text: (calls.append(text), word(text))[1])
    for words, most in ((make(plain), 1), (make([*plain, "\u00a0", "\u3000", "\x1c", "\x85"]), 900)):
        calls.clear()
        found = codes.texts([words[:500], [], words[400:], words])
        assert len(calls) <= most
        for part, ids in zip((words[:500], [], words[400:], words), found):
            assert ids.tolist() == [i for w in part for i in word(" " + w.decode())]
        calls.clear()
        codes.texts([words])
        assert not calls


@pytest.mark.parametrize("wide", [1, 4, 8])
def test_lm_attention_by_tables(wide):
    """Weights from tables, halves and positions by class give the plain layer's probabilities, also at the bound of 30."""
    model = small_model()
    s, w = model.settings, model.weights
    w["query"], w["key"] = w["query"] * np.float32(wide), w["key"] * np.float32(wide)
    ids = [np.random.default_rng(k).integers(0, 50257, k).astype(np.int32) for k in (0, 4, 30, 400)]
    x, t, _ = model.code_windows([model.classes.code(i)[0] for i in ids])
    assert model._tables()[3] == (wide < 8)
    last, where = x[:, s.overlap :], np.arange(s.overlap + s.stride)
    gap = where[s.overlap :, None] - where
    e = w["query"][last].astype(float) @ w["key"][x].transpose(0, 2, 1) + w["distance"][np.maximum(gap, 0)]
    e = np.where(gap >= 0, np.exp(np.minimum(e, 30.0)), 0.0)
    logits = e @ w["value"][x] / e.sum(axis=2, keepdims=True) @ w["out"] + model.bigram[last]
    each = np.take_along_axis(logits, np.maximum(t, 0)[..., None].astype(int), 2)[..., 0] - np.log(np.exp(logits).sum(axis=2))
    assert np.allclose(model.class_log_probability(x, t), np.where(t >= 0, each, 0).sum(axis=1), rtol=1e-4)
    assert np.allclose(model._forward(x)[5], logits, atol=1e-3)
