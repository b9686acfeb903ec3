"""The pipeline's stages against plain code on each stage's own input."""

import re
import zlib

import numpy as np

import corpus_pipeline
from wakeline.llm import packing, resampling, toxicity
from wakeline.session import durable

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_kept(rows):
    """Least identifier of each component of texts whose 5-word shingles have similarity 0.8 or more."""
    def shingles(text):
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in ids if find(i) == i}


def test_near_duplicates_take_five_words_and_eighty_percent(spark, small):
    """Ten apart edits of 454 words: 0.800 by five words, 0.837 by four, 0.783 with an eleventh."""
    words = [f"w{k}" for k in range(454)]

    def edited(n):
        return " ".join(f"x{k}" if k % 40 == 20 and k // 40 < n else w for k, w in enumerate(words))

    rows = [(1, " ".join(words)), (2, edited(10)), (3, " ".join(w + "y" for w in words)), (4, edited(11).replace("w", "z"))]
    rows.append((5, " ".join(words).replace("w", "z")))
    docs = spark.createDataFrame([(*r, None, None, 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, small).collect()}
    assert kept == near_kept(rows) == {1, 3, 4, 5}


def test_stages(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_classifier", "exact_dedup", "ngram_jaccard_join", "best_fit_packing"]
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = durable(stage(spark, docs, small))
        kept[name] = ids(out)
        assert out.columns == columns and out.count() == len(kept[name])
        rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
        if name == "toxicity":
            expected = ids(toxicity.toxicity_scores(docs, labels).filter("predicted = 0"))
        elif name == "quality_classifier":
            expected = ids(resampling.resample(docs, labels).filter("kept"))
        elif name == "exact_dedup":
            least = {}
            for i, text in sorted(rows):
                least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text), i)
            expected = set(least.values())
        else:
            expected = near_kept(rows)
        assert kept[name] == expected
        docs = out
    assert len(kept["exact_dedup"]) < len(kept["quality_classifier"]) < 200
    model = packing.encoder(packing.tokenizer_file(packing.VOCABULARY)).model
    expected = set()
    for r in docs.collect():
        codes = np.array(model.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        for k, (a, n) in enumerate(packing.cut(len(codes), 2048)):
            expected.add((r["doc_id"], k, a, n, zlib.crc32(codes[a : a + n].tobytes())))
    found = corpus_pipeline.run(spark, small).collect()
    assert {tuple(r)[:5] for r in found} == expected and len(found) == len(expected)


def test_run_on_awkward_rows_and_an_empty_table(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and identifiers, clashing columns: every kept text is packed whole."""
    from pyspark.sql import functions as F

    from tests.llm.test_operators import CLASHES, awkward_rows

    rows = awkward_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select(
        "*", *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
    labels = spark.createDataFrame(
        [(i, 0 if t and "SHOUT" in t else 1, int(i >= 110)) for i, t in rows if i is not None] + [(1, None, None), (None, 1, 1)],
        "doc_id bigint, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    labels.write.parquet(f"{tmp_path}/a/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = durable(stage(spark, kept, f"{tmp_path}/a"))
        assert kept.columns == docs.columns
    model = packing.encoder(packing.tokenizer_file(packing.VOCABULARY)).model
    lengths = sorted(len(model.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in kept.collect())
    found = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    assert sum(r["length"] for r in found) == sum(lengths) and sum(r["piece"] == 0 for r in found) == len(lengths) > 0
    docs.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
