"""Repeated runs of lines, found by winnowing over line hashes.

Lines without a word don't count and always stay. From each other line starts a
window: the shortest run of lines that holds ``min_words`` words or ``min_lines``
lines. The least line hash of a window is its fingerprint; it depends on the
window's content only, so wherever two texts share a window they share the
fingerprint. Places are joined on fingerprints that occur at two places or more;
around each, the windows that hold it are compared (two 64-bit hashes of their
lines), which extends a match to both sides as far as the texts agree. A window that
occurs earlier, by (doc_id, line), is a later repeated run: its lines are deleted.

No pairs are built: a place meets its fingerprint's and its window's first place
only. All of it is native. Only hashes and places are shuffled, once for each
aggregate, and a common line is combined before the shuffle; the text is joined with
the lines to delete.

Cases: a null text stays null and has no lines; a null identifier counts after all
others; rows with the same identifier and text count as one document and get the
same result; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wakeline.llm.common import durable

MIN_LINES, MIN_WORDS = 3, 50


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"),
    )


def windows(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """All windows: place, fingerprint and its place, two content hashes, the lines covered."""
    lines = _rows(docs).filter("text is not null").select("doc_id", "mark", F.expr(
        r"filter(transform(split(text, '\n'), (l, i) -> struct(i as at, xxhash64(l) as a, xxhash64(l, 'line') as b,"
        r" size(array_remove(split(l, '[\\x20\\x09-\\x0D]+'), '')) as n)), e -> e.n > 0)"
    ).alias("lines"))
    # Words up to and with each of the next lines; a window ends where they suffice.
    size = str(min_lines)
    for k in range(min_lines - 1, 0, -1):
        words = " + ".join(f"coalesce(get(lines, i + {j}).n, 0)" for j in range(k))
        size = f"if({words} >= {min_words}, {k}, {size})"
    spans = lines.withColumn("sizes", F.expr(f"transform(lines, (e, i) -> {size})")).withColumn(
        "spans", F.expr("transform(lines, (e, i) -> slice(lines, i + 1, sizes[i]))")
    )
    spans = spans.select("doc_id", "mark", F.posexplode(F.arrays_zip("spans", "sizes")).alias("i", "w"))
    run = F.col("w.spans")
    ends = spans.filter(F.size(run) == F.col("w.sizes")).select("doc_id", "mark", run.alias("run"))
    keyed = ends.select(
        "doc_id", "mark", F.col("run")[0]["at"].cast("bigint").alias("start"), F.col("run.at").alias("covers"),
        F.array_min("run.a").alias("fingerprint"), F.xxhash64("run.a", "run.b").alias("key_a"),
        F.xxhash64(F.lit(1), "run.b", "run.a").alias("key_b"), "run",
    )
    last = F.expr("array_max(transform(filter(run, e -> e.a = fingerprint), e -> e.at))")
    return keyed.withColumn("place", F.xxhash64("doc_id", "mark", last)).drop("run")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, mark and ``dead``, the numbers of the lines that repeat an earlier run."""
    found = durable(windows(docs, min_lines, min_words))
    shared = found.groupBy("fingerprint").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    joined = found.join(shared.filter("low <> high").select("fingerprint"), "fingerprint", "left_semi")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "start")
    firsts = joined.groupBy("key_a", "key_b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    later = joined.join(firsts.filter("first <> last").select("key_a", "key_b", "first"), ["key_a", "key_b"])
    later = later.filter(place != F.col("first"))
    # A document's own lines only: bounded by its text.
    return later.select("doc_id", "mark", F.explode("covers").alias("at")).groupBy("doc_id", "mark").agg(
        F.collect_set("at").alias("dead")
    )


def delete_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without later repeated runs, n_lines and n_deleted."""
    dead = repeated_lines(docs, min_lines, min_words).select(
        F.col("doc_id").alias("dead_id"), F.col("mark").alias("dead_mark"), "dead"
    )
    rows = _rows(docs)
    same = rows["doc_id"].eqNullSafe(dead["dead_id"]) & (rows["mark"] == dead["dead_mark"])
    rows = rows.join(dead, same, "left").withColumn("lines", F.split("text", "\n"))
    alive = "array_except(transform(lines, (l, i) -> i), dead)"
    return rows.select(
        "doc_id",
        F.expr(f"if(dead is null, text, array_join(transform({alive}, i -> lines[i]), '\n'))").alias("text"),
        F.expr("cast(if(text is null, 0, size(lines)) as bigint)").alias("n_lines"),
        F.expr("cast(if(dead is null, 0, size(dead)) as bigint)").alias("n_deleted"),
    )
