"""Exact duplicates by sorting content.

Texts are equal when they match after each run of white space became one space.
Rows are range-partitioned by sampled splitters and sorted, so equal texts become
neighbours; neighbours are compared in full.

The splitter key holds the first characters, a hash and the identifier, so its
size is bounded whatever the texts' length, and a group of any size is cut by its
identifiers into several ranges. Runs that touch an end of a range are joined by
digest in one small aggregate: each range adds its first and last key only.

Cases: a null text counts as empty; a null identifier sorts last and is the kept
one only if all are null (``keep_id`` is then null). Rows repeated with the same
identifier and text form one group and one of them is kept. An empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from wakeline.llm.common import SPACE, durable, id_text, parallel_parts, unused

PREFIX_CHARS = 48


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


def _scan(batches):
    """Runs of equal neighbours in one sorted range.

    Holds the identifiers of one run and one row's text, never the texts of a run.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    pending: dict | None = None  # the open run
    first_key = None
    held: list[dict] = []  # closed runs that wait for the last key of the range

    def rows(run: dict, edge: bool) -> pa.RecordBatch:
        ids = pa.concat_arrays(run["ids"])
        n = len(ids)
        known = pc.drop_null(ids)
        keep = known[0].as_py() if len(known) else None
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "keep_id": pa.array([keep] * n, pa.int64()),
            "group_size": pa.array(np.full(n, n, np.int64)),
            "first": pa.array(np.arange(n) == 0), "edge": pa.array(np.full(n, edge)),
            "part": pa.array(np.full(n, part, np.int32)), "text_sha256": pa.array([run["sha"]] * n, pa.string()),
        })

    def settle(run: dict):
        """Emit runs whose key is surely not the last one; keep the others."""
        while held and held[0]["key"] != run["key"]:
            old = held.pop(0)
            yield rows(old, old["key"] == first_key)
        held.append(run)

    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        text, sha, ids = batch.column("norm"), batch.column("sha"), batch.column("doc_id")
        heads, marks = batch.column("head"), batch.column("mark")
        starts = np.ones(n, bool)
        if n > 1:
            starts[1:] = pc.not_equal(text.slice(1), text.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        if pending is not None and pending["text"] == text[0].as_py():
            starts[0] = False
        cuts = np.flatnonzero(starts)
        if first_key is None:
            first_key = (heads[0].as_py(), marks[0].as_py())
        lead = cuts[0] if len(cuts) else n
        if lead > 0:
            pending["ids"].append(ids.slice(0, lead))
        for k, at in enumerate(cuts):
            if pending is not None:
                yield from settle(pending)
            end = cuts[k + 1] if k + 1 < len(cuts) else n
            pending = {
                "ids": [ids.slice(at, end - at)], "sha": sha[int(at)].as_py(), "text": text[int(at)].as_py(),
                "key": (heads[int(at)].as_py(), marks[int(at)].as_py()),
            }
    if pending is not None:
        yield from settle(pending)
        for run in held:
            yield rows(run, True)


def exact_groups(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    rows = id_text(docs).select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.select(
        "doc_id", "norm", F.sha2(F.encode("norm", "UTF-8"), 256).alias("sha"),
        F.substring("norm", 1, PREFIX_CHARS).alias("head"), F.xxhash64("norm").alias("mark"),
    )
    order = [F.asc("head"), F.asc("mark")]
    last = F.asc_nulls_last("doc_id")
    ranged = rows.repartitionByRange(parts or parallel_parts(spark), *order, last)
    scanned = ranged.sortWithinPartitions(*order, F.asc("norm"), last).mapInArrow(
        _scan,
        "doc_id bigint, keep_id bigint, group_size bigint, first boolean, edge boolean, part int,"
        " text_sha256 string",
    )
    runs = durable(scanned)
    # At most the first and the last key of each range: bounded by the number of ranges.
    joined = runs.filter("edge and first").groupBy("text_sha256").agg(
        F.min("keep_id").alias("edge_keep"), F.sum("group_size").alias("edge_size"),
        F.min(F.struct(F.col("keep_id").isNull().alias("none"), "keep_id", "part")).alias("head"),
    )
    edges = runs.filter("edge").join(F.broadcast(joined), "text_sha256").select(
        "doc_id", F.col("edge_keep").alias("keep_id"), F.col("edge_size").alias("group_size"),
        (F.col("first") & (F.col("part") == F.col("head.part"))).alias("kept"), "text_sha256",
    )
    inner = runs.filter("not edge").select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")
    return inner.unionByName(edges)


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The input's rows and columns without later copies of a text."""
    sha, key, digest = (unused(docs, name) for name in ("_sha", "_keep_id", "_keep_sha"))
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest))
    marked = docs.withColumn(sha, text_digest(F.col("text")))
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col(key)) & (F.col(sha) == F.col(digest))
    return marked.join(kept, same, "left_semi").dropDuplicates(["doc_id", sha]).drop(sha)
