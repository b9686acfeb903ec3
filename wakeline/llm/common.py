"""Small helpers that several text operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wakeline.session import durable, prepare

# White space of the word rule: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole documents table."""
    prepare(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """Only doc_id (bigint) and text (null becomes empty); other columns can't clash."""
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def unused(docs: DataFrame, name: str) -> str:
    """A column name that the table doesn't hold yet."""
    held = {c.lower() for c in docs.columns}
    while name.lower() in held:
        name += "_"
    return name


def id_hash(doc_id: Column) -> Column:
    """crc32 of the identifier's text; null for a null identifier."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))


def held_out(doc_id: Column, parts: int) -> Column:
    """True where crc32(doc_id) leaves remainder 2; a null identifier is never held out."""
    return F.coalesce(id_hash(doc_id) % parts == 2, F.lit(False))


def tokenizer_file(name: str, path: str | None = None) -> str:
    """A vocabulary file: the given path, or the installed public one."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def columns_schema(**kinds: str) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in kinds.items())


def text_batches(batches, max_bytes: int = 4_000_000, column: str = "text", sizes: str | None = None):
    """(ids, texts as bytes) from Arrow batches, cut to bounded pieces.

    A text longer than max_bytes forms a piece of its own. Sizes may come from a column.
    """
    for batch in batches:
        ids = batch.column("doc_id")
        texts = batch.column(column)
        start = total = 0
        lengths = batch.column(sizes).to_pylist() if sizes else (len(text.as_buffer() or b"") for text in texts)
        for row, length in enumerate(lengths):
            total += length
            if total >= max_bytes:
                yield ids.slice(start, row + 1 - start), texts.slice(start, row + 1 - start)
                start, total = row + 1, 0
        if start < len(texts):
            yield ids.slice(start), texts.slice(start)


def arrow_rows(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def parallel_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


__all__ = [
    "SPACE", "arrow_rows", "columns_schema", "documents", "durable", "held_out", "id_hash", "id_text",
    "parallel_parts", "prepare", "table", "text_batches", "tokenizer_file", "unused",
]
