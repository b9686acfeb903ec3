"""Writers for tables, reports and models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


ROWS_PER_FILE = 2_000_000


def write_table(
    df: DataFrame, path: str, by_date: bool = True, mode: str = "overwrite", rows_per_file: int = ROWS_PER_FILE
) -> str:
    """Parquet, partitioned by date, in files of about ``rows_per_file`` rows sorted by time.

    Rows of each date are counted first (one number for each day); a date is split into as
    many pieces as its rows fill files, by a hash of the row, and each piece goes to a task
    of its own. ``read_table`` turns a time range into folders.
    """
    if not path.endswith(".parquet"):
        path = path + ".parquet"
    if not by_date or "Timestamp" not in df.columns:
        df.write.mode(mode).parquet(path)
        return path
    dated = df.withColumn("date", F.to_date("Timestamp"))
    days = dated.groupBy("date").agg(F.count(F.lit(1)).alias("n")).collect()
    if not days:  # one empty file keeps the columns
        dated.write.mode(mode).parquet(path)
        return path
    rows, first = [], 0
    for day in days:
        pieces = max(1, round(day["n"] / rows_per_file))
        rows.append((day["date"], first, pieces))
        first += pieces
    plan = df.sparkSession.createDataFrame(rows, "_date date, _first int, _pieces int")
    piece = F.col("_first") + F.pmod(F.xxhash64(*df.columns), F.col("_pieces")).cast("int")
    placed = dated.join(F.broadcast(plan), F.col("date").eqNullSafe(F.col("_date"))).withColumn("_piece", piece)
    placed = placed.repartitionById(first, F.col("_piece")).sortWithinPartitions("Timestamp")
    placed.drop("_date", "_first", "_pieces", "_piece").write.mode(mode).partitionBy("date").parquet(path)
    return path


def read_table(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """A stored table, rows with start <= Timestamp < end. Folders of other dates are not listed into the scan."""
    df = spark.read.parquet(path)
    for bound, on_time, on_date in (
        (start, F.col("Timestamp") >= F.lit(start).cast("timestamp"), lambda d: F.col("date") >= d),
        (end, F.col("Timestamp") < F.lit(end).cast("timestamp"), lambda d: F.col("date") <= d),
    ):
        if bound is not None:
            df = df.filter(on_time)
            if "date" in df.columns:
                df = df.filter(on_date(F.to_date(F.lit(bound).cast("timestamp"))))
    return df


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A report of a few rows as JSON lines."""
    df.repartition(1).write.mode(mode).json(path)
    return path


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_fit_table(params: DataFrame, path: str) -> str:
    """Mixture parameters are a table like any other."""
    return write_table(params, path, by_date=False)


def load_fit_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
