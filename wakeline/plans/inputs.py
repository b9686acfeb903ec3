"""Ping, score and geometry views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wakeline.operators import labels
from wakeline.params import MMSI, Params
from wakeline.plans.prep import feature_table
from wakeline.session import durable, prepare
from wakeline.sources.pings import edges_from_rings, scan_pings

# Six-hour bins and a one-day label horizon suit tables with a few events per vessel and day.
SPARSE = Params(bin_minutes=360, label_horizon_minutes=1440.0)
ITEMS = SPARSE
# Short windows and refits for vessels with a few dozen rows.
REGIME_PARAMS = Params(
    bin_minutes=360, label_horizon_minutes=1440.0, window=12, update_freq=5,
    min_vessel_rows=40,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_pings(spark: SparkSession, folder: str) -> DataFrame:
    prepare(spark)
    return scan_pings(spark, f"{folder}/events.parquet").selectExpr(
        "event_id as ping_seq",
        "200000000L + user_id as MMSI",
        "cast(ts as timestamp) as Timestamp",
        "35.0D + cast((event_id * 37) % 400 as double) / 100.0D as Lat",
        "11.0D + cast((event_id * 53) % 500 as double) / 100.0D as Lon",
        "value / 4.0D as SOG",
        "cast(regexp_extract(props, '([0-9]+)', 1) as double) * 3.6D as COG",
    )


def item_pings(spark: SparkSession, folder: str) -> DataFrame:
    """A large panel with many equal time stamps."""
    return table(spark, folder, "lineitem").selectExpr(
        "(l_orderkey * 10 + l_linenumber) * 1000 + l_partkey % 1000 as ping_seq",
        "300000000L + l_suppkey as MMSI",
        "timestamp_micros(unix_micros(cast(l_shipdate as timestamp)) + (l_orderkey % 4) * 21600000000L)"
        " as Timestamp",
        "34.5D + cast(l_partkey % 400 as double) / 100.0D as Lat",
        "11.0D + cast(l_orderkey % 500 as double) / 100.0D as Lon",
        "l_quantity + 2.0D as SOG",
        "cast(l_orderkey % 370 as double) as COG",
    )


def dirty_pings(spark: SparkSession, folder: str) -> DataFrame:
    """Event pings with text identifiers, NaN, infinity and nulls in fixed places."""
    bad = event_pings(spark, folder).withColumn(
        "mmsi",
        F.when(F.col("ping_seq") % 17 == 0, F.concat(F.lit("x"), F.col("MMSI")))
        .when(F.col("ping_seq") % 19 == 0, F.concat(F.col("MMSI"), F.lit(".0")))
        .otherwise(F.col("MMSI").cast("string")),
    )
    s = F.col("ping_seq")
    return bad.withColumns({
        "Lat": F.when(s % 23 == 0, float("nan")).otherwise(F.col("Lat")),
        "Lon": F.when(s % 29 == 0, float("inf")).otherwise(F.col("Lon")),
        "SOG": F.when(s % 31 == 0, float("nan")).when(s % 37 == 0, None).otherwise(F.col("SOG")),
        "COG": F.when(s % 41 == 0, float("-inf")).otherwise(F.col("COG")),
    }).select(s, F.col("mmsi").alias("id_text"), "Timestamp", "Lat", "Lon", "SOG", "COG")


def dirty_ids(spark: SparkSession, folder: str) -> DataFrame:
    return dirty_pings(spark, folder).withColumnRenamed("id_text", "mmsi")


def features(spark: SparkSession, folder: str, p: Params = SPARSE) -> DataFrame:
    return feature_table(event_pings(spark, folder), p)


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled pings with two fixed scores, both with ties."""
    rows = labels.label_last_ping(event_pings(spark, folder), SPARSE)
    return rows.withColumns({
        "score_a": 1.0 / (F.col("SOG") + 1.0),
        "score_b": (F.col("ping_seq") * 7919 % 1000).cast("double") / 1000.0,
    })


def stored_scored(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a materialised table, for work that passes over it many times."""
    return durable(scored(spark, folder))


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Document labels with a coarse score of the text length."""
    joined = table(spark, folder, "labels").join(
        table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id"
    )
    return joined.select(
        F.col("doc_id").alias(MMSI), F.col("toxic").alias("target_dark_fleet"),
        ((F.col("n_chars") % 97).cast("double") / 97.0).alias("score"),
    )


def truth(spark: SparkSession, folder: str) -> DataFrame:
    """Known classes of the vessels, as the nested ground-truth document."""
    users = table(spark, folder, "events").select((F.col("user_id") + 200000000).alias("mmsi")).distinct()
    ship = F.struct(
        "mmsi", (F.col("mmsi") % 3 == 0).alias("is_dark"), F.lit("cargo").alias("type"),
        (F.col("mmsi") % 5).cast("int").alias("n_blackouts"),
        F.array(F.lit(12.0)).alias("blackout_durations_h"),
    )
    # one document for each of many fleets, so that no array grows with the table
    fleet = F.pmod(F.col("mmsi"), F.lit(1009))
    return users.groupBy(fleet.alias("fleet")).agg(F.collect_list(ship).alias("ships")).select("ships")


def coast_rings(spark: SparkSession, folder: str, source: str = "supplier", key: str = "s_suppkey") -> DataFrame:
    """One small closed triangle for each key, as rings of longitude and latitude."""
    k = F.col(key)
    x = 10.5 + (k * 7919 % 600).cast("double") / 100.0
    y = 34.5 + (k * 104729 % 450).cast("double") / 100.0
    size = 0.02 + (k % 7).cast("double") / 50.0
    pts = F.array(
        F.array(x, y), F.array(x + size, y), F.array(x + size / 2, y + size), F.array(x, y)
    )
    return table(spark, folder, source).select(
        F.lit("land").alias("layer"), k.alias("geom_id"), F.lit(0).alias("ring"), pts.alias("pts")
    )


def coast_edges(spark: SparkSession, folder: str) -> DataFrame:
    return edges_from_rings(coast_rings(spark, folder))
