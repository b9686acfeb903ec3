import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from wakeline.session import prepare

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    """Pings from (vessel, minutes, lat, lon, sog, cog[, seq]) tuples."""

    def build(rows, seq=False):
        cols = "MMSI long, m double, Lat double, Lon double, SOG double, COG double"
        rows = [(r[0], *map(float, r[1:6]), *r[6:]) for r in rows]
        df = spark.createDataFrame(rows, cols + (", ping_seq long" if seq else ""))
        start = 1_704_067_200_000_000
        df = df.selectExpr(
            "MMSI", f"timestamp_micros({start}L + cast(m * 60000000 as bigint)) as Timestamp",
            "Lat", "Lon", "SOG", "COG", *(["ping_seq"] if seq else []),
        )
        return df

    return build


def minutes(df, *cols):
    from pyspark.sql import functions as F

    m = ((F.unix_micros("Timestamp") - 1_704_067_200_000_000) / 60_000_000).alias("m")
    return [tuple(r) for r in df.select("MMSI", m, *cols).orderBy("MMSI", "m").collect()]
