"""Readers: ping tables, ground truth and geometry layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException

from wakeline.operators.clean import alias_columns, alias_names, normalise_mmsi

PING_CSV_SCHEMA = T.StructType([
    T.StructField("MMSI", T.StringType()),
    T.StructField("Timestamp", T.TimestampType()),
    T.StructField("Lat", T.DoubleType()),
    T.StructField("Lon", T.DoubleType()),
    T.StructField("SOG", T.DoubleType()),
    T.StructField("COG", T.DoubleType()),
])

TRUTH_SCHEMA = (
    "ships array<struct<mmsi: bigint, is_dark: boolean, type: string, n_blackouts: int,"
    " blackout_durations_h: array<double>>>"
)


def scan_pings(
    spark: SparkSession, path: str, schema: T.StructType | None = None, aliases: bool = False
) -> DataFrame:
    """Read by suffix. CSV files are split by Spark, so size is no concern.

    Without a schema a CSV header is matched by name against the ping columns;
    only the header line is read for that, never the data. ``aliases`` renames the
    accepted spellings of id and time first, so that they get their types too.
    """
    if path.endswith(".parquet"):
        df = spark.read.parquet(path)
    elif path.endswith(".csv"):
        if schema is None:
            header = spark.read.csv(path, header=True).columns
            names = alias_names(header) if aliases else {}
            types = {f.name.lower(): f.dataType for f in PING_CSV_SCHEMA}
            schema = T.StructType([
                T.StructField(c, types.get(names.get(c, c).lower(), T.StringType())) for c in header
            ])
        df = spark.read.csv(path, header=True, schema=schema)
    else:
        raise ValueError(f"unsupported format: {path}")
    if aliases:
        df = alias_columns(df)
    if "Timestamp" in df.columns:
        df = df.withColumn("Timestamp", F.col("Timestamp").cast("timestamp"))
    return normalise_mmsi(df)


def scan_first(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, str]:
    """The first path that can be read, with its name, under the accepted column aliases."""
    for path in paths:
        try:
            return scan_pings(spark, path, aliases=True), path
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"none of these can be read: {list(paths)}")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth JSON as (MMSI, is_dark, ...)."""
    raw = spark.read.schema(TRUTH_SCHEMA).json(path, multiLine=True)
    return truth_explode(raw)


def truth_explode(raw: DataFrame) -> DataFrame:
    return raw.select(F.explode("ships").alias("s")).select(
        F.col("s.mmsi").alias("MMSI"), "s.is_dark", "s.type", "s.n_blackouts",
        "s.blackout_durations_h",
    )


_POINTS = "array<array<double>>"
_FEATURE = "struct<geometry: struct<type: string, coordinates: string>>"


def read_geojson(spark: SparkSession, path: str, layer: str, by_line: bool = False) -> DataFrame:
    """GeoJSON to an edge table, in one pass over the features.

    A feature collection is one document that one task reads. ``by_line`` reads one
    feature for each line instead, which Spark splits. ``geom_id`` is a hash of file
    and feature, so that files of one layer don't share identifiers.
    """
    if by_line:
        lines = spark.read.text(path).select(F.from_json("value", _FEATURE).alias("f"), F.xxhash64("value").alias("at"))
        features = lines.filter("f is not null")
    else:
        raw = spark.read.schema(f"features array<{_FEATURE}>").json(path, multiLine=True)
        features = raw.select(F.posexplode("features").alias("at", "f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    lists = (
        F.when(kind == "LineString", F.array(F.from_json(text, _POINTS)))
        .when(kind.isin("MultiLineString", "Polygon"), F.from_json(text, f"array<{_POINTS}>"))
        .when(kind == "MultiPolygon", F.flatten(F.from_json(text, f"array<array<{_POINTS}>>")))
    )
    geom_id = F.xxhash64(F.input_file_name(), "at").alias("geom_id")
    rings = features.select(geom_id, lists.alias("lists")).select("geom_id", F.posexplode("lists").alias("ring", "pts"))
    return edges_from_rings(rings.withColumn("layer", F.lit(layer)))


def edges_from_rings(rings: DataFrame) -> DataFrame:
    """Rows of (layer, geom_id, ring, pts array<array<double>>) to one row per edge."""
    pairs = F.arrays_zip(
        F.slice("pts", 1, F.size("pts") - 1).alias("a"), F.slice("pts", 2, F.size("pts") - 1).alias("b")
    )
    return (
        rings.filter(F.size("pts") >= 2)
        .select("layer", "geom_id", "ring", F.explode(pairs).alias("e"))
        .select(
            "layer", "geom_id", "ring",
            F.col("e.a")[0].alias("x1"), F.col("e.a")[1].alias("y1"),
            F.col("e.b")[0].alias("x2"), F.col("e.b")[1].alias("y2"),
        )
    )
