"""Scans and sinks. Files are read as text and cast softly, so bad input becomes NULL and never fails a job."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roadlens.functions import scalars as S

# Column names of the input files, profiles' labels and file names.
EVENT_COLUMNS = ["segment_id", "indice_coord", "lat", "lon", "duracion_hrs", "distancia_km", "velocidad_kmh", "fecha", "hora_inicio", "hora_fin", "comuna", "via", "oneway"]
ROAD_COLUMNS = ["segment_id", "indice_coord", "lat", "lon", "duracion_hrs", "distancia_km", "velocidad_kmh", "fecha", "hora_inicio", "hora_fin", "comuna", "via"]
PROFILES = {"regional": ("Cobertura regional", "user_ratings.csv"), "concepcion": ("Solo Concepción", "user_ratings_concepcion.csv")}


def scan(spark: SparkSession, path: str) -> DataFrame:
    """CSV (all columns as text) or Parquet, with row_no in the order of the files: by file name, place of the split in its file, and row of the split."""
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    in_split = F.monotonically_increasing_id()
    t = df.withColumn("row_no", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), in_split.alias("row")))
    # splits of a file are read by tasks in any order: each split's first number is taken off, and splits are counted in file order
    splits = t.groupBy("row_no.file", "row_no.start").agg(F.count(F.lit(1)).alias("n"), F.min("row_no.row").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    splits = splits.select(F.col("file"), F.col("start"), "first", before.alias("before"))
    row = F.col("row_no.row") - F.col("first") + F.col("before")
    t = t.join(splits, (F.col("row_no.file") == F.col("file")) & (F.col("row_no.start") == F.col("start")))
    return t.select(*df.columns, row.alias("row_no"))


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what}: missing columns {missing}")
    return df


def scan_events(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Accidents or congestions, labelled."""
    return scan(spark, path).withColumn("label", F.lit(label))


def scan_roads(spark: SparkSession, path: str) -> DataFrame:
    """The road network; an absent file is an empty network. A file without oneway gets it as NULL, which counts as two-way."""
    try:
        t = scan(spark, path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in EVENT_COLUMNS) + ", row_no long")
    require(t, ROAD_COLUMNS, "roads")
    return t if "oneway" in t.columns else t.withColumn("oneway", F.lit(None).cast("string"))


def scan_ratings(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return clean_ratings(scan(spark, path), keep)


def clean_ratings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """user_id, via (titled), rating and columns to keep; incomplete rows are dropped."""
    require(df, ["user_id", "via", "rating"], "ratings")
    t = df.select(F.col("user_id").cast("string").alias("user_id"), S.clean(F.col("via")).alias("via"), S.number("rating").alias("rating"), *keep).dropna(subset=["user_id", "via", "rating"])
    return t.withColumn("via", S.title(F.col("via")))


def profile_ratings(spark: SparkSession, folder: str, profile: str, keep: tuple[str, ...] = ()) -> DataFrame:
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}; known: {sorted(PROFILES)}")
    label, name = PROFILES[profile]
    return scan_ratings(spark, f"{folder}/{name}", keep).withColumn("profile", F.lit(label))


def incidents_for_ratings(accidents: DataFrame, congestions: DataFrame) -> DataFrame:
    """Both kinds of incidents with stripped vias; blank vias go, missing durations are 0."""
    both = accidents.withColumn("tipo_evento", F.lit("Accidente")).unionByName(congestions.withColumn("tipo_evento", F.lit("Congestión")), allowMissingColumns=True)
    both = both.withColumn("via", F.trim(F.col("via").cast("string"))).filter("via <> ''")
    return both.withColumn("duracion_hrs", F.coalesce(S.number("duracion_hrs"), F.lit(0.0)))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Materialise a derived table as Parquet, sorted by segment within files where it has segments."""
    keys = [c for c in ("segment_id", "segment_seq") if c in df.columns]
    out = df.sortWithinPartitions(*keys) if keys else df
    out.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def write_segments(df: DataFrame, path: str, table: str, partition_by: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """Materialise a derived table in buckets of segments, each a file sorted by segment and place, and return it from the catalog.

    All tasks write, and a segment's rows stand in order in one file of each partition. Joins, groups and windows by segment_id of tables with as many
    buckets need no shuffle.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [c for c in ("segment_id", "segment_seq") if c in df.columns]
    require(df, ["segment_id"], table)
    # one task for each bucket, so that a bucket is one file
    out = df.repartition(n, "segment_id").sortWithinPartitions(*(partition_by or []), *keys).write.mode("overwrite").option("path", path)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.bucketBy(n, "segment_id").sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header. Ratings come in order of user and via, road rows in that of segment and point, over all files by name."""
    keys = next((k for k in (["user_id", "via"], ["segment_id", "row_idx"]) if set(k) <= set(df.columns)), [])
    out = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys) if keys else df
    out.write.mode("overwrite").option("header", True).csv(path)
