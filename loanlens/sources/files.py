"""Reading and writing files: CSV layouts, year partitions, manifests, snapshots, exports."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.scalar import finite_or_null
from loanlens.session import scratch_path


def read_csv_union(
    spark: SparkSession, layouts: Sequence[str | Sequence[str]], encoding: str = "ISO-8859-1"
) -> DataFrame:
    """CSV files as text, columns matched by name, malformed lines dropped.

    Each entry of `layouts` is one header layout: a single reader would match columns by position.
    """
    out: DataFrame | None = None
    for paths in layouts:
        part = spark.read.csv(
            paths if isinstance(paths, str) else list(paths),
            header=True, inferSchema=False, mode="DROPMALFORMED", encoding=encoding,
            quote='"', escape='"',
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no CSV layout given")
    return out


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an expensive row-level intermediate once to the shared folder and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def with_file_metadata(df: DataFrame) -> DataFrame:
    """Add file name, vintage (`asof_YYMMDD`) and first/last fiscal year read from the file path."""
    return with_name_metadata(df.withColumn("file_path", F.col("_metadata.file_path")), "file_path")


def with_name_metadata(df: DataFrame, path: str) -> DataFrame:
    span = r"FY(\d{4})(?:[-_](?:FY)?(\d{4}|Present))?"
    p = F.col(path)
    return df.select(
        "*",
        F.nullif(F.regexp_extract(p, r"asof_(\d{6})", 1), F.lit("")).alias("vintage"),
        F.regexp_extract(p, span, 1).try_cast("int").alias("fy_first"),
        F.regexp_extract(p, span, 2).try_cast("int").alias("fy_last"),
    )


def read_years(
    spark: SparkSession, root: str, years: Sequence[int], column: str = "activity_year"
) -> DataFrame:
    """Year-partitioned Parquet restricted to a declared window: only those folders are listed.

    A declared year without a folder is an error, whatever else is in the directory.
    """
    df = spark.read.parquet(root)
    # the listing is already on the driver; no job is needed to learn which folders exist
    present = {int(m) for f in df.inputFiles() for m in re.findall(rf"{column}=(\d+)", f)}
    missing = sorted(set(int(y) for y in years) - present)
    if missing:
        raise FileNotFoundError(f"no partition for declared years {missing} under {root}")
    return df.where(F.col(column).isin([int(y) for y in years]))


def prune_and_filter(
    df: DataFrame, keep: Sequence[str], kept_actions: Sequence[str] = ("1", "3")
) -> DataFrame:
    """Declared columns that are available, decisions only."""
    return df.where(F.col("action_taken").isin(list(kept_actions))).select(
        *[F.col(f"`{c}`") for c in keep if c in df.columns]
    )


def ingest(df: DataFrame, path: str, keep: Sequence[str], partition: Sequence[str]) -> None:
    """Write the pruned table partitioned, zstd. `ignore` leaves an existing table as it is."""
    (
        prune_and_filter(df, keep).write.mode("ignore").partitionBy(*partition)
        .option("compression", "zstd").parquet(path)
    )


def vintage_as_of(df: DataFrame, column: str = "AsOfDate") -> DataFrame:
    """One row `as_of`: the latest readable date. An unreadable column is an error."""
    top = F.max(F.col(column).try_cast("date"))
    return df.agg(
        F.coalesce(top, F.raise_error(F.lit("no readable as-of date")).cast("date")).alias("as_of")
    )


BLOB = 128 * 1024 * 1024  # up to here a file is one value of a row; larger ones are streamed


def _streamed_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of one file of any size and file system, by the driver's JVM as a stream in constant memory."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(place)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of each file: hashed on the executors up to `BLOB` bytes, streamed one by one above.

    Executors' Python cannot open every store, and Spark hands out a file there as one value only.
    """
    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    whole = files.where(F.col("length") <= BLOB).select(
        name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    sizes = {r["path"]: (r["name"], r["length"]) for r in files.select("path", name, "length").collect()}  # a listing, no content
    streamed = [(n, size, _streamed_digest(spark, p)) for p, (n, size) in sizes.items() if size > BLOB]
    listed = files.inputFiles()
    if len(listed) > len(sizes):  # Spark makes no row of an empty file
        jvm = spark.sparkContext._jvm
        paths = {jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(p)).toString() for p in listed}
        streamed += [(p.rsplit("/", 1)[-1], 0, hashlib.sha256().hexdigest()) for p in sorted(paths - sizes.keys())]
    return whole.unionByName(spark.createDataFrame(streamed, whole.schema)) if streamed else whole


def verify_manifest(manifest: DataFrame, digests: DataFrame) -> DataFrame:
    """Each manifest entry is OK, MISSING or MISMATCH."""
    found = digests.select("name", F.col("sha256").alias("found_sha256"))
    return manifest.join(found, "name", "left").select(
        "name",
        F.when(F.col("found_sha256").isNull(), "MISSING")
        .when(F.col("found_sha256") == F.col("sha256"), "OK")
        .otherwise("MISMATCH").alias("verdict"),
    )


def merge_manifest(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New entries replace old ones with the same key, the others stay."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def reconcile_counts(
    local: DataFrame, official: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Full outer comparison of two (keys, rows) tables."""
    a = local.select(*keys, F.col("rows").alias("local_rows"))
    b = official.select(*keys, F.col("rows").alias("official_rows"))
    return a.join(b, list(keys), "full_outer").select(
        *keys, "local_rows", "official_rows",
        F.col("local_rows").eqNullSafe(F.col("official_rows")).alias("matches"),
    )


def save_predictions(
    df: DataFrame, path: str, y: str, models: Sequence[str], key: Sequence[str] = ()
) -> None:
    """Labels and one score per model, narrow types, zstd."""
    (
        df.select(*key, F.col(y).cast("tinyint").alias("y"),
                  *[F.col(m).cast("float").alias(m) for m in models])
        .write.mode("overwrite").option("compression", "zstd").parquet(path)
    )


def finite_only(df: DataFrame) -> DataFrame:
    """NaN and infinities to null in every floating column."""
    return df.select(*[
        finite_or_null(F.col(c)).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in df.dtypes
    ])


def export_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A published result table as one sorted CSV. Meant for summaries, not for row-level data."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A published result table as JSON lines without NaN or Infinity."""
    finite_only(df).orderBy(*order).coalesce(1).write.mode("overwrite").option(
        "ignoreNullFields", False).json(path)


PROFILE_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()), T.StructField("bin", T.IntegerType()),
    T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()),
    T.StructField("share", T.DoubleType()),
])


def save_profile(profile: DataFrame, path: str) -> None:
    """Numeric profile rows; open ends are stored as null."""
    finite_only(profile.select([f.name for f in PROFILE_SCHEMA])).write.mode("overwrite").json(path)


def load_profile(spark: SparkSession, path: str) -> DataFrame:
    """Null bounds come back as infinities by position: low end and high end."""
    df = spark.read.schema(PROFILE_SCHEMA).json(path)
    return df.select(
        "feature", "bin",
        F.coalesce("lo", F.lit(float("-inf"))).alias("lo"),
        F.coalesce("hi", F.lit(float("inf"))).alias("hi"),
        "share",
    )
