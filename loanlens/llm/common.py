"""Small helpers of the text operators: tables, staging, folds and column names."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.session import scratch_path

#: Lower-casing of A-Z only, on bytes.
LOWER_AZ = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
WORD = r"[^\x20\x09-\x0D]+"
WORD_CHARS = re.compile(r"[^\W\d_]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back; a lost executor then loses nothing."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def lower_az(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of `df` has it, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z; bytes.split() cuts at exactly space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_AZ).split()
