"""Table scans and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan one Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_jdbc(
    spark: SparkSession, url: str, table: str, properties: Mapping[str, str] | None = None,
    split_on: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1,
) -> DataFrame:
    """Scan a database table in ``partitions`` ranges of ``split_on``.

    Without ``split_on`` the table is read by one task, which suits small tables only;
    more than one partition is refused then.
    """
    if partitions > 1 and not split_on:
        raise ValueError("give split_on with its bounds to read in several partitions")
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    if split_on:
        reader = (
            reader.option("partitionColumn", split_on).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", partitions)
        )
    return reader.options(**dict(properties or {})).load()


def open_table(spark: SparkSession, location: str, name: str, **jdbc) -> DataFrame:
    """Scan a table from the configured location: a ``jdbc:`` URL or a Parquet folder."""
    if location.startswith("jdbc:"):
        return read_jdbc(spark, location, name, **jdbc)
    return read_table(spark, location, name)


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a new table state. The target must not be an input of ``df``."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_csv(spark: SparkSession, path: str, schema: StructType, problems: str | None = None,
             line_ends: bool = True) -> DataFrame:
    """Read a headed CSV by column name; columns outside ``schema`` are ignored.

    Quoted cells may hold commas, doubled quotes and, with ``line_ends``, line ends. A file
    whose cells may hold line ends is read by one task; without, large files are split.
    ``problems`` names an array column to add, with the columns whose cells could not be
    cast (these are null).
    """
    header = (
        spark.read.option("header", True).option("multiLine", line_ends).option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
    found = [f for f in schema if f.name in header.columns]
    cast = [header[f.name].try_cast(f.dataType).alias(f.name) for f in found]
    if problems:
        bad = [F.when(header[f.name].isNotNull() & header[f.name].try_cast(f.dataType).isNull(), F.lit(f.name)) for f in found]
        cast.append(F.array_compact(F.array(*bad)).alias(problems))
    return header.select(*cast)


def write_csv(df: DataFrame, path: str) -> None:
    """Write a headed CSV whose quotes are doubled inside quoted cells, as other readers expect."""
    (
        df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True)
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    )
