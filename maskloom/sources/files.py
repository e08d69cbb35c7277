"""Tables, token/tag JSON, language lists. Schemas are given, so nothing is inferred by a pass over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a table is dealt before work on its texts.
SMALL = 256 << 20
EXAMPLE = "tokens array<string>, ner_tags array<string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; a missing path is an error of Spark's own."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, most: int = SMALL) -> DataFrame:
    """A small table dealt to all cores, as one row group is one task; tables beyond ``most`` bytes have splits enough and are not shuffled."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size <= most else rows


def read_examples(spark: SparkSession, path: str, schema: str = EXAMPLE, array: bool = True) -> DataFrame:
    """Token/tag examples from a JSON array (one file, one document) or from JSON lines (splittable)."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def write_examples(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    """Language codes of a comma-separated list; lines that hold a count are left out."""
    lines = spark.read.text(path)
    codes = lines.select(F.explode(F.split("value", ",")).alias("code")).select(F.trim("code").alias("code"))
    return codes.where((F.col("code") != "") & ~F.col("code").rlike("[0-9]|[ :]"))


def preview(rows: DataFrame, n: int = 5) -> tuple[list[str], list[tuple[object, ...]]]:
    """Column names and the first rows."""
    return rows.columns, [tuple(r) for r in rows.limit(n).collect()]
