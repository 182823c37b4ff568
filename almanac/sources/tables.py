"""Parquet tables by name. The schema comes with the files; columns are pruned by the plans that follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def string_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every column as text; an empty field is an empty text, not null."""
    raw = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).csv(path)
    return raw.na.fill("")
