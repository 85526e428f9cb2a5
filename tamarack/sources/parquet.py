"""Parquet tables of a directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """``directory/name.parquet`` with just ``columns`` (all when none are named).

    Operators name what they need, so that extra columns of the file, whatever they are called,
    neither get read nor clash with columns an operator adds.
    """
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    return df.select(*[df[f"`{c}`"] for c in columns]) if columns else df
