"""Reading tables, and saving and loading a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def views(spark: SparkSession, folder: str, names: list[str]) -> SparkSession:
    """A session of its own, which sees the named tables as views."""
    session = spark.newSession()
    for name in names:
        read(session, folder, name).createOrReplaceTempView(name)
    return session
