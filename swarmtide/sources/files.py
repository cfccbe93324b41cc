"""Which of several naming conventions a store follows, asked through Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def matches(spark: SparkSession, pattern: str) -> list[str]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def first_of(spark: SparkSession, patterns: list[str]) -> list[str]:
    for pattern in patterns:
        if found := matches(spark, pattern):
            return found
    raise FileNotFoundError(f"no file fits any of: {', '.join(patterns)}")
