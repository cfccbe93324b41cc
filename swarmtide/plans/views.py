"""Stand-in views over the star-schema tables, in Spark and in SQL: points, list members, steps in time, a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in the unit box."""
    e = lambda k: F.col("embedding")[k].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), *((e(k) - F.floor(e(k))).alias(c) for k, c in enumerate("xyz")),
        *(e(k + 3).alias(f"v{c}") for k, c in enumerate("xyz")), (F.col("label") + 1).cast("double").alias("mass"),
        (F.col("vec_id") % 6).cast("int").alias("type"), F.when(F.col("label") == 9, -1).otherwise(F.col("label")).cast("long").alias("halo_id"),
    )


def cat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of tracks: members in order."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    lines = lines.withColumn("ord", (F.row_number().over(w) - 1).cast("long"))
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("track"), "ord", F.col("l_partkey").alias("id"), F.col("l_quantity").alias("mass"),
        (F.col("l_suppkey") % 6).cast("int").alias("type"), F.col("o_custkey").alias("host"), F.year("o_orderdate").cast("int").alias("snapshot"),
    )


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per order as a track with a mass, a host (one in ten in the field) and a kinematic distance."""
    field = F.when(F.col("o_orderkey") % 10 == 0, -1).otherwise(F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("track"), field.cast("long").alias("host"), F.col("o_totalprice").alias("mass"),
        (F.col("o_orderkey") * 7919 % 1009).cast("double").alias("kdist"), F.year("o_orderdate").cast("int").alias("snapshot"),
    )


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each particle and day: its halo and mass then."""
    last = F.max(F.struct("ts", "event_id", "event_type", "value"))
    seen = table(spark, sf_dir, "events").groupBy((F.dayofmonth("ts") - 1).cast("int").alias("snapshot"), F.col("user_id").alias("id")).agg(last.alias("e"))
    return seen.select("snapshot", "id", F.col("e.event_type").alias("halo"), F.col("e.value").alias("mass"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of children to parents."""
    rows = table(spark, sf_dir, "customer").where("c_custkey > 0")
    return rows.select(F.col("c_custkey").alias("child"), F.floor(F.col("c_custkey") / 4).cast("long").alias("parent"), F.col("c_acctbal").alias("mass"))


SQL = {
    "pts": """SELECT vec_id AS id, embedding[1]::DOUBLE - floor(embedding[1]::DOUBLE) AS x, embedding[2]::DOUBLE - floor(embedding[2]::DOUBLE) AS y,
        embedding[3]::DOUBLE - floor(embedding[3]::DOUBLE) AS z, embedding[4]::DOUBLE AS vx, embedding[5]::DOUBLE AS vy, embedding[6]::DOUBLE AS vz,
        (label + 1)::DOUBLE AS mass, (vec_id % 6)::INTEGER AS type, (CASE WHEN label = 9 THEN -1 ELSE label END)::BIGINT AS halo_id FROM embeddings""",
    "cat": """SELECT l_orderkey AS track, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS ord,
        l_partkey AS id, l_quantity AS mass, (l_suppkey % 6)::INTEGER AS type, o_custkey AS host, year(o_orderdate)::INTEGER AS snapshot
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "tracks": """SELECT o_orderkey AS track, (CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END)::BIGINT AS host, o_totalprice AS mass,
        (o_orderkey * 7919 % 1009)::DOUBLE AS kdist, year(o_orderdate)::INTEGER AS snapshot FROM orders""",
    "steps": """SELECT (day(ts) - 1)::INTEGER AS snapshot, user_id AS id, event_type AS halo, value AS mass FROM events
        QUALIFY row_number() OVER (PARTITION BY day(ts), user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "tree": "SELECT c_custkey AS child, c_custkey // 4 AS parent, c_acctbal AS mass FROM customer WHERE c_custkey > 0",
}
