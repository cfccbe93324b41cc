"""Numbers over a global order without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmtide.plans.workspace import Workspace


def numbered(df: DataFrame, order: list, into: str, start: int = 0) -> DataFrame:
    """Adds gapless numbers in a total order: range partitions, their counts' running sum, and ranks within."""
    spark = df.sparkSession
    work = Workspace(spark, "numbered")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = work.keep(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").count()  # a row per partition
    before = F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = dealt.withColumn("__rank", rank).join(F.broadcast(offsets), "__part")
    return out.withColumn(into, (F.col("__before") + F.col("__rank") + (start - 1)).cast("long")).drop("__part", "__before", "__rank")
