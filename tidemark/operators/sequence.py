"""Dense numbering of distributed rows."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def with_index(df: DataFrame, order: list, name: str, start: int = 0) -> DataFrame:
    """``df`` with a dense index from ``start`` in the given order, without moving all rows to one task.

    Rows are range-partitioned and sorted, and written with their partition and their place in it; the partitions'
    sizes, one row each, give the offsets. Both come from the written table: a range exchange that is planned twice
    samples twice, and then offsets and rows need not agree.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
    placed = written(placed, "index")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    joined = placed.join(F.broadcast(offsets), "_part")  # at most one row for each shuffle partition
    return joined.withColumn(name, F.col("_offset") + F.col("_place") + start).drop("_part", "_place", "_offset")


def stamp(batch: DataFrame, order: list, last_sequence: int) -> DataFrame:
    """A batch of (user_key, value_type, value) with sequences that follow ``last_sequence`` in the given order."""
    return with_index(batch, order, "sequence", last_sequence + 1).select("user_key", "sequence", F.col("value_type").cast("byte").alias("value_type"), "value")
