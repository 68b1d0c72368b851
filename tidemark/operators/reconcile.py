"""Read operators: pure DataFrame-to-DataFrame functions over a mutation log.

The newest version of a key is picked before deletions are hidden; the other way round would bring deleted
keys back. Filters on ``user_key`` move below the window into the Parquet scan, filters on the type don't.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import is_put
from ..shared import written


def newest_first() -> list[Column]:
    return [F.desc("sequence"), F.desc("value_type")]


def in_range(start: bytes | None, end: bytes | None) -> Column:
    """``start <= user_key < end``; None leaves a side open, and start >= end holds for no key."""
    out = F.lit(True)
    if start is not None:
        out = out & (F.col("user_key") >= F.lit(bytes(start)))
    if end is not None:
        out = out & (F.col("user_key") < F.lit(bytes(end)))
    return out


def has_prefix(prefix: bytes) -> Column:
    """Keys that start with ``prefix``, as a range that reaches the scan."""
    last = prefix.rstrip(b"\xff")
    return in_range(prefix, last[:-1] + bytes([last[-1] + 1]) if last else None)


def newest_per_key(mutations: DataFrame) -> DataFrame:
    """The newest version of each key, deletions included. One shuffle by key, after a map-side top-1."""
    order = [*newest_first(), F.asc("source_rank")] if "source_rank" in mutations.columns else newest_first()
    rank = F.row_number().over(Window.partitionBy("user_key").orderBy(*order))
    return mutations.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def as_of(mutations: DataFrame, sequence: int) -> DataFrame:
    """The log as it was after mutation ``sequence``."""
    return mutations.where(F.col("sequence") <= sequence)


def live_view(mutations: DataFrame) -> DataFrame:
    """Each live key with its newest value, unordered."""
    return newest_per_key(mutations).where(is_put()).select("user_key", "value")


def scan(mutations: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Live keys of the half-open range, ascending."""
    return live_view(mutations.where(in_range(start, end))).orderBy("user_key")


def get(mutations: DataFrame, user_key: bytes) -> DataFrame:
    """No row or the one value of ``user_key``; a top-1 without any shuffle of the log."""
    return mutations.where(F.col("user_key") == F.lit(bytes(user_key))).orderBy(*newest_first()).limit(1).where(is_put()).select("user_key", "value")


def multi_get(mutations: DataFrame, keys: DataFrame) -> DataFrame:
    """Live keys among ``keys`` (column user_key). The semi join comes before the window and prunes the log."""
    probes = keys.select("user_key").where(F.col("user_key").isNotNull()).distinct()
    return live_view(mutations.join(probes, "user_key", "left_semi"))


def tombstones(mutations: DataFrame) -> DataFrame:
    return newest_per_key(mutations).where(~is_put()).select("user_key", "sequence")


def merge_sources(*newest_first: DataFrame) -> DataFrame:
    """All versions of all sources, with ``source_rank`` 0 for the newest source."""
    ranked = [df.withColumn("source_rank", F.lit(k)) for k, df in enumerate(newest_first)]
    return reduce(DataFrame.unionByName, ranked)


def first_source(merged: DataFrame) -> DataFrame:
    """Of each key the version that the newest source holding any version has."""
    rank = F.row_number().over(Window.partitionBy("user_key").orderBy("source_rank", *newest_first()))
    return merged.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def internal_order(mutations: DataFrame) -> DataFrame:
    """The log sorted by internal key; a range exchange and a sort."""
    return mutations.orderBy(F.asc("user_key"), *newest_first())


def ceiling(keys: DataFrame, probes: DataFrame) -> DataFrame:
    """For each probe the smallest key >= probe, or null: a lower-bound seek in bulk. Null probes are left out.

    Keys and probes, each once, are dealt by Spark's range partitioner and written with the number of their range; in
    each range a running minimum from the right finds the key, and what a range lacks is the first key of a later
    range. No non-equi join and no window over all rows; the only unpartitioned step sees one row per range.
    """
    no, yes = F.lit(False), F.lit(True)
    both = keys.select("user_key", yes.alias("stored"), no.alias("asked")).unionByName(probes.select("user_key", no.alias("stored"), yes.alias("asked")))
    both = both.where(F.col("user_key").isNotNull()).groupBy("user_key").agg(F.max("stored").alias("stored"), F.max("asked").alias("asked"))
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = written(both.repartitionByRange(n, "user_key").withColumn("range", F.spark_partition_id()), "ceiling")
    both = both.withColumn("key", F.when(F.col("stored"), F.col("user_key")))
    right = Window.partitionBy("range").orderBy(F.col("user_key")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    firsts = both.groupBy("range").agg(F.min("key").alias("first"))
    later = firsts.select("range", F.min("first").over(Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)).alias("next"))
    near = both.withColumn("found", F.min("key").over(right)).where("asked")
    return near.join(F.broadcast(later), "range", "left").select(F.col("user_key").alias("probe"), F.coalesce("found", "next").alias("ceiling"))


MOST_CELLS = 64


def delete_ranges(mutations: DataFrame, ranges: DataFrame) -> DataFrame:
    """The log without versions covered by a newer range deletion (start_key, end_key, sequence). Beyond parity.

    The key space is cut into at most ``MOST_CELLS`` cells at starts of ranges, chosen by a hash; a range counts in each
    cell that it meets, so the anti join is an equi-join on cells, which Spark shuffles if the ranges are many.
    """
    r = ranges.where("start_key < end_key").select("start_key", "end_key", F.col("sequence").alias("deleted_at"))
    sample = r.select("start_key").distinct().orderBy(F.xxhash64("start_key"), "start_key").limit(16 * MOST_CELLS)
    starts = sorted(bytes(x[0]) for x in sample.collect())
    cuts = sorted({starts[k * len(starts) // MOST_CELLS] for k in range(1, MOST_CELLS)}) if starts else []
    cells = r.withColumn("cell", F.explode(F.sequence(_cell("start_key", cuts), _cell("end_key", cuts))))
    hit = (F.col("user_key") >= F.col("start_key")) & (F.col("user_key") < F.col("end_key")) & (F.col("sequence") < F.col("deleted_at"))
    placed = mutations.withColumn("_cell", _cell("user_key", cuts))
    return placed.join(cells, (F.col("_cell") == F.col("cell")) & hit, "left_anti").drop("_cell")


def _cell(key: str, cuts: list[bytes]) -> Column:
    """Number of cuts at or before a key: a binary search written as a balanced tree of comparisons."""

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) < F.lit(bytearray(cuts[mid])), place(low, mid)).otherwise(place(mid + 1, high))

    return place(0, len(cuts))
