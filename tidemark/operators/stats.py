"""Statistics over a mutation log, and the sequence and generation operators."""

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys
from ..schema import is_put
from .reconcile import newest_per_key

ENTRY_BYTES = "length(user_key) + 8 + length(value)"
ROWS_PER_CHUNK = 1 << 20


def max_sequence(mutations: DataFrame) -> DataFrame:
    """Largest sequence and number of mutations; Parquet footers can answer it."""
    return mutations.agg(F.max("sequence").alias("max_sequence"), F.count("*").alias("n"))


def physical_bytes(mutations: DataFrame) -> DataFrame:
    return mutations.agg(F.coalesce(F.sum(F.expr(ENTRY_BYTES)), F.lit(0)).cast("long").alias("physical_bytes"))


def space_amplification(mutations: DataFrame) -> DataFrame:
    """Bytes of all versions, bytes of live data, and their ratio, in one pass over the log.

    Per key the totals and the newest version come out of one aggregate on numbers only: the size and type of
    the newest version ride in a struct that ``max`` orders by sequence.
    """
    size = F.expr(ENTRY_BYTES).cast("long")
    newest = F.struct("sequence", "value_type", (F.length("user_key") + F.length("value")).cast("long").alias("live"))
    per_key = mutations.groupBy("user_key").agg(F.sum(size).alias("physical"), F.max(newest).alias("newest"))
    live = F.sum(F.when(F.col("newest.value_type") == 1, F.col("newest.live")).otherwise(0))
    out = per_key.agg(F.coalesce(F.sum("physical"), F.lit(0)).alias("physical_bytes"), F.coalesce(live, F.lit(0)).alias("live_bytes"))
    return out.withColumn("amplification", F.when(F.col("live_bytes") > 0, F.col("physical_bytes") / F.col("live_bytes")))


def prefix_share(mutations: DataFrame) -> DataFrame:
    """Bytes each user key shares with the one before it in internal order, which block prefix compression saves.

    Within a key all versions after the first share the whole key, so only distinct keys need comparing.
    """
    from .sequence import with_index

    distinct = with_index(mutations.groupBy("user_key").agg(F.count("*").alias("versions")), ["user_key"], "at")
    before = distinct.select((F.col("at") + 1).alias("at"), F.col("user_key").alias("previous"))
    firsts = distinct.join(before, "at", "left").select("user_key", "versions", F.when(F.col("previous").isNotNull(), keys.shared_prefix(F.col("previous"), F.col("user_key"))).alias("first"))
    own = F.transform(F.sequence(F.lit(1), F.col("versions")), lambda k: F.when(k == 1, F.col("first")).otherwise(F.length("user_key")))
    return firsts.select("user_key", F.explode(own).alias("shared")).where(F.col("shared").isNotNull())


def _chunk_functions(buffer_bytes: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """For each byte count that may already be in the buffer: when it first overflows, what is left at the end."""
        pdf = pdf.sort_values("sequence")
        sizes = pdf["bytes"].tolist()
        n = len(sizes)
        total = [0]
        for s in sizes:
            total.append(total[-1] + s)
        # after[i]: generations closed and bytes left when the buffer is empty before row i
        after: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        end = n  # the first row whose arrival overflows a buffer that is empty before row i
        for i in range(n - 1, -1, -1):
            while end > i and total[end] - total[i] >= buffer_bytes:
                end -= 1
            if total[end + 1 if end < n else n] - total[i] >= buffer_bytes:
                closed, left = after[end + 1]
                after[i] = (closed + 1, left)
            else:
                after[i] = (0, total[n] - total[i])
        rows, low = [], buffer_bytes
        for i in range(n):  # rows that can be the first to overflow; held: least bytes held before the chunk
            held = max(0, buffer_bytes - total[i + 1])
            if held < low:
                rows.append((held, after[i + 1][0] + 1, after[i + 1][1], True))
                low = held
            if held == 0:
                break
        if low > 0:
            rows.append((0, 0, total[n], False))
        out = pd.DataFrame(rows, columns=["held", "closed", "remaining", "overflows"])
        out.insert(0, "chunk", pdf["chunk"].iloc[0])
        return out

    return run


def flush_generations(mutations: DataFrame, buffer_bytes: int, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """The write-buffer generation of each mutation: a running byte sum that starts anew after reaching the buffer.

    The mutation that reaches the buffer belongs to the generation it closes. A running sum with resets is no
    window frame, but a chunk of the log is a step function from the bytes held before it to those held after
    it, with one step for each row that may be the first to overflow. Chunks compute theirs in parallel, the driver
    walks the chunks keeping one number, and a second pass numbers the rows.
    """
    sized = mutations.select("sequence", F.expr(ENTRY_BYTES).cast("long").alias("bytes"), F.floor(F.col("sequence") / rows_per_chunk).alias("chunk"))
    steps = sized.groupBy("chunk").applyInPandas(_chunk_functions(buffer_bytes), "chunk long, held long, closed long, remaining long, overflows boolean")
    begins, at, held, generation, new = [], None, 0, 0, None

    def close():
        if at is not None:
            begins.append((at, held, generation))

    for row in steps.orderBy("chunk", F.desc("held"), F.desc("overflows")).toLocalIterator():
        if row.chunk != at:
            if new is not None:
                generation, held = generation + new[0], new[1]
            at, new = row.chunk, None
            close()
        if new is None and held >= row.held:
            new = (row.closed, row.remaining + (0 if row.overflows else held))
    spark = mutations.sparkSession
    starts = spark.createDataFrame(begins, "chunk long, held long, generation long")

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence").reset_index(drop=True)
        inside, gen, out = int(pdf["held"].iloc[0]), int(pdf["generation"].iloc[0]), []
        for size in pdf["bytes"]:
            out.append(gen)
            inside += size
            if inside >= buffer_bytes:
                inside, gen = 0, gen + 1
        return pdf.assign(generation=out)[["sequence", "bytes", "generation"]]

    return sized.join(starts, "chunk").groupBy("chunk").applyInPandas(number, "sequence long, bytes long, generation long")


def engine_metrics(mutations: DataFrame, buffer_bytes: int, durability: str = "sync") -> DataFrame:
    """The counters a store that took these mutations one by one would show, as one row."""
    flushed = flush_generations(mutations, buffer_bytes).groupBy("generation").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    full = F.col("bytes") >= buffer_bytes
    return flushed.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("wal_append_count"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("wal_sync_count") if durability != "none" else F.lit(0).cast("long").alias("wal_sync_count"),
        F.coalesce(F.sum(F.when(full, 1).otherwise(0)), F.lit(0)).cast("long").alias("memtable_switch_count"),
        F.coalesce(F.sum(F.when(full, 1).otherwise(0)), F.lit(0)).cast("long").alias("flush_count"),
        F.coalesce(F.sum(F.when(full, F.col("bytes")).otherwise(0)), F.lit(0)).cast("long").alias("flush_bytes"),
        F.coalesce(F.sum(F.when(~full, F.col("bytes")).otherwise(0)), F.lit(0)).cast("long").alias("memtable_size_bytes"),
    )


def versions_per_key(mutations: DataFrame) -> DataFrame:
    return mutations.groupBy("user_key").agg(F.count("*").alias("versions"), F.sum(F.when(is_put(), 0).otherwise(1)).alias("deletes"))


__all__ = ["engine_metrics", "flush_generations", "max_sequence", "newest_per_key", "physical_bytes", "prefix_share", "space_amplification", "versions_per_key", "Window"]
