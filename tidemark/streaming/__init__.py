"""Structured Streaming views of a mutation log. Beyond parity: a log tail kept up to date."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import is_put


def latest(mutations: DataFrame) -> DataFrame:
    """Newest version of each key of a streaming log, for update or complete mode.

    State is one row for each key ever written; sequence order is arrival order, so nothing can be late and
    no watermark applies.
    """
    newest = F.max(F.struct("sequence", "value_type", "value")).alias("newest")
    return mutations.groupBy("user_key").agg(newest).select("user_key", "newest.*")


def live(mutations: DataFrame) -> DataFrame:
    """Live keys of a streaming log, for complete mode."""
    return latest(mutations).where(is_put()).select("user_key", "value")


def append_to(store, order: list, name: str):
    """A ``foreachBatch`` sink that appends each micro-batch of the stream ``name`` once: a batch already in the store is skipped.

    Batch numbers start anew in each stream, so streams into one store need names of their own, kept over restarts.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store.write_batch(batch, order=order, batch_id=f"stream-{name}-{batch_id}")

    return write
