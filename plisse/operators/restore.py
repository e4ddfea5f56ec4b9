"""The restore store: originals by content address, with a time to live and a bound on bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plisse.functions.hashes import restore_id
from plisse.functions.tables import materialize
from plisse.functions.text import valid_restore_id
from plisse.plans.options import STORE_BYTES, STORE_TTL_SECONDS

STORE = "restore_id string, original binary, cost bigint, stored_at timestamp, seq bigint"


def entries(originals: DataFrame, stored_at: Column, first_seq: Column) -> DataFrame:
    """Store rows of originals(restore_id, original, marker, payload_id, seq), numbered upwards in output order.

    The rows are sorted by ranges and numbered where they are; numbers ascend but have gaps.
    """
    o = originals.orderBy("payload_id", "seq").withColumn("_n", F.monotonically_increasing_id())
    cost = F.octet_length("original") + F.octet_length("marker")
    return o.select("restore_id", "original", cost.cast("long").alias("cost"), stored_at.alias("stored_at"), (first_seq + F.col("_n")).cast("long").alias("seq"))


def insert(store: DataFrame, new: DataFrame, now: Column, ttl_seconds: int = STORE_TTL_SECONDS, max_bytes: int = STORE_BYTES) -> DataFrame:
    """The store after new rows: content-addressed, the latest of equal ids stays; too old rows go, then the oldest beyond the
    bound on bytes. Rows larger than the bound, and all rows where the time to live is 0, are refused."""
    fits = new.where((F.col("cost") <= max_bytes) & F.lit(ttl_seconds > 0))
    both = store.where(~_expired(now, ttl_seconds)).unionByName(fits)
    latest = both.groupBy("restore_id").agg(F.max_by(F.struct("original", "cost", "stored_at", "seq"), "seq").alias("e")).select("restore_id", "e.*")
    latest = materialize(latest, "store-latest")
    # Running sums in two steps: of the sorted partitions, one row each, and within each; originals are joined to what stays.
    s = latest.select("restore_id", "seq", "cost").orderBy(F.desc("seq")).withColumn("_p", F.spark_partition_id())
    s = materialize(s, "store-order")
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = s.groupBy("_p").agg(F.sum("cost").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(ahead), F.lit(0))).drop("_c")
    newest = Window.partitionBy("_p").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stays = s.join(before, "_p").withColumn("_held", F.col("_before") + F.sum("cost").over(newest)).where(F.col("_held") <= max_bytes)
    return latest.join(stays.select("restore_id"), "restore_id", "left_semi")


def _expired(now: Column, ttl_seconds: int) -> Column:
    return F.unix_micros(now) - F.unix_micros("stored_at") >= ttl_seconds * 1_000_000


def restore(ids: DataFrame, store: DataFrame, now: Column, ttl_seconds: int = STORE_TTL_SECONDS) -> DataFrame:
    """(restore_id, original) of ids(restore_id); null where the id is malformed, unknown, too old or doesn't verify."""
    asked = ids.select("restore_id", valid_restore_id(F.col("restore_id")).alias("_ok"))
    held = store.where(~_expired(now, ttl_seconds)).withColumn("_is", restore_id(F.col("original"))).where(F.col("_is") == F.col("restore_id"))
    found = held.select(F.col("restore_id").alias("_id"), "original")
    return asked.join(found, F.when(F.col("_ok"), F.col("restore_id")) == F.col("_id"), "left").select("restore_id", "original")
