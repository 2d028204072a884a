"""Recording of overlay messages: catalog snapshots by digest, injections and markers, with counters by kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of messages, and events, stop reasons and markers that are valid.
KINDS = ("catalog", "injection", "injection_active", "marker")
EVENTS = ("start", "stop")
REASONS = ("expired", "cleared", "jump", "reset")
MARKERS = ("jump", "reset", "loop")


def catalog_digest(source_sha256: Column, payload: Column) -> Column:
    """The digest that a catalog is kept once by: that of its source files, else that of the message."""
    return F.coalesce(source_sha256, F.sha2(payload, 256))


def valid(kind: Column, event: Column, reason: Column) -> Column:
    """Whether a message's fixed words are right: an injection's event and reason, a marker's kind (in ``event``)."""
    injection = event.isin(*EVENTS) & (reason.isNull() | reason.isin(*REASONS))
    return F.coalesce(F.when(kind == "injection", injection).when(kind == "marker", event.isin(*MARKERS)).otherwise(kind.isin(*KINDS)), F.lit(False))


def recorded(messages: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``messages`` with digest and fate: stored, duplicate, invalid or, for active lists, kept.

    ``messages`` has message_id (unique; the order of arrival), kind, unit_id, instance_id, event, reason, source_sha256 and payload.
    A catalog is stored once a digest, an injection once a unit, instance and event, the earliest message each; every valid marker is
    stored, every valid active list is only kept as the newest. ``stored`` holds digest, kind, unit_id, instance_id and event of earlier
    batches; what is there is a duplicate. Keys are folded before they are joined, so one that is sent over and over is one row.
    """
    fine = valid(F.col("kind"), F.col("event"), F.col("reason"))
    key = F.when(F.col("kind") == "catalog", F.struct(F.lit("").alias("u"), F.lit("").alias("i"), F.col("digest").alias("e"))).when(
        F.col("kind") == "injection", F.struct(F.coalesce(F.col("unit_id").cast("string"), F.lit("")).alias("u"), F.coalesce(F.col("instance_id").cast("string"), F.lit("")).alias("i"), F.col("event").alias("e"))
    )
    with_digest = lambda df: df.withColumn("digest", F.when(F.col("kind") == "catalog", catalog_digest(F.col("source_sha256"), F.col("payload"))))
    every = with_digest(messages).withColumns({"_fine": fine, "_key": key})
    first = every.where("_fine AND _key IS NOT NULL").groupBy("kind", "_key").agg(F.min("message_id").alias("message_id"))
    if stored is not None:
        first = first.join(stored.withColumn("_key", key).select("kind", "_key").distinct(), ["kind", "_key"], "left_anti")
    found = every.join(first.select("message_id", F.lit(True).alias("_first")), "message_id", "left")
    fate = F.when(~F.col("_fine"), "invalid").when(F.col("kind") == "injection_active", "kept").when(F.col("_key").isNull() | F.col("_first"), "stored").otherwise("duplicate")
    return found.withColumn("fate", fate).drop("_fine", "_key", "_first")


def counters(record: DataFrame) -> DataFrame:
    """Valid, stored, duplicate and invalid messages by kind."""
    of = lambda *fates: F.count_if(F.col("fate").isin(*fates))
    return record.groupBy("kind").agg(of("stored", "duplicate", "kept").alias("received"), of("stored").alias("stored"), of("duplicate").alias("duplicates"), of("invalid").alias("invalid"))
