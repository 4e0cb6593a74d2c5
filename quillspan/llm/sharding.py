"""Contiguous shards of nearly equal bytes by global prefix sums.

Rows are range-partitioned by doc_id (then by checksum and size, so that one repeated id is split
too), each partition's total is taken, the totals are summed up in partition order, and each row
gets its global first byte. A row goes to the shard that holds its middle byte, so each cut is at
most half a row from its target.

Cases: a null text has no bytes and counts 1, as an empty one does; a null doc_id comes first;
repeated rows are kept, each with its own place; an empty table has no shards; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .store import cut


def shard_by_bytes(documents: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard (from 0), slot (gapless from 0 in each shard, in order)."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    rows = documents.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    order = ["doc_id", "text_crc32", "size"]
    # The checkpoint fixes which partition and place each row has.
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}))
    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row a partition: a bounded table, and the only window without a key.
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("row0"))
    total = totals.agg(F.sum("bytes").alias("total"))
    within = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        rows.repartitionByRange("part")
        .select("*", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("b"), F.count("*").over(within).alias("r"))
        .join(F.broadcast(starts), "part")
        .join(F.broadcast(total))
        .select("doc_id", "size", "text_crc32", F.expr(f"cast(least({shards - 1}, (2 * (byte0 + b) + size) * {shards} div (2 * total)) as int)").alias("shard"), (F.col("row0") + F.col("r")).alias("row"))
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most ``shards`` rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
