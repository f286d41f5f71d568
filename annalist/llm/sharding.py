"""Contiguous shards of nearly equal bytes.

Rows are put in doc_id order by a range exchange that carries three numbers a row and no text, and cuts by all of them,
so that one id of many rows is spread too. Each range
partition's total of bytes is summed; the running sum of these few totals gives the bytes before a partition,
a window inside the partition gives the bytes before a row, and the row goes to the shard in whose equal part
of all bytes it starts. Shards are runs of the order, so no shard is over or under the target by more than
one document.

Defined cases: a null text counts as empty (size 1); a null id comes first; rows with the same id are ordered
by checksum and size, repeated rows each get a slot; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import written


def shard_by_bytes(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, size (UTF-8 bytes + 1), text_crc32, law, shard, slot, grown_shard (null)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = ["id", "text_crc32", "size"]
    sized = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    ranged = written(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "shard-sizes")

    # A row per range partition: their number depends on the cluster's settings and not on the documents.
    parts = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_bytes"),
    )
    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("nth", F.row_number().over(inside))
        .join(F.broadcast(parts), "part")
        .withColumn("start", F.col("bytes_before") + F.col("upto") - F.col("size"))
        .select("id", "size", "text_crc32", F.expr(f"cast(start * {int(n_shards)} div all_bytes as int)").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    )
    placed = written(placed, "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
