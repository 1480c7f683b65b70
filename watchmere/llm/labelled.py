"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel

#: Learning takes this many documents of each class at most, of any length.
PER_CLASS = 1200


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, held_out_of: int = 5, held_out: int = 0) -> list[tuple[bytes, int]]:
    """(text, label) of about per_class documents of each class outside the held-out bucket.

    The ids with the smallest hashes are taken, so the sample doesn't depend on
    partitions or order.  Rows with a null id, label or text, or a label other
    than 0 and 1, teach nothing; an id with several labels counts by the largest, one
    with several texts by the smallest.
    Only the chosen ids (2 * per_class at most) are broadcast.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (kernel.crc_bucket(F.col("doc_id"), held_out_of) != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64("doc_id", F.lit(label))
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("label") == y).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionAll(part)
    ids = {r["doc_id"]: r["label"] for r in chosen.collect()}  # 2 * per_class at most
    if not ids:
        return []
    spark = docs.sparkSession
    small = spark.createDataFrame(list(ids.items()), "doc_id long, label int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    got = texts.join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label")).orderBy("doc_id").select("text", "label").collect()
    return [(r["text"].encode(), r["label"]) for r in got]
