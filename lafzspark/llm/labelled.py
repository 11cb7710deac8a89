"""Bounded samples of labelled documents for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000


def remainder(doc_id: Column, modulus: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def is_held_out(doc_id: Column, modulus: int, held: int) -> Column:
    """Null ids are not held out (and have no labels)."""
    return F.coalesce(remainder(doc_id, modulus) == held, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, limit: int = SAMPLE) -> DataFrame:
    """text and label (0 or 1) of at most `limit` labelled documents that aren't held out, chosen by hash of the id.

    docs has doc_id and text. At most `limit` ids (8 bytes and a flag each) are broadcast, and only texts of these ids are
    shuffled. An id with several labels has the largest; null labels and ids don't count. Of an id's several rows the one
    of the smallest hash of its text is taken, so there are `limit` rows at most.
    """
    ids = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    ids = ids.where(remainder(F.col("doc_id"), modulus) != held).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "label")).alias("r"))
    return rows.select("r.text", "r.label")
