"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def schema(df: DataFrame, ddl: str) -> T.StructType:
    """doc_id as df has it, then the columns of ddl."""
    return T.StructType([T.StructField("doc_id", df.schema["doc_id"].dataType), *T.StructType.fromDDL(ddl).fields])


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], out: T.StructType | str) -> DataFrame:
    """work on each Arrow batch by itself, so that nothing is held between batches."""

    def run(batches):
        for batch in batches:
            yield from work(batch)

    return df.mapInArrow(run, out)


def utf8_size(text: F.Column) -> F.Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def rows_kept(docs: DataFrame, flags: Callable[[], Callable[[pa.RecordBatch], pa.Array]]) -> DataFrame:
    """The rows, with all their columns, for which a batch's flags hold; flags() is called once in each task."""

    def run(batches):
        keep = flags()
        for batch in batches:
            yield batch.filter(keep(batch))

    return docs.mapInArrow(run, docs.schema)
