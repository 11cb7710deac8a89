"""The functions under SQL names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lafzspark.functions import letters, numbers, plain
from lafzspark.functions.letters import SOURCES, Reader
from lafzspark.resources import roman as R

TABLE = dict(R.LEXICON)


def _transliterated(text: str) -> dict:
    out = Reader(TABLE).read(text)
    return {"text": "".join(w for _, w, _ in out), "sources": [{"token": t, "tag": g} for t, _, g in out if g != "space"]}


FUNCTIONS = {
    "lafz_normalize": (plain.normal, "string"),
    "lafz_parse_number": (numbers._float, "double"),
    "lafz_parse_ordinal": (numbers.parse_position, "long"),
    "lafz_find_numbers": (numbers.spans, numbers.SPANS),
    "lafz_transliterate": (_transliterated, SOURCES),
    "lafz_rules_to_urdu": (letters.spelled, "string"),
}


def _arrow(function, kind: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    arrow_type = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in column.to_pylist()], arrow_type)

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


class _Spans:
    """Number phrases of a text, a row each."""

    def eval(self, text: str):
        for s in numbers.spans(text) if text is not None else ():
            yield s["text"], s["value"], s["start"], s["end"], s["ordinal"]


def register(spark: SparkSession) -> None:
    """Scalar functions lafz_* in Arrow batches, and the table function lafz_number_rows(text)."""
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(name, _arrow(function, kind))
    spark.udtf.register("lafz_number_rows", F.udtf(_Spans, returnType="text string, value double, start int, end int, ordinal boolean"))
