"""Lines, documents and word tables from files, and lines to files.

UTF-8 files are read by Spark's text reader, which splits them. Those of another encoding can't be cut at any byte: each is
one row of bytes that one task decodes, strictly, so an undecodable byte fails the job with its file, line and value.
"""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class InputError(ValueError):
    """A source that can't be read as it was asked to be."""


def sniffed(head: bytes) -> str:
    """The encoding that a mark at the beginning, or NULs at every other byte, tell; else UTF-8, its mark dropped."""
    if head.startswith((codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE)):
        return "utf-32"
    if head.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
        return "utf-16"
    even, odd = head[:64:2], head[1:64:2]
    for zeros, others, name in ((odd, even, "utf-16-le"), (even, odd, "utf-16-be")):
        if len(head) > 3 and zeros.count(0) > 0.6 * len(zeros) and not others.count(0):
            return name
    return "utf-8-sig"


def decoded_lines(content: bytes, name: str, encoding: str | None = None) -> list[str]:
    """The lines of a file's bytes; InputError names the line and byte that can't be decoded."""
    chosen = encoding or sniffed(content[:64])
    chosen = "utf-8-sig" if chosen.lower().replace("_", "-") in ("utf-8", "utf8") else chosen
    try:
        codecs.lookup(chosen)
        text = content.decode(chosen)
    except LookupError:
        raise InputError(f"unknown encoding {encoding!r}") from None
    except UnicodeDecodeError as error:
        line = content[: error.start].count(b"\n") + 1
        hint = f"it is not {encoding}" if encoding else "save it as UTF-8, or name its encoding"
        raise InputError(f"{name}, line {line}: byte 0x{content[error.start]:02X} is not {chosen.removesuffix('-sig')}; {hint}") from None
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _decode(encoding: str | None):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                lines = decoded_lines(content, path, encoding)
                for a in range(0, len(lines), 8192):
                    part = lines[a : a + 8192]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(range(a + 1, a + 1 + len(part)), pa.int64()), pa.array(part, pa.string())], names=["path", "number", "line"])

    return run


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """line, one row each. encoding: "utf-8" reads with Spark's own reader, in parts; None looks at each file's first bytes."""
    if encoding and encoding.lower().replace("_", "-") in ("utf-8", "utf8"):
        return spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_decode(encoding), "path string, number long, line string").select("line")


def read_documents(spark: SparkSession, path: str, text_col: str | None = None) -> DataFrame:
    """text, one row for each document: a Parquet table's column `text` (or its last one), or a text file's lines, packed
    or not; blank ones are left out."""
    parquet = path.rstrip("/").endswith(".parquet")
    if not parquet and not path.endswith((".txt", ".txt.gz")):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)]
        parquet = any(n.endswith(".parquet") for n in names)
    if not parquet:
        rows = spark.read.text(path).select(F.col("value").alias("text"))
    else:
        table = spark.read.parquet(path)
        rows = table.select(F.col(text_col or ("text" if "text" in table.columns else table.columns[-1])).cast("string").alias("text"))
    return rows.where(F.trim("text") != "")


def read_lexicon(spark: SparkSession, path: str, most: int = 100_000) -> dict[str, str]:
    """Roman words by their Urdu ones, from lines of roman, tab, urdu; a table for letters.transliterate, of `most` rows at most."""
    rows = spark.read.csv(path, sep="\t", schema="roman string, urdu string", quote="").where("roman IS NOT NULL AND urdu IS NOT NULL")
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise InputError(f"{path} has more than {most} words")
    return {r["roman"].lower(): r["urdu"] for r in found}


def read_spellings(spark: SparkSession, path: str) -> DataFrame:
    """urdu, roman, n from lines of urdu, tab, roman, tab, count."""
    return spark.read.csv(path, sep="\t", schema="urdu string, roman string, n long", quote="")


def write_lines(rows: DataFrame, line: str, path: str) -> None:
    """A column as lines; files appear whole or not at all, by Spark's commit."""
    rows.select(F.coalesce(F.col(line), F.lit("")).alias("value")).write.mode("errorifexists").text(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    """Rows as JSON objects, letters as they are."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def looks_mangled(line: Column) -> Column:
    """Three or more question marks and, marks and digits aside, nothing else: a shell put them for the letters."""
    plain = F.replace(line, F.lit(" "), F.lit(""))
    return (F.length(plain) - F.length(F.replace(plain, F.lit("?"), F.lit(""))) >= 3) & plain.rlike(r"^[?.,!؟۔0-9]*\z")


import sys  # noqa: E402

cloudpickle.register_pickle_by_value(sys.modules[__name__])
