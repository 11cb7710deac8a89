"""Benchmark decontamination: words of documents that stand inside a passage of a benchmark item.

Method: one Aho-Corasick automaton over the items' windows of normalised words; each text is scanned once, and
matches are mapped back to code point offsets of the original text.

The automaton goes to the executors with the tasks, so its size is checked: a benchmark of more than AUTOMATON_BYTES of
text is dealt by hash into parts of about that size. The driver holds one part at a time, each part's scan is written
before the next one is built, and the hits of each document are merged. One part is the rule (a benchmark of some
hundred items has a few dozen KB), and then documents are scanned once and never shuffled.

Defined cases: a null or word-free text or item has no words and no windows; an item of fewer words than a window is
one window; items with equal windows are all reported; repeated rows of documents each give a row (with a benchmark of
several pieces, rows of equal doc_id and text give one row each, too); an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm import scan, tables
from lafzspark.llm.scratch import written

WINDOW = 10
AUTOMATON_BYTES = 2 << 20
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def normal(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def automaton(items: list[tuple[str, bytes]], window: int):
    """Over ' word word ... ' of each window; the value is its number of words and the items that have it."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        words = normal(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(b" ".join(words[i : i + window]), set()).add(item)
    trie = ahocorasick.Automaton()
    for phrase, who in owners.items():
        trie.add_word(f" {phrase.decode('latin-1')} ", (phrase.count(b" ") + 1, tuple(sorted(who))))
    if owners:
        trie.make_automaton()
    return trie


def _starts_of_words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code point offsets of the normalised words' starts and ends in the original text."""
    raw = np.frombuffer(text, np.uint8)
    folded = np.frombuffer(text.translate(FOLD), np.uint8)
    starts, ends, _ = scan.spans(folded, np.array([0, len(raw)]))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[starts], points[ends]


def hits(trie, text: bytes) -> tuple[int, int, list[tuple[int, int]], set[str]]:
    """Words, hit words, maximal hit spans (code points, end exclusive), items."""
    words = normal(text)
    line = f" {b' '.join(words).decode('latin-1')} "
    found = list(trie.iter(line)) if len(trie) else []
    if not found:
        return len(words), 0, [], set()
    ends = np.cumsum([len(w) + 1 for w in words])  # the blank behind each word
    edge = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    last = np.searchsorted(ends, [at for at, _ in found])
    for k, (_, (n, who)) in zip(last.tolist(), found, strict=True):
        edge[k - n + 1] += 1
        edge[k + 1] -= 1
        items.update(who)
    hit = np.concatenate([[0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]])
    change = np.diff(hit)
    a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    left, right = _starts_of_words(text)
    return len(words), int(hit.sum()), list(zip(left[a].tolist(), right[b - 1].tolist(), strict=True)), items


SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(items: list[tuple[str, bytes]], window: int):
    def run(batches):
        trie = automaton(items, window)
        for batch in batches:
            for a, b in scan.slices(np.full(len(batch), 1), 1024):
                rows = [hits(trie, t or b"") for t in scan.as_bytes(batch.column("text").slice(a, b - a)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([[{"start": x, "end": y} for x, y in r[2]] for r in rows], SPAN),
                        pa.array([sorted(r[3]) for r in rows], pa.list_(pa.string())),
                    ],
                    names=["doc_id", "n_words", "n_hit", "spans", "items"],
                )

    return run


def pieces(benchmark: DataFrame, most: int) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """(number of parts, items of the next part): about `most` bytes of text each, collected one after the other."""
    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, -(-total // most))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) if n > 1 else rows
        yield n, [("" if r["i"] is None else r["i"], r["t"].encode()) for r in part.distinct().collect()]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_hit, spans (code points of the original text), items (sorted ids of items that occur)."""
    own = tables.id_text(docs, id_col, text_col)
    out = tables.schema(own, "n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>")
    rest = found = None
    for n, part in pieces(benchmark, automaton_bytes):
        if n == 1:
            return own.mapInArrow(_scan(part, window), out)
        if rest is None:  # a row number fixed by a written table keeps repeated rows apart
            own = written(own.withColumn("row", F.monotonically_increasing_id()))
            rest = own.select(F.col("row").alias("doc_id"), "text")
        one = rest.mapInArrow(_scan(part, window), "doc_id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>")
        one = written(one.where("n_hit > 0").select("doc_id", "spans", "items"))
        found = one if found is None else found.union(one)
    found = found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("raw"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    joined = own.join(found.withColumnRenamed("doc_id", "row"), "row", "left").select("doc_id", "text", "raw", "items")
    return joined.mapInArrow(_merge, out)


def _merge(batches):
    """One row a document from the spans of several pieces of the benchmark."""
    for batch in batches:
        n_words, n_hit, spans = [], [], []
        for text, raw in zip(scan.as_bytes(batch.column("text")).to_pylist(), batch.column("raw").to_pylist(), strict=True):
            left, right = _starts_of_words(text or b"")
            edge = np.zeros(len(left) + 1, np.int64)
            for x in raw or ():
                edge[np.searchsorted(left, x["start"])] += 1
                edge[np.searchsorted(right, x["end"]) + 1] -= 1
            hit = np.cumsum(edge[:-1]) > 0
            change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            a, b = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
            n_words.append(len(left))
            n_hit.append(int(hit.sum()))
            spans.append([{"start": x, "end": y} for x, y in zip(left[a].tolist(), right[b - 1].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_words, pa.int64()),
                pa.array(n_hit, pa.int64()),
                pa.array(spans, SPAN),
                pa.array([x or [] for x in batch.column("items").to_pylist()], pa.list_(pa.string())),
            ],
            names=["doc_id", "n_words", "n_hit", "spans", "items"],
        )


def op3(spark, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS p FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM d, (SELECT DISTINCT n FROM iw), unnest(range(1, len(w) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.p = iw.p AND dw.n = iw.n),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS c FROM hit, unnest(range(0, n)) AS t(k) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS c, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(cov.c, 0)::BIGINT AS n_hit, coalesce(its.c, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(cov.c, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """docs without the rows in which a window of the benchmark occurs; one scan for each part of the benchmark."""
    for n, part in pieces(benchmark, automaton_bytes):
        docs = tables.rows_kept(docs, _clean(part, window))
        docs = docs if n == 1 else written(docs)
    return docs


def _clean(items: list[tuple[str, bytes]], window: int):
    def flags():
        trie = automaton(items, window)
        return lambda batch: pa.array([not hits(trie, t or b"")[1] for t in scan.as_bytes(batch.column("text")).to_pylist()], pa.bool_())

    return flags
