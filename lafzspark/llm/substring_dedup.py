"""Substring dedup: words inside any window of words that also starts somewhere else in the corpus are removed.

Method: Rabin-Karp hashes of every window, counted in Spark, and repeated windows merged into maximal intervals.

Plan. (1) Texts are packed into chunks of a few megabytes, written once to the shared folder, so that each later
scan meets the same windows in the same order. (2) Each chunk sends every distinct window hash once, sorted and
packed by the hash's leading bits: one row for each chunk and hash range. A passage that stands in a third of all
documents thus costs a range at most one entry per chunk. (3) Each range counts its hashes and sends a bit per hash
back to the chunk. (4) Chunks meet their bits, flag the repeated windows and merge them.
Shuffled: 7 bytes per distinct window and chunk, the packed texts, and one bit per window. Nothing is collected.

Defined cases: a null or blank text has no words and an empty kept text; a text of fewer words than the window loses
nothing; a repeated row repeats all its windows; a null doc_id is kept as it is; an empty table gives no rows.
Windows are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm import scan, tables
from lafzspark.llm.scratch import written

RANGE_HASHES = 1 << 21


def _pack(ids: pa.Array, texts: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([ids, texts], names=["doc_id", "text"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def _unpack(blob: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob))))


def _to_chunks(batch: pa.RecordBatch):
    texts = batch.column("text")
    rows = []
    for a, b, buf, offsets in scan.chunks(texts):
        starts, _, before = scan.spans(buf, offsets)
        rows.append((uuid.uuid4().hex, len(starts), _pack(batch.column("doc_id").slice(a, b - a), texts.slice(a, b - a))))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["chunk", "n_words", "blob"])


def _windows(batch: pa.RecordBatch, window: int, hasher: scan.Hasher):
    """Words before each document, each window's hash, and the first word of each (windows stay in one document)."""
    _, _, buf, offsets = next(scan.chunks(batch.column("text"), 1 << 62))
    starts, ends, before = scan.spans(buf, offsets)
    hashes = hasher.windows(hasher.words(buf, starts, ends), window)
    last = np.repeat(before[1:], np.diff(before))[: len(hashes)]  # the end of the document of each word
    at = np.flatnonzero(np.arange(len(hashes)) + window <= last)
    return before, hashes[at], at


def _send(window: int, bits: int):
    def run(batches):
        hasher = scan.Hasher()
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk"), batch.column("blob"), strict=True):
                _, hashes, _ = _windows(_unpack(blob.as_py()), window, hasher)
                found = np.unique(hashes)
                cut = np.searchsorted(found >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                low = np.ascontiguousarray(found.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :7]
                full = np.flatnonzero(np.diff(cut))
                packed = [low[cut[k] : cut[k + 1]].tobytes() for k in full.tolist()]
                if packed:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(full, pa.int32()), pa.array([chunk.as_py()] * len(packed)), pa.array(packed, pa.binary())],
                        names=["part", "chunk", "hashes"],
                    )

    return run


def _count(key, table):
    """Which of each chunk's hashes other chunks have too, as bits; chunks without any are left out."""
    rows = [np.frombuffer(x.as_py(), np.uint8).reshape(-1, 7) for x in table.column("hashes")]
    sizes = [len(x) for x in rows]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :7] = np.concatenate(rows)
    values = wide.view("<u8").ravel()
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(values), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    parts = np.split(hit, np.cumsum(sizes)[:-1])
    keep = [i for i, x in enumerate(parts) if x.any()]
    return pa.table(
        {
            "chunk": table.column("chunk").take(pa.array(keep, pa.int64())),
            "part": pa.array([key[0].as_py()] * len(keep), pa.int32()),
            "bits": pa.array([np.packbits(parts[i]).tobytes() for i in keep], pa.binary()),
        }
    )


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _finish(window: int, bits: int):
    def run(batches):
        hasher = scan.Hasher()
        for batch in batches:
            for blob, flags in zip(batch.column("blob"), batch.column("flags"), strict=True):
                docs = _unpack(blob.as_py())
                before, hashes, at = _windows(docs, window, hasher)
                found, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
                hit = times > 1
                cut = np.searchsorted(found >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                for x in flags.as_py() or ():
                    a, b = cut[x["part"]], cut[x["part"] + 1]
                    hit[a:b] |= np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
                edge = np.zeros(int(before[-1]) + window + 1, np.int32)
                starts = at[hit[back]]
                edge[starts] += 1
                edge[starts + window] -= 1
                covered = np.cumsum(edge) > 0
                spans, kept = [], []
                for i, text in enumerate(scan.as_bytes(docs.column("text")).to_pylist()):
                    words = (text or b"").split()
                    a, b = _intervals(covered[before[i] : before[i + 1]])
                    spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)])
                    for x, y in zip(a[::-1].tolist(), b[::-1].tolist(), strict=True):
                        del words[x:y]
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.column("doc_id"),
                        pa.array(np.diff(before), pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "removed", "kept_text"],
                )

    return run


def substring_dedup(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, removed (maximal intervals of word numbers, end exclusive), kept_text (words joined by a space)."""
    own = tables.id_text(docs, id_col, text_col)
    chunks = written(tables.map_arrow(own, _to_chunks, "chunk string, n_words long, blob binary"), "uncompressed")
    total = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    bits = max(8, math.ceil(math.log2(max(1, total) / RANGE_HASHES)))
    sent = chunks.select("chunk", "blob").mapInArrow(_send(window, bits), "part int, chunk string, hashes binary")
    flags = sent.groupBy("part").applyInArrow(_count, "chunk string, part int, bits binary")
    flags = flags.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias("flags"))
    out = tables.schema(own, "n_words long, removed array<struct<start:int,end:int>>, kept_text string")
    return chunks.select("chunk", "blob").join(flags, "chunk", "left").select("blob", "flags").mapInArrow(_finish(window, bits), out)


def op1(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM d, unnest(range(1, len(w) - 33)) AS t(i)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
cov AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN rep USING (h), unnest(range(0, 35)) AS t(k)),
word AS (SELECT doc_id, p, w[p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN cov USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
