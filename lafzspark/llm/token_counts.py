"""Token counts: tokens of each document under a given tokenizer, without ids of documents being made.

Method: pieces are counted once per distinct pre-token, joined to the per-document frequencies of pre-tokens, and
summed. A pre-token is a maximal run of characters outside ASCII white space: the tokenizer drops white space before
anything else, so its tokens never cross one, and a special string has none inside.

Plan. (1) Each task counts its pre-tokens in a table of bounded size, from which the rarest go when it is full; those
that it met twice or more are added up. The HOT_WORDS most frequent of HOT_BYTES at most (so HOT_WORDS * HOT_BYTES
bytes, whatever the corpus; the level comes from a histogram of counts) are encoded and broadcast. (2) Each task adds
up what the dictionary knows of a document; other pre-tokens go, with their frequency in the document, to the task of
their word, which encodes each distinct one once and multiplies. (3) Sums by document. What the dictionary holds
decides only where a pre-token is counted, never how. A pre-token too long for the dictionary may be in any number of
documents, so its rows are dealt to LONG tasks.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each for itself; an empty
table gives no rows.
"""

from __future__ import annotations

import os
from collections import Counter
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm import scan, tables
from lafzspark.llm.scratch import discard, partitions, written

HOT_WORDS = 1 << 18
HOT_BYTES = 64
HELD_WORDS = 1 << 19
LONG = 16
#: Shuffle partitions for each task of words: a document gets a row back from each task that holds a word of it.
SHARE = 8
#: Rows of an Arrow batch.
TEXTS = 1 << 12


def _frequencies(batches):
    """Pre-tokens of HOT_BYTES at most that this task met twice or more; when HELD_WORDS are held, the rarer half goes."""
    held: Counter = Counter()
    for batch in batches:
        for _, _, buf, _ in _rows(batch.column("text")):
            held.update(w for w in buf.split() if len(w) <= HOT_BYTES)
            if len(held) >= HELD_WORDS:
                held = Counter(dict(held.most_common(HELD_WORDS // 2)))
    often = ((w, n) for w, n in held.items() if n > 1)
    while part := list(islice(often, 1 << 14)):
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])
    held.clear()
    scan.give_back()


def _rows(column):
    for i, text in enumerate(scan.as_bytes(column)):
        yield i, i + 1, text.as_py() or b"", None


def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; each thread would hold memory of its own
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def pieces(words: list[bytes]) -> list[int]:
        out: list[int] = []
        for a in range(0, len(words), 4096):
            out += [len(x) for x in tokenizer.encode_batch_fast([w.decode() for w in words[a : a + 4096]], add_special_tokens=False)]
        return out

    return pieces


def _encode(path: str):
    def run(batches):
        pieces = _tokenizer(path)
        for batch in batches:
            words = batch.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array(pieces(words.to_pylist()), pa.int64())], names=["word", "pieces"])
        del pieces
        scan.give_back()

    return run


PARTS = "text_hash long, n_bytes long, word binary, n long, rows long"


def _sum(hot):
    """A document's tokens that the dictionary knows (word null, rows 1), and a row for each other word (rows 0)."""

    def run(batches):
        known = hot.value
        for batch in batches:
            for a, b in scan.slices(np.full(len(batch), 1), 512):
                part = batch.slice(a, b - a)
                at, words, values = [], [], []
                for i, text in enumerate(scan.as_bytes(part.column("text")).to_pylist()):
                    found = 0
                    for word, n in Counter((text or b"").split()).items():
                        pieces = known.get(word)
                        if pieces is None:
                            at.append(i)
                            words.append(word)
                            values.append(n)
                        else:
                            found += n * pieces
                    at.append(i)
                    words.append(None)
                    values.append(found)
                at, word = pa.array(at, pa.int64()), pa.array(words, pa.binary())
                size = part.column("n_bytes").take(pc.if_else(word.is_null(), at, None))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("text_hash").take(at), size, word, pa.array(values, pa.int64()), word.is_null().cast(pa.int64())], names=["doc_id", *(c.split()[0] for c in PARTS.split(", "))])
        scan.give_back()

    return run


def _multiply(path: str):
    """Rows of words become tokens; a task encodes a word once, or again only after HELD_WORDS others."""

    def run(batches):
        pieces, held = _tokenizer(path), {}
        for batch in batches:
            coded = batch.column("word").dictionary_encode()
            words = coded.dictionary.to_pylist()
            if len(held) > HELD_WORDS:
                held.clear()
            new = [w for w in words if w not in held]
            held.update(zip(new, pieces(new), strict=True))
            each = np.array([*(held[w] for w in words), 1], np.int64)  # a null word's row holds tokens already
            n = batch.column("n").to_numpy() * each[coded.indices.fill_null(len(words)).to_numpy(zero_copy_only=False)]
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "n" else pa.array(n) for c in ("doc_id", "text_hash", "n_bytes", "n", "rows")], names=["doc_id", "text_hash", "n_bytes", "n", "rows"])
        del pieces
        scan.give_back()

    return run


def frequent(words: DataFrame, most: int) -> DataFrame:
    """Words (word, n) of the lowest level, an eighth of a doubling wide, above which there are `most` at most."""
    level = F.floor(8 * F.log2(F.col("n").cast("double")))
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in levels:
        total += r["words"]
        if total > most:
            break
        least = r["level"]
    return words.where(level >= least) if least is not None else words.limit(0)


def token_counts(
    docs: DataFrame, tokenizer_path: str, hot_words: int = HOT_WORDS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens. tokenizer_path: a tokenizer.json that every executor can read."""
    own = tables.id_text(docs, id_col, text_col)
    words = own.select("text").mapInArrow(_frequencies, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = written(words, batch_rows=TEXTS)
    top = frequent(words, hot_words).select("word").mapInArrow(_encode(tokenizer_path), "word binary, pieces long")
    hot = docs.sparkSession.sparkContext.broadcast({bytes(r["word"]): r["pieces"] for r in top.collect()})
    discard(words)
    # A document's rows meet again by doc_id and content, so rows with one doc_id and different texts stay apart.
    keyed = own.select("doc_id", F.xxhash64("text").alias("text_hash"), tables.utf8_size(F.col("text")).alias("n_bytes"), "text")
    parts = keyed.mapInArrow(_sum(hot), tables.schema(own, PARTS))
    place = F.when(F.col("word").isNull(), F.col("text_hash")).when(F.length("word") > HOT_BYTES, F.pmod("text_hash", F.lit(LONG))).otherwise(0)
    dealt = parts.repartition(max(2, partitions(docs.sparkSession) // SHARE), "word", place)
    counted = dealt.mapInArrow(_multiply(tokenizer_path), tables.schema(own, "text_hash long, n_bytes long, n long, rows long"))
    total = written(counted.groupBy("doc_id", "text_hash").agg(F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n"), F.sum("rows").alias("rows")), batch_rows=TEXTS)
    # Exact repeats of a row share a group; each is given back, with its share of the sum.
    each = total.select("doc_id", "n_bytes", (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return each.select("doc_id", "n_bytes", "n_tokens")


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)
