"""Relations over a corpus: bigrams, census, fingerprints, held-out sentences, audits of letters and duplicates, filters.

Rows are exploded, combined in each task and shuffled as counts. Where something is drawn or sampled, it follows from
hashes of the rows or from ranks over ranges of the order, so runs agree and no window holds a whole table.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lafzspark.functions import plain
from lafzspark.functions import text as T
from lafzspark.resources import script as S

START, UNKNOWN = "<s>", "<unk>"
MARKUP = ("{{", "}}", "[[", "]]", "<", ">", "http", "|", "=")


def is_urdu_word(w: Column) -> Column:
    """All letters, all in the blocks that hold Urdu."""
    return w.rlike(rf"^[\p{{L}}&&[{S.URDU_BLOCKS}]]+\z")


#: Different keys that a task counts before it hands them on.
HELD = 300_000
AROUND = ".,;:!?\"'()"
#: Different pairs of words, or pieces between blanks, that a task holds as numbers before it hands the counts on.
HELD_PAIRS = 4_000_000


def counted(batches: Iterator[pa.RecordBatch], keys: Callable[[str], Iterable], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counts of the keys (a string, or a tuple of them) of each batch's first column, added up within a task up to HELD keys."""
    held: Counter = Counter()

    def rows() -> pa.RecordBatch:
        columns = [list(held)] if len(names) == 2 else list(zip(*held, strict=True)) or [()] * (len(names) - 1)
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(held.values()), pa.int64())], names=names)

    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                held.update(keys(text.as_py()))
                if len(held) > HELD:
                    yield rows()
                    held.clear()
    yield rows()


class _Pieces(dict):
    """What stands between blanks, by its place in a list of tokens: normalising and tokens never reach over a blank or the end of a
    line, so each different piece is normalised once."""

    def __init__(self, behind: Collection[str] | None) -> None:
        super().__init__({"\n": 0})
        self.words, self.ids, self.behind = [START, UNKNOWN], {}, behind
        self.codes, self.start, self.counts_behind = array("q", [0]), array("q", [0, 1]), bytearray([1, 1])

    def __missing__(self, piece: str) -> int:
        inner = piece.strip(AROUND)
        if inner != piece and inner.isalpha() and not inner.startswith(("http", "www")):  # marks around letters are no part of a token
            self[piece] = self[inner]
            return self[piece]
        for w in plain.words(piece):
            if plain.is_urdu_word(w):
                if w not in self.ids:
                    self.ids[w] = len(self.words)
                    self.words.append(w)
                    self.counts_behind.append(self.behind is None or w in self.behind)
                self.codes.append(self.ids[w])
            else:
                self.codes.append(1)
        self.start.append(len(self.codes))
        self[piece] = len(self.start) - 2
        return self[piece]

    def pairs(self, texts: list[str]) -> np.ndarray:
        """Each Urdu word and what stands before it, as one number."""
        pieces = "\n".join(texts).replace("\n", " \n ").split(" ")
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        start = np.array(self.start)
        size = (start[1:] - start[:-1])[at]
        places = np.repeat(start[at] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        tokens = np.concatenate([[0], np.array(self.codes)[places]])
        before, word = tokens[:-1], tokens[1:]
        kept = (word > 1) & np.frombuffer(bytes(self.counts_behind), bool)[before]
        return before[kept] << 32 | word[kept]

    def rows(self, pairs: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words = pa.array(self.words, pa.string())
        for i in range(0, len(pairs), 1 << 16):
            own = pairs[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([words.take(pa.array(own >> 32)), words.take(pa.array(own & 0xFFFFFFFF)), pa.array(counts[i : i + (1 << 16)])], names=["prev", "word", "n"])


def counted_neighbours(batches: Iterator[pa.RecordBatch], behind: Collection[str] | None = None) -> Iterator[pa.RecordBatch]:
    """prev, word, n of the Urdu words in each batch's first column, added up within a task up to HELD_PAIRS; behind: as in bigrams."""
    pieces, held, counts = _Pieces(behind), np.zeros(0, np.int64), np.zeros(0, np.int64)
    waiting: list[np.ndarray] = []

    def added() -> tuple[np.ndarray, np.ndarray]:
        new, n = np.unique(np.concatenate([*waiting, np.zeros(0, np.int64)]), return_counts=True)
        waiting.clear()
        keys, n = np.concatenate([held, new]), np.concatenate([counts, n])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(keys) else n

    def read() -> Iterator[list[str]]:
        some, size = [], 0
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    some.append(text.as_py())
                    size += len(some[-1])
                    if size > 1 << 21:
                        yield some
                        some, size = [], 0
        if some:
            yield some

    for texts in read():
        waiting.append(pieces.pairs(texts))
        if sum(map(len, waiting)) > HELD_PAIRS or len(pieces) > HELD_PAIRS:
            held, counts = added()
            if len(held) > HELD_PAIRS or len(pieces) > HELD_PAIRS:
                yield from pieces.rows(held, counts)
                pieces, held, counts = _Pieces(behind), held[:0], counts[:0]
    yield from pieces.rows(*added())


def bigrams(docs: DataFrame, words: DataFrame, least: int = 3, text_col: str = "text", behind: Collection[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(prev, word, n) seen `least` times or more between words of `words`, and (prev, total, types) before that cut.

    A line begins with <s>; behind a token that is no Urdu word stands <unk>, and the token itself isn't counted. behind: the words of
    `words`, if they may be broadcast; contexts are then only those and <s> and <unk>, and what stands behind others isn't shuffled.
    """
    shared = None if behind is None else docs.sparkSession.sparkContext.broadcast(frozenset(behind))
    found = docs.select(text_col).mapInArrow(lambda batches: counted_neighbours(batches, shared and shared.value), "prev string, word string, n long")
    # with these tests and without semi-joins nothing is pushed below the counts, so a plan with both results shuffles them once
    counts = found.where("prev IS NOT NULL AND word IS NOT NULL").groupBy("prev", "word").agg(F.sum("n").alias("n"))
    contexts = counts.groupBy("prev").agg(F.sum("n").alias("total"), F.count("*").alias("types"))
    known = words.select("word").distinct()
    ends = known.union(docs.sparkSession.sql(f"SELECT * FROM VALUES ('{START}'), ('{UNKNOWN}') AS t(word)")).distinct()
    kept = counts.where(F.col("n") >= least).join(known, "word").join(ends.withColumnRenamed("word", "prev"), "prev")
    return kept.select("prev", "word", "n"), contexts


def raw_tokens(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """raw, norm, n: each distinct token between blanks, its normalised form and its count; normalised once a spelling."""
    tokens = docs.select(F.explode(F.filter(F.split(text_col, f"[{S.BLANK}]+"), lambda w: w != "")).alias("raw"))
    return tokens.groupBy("raw").agg(F.count("*").alias("n")).withColumn("norm", T.normalize(F.col("raw")))


def census(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of totals: documents, characters, raw tokens, those that normalising changes, types, types of several raw
    spellings, tokens that would move to their type's commonest spelling, tokens, and those that are stopwords."""
    size = docs.agg(F.count("*").alias("documents"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("characters"))
    raw = raw_tokens(docs, text_col)
    types = raw.groupBy("norm").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("spellings"), F.sum(F.when(F.col("raw") != F.col("norm"), F.col("n")).otherwise(0)).alias("changed"))
    total = types.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("raw_tokens"), F.coalesce(F.sum("changed"), F.lit(0)).alias("changed_tokens"), F.count("*").alias("types"),
        F.count_if(F.col("spellings") > 1).alias("types_of_several_spellings"), F.coalesce(F.sum(F.col("n") - F.col("top")), F.lit(0)).alias("moved_tokens"),
    )
    tokens = docs.select(F.explode(T.words(F.col(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    stops = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.when(T.is_stopword(F.col("w"), normalized=True), F.col("n")).otherwise(0)), F.lit(0)).alias("stopwords"))
    return size.crossJoin(total).crossJoin(stops)  # rows of one each


def fingerprint(rows: DataFrame, by: str, line: Column) -> DataFrame:
    """by, lines, chars, digest: the same for the same lines in any order.

    Digests of lines are sorted within each of 4096 ranges and hashed, and so are the ranges' hashes: no task holds a corpus.
    """
    hashed = rows.select(by, line.alias("line")).where("line IS NOT NULL").select(by, F.length("line").alias("chars"), F.sha2("line", 256).alias("h"))
    equal = hashed.groupBy(by, "h").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    part = F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" ", "h", "n"))), "\n"), 256).alias("d")
    ranges = equal.groupBy(by, F.left("h", F.lit(3)).alias("r")).agg(part, F.sum("n").alias("lines"), F.sum("chars").alias("chars"))
    whole = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "d"))), lambda x: x["d"]), "\n"), 256)
    return ranges.groupBy(by).agg(F.sum("lines").alias("lines"), F.sum("chars").alias("chars"), whole.alias("digest"))


def _sentences(docs: DataFrame, text_col: str, least: int) -> DataFrame:
    split = docs.select(F.explode(F.split(text_col, rf"(?<=[{S.SENTENCE_ENDS}])[{S.BLANK}]+")).alias("s"))
    plain = split.select(T.strip(F.regexp_replace("s", f"[{S.BLANK}]+", " ")).alias("sentence"))
    return plain.where(F.size(F.split("sentence", " ")) >= least).distinct()


def held_out_sentences(train: DataFrame, held: DataFrame, text_col: str = "text", least: int = 5) -> DataFrame:
    """sentence, part: distinct sentences of `least` words or more of train, and those of held that train hasn't, as val or
    test by the parity of the first byte of their SHA-256."""
    own, other = _sentences(train, text_col, least), _sentences(held, text_col, least)
    even = F.conv(F.substring(F.sha2("sentence", 256), 2, 1), 16, 10).cast("int") % 2 == 0
    fresh = other.join(own, "sentence", "left_anti").withColumn("part", F.when(even, "val").otherwise("test"))
    return own.withColumn("part", F.lit("train")).union(fresh)


def every_kth(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most `most` rows, evenly spread over the order of a unique column: those at floor(i * rows / most)."""
    total = rows.count()
    if total <= most:
        return rows
    at = _placed(rows, order)
    step = total / most
    first = F.floor(F.ceil(F.col("_at") / F.lit(step)) * F.lit(step))
    return at.where((first == F.col("_at")) & (F.ceil(F.col("_at") / F.lit(step)) < most)).drop("_at")


def _placed(rows: DataFrame, order: str) -> DataFrame:
    """rows with _at, their place (from 0) in the order of a column, by ranks over 1,024 ranges of its values."""
    cuts = rows.select(F.percentile_approx(order, [i / 1024 for i in range(1, 1024)], 10000).alias("c")).first()["c"] or []
    range_ = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast(f"array<{rows.schema[order].dataType.simpleString()}>"), lambda c: c < F.col(order))) if cuts else F.lit(0)
    own = rows.withColumn("_range", range_)
    counts = own.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    firsts = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    met = own.join(F.broadcast(firsts), "_range")
    return met.withColumn("_at", F.col("_first") + F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1).drop("_range", "_first")


def audit_line(t: Column) -> Column:
    """A line as the audit compares it: composed, without tatweel and combining marks, blanks one space."""
    plain = F.regexp_replace(T.bound(t, T.compose), rf"{S.TATWEEL}|\p{{M}}", "")
    return T.strip(F.regexp_replace(plain, f"[{S.BLANK}]+", " "))


def cross_label_duplicates(rows: DataFrame, label: str, text_col: str, least: int = 24) -> DataFrame:
    """key, labels, n of lines of `least` characters or more that stand under several labels; join_back finds their rows."""
    lines = rows.select(F.col(label).alias("label"), audit_line(F.col(text_col)).alias("line")).where(F.length("line") >= least)
    counts = lines.groupBy(F.md5("line").alias("key"), "label").agg(F.count("*").alias("n"))
    return counts.groupBy("key").agg(F.sort_array(F.collect_list("label")).alias("labels"), F.sum("n").alias("n")).where(F.size("labels") > 1)


def join_back(rows: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """The rows whose line is one of `found`."""
    return rows.withColumn("key", F.md5(audit_line(F.col(text_col)))).join(found.select("key", "labels"), "key")


def letter_shares(lines: DataFrame, lang: str, text_col: str) -> DataFrame:
    """lang, letter, share of the language's lines that have the letter."""
    own = lines.select(F.col(lang).alias("lang"), T.strip(T.bound(F.col(text_col), T.compose)).alias("line")).where("line <> ''")
    totals = own.groupBy("lang").agg(F.count("*").alias("lines"))
    letters = own.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"\p{L}"), F.lit(0)))).alias("letter")).groupBy("lang", "letter").agg(F.count("*").alias("n"))
    return letters.join(F.broadcast(totals), "lang").select("lang", "letter", (F.col("n") / F.col("lines")).alias("share"))


def own_letters(shares: DataFrame, least: float = 0.02, elsewhere: float = 0.001) -> DataFrame:
    """lang, letter, share: in this share of the language's lines at least, and in at most `elsewhere` of any other's."""
    tops = shares.groupBy("letter").agg(F.sort_array(F.collect_list("share"), False).alias("s"))  # a share for each language
    met = shares.where(F.col("share") >= least).join(tops, "letter")
    return met.where(F.coalesce(F.get("s", F.lit(1)), F.lit(0.0)) <= elsewhere).select("lang", "letter", "share")


def usable(t: Column, least: int = 40, share: float = 0.6) -> Column:
    """Long enough, without markup, and mostly in Perso-Arabic letters."""
    marked = F.lit(False)
    for m in MARKUP:
        marked = marked | F.contains(t, F.lit(m))
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    own = F.length(F.regexp_replace(t, r"[^؀-ۿݐ-ݿ]", ""))
    return F.when(t.isNotNull(), (F.length(t) >= least) & ~marked & (letters > 0) & F.coalesce(F.try_divide(own, letters) >= share, F.lit(False)))


def segments(docs: DataFrame, text_col: str = "text", least: int = 40) -> DataFrame:
    """Distinct usable sentences of texts."""
    split = docs.select(F.explode(F.split(text_col, rf"(?<=[{S.SENTENCE_ENDS}])[{S.BLANK}]+")).alias("s"))
    return split.select(T.strip(F.regexp_replace("s", f"[{S.BLANK}]+", " ")).alias("line")).where(usable(F.col("line"), least)).distinct()


def shuffled_lines(words: DataFrame, lines: int, seed: int, shortest: int = 3, longest: int = 12) -> DataFrame:
    """id, line: synthetic lines of words drawn by their counts (word, n). Each draw is a hash of seed, line and place, met with
    the words' cumulative counts by a range join over 1,024 slots of the total."""
    ranked = _cumulated(words)
    total = words.agg(F.sum("n")).first()[0] or 0
    draw = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(max(1, total)))
    size = F.lit(shortest) + F.pmod(F.xxhash64(F.lit(seed), F.lit("size"), "id"), F.lit(longest - shortest + 1))
    slots = words.sparkSession.range(lines).withColumn("pos", F.explode(F.sequence(F.lit(1).cast("long"), size)))
    slots = slots.withColumn("at", draw("id", "pos"))
    width = max(1, -(-total // 1024))
    spread = ranked.withColumn("slot", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))))
    met = slots.withColumn("slot", F.floor(F.col("at") / width)).join(spread, "slot").where("at >= low AND at < high")
    return met.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("line"))


def _cumulated(words: DataFrame) -> DataFrame:
    """word, low, high: the words' counts laid end to end in the order of the words' hashes, by 256 ranges."""
    own = words.select("word", "n", F.md5("word").alias("h")).withColumn("r", F.left("h", F.lit(2)))
    firsts = own.groupBy("r").agg(F.sum("n").alias("s"))
    firsts = firsts.select("r", F.coalesce(F.sum("s").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    high = F.col("first") + F.sum("n").over(Window.partitionBy("r").orderBy("h", "word"))
    return own.join(F.broadcast(firsts), "r").withColumn("high", high).select("word", (F.col("high") - F.col("n")).alias("low"), "high")


def noisy(t: Column, seed: int, rate: float = 0.05) -> Column:
    """Each letter is dropped or doubled with this chance, by hashes of seed, text and place."""
    def step(c: Column, i: Column) -> Column:
        u = F.pmod(F.xxhash64(F.lit(seed), t, i), F.lit(1_000_000)) / 1_000_000.0
        return F.when(~c.rlike(r"\p{L}"), c).when(u < rate / 2, F.lit("")).when(u < rate, F.concat(c, c)).otherwise(c)

    return F.array_join(F.transform(F.split(t, ""), step), "")


def splice(urdu: Column, english: Column, key: Column, most: int = 3) -> Column:
    """tokens and tags of a text into which 1 to `most` words of another are put at one place, by a hash of key."""
    draw = lambda salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30))
    own, other = F.filter(F.split(urdu, " "), lambda w: w != ""), F.filter(F.split(english, " "), lambda w: w != "")
    count = F.least(F.lit(most), (draw("count") % most + 1).cast("int"), F.size(other))
    at = (draw("at") % (F.size(own) + 1)).cast("int")
    some = F.slice(other, (draw("from") % F.greatest(F.size(other) - count + 1, F.lit(1)) + 1).cast("int"), F.greatest(count, F.lit(0)))
    tagged = lambda words, tag: F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(tag).alias("tag")))
    left, right = F.slice(own, F.lit(1), at), F.slice(own, at + 1, F.size(own))
    return F.concat(tagged(left, "ur"), tagged(some, "en"), tagged(right, "ur"))


def label_map(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """said, label: another classifier's label by itself where we have it, else by the commonest truth of its rows (said, truth),
    ties by the label."""
    counts = pairs.groupBy("said", "truth").agg(F.count("*").alias("n"))
    best = counts.groupBy("said").agg(F.min(F.struct((-F.col("n")).alias("m"), "truth"))["truth"].alias("common"))
    return best.select("said", F.when(F.col("said").isin(labels), F.col("said")).otherwise(F.col("common")).alias("label"))


def chained_lines(pairs: DataFrame, lines: int, seed: int, longest: int = 12) -> DataFrame:
    """id, line: chains of words, each drawn by the counts of what follows the one before it (prev, word, n), from <s> on; a
    chain ends where nothing follows. One step for all lines is a join of the lines with the followers' cumulated counts."""
    order = Window.partitionBy("prev").orderBy("h", "word")
    laid = pairs.withColumn("h", F.md5("word")).withColumn("high", F.sum("n").over(order))  # a word's followers
    laid = laid.select(F.col("prev").alias("p"), "word", (F.col("high") - F.col("n")).alias("low"), "high", F.sum("n").over(Window.partitionBy("prev")).alias("total"))
    now = pairs.sparkSession.range(lines).select("id", F.lit(START).alias("last"), F.array().cast("array<string>").alias("words"))
    for step in range(longest):
        met = now.join(laid, F.col("last") == F.col("p"), "left").withColumn("at", F.pmod(F.xxhash64(F.lit(seed), F.lit(step), "id"), F.coalesce("total", F.lit(1))))
        kept = met.where("p IS NULL OR (at >= low AND at < high)")
        now = kept.select("id", F.coalesce("word", F.lit("")).alias("last"), F.when(F.col("word").isNull(), F.col("words")).otherwise(F.concat("words", F.array("word"))).alias("words"))
    return now.select("id", F.array_join("words", " ").alias("line")).where("line <> ''")


def inputs_digest(settings: dict, tables: dict[str, DataFrame]) -> str:
    """A digest of what a model is made of: settings by name, and the fingerprint of each table's rows in any order."""
    parts = [f"{k}={settings[k]!r}" for k in sorted(settings)]
    for name in sorted(tables):
        row = F.to_json(F.struct(*sorted(tables[name].columns)))
        found = fingerprint(tables[name].select(F.lit(name).alias("name"), row.alias("line")), "name", F.col("line")).first()
        parts.append(f"{name}:{found['digest'] if found else ''}")
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:32]
