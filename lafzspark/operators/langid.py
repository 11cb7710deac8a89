"""Language identification by character n-grams: training as counts, scoring as a join.

A text's score for a language is the sum over its grams of log((count + alpha) / (total + alpha * V)). Written as the
number of grams times the value of an unseen one, plus what the seen ones add, only grams that the model has need a row;
a document's partial sums combine in its own task, so the shuffle holds about one row a document.
"""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict, namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lafzspark.functions import text as T
from lafzspark.functions.guards import require_text
from lafzspark.resources import script as S

N_MAX, ALPHA, TOP = 6, 0.03, 180_000
MIN_CHARS = 20
#: A model of at most so many rows (about 100 bytes each) is broadcast.
BROADCAST_ROWS = 400_000

#: weights: gram and, for each language, what a gram adds to the value of an unseen one; unseen: that value by language;
#: distinctive: (lang, letters), few rows.
Model = namedtuple("Model", "n_max languages weights unseen distinctive")


def language_runs(t: Column) -> Column:
    """The runs of Perso-Arabic letters, one blank apart, composed and without presentation forms, else as written."""
    return F.array_join(F.regexp_extract_all(T.bound(T.bound(t, T.compose), T.expand_shapes), F.lit(S.LANGUAGE_RUN), F.lit(0)), " ")


def grams(runs: Column, n_max: int = N_MAX) -> Column:
    """All windows of 1 to n_max characters of the text between two blanks, but for longer ones of blanks alone."""
    padded = F.concat(F.lit(" "), runs, F.lit(" "))
    return F.filter(F.concat(*[T.windows(padded, n) for n in range(1, n_max + 1)]), lambda g: (F.length(g) == 1) | (F.trim(g) != ""))


def part_of(paragraph: Column) -> Column:
    """train, val or test (80, 15 and 5 in 100), by the first byte of the paragraph's SHA-256."""
    share = F.conv(F.left(F.sha2(paragraph, 256), F.lit(2)), 16, 10).cast("int") / 256
    return F.when(share < 0.80, "train").when(share < 0.95, "val").otherwise("test")


def _numbered(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys (below size) in order, and the place of each key among them."""
    if size > 1 << 22:
        return np.unique(keys, return_inverse=True)
    found = np.flatnonzero(np.bincount(keys, minlength=size))
    places = np.zeros(size, np.int32)
    places[found] = np.arange(len(found), dtype=np.int32)
    return found, places[keys]


def counted_grams(texts: list[str], n_max: int) -> Counter:
    """The grams() of all texts (without U+0000) with their counts: windows over one array of codes, as numbers to their alphabet's
    base, numbered anew for each length."""
    codes = np.frombuffer("\0".join(["", *(f" {t} " for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters, own = _numbered(codes, 0x110000)
    base, end, blank = len(letters), np.flatnonzero(letters == 0), np.flatnonzero(letters == 32)
    kinds, place, alive, empty = [chr(c) for c in letters.tolist()], own, own != end, own == blank
    out: Counter = Counter()
    for n in range(1, n_max + 1):
        if n > 1:
            ahead = own[n - 1 :]
            alive, empty = alive[:-1] & (ahead != end), empty[:-1] & (ahead == blank)
            found, place = _numbered(place[:-1].astype(np.int64) * base + ahead, len(kinds) * base)
            kinds = [kinds[k // base] + chr(letters[k % base]) for k in found.tolist()]
        n_of = np.bincount(place[alive & ~empty if n > 1 else alive], minlength=len(kinds)).tolist()
        out.update({g: k for g, k in zip(kinds, n_of, strict=True) if k})
    return out


def gram_counts(rows: DataFrame, n_max: int = N_MAX) -> DataFrame:
    """lang, gram, n over rows (lang, text) of 20 letters or more; each Arrow batch is counted as a whole, so a gram is no row before."""
    runs = rows.select("lang", language_runs(F.col("text")).alias("t")).where(F.length("t") >= MIN_CHARS)

    def run(batches):
        for batch in batches:
            of: dict = defaultdict(list)
            for lang, t in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strict=True):
                of[lang].append(t)
            for lang, texts in of.items():
                found = counted_grams(texts, n_max)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "gram", "n"])

    return runs.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, top: int = TOP) -> DataFrame:
    """The `top` most frequent grams of each language, ties by gram."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).drop("r")


def distinctive_letters(counts: DataFrame) -> DataFrame:
    """lang, letters (sorted): common (1 in 1000 letters) in one to three languages, and below 1 in 50,000 elsewhere."""
    own = counts.where((F.length("gram") == 1) & F.col("gram").rlike("[^ ]"))
    totals = own.groupBy("lang").agg(F.sum("n").alias("total"))
    share = own.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    users = share.groupBy("gram").agg(F.count_if(F.col("share") >= 1e-3).alias("users"), F.max(F.when(F.col("share") < 1e-3, F.col("share"))).alias("rest"))
    few = users.where("users BETWEEN 1 AND 3 AND coalesce(rest, 0) < 2e-5").select("gram")
    picked = share.where(F.col("share") >= 1e-3).join(few, "gram", "left_semi")
    return picked.groupBy("lang").agg(F.sort_array(F.collect_set("gram")).alias("letters"))


def fit(counts: DataFrame, n_max: int = N_MAX, alpha: float = ALPHA, top: int = TOP) -> Model:
    """A model from counts (lang, gram, n), which are made once: they are cached while the model is made, and its weights stay so.
    One row for each language comes to the driver."""
    counts = counts.persist()
    kept = most_frequent(counts, top).persist()
    totals = {r["lang"]: r["total"] for r in kept.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    wide = kept.groupBy("gram").pivot("lang", languages).agg(F.first("n"))
    added = [F.log((F.coalesce(F.col(f"`{c}`"), F.lit(0)) + alpha) / alpha).alias(c) for c in languages]
    size = kept.select("gram").distinct().count()
    unseen = {c: math.log(alpha) - math.log(totals[c] + alpha * size) for c in languages}
    weights = wide.select("gram", *added).persist()
    weights.count()
    own = [(r["lang"], r["letters"]) for r in distinctive_letters(counts).collect()]
    kept.unpersist()
    counts.unpersist()
    return Model(n_max, languages, weights, unseen, counts.sparkSession.createDataFrame(own, "lang string, letters array<string>"))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, language, name, margin, ranking (code and score, best first, ties by code), evidence, short.

    Texts without Perso-Arabic letters have no language, margin 0 and an empty ranking.
    """
    require_text(docs, text_col, "identify")
    rows = docs.select(F.col(id_col).alias("id"), language_runs(F.col(text_col)).alias("t"))
    usable = rows.where(F.col("t").rlike("[^ ]"))
    weights = F.broadcast(model.weights) if model.weights.count() <= BROADCAST_ROWS else model.weights
    seen = usable.select("id", F.length("t").alias("size"), F.explode(grams(F.col("t"), model.n_max)).alias("gram")).join(weights, "gram", "left")
    sums = seen.groupBy("id", "size").agg(F.count("*").alias("n"), *[F.coalesce(F.sum(f"`{c}`"), F.lit(0.0)).alias(f"s_{c}") for c in model.languages])
    score = [F.struct((-(F.col(f"s_{c}") + F.col("n") * model.unseen[c])).alias("minus"), F.lit(c).alias("code")) for c in model.languages]
    ranked = sums.select("id", "size", F.transform(F.sort_array(F.array(*score)), lambda x: F.struct(x["code"].alias("code"), (-x["minus"]).alias("score"))).alias("ranking"))
    own = F.from_json(F.lit(json.dumps({r["lang"]: r["letters"] for r in model.distinctive.collect()})), "map<string,array<string>>")  # a row for each language
    known = ranked.select(F.col("id").alias("k"), "ranking", F.round((F.col("ranking")[0]["score"] - F.get("ranking", F.lit(1))["score"]) / F.greatest("size", F.lit(1)), 4).alias("margin"))
    met = rows.join(known, F.col("id") == F.col("k"), "left")
    met = met.withColumn("language", F.get("ranking", F.lit(0))["code"])
    names = F.create_map(*[F.lit(x) for pair in S.LANGUAGES.items() for x in pair])
    evidence = F.map_filter(F.transform_values(own, lambda c, x: F.filter(x, lambda y: F.contains("t", y))), lambda c, x: F.size(x) > 0)
    return met.select(
        F.col("id").alias(id_col), "language", names[F.col("language")].alias("name"), F.coalesce("margin", F.lit(0.0)).alias("margin"),
        F.coalesce("ranking", F.array().cast("array<struct<code:string,score:double>>")).alias("ranking"), evidence.alias("evidence"),
        F.coalesce(F.length(F.regexp_replace("t", r"\P{L}", "")) < S.SHORT_TEXT, F.lit(True)).alias("short"),
    )
