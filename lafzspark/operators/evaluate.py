"""Measures of classifiers: calibration, other priors, paired tests, and splits by source.

Each reads its rows once and shuffles counts; only tables of bins, of labels or of hash ranges meet in one place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def calibration_bins(rows: DataFrame, confidence: Column, correct: Column, bins: int = 15) -> DataFrame:
    """bin (from 1, upper edges belong to it), n, hits, confidence (mean), gap (of accuracy and confidence).

    Rows with a null or NaN in either take no part; confidences at or below 0 fall into the first bin.
    """
    own = rows.select(confidence.cast("double").alias("c"), correct.cast("boolean").alias("hit")).where("c IS NOT NULL AND NOT isnan(c) AND hit IS NOT NULL")
    binned = own.withColumn("bin", F.least(F.greatest(F.ceil(F.col("c") * bins), F.lit(1)), F.lit(bins)).cast("long"))
    sums = binned.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), (F.sum("c") / F.count("*")).alias("mean"))
    return sums.select("bin", "n", "hits", F.round("mean", 6).alias("confidence"), F.round(F.abs(F.col("hits") / F.col("n") - F.col("mean")), 6).alias("gap"))


def calibration_errors(bins: DataFrame) -> DataFrame:
    """One row: ece (gaps weighted by their rows) and mce (the widest gap); nulls without rows."""
    return bins.agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))


def prior_shift(confusion: DataFrame, prior: DataFrame) -> DataFrame:
    """label, share, precision, recall, f1 of a confusion (truth, pred, n) if labels had the shares of prior (label, weight).

    Recall stays: each truth's cells are scaled to its share. Labels are those of the truths that prior has; its weights
    are scaled to sum to 1. Precision is null for a label that nothing is taken for, recall for one without rows; f1 is 0 then.
    """
    cells = confusion.groupBy("truth", "pred").agg(F.sum("n").alias("n"))
    truths = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("seen")).join(prior.select("label", F.col("weight").cast("double")), "label")
    shares = truths.select("label", "seen", (F.col("weight") / F.sum("weight").over(Window.partitionBy(F.lit(0)))).alias("share"))  # a row for each label
    joint = cells.join(shares.withColumnRenamed("label", "truth"), "truth").withColumn("mass", F.when(F.col("seen") > 0, F.col("share") * F.col("n") / F.col("seen")).otherwise(0.0))
    said = joint.groupBy(F.col("pred").alias("label")).agg(F.sum("mass").alias("said"), F.sum(F.when(F.col("pred") == F.col("truth"), F.col("mass")).otherwise(0.0)).alias("tp"))
    both = shares.join(said, "label", "left").na.fill(0.0, ["said", "tp"])
    precision = F.when(F.col("said") > 0, F.col("tp") / F.col("said"))
    recall = F.when((F.col("seen") > 0) & (F.col("share") > 0), F.col("tp") / F.col("share"))
    f1 = F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return both.select("label", F.round("share", 6).alias("share"), F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def log10_sign_test(a: int, b: int) -> float:
    """log10 of the two-sided exact probability that a fair coin splits a + b as unevenly, 0 at most.

    Terms fall from the middle outwards by k / (n - k + 1), so the sum ends when they no longer count.
    """
    n, k = a + b, min(a, b)
    head = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)) / math.log(10) - n * math.log10(2)
    total, term = 1.0, 1.0
    while k and term > 1e-17 * total:
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return min(0.0, head + math.log10(total) + math.log10(2))


def paired_test(rows: DataFrame, a_right: Column, b_right: Column) -> DataFrame:
    """One row: a_only, b_only, log10_p of the exact McNemar test. Rows with a null take no part."""
    counted = rows.agg(F.count_if(a_right & ~b_right).alias("a"), F.count_if(~a_right & b_right).alias("b")).first()
    found = (counted["a"], counted["b"], round(log10_sign_test(counted["a"], counted["b"]), 2) + 0.0)
    return rows.sparkSession.createDataFrame([found], "a_only long, b_only long, log10_p double")


def split_by_source(rows: DataFrame, by: list[str], id_col: str, seed: str, train: float = 0.8, val: float = 0.1) -> DataFrame:
    """rows with part: train, val or test, in these shares (rounded down) of each group of by, null one of its values.

    The order in a group is by md5 of seed, group and id, then id; rows that repeat an id stand in any order. Groups
    are cut into 4096 hash ranges, so a window never holds a whole group: a row's rank is its range's first plus its own.
    """
    key = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by], F.col(id_col).cast("string")))
    own = rows.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    ranges = own.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    firsts = ranges.select(*by, "_range", (F.sum("_n").over(before) - F.col("_n")).alias("_first"), F.sum("_n").over(group).alias("_all"))
    names = {c: f"_by{i}" for i, c in enumerate([*by, "_range"])}
    firsts = firsts.select(*[F.col(c).alias(n) for c, n in names.items()], "_first", "_all")
    met = own.join(firsts, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()], "left")
    rank = F.col("_first") + F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_key", id_col))
    n_train, n_val = F.floor(F.col("_all") * train), F.floor(F.col("_all") * val)
    part = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return met.withColumn("_rank", rank).select(*rows.columns, part.alias("part"))


def wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    """rate, lo and hi of a share; NULL without rows."""
    p, d = hits / n, 1 + z * z / n
    centre, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    bounds = (F.round(p, 4).alias("rate"), F.round(F.greatest(F.lit(0.0), centre - half), 4).alias("lo"), F.round(F.least(F.lit(1.0), centre + half), 4).alias("hi"))
    return F.when(n > 0, F.struct(*bounds))


def classes(cells: DataFrame) -> DataFrame:
    """label, support, precision, recall, f1 of a confusion (truth, pred, n); a measure without rows is NULL."""
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("seen"), F.lit(0).cast("long").alias("said"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("seen"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")),
    )))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("seen", "said", "hit")])
    p, r = F.try_divide("hit", "said"), F.try_divide("hit", "seen")
    return sums.select("label", F.col("seen").alias("support"), p.alias("precision"), r.alias("recall"), F.try_divide(2 * F.col("hit"), F.col("seen") + F.col("said")).alias("f1"))


def averages(by_class: DataFrame) -> DataFrame:
    """One row: macro_f1 (of classes that have rows), micro_f1 and classes."""
    hit = F.sum(F.coalesce(F.col("recall"), F.lit(0.0)) * F.col("support"))
    return by_class.agg(F.round(F.avg(F.when(F.col("support") > 0, F.col("f1"))), 6).alias("macro_f1"), F.round(hit / F.sum("support"), 6).alias("micro_f1"), F.count_if(F.col("support") > 0).alias("classes"))


def confusion(pairs: DataFrame, labels: list) -> DataFrame:
    """truth and a column of counts for each label."""
    return pairs.groupBy("truth").pivot("pred", labels).agg(F.count(F.lit(1))).na.fill(0)


BANDS = (0.0, 0.02, 0.05, 0.1, 99.0)


def bands(rows: DataFrame, margin: Column, right: Column, edges: tuple[float, ...] = BANDS) -> DataFrame:
    """band (its lower edge), n, accuracy; margins outside of all bands take no part."""
    low = F.lit(None).cast("double")
    for a, b in zip(edges, edges[1:], strict=False):
        low = F.when((margin >= a) & (margin < b), F.lit(a)).otherwise(low)
    own = rows.select(low.alias("band"), right.alias("ok")).where("band IS NOT NULL AND ok IS NOT NULL")
    return own.groupBy("band").agg(F.count("*").alias("n"), F.round(F.count_if("ok") / F.count("*"), 4).alias("accuracy"))


def _ranked(rows: DataFrame, margin: Column, right: Column) -> DataFrame:
    """margin, ok and the row's place (from 0) by margin, wrong ones first; equal rows are counted together before a window sees them."""
    own = rows.select(margin.alias("m"), right.alias("ok")).where("m IS NOT NULL AND ok IS NOT NULL").groupBy("m", "ok").agg(F.count("*").alias("c"))
    cuts = own.select(F.percentile_approx("m", [i / 256 for i in range(1, 256)], 10000).alias("c")).first()["c"] or []
    own = own.withColumn("r", F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col("m"))))
    sums = own.groupBy("r").agg(F.sum("c").alias("s"))
    firsts = sums.select("r", F.coalesce(F.sum("s").over(Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"), F.sum("s").over(Window.partitionBy(F.lit(0))).alias("all"))
    met = own.join(F.broadcast(firsts), "r")
    return met.withColumn("end", F.col("first") + F.sum("c").over(Window.partitionBy("r").orderBy("m", "ok"))).select("m", "ok", "c", (F.col("end") - F.col("c")).alias("start"), "end", "all")


def deciles(rows: DataFrame, margin: Column, right: Column) -> DataFrame:
    """decile, margin_from, margin_to, n, accuracy, errors: tenths of the rows by margin, cut at i * rows // 10."""
    own = _ranked(rows, margin, right).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9))))
    low, high = F.floor(F.col("i") * F.col("all") / 10), F.floor((F.col("i") + 1) * F.col("all") / 10)
    inside = own.withColumn("x", F.least("end", high) - F.greatest("start", low)).where("x > 0")
    sums = inside.groupBy("i").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.sum("x").alias("n"), F.sum(F.when(~F.col("ok"), F.col("x")).otherwise(0)).alias("errors"))
    return sums.select((F.col("i") + 1).cast("long").alias("decile"), F.round("a", 4).alias("margin_from"), F.round("b", 4).alias("margin_to"), "n", F.round(1 - F.col("errors") / F.col("n"), 4).alias("accuracy"), "errors")


KEEP = (0.5, 0.75, 0.9, 0.95, 0.99)


def retention(rows: DataFrame, margin: Column, right: Column, keep: tuple[float, ...] = KEEP) -> DataFrame:
    """keep, n, accuracy, errors_kept, errors_total: what is left when only this share of the highest margins is kept."""
    own = _ranked(rows, margin, right).withColumn("keep", F.explode(F.array(*[F.lit(k) for k in keep])))
    kept = F.greatest(F.col("end") - F.greatest(F.col("start"), F.floor(F.col("all") * (1 - F.col("keep")))), F.lit(0))
    sums = own.withColumn("x", kept).groupBy("keep").agg(F.sum("x").alias("n"), F.sum(F.when(~F.col("ok"), F.col("x")).otherwise(0)).alias("errors_kept"), F.sum(F.when(~F.col("ok"), F.col("c")).otherwise(0)).alias("errors_total"))
    return sums.select("keep", "n", F.round(1 - F.col("errors_kept") / F.col("n"), 4).alias("accuracy"), "errors_kept", "errors_total")


def bootstrap(rows: DataFrame, value: Column, draws: int = 1000, level: float = 0.95, seed: int = 0, key: str | None = None) -> DataFrame:
    """One row: mean, lo, hi by a Poisson bootstrap: a row's weight in a draw is a hash of seed, draw and its key, so no row moves
    but for sums; equal in distribution to drawing rows. Draws are dealt a row each, combined in each task."""
    own = rows.select(value.cast("double").alias("v"), (F.col(key) if key else F.monotonically_increasing_id()).alias("k")).where("v IS NOT NULL")
    u = F.pmod(F.xxhash64(F.lit(seed), "d", "k"), F.lit(1 << 40)) / float(1 << 40)
    steps, tail, term = [], 0.0, math.exp(-1.0)
    for i in range(12):
        tail += term
        steps.append(tail)
        term /= i + 1
    weight = sum(((u >= s).cast("int") for s in steps), F.lit(0))
    dealt = own.withColumn("d", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = dealt.groupBy("d").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("mean"))
    ends = means.agg(F.percentile("mean", F.lit((1 - level) / 2)).alias("lo"), F.percentile("mean", F.lit((1 + level) / 2)).alias("hi"))
    return own.agg(F.avg("v").alias("mean")).crossJoin(ends)  # a row each


def log_softmax(scores: Column, temperature: float) -> Column:
    """Of an array of scores."""
    scaled = F.transform(scores, lambda s: s / temperature)
    top = F.array_max(scaled)
    whole = F.log(F.aggregate(scaled, F.lit(0.0), lambda a, s: a + F.exp(s - top)))
    return F.transform(scaled, lambda s: s - top - whole)


def fit_temperature(rows: DataFrame, low: float = 0.05, high: float = 200.0, steps: int = 40) -> tuple[float, float]:
    """The temperature that makes the true labels likeliest, and the mean negative log-likelihood there. rows: scores (array),
    truth (its index). Eight temperatures at a time are tried in one pass, evenly in the logarithm, around the best so far."""
    best = None
    a, b = math.log(low), math.log(high)
    for _ in range(max(1, steps // 8)):
        tried = [a + (b - a) * i / 7 for i in range(8)]
        means = [F.avg(-F.get(log_softmax(F.col("scores"), math.exp(t)), F.col("truth"))) for t in tried]
        found = rows.agg(*means).first()
        if found[0] is None:
            raise ValueError("no rows to fit a temperature to")
        at = min(range(8), key=lambda i: found[i])
        best = (math.exp(tried[at]), found[at])
        a, b = tried[max(0, at - 1)], tried[min(7, at + 1)]
    return best


def temperatures(rows: DataFrame, by: str, least: int = 30) -> dict:
    """A temperature for each group of `least` rows or more; groups are labels, so few."""
    groups = [r[by] for r in rows.groupBy(by).count().where(F.col("count") >= least).collect()]
    return {g: fit_temperature(rows.where(F.col(by).eqNullSafe(F.lit(g)))) for g in groups}


def two_proportions(a_hits: int, a_n: int, b_hits: int, b_n: int) -> tuple[float, float]:
    """z and the two-sided p of two shares' difference, pooled."""
    pooled = (a_hits + b_hits) / (a_n + b_n)
    spread = math.sqrt(pooled * (1 - pooled) * (1 / a_n + 1 / b_n))
    z = 0.0 if spread == 0 else (a_hits / a_n - b_hits / b_n) / spread
    return z, math.erfc(abs(z) / math.sqrt(2))


def size_or_variety(rows: DataFrame, lang: str, source: str, id_col: str, seed: str) -> DataFrame:
    """rows with arm: `one` for the rows of each language's largest source, `many` for as many rows of all its sources, drawn by
    hash ranges as in split_by_source; a row can be in both, other rows in none."""
    sizes = rows.groupBy(lang, source).agg(F.count("*").alias("n"))
    largest = sizes.groupBy(lang).agg(F.max(F.struct("n", source)).alias("m"), F.sum("n").alias("all")).select(F.col(lang).alias("_l"), F.col(f"m.{source}").alias("_s"), (F.col("m.n") / F.col("all")).alias("_share"))
    met = rows.join(F.broadcast(largest), F.col(lang).eqNullSafe(F.col("_l")))
    chance = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string"))), F.lit(8)), 16, 10).cast("double") / float(1 << 32)
    arms = F.array_compact(F.array(F.when(F.col(source).eqNullSafe(F.col("_s")), F.lit("one")), F.when(chance < F.col("_share"), F.lit("many"))))
    return met.select(*rows.columns, F.explode(arms).alias("arm"))


def scores_by(rows: DataFrame, right: Column, sets: list[list[str]]) -> DataFrame:
    """n, hits and accuracy by each set of columns, in one pass (grouping sets); columns outside a set are NULL, `level` tells
    the sets apart."""
    names = sorted({c for s in sets for c in s})
    own = rows.select(*names, right.alias("_ok")).where("_ok IS NOT NULL")
    grouped = own.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in names])
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.count_if("_ok").alias("hits")).withColumn("accuracy", F.round(F.col("hits") / F.col("n"), 4))


def worse(candidate: dict[str, tuple[int, int]], level: float = 0.05) -> str | None:
    """The first test, by p, in which a candidate is significantly behind (wins, losses against the best), by Holm's steps; only
    losses count."""
    tests = sorted(((10 ** log10_sign_test(w, x), name) for name, (w, x) in candidate.items() if x > w), key=lambda t: t[0])
    return next((name for i, (p, name) in enumerate(tests) if p <= level / (len(tests) - i)), None)


def smallest_not_worse(outcomes: DataFrame, sizes: dict[str, int]) -> str:
    """The smallest model that no test shows to be behind the one of the best mean. outcomes: model, test, item, ok; models and
    tests are few, items any number: one pass counts means, one the pairs against the best."""
    means = {r["model"]: r["mean"] for r in outcomes.groupBy("model", "test").agg(F.avg(F.col("ok").cast("double")).alias("a")).groupBy("model").agg(F.avg("a").alias("mean")).collect()}
    best = max(sorted(means), key=lambda m: means[m])
    top = outcomes.where(F.col("model") == best).select(F.col("test").alias("t"), F.col("item").alias("i"), F.col("ok").alias("top"))
    met = outcomes.where(F.col("model") != best).join(top, (F.col("test") == F.col("t")) & (F.col("item") == F.col("i")))
    pairs = met.groupBy("model", "test").agg(F.count_if(F.col("ok") & ~F.col("top")).alias("wins"), F.count_if(~F.col("ok") & F.col("top")).alias("losses")).collect()
    against: dict[str, dict[str, tuple[int, int]]] = {}
    for r in pairs:
        against.setdefault(r["model"], {})[r["test"]] = (r["wins"], r["losses"])
    for model in sorted(means, key=lambda m: (sizes[m], -means[m], m)):
        if model == best or worse(against.get(model, {})) is None:
            return model
    return best


def calibration_arms(rows: DataFrame, by: str, temperature: float, bins: int = 15) -> DataFrame:
    """by, n, accuracy, confidence, ece of each group at one temperature. rows: scores (array), truth (its index), by."""
    best = F.array_max(log_softmax(F.col("scores"), temperature))
    right = F.array_position("scores", F.array_max("scores")) - 1 == F.col("truth")
    own = rows.select(by, F.exp(best).alias("c"), right.alias("ok")).where("c IS NOT NULL AND ok IS NOT NULL")
    binned = own.withColumn("bin", F.least(F.greatest(F.ceil(F.col("c") * bins), F.lit(1)), F.lit(bins)))
    cells = binned.groupBy(by, "bin").agg(F.count("*").alias("n"), F.count_if("ok").alias("hits"), F.sum("c").alias("c"))
    sums = cells.groupBy(by).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("c").alias("c"), F.sum(F.abs(F.col("hits") - F.col("c"))).alias("gaps"))
    return sums.select(by, "n", F.round(F.col("hits") / F.col("n"), 4).alias("accuracy"), F.round(F.col("c") / F.col("n"), 4).alias("confidence"), F.round(F.col("gaps") / F.col("n"), 4).alias("ece"))


def balanced(arms: DataFrame) -> DataFrame:
    """One row: the groups' accuracy, confidence and ece, each group the same weight."""
    return arms.agg(*[F.round(F.avg(c), 4).alias(c) for c in ("accuracy", "confidence", "ece")])


def left_out(rows: DataFrame, by: str) -> dict:
    """For each group (labels, so few) the temperature that the others give, and its own error there."""
    out = {}
    for r in rows.select(by).distinct().collect():
        own, rest = (rows.where(F.col(by).eqNullSafe(F.lit(r[by]))), rows.where(~F.col(by).eqNullSafe(F.lit(r[by]))))
        if rest.isEmpty():
            continue
        temperature = fit_temperature(rest)[0]
        out[r[by]] = (temperature, calibration_arms(own, by, temperature).first()["ece"])
    return out
