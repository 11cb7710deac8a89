"""Mixing sources to target weights: how often each document is taken, by pivotal dependent rounding.

Method: every document has an expected number of copies, its source's target over its source's size. The whole part
is taken; the fraction is a probability. Within a block of documents of one source and similar size, the largest
first, two fractions meet at a time and mass moves at random from one to the other until one is 0 or 1; what one loses
in words the other gains, so a source's words stay as they are. What is left of a block is one document with a fraction, and the
leftovers of up to BLOCK blocks form a block of the next level of a reduction tree. Only the last document of a source
is rounded alone: a source's taken words differ from its target by less than one of its documents has.

All of it is DataFrame operations. Texts are read once for their sizes; from then on only ids and numbers move. Equal
rows are one unit, as many of which as are certain take a copy more, so only a fraction of one row is left to chance.
Blocks are cut by a hash of id and text, sized from counts combined in each task before the shuffle, so a source with a third
of all rows becomes many blocks. Levels: the logarithm of the largest source to base BLOCK, rounded up (3 for 10**8).

Defined cases: a null source is a source of its own, last in order; a null or blank text has size 0, is never taken
and weighs nothing; repeated rows are documents of their own; an empty table gives no rows; random numbers come from
ids and texts, so runs agree whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lafzspark.llm.scratch import written

BLOCK = 512
WEIGHTS = (5.0, 2.0, 1.0)
NEAR = 1e-9


def _numbered(sources: DataFrame) -> DataFrame:
    """sources with their place (from 0) by code point, null last; a sort over ranges, no window over all of them."""
    at = F.monotonically_increasing_id()
    rows = written(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", at))
    part = F.shiftright("at", 33).alias("part")
    first = rows.groupBy(part).agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = first.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(first), F.shiftright("at", 33) == F.col("p")).select("source", "source_size", (F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("place"))


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """source, source_size -> target: shares of the total by weight, none above `most` times its source's size.

    Sources fill up to the level that the total, less what full ones hold, leaves for the weights of the others; each
    round finds those that are full at the last level, and the level only rises, until no source is added.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = written(_numbered(sources).select("source", "source_size", cycle.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("full")))
    level, known = 0.0, None
    while True:
        full = F.col("full") <= level * F.col("w") if known is not None else F.lit(False)
        n, total, held, open_ = s.agg(F.count_if(full), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(full, F.col("full"))), F.lit(0.0)), F.sum(F.when(~full, F.col("w")))).first()
        if n == known or not open_:
            break
        level, known = (total - held) / open_, n
    return s.select("source", "source_size", F.least(F.col("full"), F.lit(level) * F.col("w")).alias("target"))


def _uniform(key: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _meet(state: Column, x: Column, salt: int) -> Column:
    """One step of the fold: the carried document meets the next one and one of them is settled, their words kept.

    Up: the carried one gains copies until it has 1 or the other has none; down: it loses them until it has none or the
    other has 1. The chances are such that no document's expected copies change.
    """
    held, p, q = state["held"], state["held"]["p"], x["p"]
    ratio = held["size"] / x["size"]
    up, down = F.least(1 - p, q / ratio), F.least(p, (1 - q) / ratio)
    goes_up = _uniform(x["rank"], salt) * (up + down) < down
    ends = F.when(goes_up, (1 - p) <= q / ratio).otherwise(p <= (1 - q) / ratio)  # of the carried one
    other = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(goes_up, q - (1 - p) * ratio).otherwise(q + p * ratio)))
    own = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(goes_up, p + q / ratio).otherwise(p - (1 - q) / ratio)))
    up_, down_ = F.when(goes_up, 1).otherwise(0), F.when(goes_up, 0).otherwise(1)
    done = F.when(ends, held.withField("extra", up_)).otherwise(x.withField("extra", down_))
    rest = F.when(ends, x.withField("p", other)).otherwise(held.withField("p", own))
    return F.struct(F.concat(state["done"], F.array(done)).alias("done"), rest.alias("held"))


UNIT = ("size", "rank", "doc_id", "text_hash", "base", "rows", "p", "extra")


def _settle(units: DataFrame, keys: list[str], salt: int, blocks: DataFrame) -> DataFrame:
    """units folded block by block: one row a block with `done` (settled units) and `held` (the one left over)."""
    own = units.join(blocks, F.expr(" AND ".join(f"{k} <=> b_{k}" for k in keys)))
    block = F.pmod(F.xxhash64("rank", F.lit(salt)), F.col("n_blocks"))
    own = own.select(*keys, block.alias("block"), F.struct(*UNIT).alias("unit"))
    lists = own.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("unit"), False).alias("units"))
    start = F.struct(F.slice("units", 1, 0).alias("done"), F.element_at("units", 1).alias("held"))
    rest = F.slice(F.col("units"), F.lit(2), F.greatest(F.size("units") - 1, F.lit(0)))
    folded = lists.select("source", F.aggregate(rest, start, lambda s, x: _meet(s, x, salt)).alias("r"))
    return folded.select("source", "r.done", "r.held")


def _blocks(units: DataFrame, keys: list[str], block: int) -> DataFrame:
    n = units.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(float(block))).alias("n_blocks"))
    return n.select(*[F.col(k).alias(f"b_{k}") for k in keys], "n_blocks")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, block: int = BLOCK, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """doc_id, source, size (words), source_size, target (words), copies, taken (words)."""
    words = F.regexp_count(F.col(f"`{text_col}`").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    text = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    each = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.coalesce(words, F.lit(0).cast("long")).alias("size"), text.alias("text_hash"))
    # Equal rows are one unit of several, so that no block can fill with them.
    sized = written(each.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("rows")))
    sources = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = written(sources.withColumn("rate", rate))
    whole = F.floor(F.col("rate") + NEAR).cast("int")
    named = sources.select(F.col("source").alias("s_source"), "source_size", "target", whole.alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("part"))
    joined = sized.join(named, F.expr("source <=> s_source")).withColumn("mass", F.when(F.col("size") > 0, F.col("part") * F.col("rows")).otherwise(0.0))
    base = F.floor(F.col("mass") + NEAR).cast("long")  # so many of a unit's rows have a copy more for certain
    joined = joined.select("doc_id", "source", "size", "text_hash", "rows", base.alias("base"), F.greatest(F.col("mass") - base, F.lit(0.0)).alias("p"))
    plain = joined.where(F.col("p") < NEAR).select("doc_id", "source", "size", "rows", F.col("base").alias("extra"))
    units = joined.where(F.col("p") >= NEAR).select(
        "source", F.floor(F.log2(F.col("size").cast("double"))).alias("class"), "size", F.xxhash64("doc_id", "text_hash", F.lit(seed)).alias("rank"), "doc_id", "text_hash", "base", "rows", "p", F.lit(0).alias("extra")
    )
    keys, done, level = ["source", "class"], plain, 1
    settled = lambda u: F.col(f"{u}.base") + F.col(f"{u}.extra")
    while True:
        blocks = written(_blocks(units, keys, block))
        tree = written(_settle(units, keys, seed + level, blocks))
        done = done.union(tree.select("source", F.explode("done").alias("u")).select("u.doc_id", "source", "u.size", "u.rows", settled("u")))
        units = tree.select("source", *[f"held.{c}" for c in UNIT])
        if keys == ["source"] and blocks.agg(F.coalesce(F.max("n_blocks"), F.lit(0))).first()[0] <= 1:
            break
        keys, level = ["source"], level + 1
    last = units.select("doc_id", "source", "size", "rows", F.col("base") + (_uniform(F.col("rank"), seed - 1) < F.col("p")).cast("int"))
    out = done.union(last).join(named.drop("part"), F.expr("source <=> s_source"))
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copies = (F.col("whole") + (F.col("i") <= F.col("extra")).cast("int")).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def op4(spark, sf_dir: str) -> DataFrame:
    found = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", "taken")
