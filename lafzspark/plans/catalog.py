"""Queries over the driver's tables, each with its DuckDB equivalent.

The tables hold no Urdu, so Urdu texts are made from Latin ones letter by letter (URDU), alike in both languages.
Counts are partial before the shuffle; functions that cost much per word run once for each distinct word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lafzspark.functions import figures, letters
from lafzspark.functions import text as T
from lafzspark.operators import evaluate
from lafzspark.plans import sql
from lafzspark.resources import script as S

LATIN = "abcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
URDU = "ابچدےفگهيجكلمنوپقرستعژںخیز" * 2


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts in fewer parts than the session has cores (a small file of one row group) are dealt to all of them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "conversations", "orders") and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def _urdu(text: str = "text") -> Column:
    return F.translate(F.col(text), LATIN, URDU)


URDU_SQL = f"translate(text, '{LATIN}', {sql.q(URDU)})"
WORDS_SQL = f"SELECT doc_id, lang, unnest({sql.words(sql.normalize(URDU_SQL))}) AS word FROM documents"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", "lang", F.explode(T.words(_urdu())).alias("word"))


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))


def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent stems without stopwords."""
    kept = _distinct_words(spark, sf_dir).where(~T.is_stopword(F.col("word"), normalized=True))
    stems = kept.select(T.stem(F.col("word"), normalized=True).alias("stem"), "n").groupBy("stem").agg(F.sum("n").alias("n"))
    return stems.orderBy(F.desc("n"), "stem").limit(50)


STEM_COUNTS = f"""
WITH w AS ({WORDS_SQL}), d AS (SELECT word, count(*) AS n FROM w GROUP BY word)
SELECT {sql.stem("word")} AS stem, sum(n)::BIGINT AS n FROM d WHERE NOT ({sql.stop("word")}) GROUP BY 1 ORDER BY n DESC, stem LIMIT 50"""


def normalize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.normalize(_urdu()).alias("text"))


def resolve_heh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.resolve_heh(_urdu()).alias("text"))


def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with marks of each document, as their number and a digest."""
    tokens = _read(spark, sf_dir, "documents").select("doc_id", T.words(_urdu(), True).alias("tokens"))
    return tokens.select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", "\n")).alias("digest"))


WORD_LISTS = f"""
WITH t AS (SELECT doc_id, {sql.words(sql.normalize(URDU_SQL), True)} AS tokens FROM documents)
SELECT doc_id, len(tokens) AS n, md5(array_to_string(tokens, chr(10))) AS digest FROM t"""


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(_urdu())).alias("pos", "sentence"))
    return split.select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence")


SENTENCE_ROWS = f"""
WITH n AS (SELECT doc_id, {sql.normalize(URDU_SQL)} AS t FROM documents),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, {sql.q(f"([{S.SENTENCE_ENDS}])[{S.BLANK}]+")}, '\\1' || chr(1), 'g'), chr(1)), lambda x: {sql.strip("x")}), lambda x: x <> '') AS parts FROM n)
SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS sentence FROM s"""


def stopword_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each word that isn't a stopword occurs."""
    return _distinct_words(spark, sf_dir).where(~T.is_stopword(F.col("word"), normalized=True))


STOPWORD_REMOVAL = f"WITH w AS ({WORDS_SQL}) SELECT word, count(*) AS n FROM w WHERE NOT ({sql.stop('word')}) GROUP BY word"


def word_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("word")
    return _distinct_words(spark, sf_dir).select("word", T.stem(w, normalized=True).alias("full_stem"), T.stem(w, True, normalized=True).alias("light_stem"), T.stem(w, False, 2, True).alias("short_stem"))


WORD_STEMS = f"""
WITH w AS ({WORDS_SQL}) SELECT DISTINCT word, {sql.stem("word")} AS full_stem, {sql.stem("word", True)} AS light_stem, {sql.stem("word", False, 2)} AS short_stem FROM w"""


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of padded character trigrams, weighted by their word's."""
    grams = _distinct_words(spark, sf_dir).select(F.explode(T.character_ngrams(F.col("word"))).alias("gram"), "n")
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


NGRAM_COUNTS = f"""
WITH w AS ({WORDS_SQL}), d AS (SELECT '<' || word || '>' AS t, count(*) AS n FROM w GROUP BY word),
g AS (SELECT unnest(list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))) AS gram, n FROM d)
SELECT gram, sum(n)::BIGINT AS n FROM g GROUP BY gram"""


def urdu_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = F.concat(F.col("text"), F.lit(" "), F.translate(F.col("text"), LATIN[:13], URDU[:13]))
    return _read(spark, sf_dir, "documents").select(
        "doc_id", T.is_urdu(F.col("text")).alias("latin"), T.is_urdu(_urdu()).alias("urdu"), T.is_urdu(mixed, 0.25).alias("mixed")
    )


def _share_sql(x: str, least: float) -> str:
    letters_ = f"regexp_replace({x}, '\\P{{L}}', '', 'g')"
    own = f"regexp_replace({letters_}, {sql.q(f'[^{S.URDU_BLOCKS}]')}, '', 'g')"
    return f"CASE WHEN {x} IS NOT NULL THEN coalesce(length({own}) / nullif(length({letters_}), 0) >= {least}, false) END"


_MIXED = f"(text || ' ' || translate(text, '{LATIN[:13]}', {sql.q(URDU[:13])}))"
URDU_SHARE = f"SELECT doc_id, {_share_sql('text', 0.5)} AS latin, {_share_sql(URDU_SQL, 0.5)} AS urdu, {_share_sql(_MIXED, 0.25)} AS mixed FROM documents"


def letter_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and documents of the Arabic letters that stand in for Urdu ones."""
    own = _read(spark, sf_dir, "documents").select(_urdu().alias("t"))
    count = lambda c: F.length("t") - F.length(F.replace("t", F.lit(c)))
    sums = own.agg(*[F.coalesce(f, F.lit(0)).alias(f"{k}_{i}") for i, c in enumerate("يكةىه") for k, f in (("n", F.sum(count(c))), ("docs", F.count_if(count(c) > 0)))])
    rows = F.array(*[F.struct(F.lit(c).alias("letter"), F.col(f"n_{i}").alias("n"), F.col(f"docs_{i}").alias("docs")) for i, c in enumerate("يكةىه")])
    return sums.select(F.inline(rows))


LETTER_CENSUS = " UNION ALL ".join(
    f"SELECT {sql.q(c)} AS letter, coalesce(sum(length(t) - length(replace(t, {sql.q(c)}, ''))), 0)::BIGINT AS n, count(*) FILTER (WHERE contains(t, {sql.q(c)})) AS docs FROM (SELECT {URDU_SQL} AS t FROM documents)"
    for c in "يكةىه"
)


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents that aren't themselves an item of the benchmark, white space aside."""
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\r\n]+", " "))
    docs = _read(spark, sf_dir, "documents").withColumn("plain", plain)
    held = _read(spark, sf_dir, "benchmark").select(plain.alias("plain")).distinct()
    w = docs.join(held, "plain", "left_anti").select(F.explode(T.words(_urdu())).alias("word"))
    return w.where(F.col("word").rlike(rf"^[\p{{L}}&&[{S.URDU_BLOCKS}]]+\z")).groupBy("word").agg(F.count("*").alias("n"))


_PLAIN = "trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n]+', ' ', 'g'))"
VOCABULARY = f"""
WITH k AS (SELECT * FROM documents WHERE {_PLAIN} NOT IN (SELECT {_PLAIN} FROM benchmark)),
w AS (SELECT unnest({sql.words(sql.normalize(URDU_SQL))}) AS word FROM k)
SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, {sql.q(f"[{S.URDU_BLOCKS}]+")}) AND NOT regexp_matches(word, '\\P{{L}}') GROUP BY word"""


def source_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and characters by language, by language and source, and over all."""
    docs = _read(spark, sf_dir, "documents").withColumn("chars", F.length("text"))
    docs.createOrReplaceTempView("lafz_source_scores")
    return spark.sql("""SELECT lang, source, count(*) AS n, sum(chars) AS chars FROM lafz_source_scores
        GROUP BY GROUPING SETS ((lang), (lang, source), ())""")


SOURCE_SCORES = "SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY GROUPING SETS ((lang), (lang, source), ())"


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1 and the Wilson interval of recall, of quality as a guess at not toxic."""
    return _scored(_read(spark, sf_dir, "labels").select(F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("pred")))


def _scored(pairs: DataFrame) -> DataFrame:
    cells = pairs.where("truth IS NOT NULL AND pred IS NOT NULL").groupBy("truth", "pred").agg(F.count("*").alias("n"))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("truth").alias("label"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("seen"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("seen"), F.col("n").alias("said")),
    )))
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hit", "seen", "said")])
    return sums.selectExpr("label", "hit", "seen", "said", *_SCORES)


_Z = 1.96
_P = "(hit / nullif(seen, 0)::DOUBLE)"
_SCORES = [
    "round(hit / nullif(said, 0)::DOUBLE, 6) AS precision",
    f"round({_P}, 6) AS recall",
    "round(2.0::DOUBLE * hit / nullif(seen + said, 0), 6) AS f1",
    f"round(({_P} + {_Z**2 / 2}::DOUBLE / seen - {_Z}::DOUBLE * sqrt({_P} * (1 - {_P}) / seen + {_Z**2 / 4}::DOUBLE / seen / seen)) / (1 + {_Z**2}::DOUBLE / seen), 6) AS recall_low",
]
CLASS_SCORES = f"""
WITH p AS (SELECT toxic AS truth, 1 - quality AS pred FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL),
s AS (SELECT truth AS label, (truth = pred)::INT AS hit, 1 AS seen, 0 AS said FROM p UNION ALL SELECT pred, 0, 0, 1 FROM p),
g AS (SELECT label, sum(hit)::BIGINT AS hit, sum(seen)::BIGINT AS seen, sum(said)::BIGINT AS said FROM s GROUP BY label)
SELECT label, hit, seen, said, {", ".join(_SCORES)} FROM g"""


def centred_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text")
    return _read(spark, sf_dir, "documents").select("doc_id", F.when(size > 50, F.substring(F.col("text"), F.floor((size - 50) / 2).cast("int") + 1, F.lit(50))).alias("w"))


def grouped_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("o_totalprice")
    return _read(spark, sf_dir, "orders").select(
        "o_orderkey", figures.format_number(price).alias("price"), figures.format_number(-F.col("o_orderkey")).alias("debt"), figures.format_number(price, True).alias("urdu")
    )


_DECIMAL = "o_totalprice::VARCHAR::DECIMAL(38, 15)"
GROUPED_AMOUNTS = f"""
WITH p AS (SELECT o_orderkey, {sql.format_number(f"({_DECIMAL})")} AS price, {sql.format_number("((-o_orderkey)::DECIMAL(38, 15))")} AS debt FROM orders)
SELECT o_orderkey, price, debt, translate(price, '0123456789,.', '{S.URDU_DIGITS}٬٫') AS urdu FROM p"""


def spelled_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select("o_orderkey", figures.number_to_words(key).alias("words"), figures.number_to_words(key * 6_700_417).alias("large"))


SPELLED_NUMBERS = f"SELECT o_orderkey, {sql.number_to_words('o_orderkey')} AS words, {sql.number_to_words('(o_orderkey * 6700417)')} AS large FROM orders"


def spelled_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct Latin words of the documents in Urdu letters."""
    lowered = F.translate(F.col("text"), LATIN[26:], LATIN[:26])
    w = _read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(lowered, F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return w.select("word", letters.rules_to_urdu(F.col("word")).alias("urdu"))


SPELLED_BY_RULES = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, '{LATIN[26:]}', '{LATIN[:26]}'), '[a-z]+')) AS word FROM documents)
SELECT word, {sql.rules_to_urdu("word")} AS urdu FROM w"""

CONFIDENCE = "((doc_id * 7919) % 1000 + 1) / 1000.0::DOUBLE"


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability bins of quality under a confidence made from doc_id."""
    labels = _read(spark, sf_dir, "labels")
    return evaluate.calibration_bins(labels, ((F.col("doc_id") * 7919) % 1000 + 1) / F.lit(1000.0), F.col("quality") == 1)


CALIBRATION_BINS = f"""
WITH c AS (SELECT {CONFIDENCE} AS c, quality = 1 AS hit FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT least(greatest(ceil(c * 15), 1), 15)::BIGINT AS bin, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, sum(c) / count(*) AS mean FROM c GROUP BY 1)
SELECT bin, n, hits, round(mean, 6) AS confidence, round(abs(hits / n - mean), 6) AS gap FROM b"""


def prior_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity guessed as low quality, if one document in twenty were toxic."""
    pairs = _read(spark, sf_dir, "labels").where("toxic IS NOT NULL AND quality IS NOT NULL")
    cells = pairs.groupBy(F.col("toxic").alias("truth"), (1 - F.col("quality")).alias("pred")).agg(F.count("*").alias("n"))
    return evaluate.prior_shift(cells, spark.sql("SELECT * FROM VALUES (0, 19), (1, 1) AS t(label, weight)"))


PRIOR_SHIFT = """
WITH c AS (SELECT toxic AS truth, 1 - quality AS pred, count(*) AS n FROM labels WHERE toxic IS NOT NULL AND quality IS NOT NULL GROUP BY 1, 2),
s AS (SELECT truth AS label, sum(n) AS seen, CASE truth WHEN 0 THEN 19 WHEN 1 THEN 1 END AS w FROM c WHERE truth IN (0, 1) GROUP BY truth),
p AS (SELECT label, seen, w / sum(w) OVER () AS share FROM s),
j AS (SELECT truth, pred, share * n / seen AS mass FROM c JOIN p ON truth = label),
g AS (SELECT pred AS label, sum(mass) AS said, coalesce(sum(mass) FILTER (WHERE pred = truth), 0) AS tp FROM j GROUP BY pred),
m AS (SELECT p.label, share, coalesce(tp, 0) / nullif(said, 0) AS a, coalesce(tp, 0) / share AS r FROM p LEFT JOIN g USING (label))
SELECT label, round(share, 6) AS share, round(a, 4) AS precision, round(r, 4) AS recall, coalesce(CASE WHEN a > 0 AND r > 0 THEN round(2 * a * r / (a + r), 4) END, 0) AS f1 FROM m"""


def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low quality as a guess at toxicity, against never guessing it."""
    return evaluate.paired_test(_read(spark, sf_dir, "labels"), F.col("toxic") == 1 - F.col("quality"), F.col("toxic") == 0)


PAIRED_TEST = """
WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 - quality AND toxic <> 0) AS a, count(*) FILTER (WHERE toxic <> 1 - quality AND toxic = 0) AS b FROM labels),
t AS (SELECT unnest([(lgamma(a + b + 1) - lgamma(k + 1) - lgamma(a + b - k + 1)) / ln(10) - (a + b) * log10(2) for k in range(least(a, b) + 1)]) AS x FROM c),
m AS (SELECT max(x) AS top FROM t), s AS (SELECT top + log10(sum(pow(10, x - top))) + log10(2) AS p FROM t JOIN m ON true GROUP BY top)
SELECT a AS a_only, b AS b_only, round(least(0, p), 2) + 0.0::DOUBLE AS log10_p FROM c JOIN s ON true"""


def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80 / 10 / 10 within each language and source."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return evaluate.split_by_source(docs, ["lang", "source"], "doc_id", "17")


SOURCE_SPLIT = """
WITH k AS (SELECT doc_id, lang, source, md5('17|' || coalesce(lang, '') || '|' || coalesce(source, '') || '|' || doc_id) AS h FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, doc_id) AS i, count(*) OVER (PARTITION BY lang, source) AS n FROM k),
c AS (SELECT *, floor(n * 0.8::DOUBLE) AS a, floor(n * 0.1::DOUBLE) AS b FROM r)
SELECT doc_id, lang, source, CASE WHEN i <= a THEN 'train' WHEN i <= a + b THEN 'val' ELSE 'test' END AS part FROM c"""

QUERIES = {
    "stem_counts": stem_counts,
    "normalize_documents": normalize_documents,
    "resolve_heh": resolve_heh,
    "word_lists": word_lists,
    "sentence_rows": sentence_rows,
    "stopword_removal": stopword_removal,
    "word_stems": word_stems,
    "ngram_counts": ngram_counts,
    "urdu_share": urdu_share,
    "letter_census": letter_census,
    "vocabulary": vocabulary,
    "source_scores": source_scores,
    "class_scores": class_scores,
    "centred_windows": centred_windows,
    "grouped_amounts": grouped_amounts,
    "spelled_numbers": spelled_numbers,
    "spelled_by_rules": spelled_by_rules,
    "calibration_bins": calibration_bins,
    "prior_shift": prior_shift,
    "paired_test": paired_test,
    "source_split": source_split,
}
ORACLE_SQL = {
    "stem_counts": STEM_COUNTS,
    "normalize_documents": f"SELECT doc_id, {sql.normalize(URDU_SQL)} AS text FROM documents",
    "resolve_heh": f"SELECT doc_id, {sql.heh(URDU_SQL)} AS text FROM documents",
    "word_lists": WORD_LISTS,
    "sentence_rows": SENTENCE_ROWS,
    "stopword_removal": STOPWORD_REMOVAL,
    "word_stems": WORD_STEMS,
    "ngram_counts": NGRAM_COUNTS,
    "urdu_share": URDU_SHARE,
    "letter_census": LETTER_CENSUS,
    "vocabulary": VOCABULARY,
    "source_scores": SOURCE_SCORES,
    "class_scores": CLASS_SCORES,
    "centred_windows": "SELECT doc_id, CASE WHEN length(text) > 50 THEN substring(text, (length(text) - 50) // 2 + 1, 50) END AS w FROM documents",
    "grouped_amounts": GROUPED_AMOUNTS,
    "spelled_numbers": SPELLED_NUMBERS,
    "spelled_by_rules": SPELLED_BY_RULES,
    "calibration_bins": CALIBRATION_BINS,
    "prior_shift": PRIOR_SHIFT,
    "paired_test": PAIRED_TEST,
    "source_split": SOURCE_SPLIT,
}
