"""Queries over the corpus and evaluation operators, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lafzspark.functions import text as T
from lafzspark.operators import corpus, evaluate, langid, ranking
from lafzspark.plans import sql
from lafzspark.plans.catalog import CONFIDENCE, LATIN, URDU, URDU_SQL, WORDS_SQL, _read, _urdu
from lafzspark.resources import script as S

q = sql.q
URDU_WORD = f"regexp_full_match(w, {q(f'[{S.URDU_BLOCKS}]+')}) AND NOT regexp_matches(w, '\\P{{L}}')"
CONFIDENCE_COLUMN = "((doc_id * 7919) % 1000 + 1) / 1000.0"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents")


def _urdu_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).withColumn("text", _urdu())


def _vocabulary(docs: DataFrame, least: int = 5) -> DataFrame:
    words = docs.select(F.explode(T.words(F.col("text"))).alias("word")).where(corpus.is_urdu_word(F.col("word")))
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


_LINES = f"SELECT {sql.words(sql.normalize('line'))} AS t FROM (SELECT unnest(string_split({URDU_SQL}, chr(10))) AS line FROM documents)"
_PAIRS = f"""
l AS ({_LINES}), e AS (SELECT unnest(t) AS w, unnest(['<s>'] || t[:-2]) AS a, unnest(range(len(t))) AS i FROM l),
p AS (SELECT CASE WHEN i = 0 THEN '<s>' WHEN {URDU_WORD.replace("(w,", "(a,")} THEN a ELSE '<unk>' END AS prev, w AS word FROM e WHERE {URDU_WORD}),
c AS (SELECT prev, word, count(*) AS n FROM p GROUP BY 1, 2)"""


def line_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbours in a line seen three times or more, between words that occur five times."""
    docs = _urdu_docs(spark, sf_dir)
    return corpus.bigrams(docs, _vocabulary(docs))[0]


LINE_BIGRAMS = f"""
WITH {_PAIRS}, v AS (SELECT w AS word FROM ({WORDS_SQL.replace('AS word', 'AS w')}) WHERE {URDU_WORD} GROUP BY w HAVING count(*) >= 5)
SELECT * FROM c WHERE n >= 3 AND word IN (SELECT word FROM v) AND (prev IN ('<s>', '<unk>') OR prev IN (SELECT word FROM v))"""


def bigram_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _urdu_docs(spark, sf_dir)
    return corpus.bigrams(docs, _vocabulary(docs))[1]


BIGRAM_CONTEXTS = f"WITH {_PAIRS} SELECT prev, sum(n)::BIGINT AS total, count(*) AS types FROM c GROUP BY prev"


def corpus_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.census(_urdu_docs(spark, sf_dir))


CORPUS_CENSUS = f"""
WITH d AS (SELECT {URDU_SQL} AS text FROM documents),
r AS (SELECT raw, count(*) AS n, {sql.normalize("raw")} AS norm FROM (SELECT unnest(string_split_regex(text, {q(f"[{S.BLANK}]+")})) AS raw FROM d) WHERE raw <> '' GROUP BY raw),
y AS (SELECT norm, sum(n) AS n, max(n) AS top, count(*) AS k, sum(CASE WHEN raw <> norm THEN n ELSE 0 END) AS changed FROM r GROUP BY norm),
w AS (SELECT word FROM ({WORDS_SQL}))
SELECT (SELECT count(*) FROM d) AS documents, (SELECT sum(length(text))::BIGINT FROM d) AS characters, sum(n)::BIGINT AS raw_tokens, sum(changed)::BIGINT AS changed_tokens,
  count(*) AS types, count(*) FILTER (WHERE k > 1) AS types_of_several_spellings, sum(n - top)::BIGINT AS moved_tokens,
  (SELECT count(*) FROM w) AS tokens, (SELECT count(*) FROM w WHERE {sql.stop("word")}) AS stopwords FROM y"""


def source_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("source", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.fingerprint(docs, "source", F.col("line"))


SOURCE_FINGERPRINTS = """
WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents),
e AS (SELECT source, sha256(line) AS h, count(*) AS n, sum(length(line)) AS chars FROM l WHERE line IS NOT NULL GROUP BY 1, 2),
r AS (SELECT source, h[1:3] AS r, sha256(string_agg(h || ' ' || n, chr(10) ORDER BY h)) AS d, sum(n) AS n, sum(chars) AS chars FROM e GROUP BY 1, 2)
SELECT source, sum(n)::BIGINT AS lines, sum(chars)::BIGINT AS chars, sha256(string_agg(d, chr(10) ORDER BY r)) AS digest FROM r GROUP BY source"""


def english_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    train, held = docs.where("lang = 'en' AND doc_id % 10 <> 0"), docs.where("lang = 'en' AND doc_id % 10 = 0")
    return corpus.held_out_sentences(train, held).select(F.md5("sentence").alias("digest"), "part")


_SPLIT_SENTENCE = f"string_split(regexp_replace(text, {q(f'([{S.SENTENCE_ENDS}])[{S.BLANK}]+')}, '\\1' || chr(1), 'g'), chr(1))"
ENGLISH_SENTENCES = f"""
WITH s AS (SELECT DISTINCT doc_id % 10 = 0 AS held, {sql.strip(sql.every("s", f"[{S.BLANK}]+", " "))} AS s FROM (SELECT doc_id, unnest({_SPLIT_SENTENCE}) AS s FROM documents WHERE lang = 'en')),
k AS (SELECT * FROM s WHERE len(string_split(s, ' ')) >= 5)
SELECT md5(s) AS digest, 'train' AS part FROM k WHERE NOT held
UNION ALL SELECT md5(s), CASE WHEN sha256(s)[2] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'val' ELSE 'test' END FROM k WHERE held AND s NOT IN (SELECT s FROM k WHERE NOT held)"""


def sampled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """97 documents, evenly spread over their ids: the sampling operator itself."""
    return corpus.every_kth(_docs(spark, sf_dir).select("doc_id"), "doc_id", 97)


SAMPLED_DOCUMENTS = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
k AS (SELECT i, (SELECT max(n) FROM r) AS n FROM range(97) AS t(i))
SELECT doc_id FROM r WHERE n <= 97 OR pos IN (SELECT floor(i * (n / 97.0::DOUBLE))::BIGINT FROM k)"""


def cross_language_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.cross_label_duplicates(lines, "lang", "line").select("key", F.array_join("labels", ",").alias("labels"), "n")


_AUDIT = sql.strip(sql.every(sql.every("nfc_normalize(line)", f"{S.TATWEEL}|\\p{{M}}", ""), f"[{S.BLANK}]+", " "))
CROSS_LANGUAGE_LINES = f"""
WITH l AS (SELECT lang, {_AUDIT} AS line FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)),
c AS (SELECT md5(line) AS key, lang, count(*) AS n FROM l WHERE length(line) >= 24 GROUP BY 1, 2)
SELECT key, string_agg(lang, ',' ORDER BY lang) AS labels, sum(n)::BIGINT AS n FROM c GROUP BY key HAVING count(*) > 1"""


def letters_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.letter_shares(lines, "lang", "line").select("lang", "letter", F.round("share", 9).alias("share"))


_SHARES = f"""
l AS (SELECT lang, {sql.strip("nfc_normalize(line)")} AS line FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents)),
k AS (SELECT lang, line, row_number() OVER () AS i FROM l WHERE line <> ''), z AS (SELECT lang, count(*) AS lines FROM k GROUP BY lang),
c AS (SELECT lang, letter, count(*) AS n FROM (SELECT lang, unnest(list_distinct(regexp_extract_all(line, '\\p{{L}}'))) AS letter FROM k) GROUP BY 1, 2),
s AS (SELECT lang, letter, n / lines AS share FROM c JOIN z USING (lang))"""
LETTERS_BY_LANGUAGE = f"WITH {_SHARES} SELECT lang, letter, round(share, 9) AS share FROM s"


def own_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _docs(spark, sf_dir).select("lang", F.explode(F.split("text", "\n")).alias("line"))
    return corpus.own_letters(corpus.letter_shares(lines, "lang", "line")).select("lang", "letter", F.round("share", 9).alias("share"))


OWN_LETTERS = f"""
WITH {_SHARES} SELECT lang, letter, round(share, 9) AS share FROM s AS x WHERE share >= 0.02
AND coalesce((SELECT max(share) FROM s AS y WHERE y.letter = x.letter AND y.lang <> x.lang), 0) <= 0.001"""


def usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.segments(_urdu_docs(spark, sf_dir)).select(F.md5("line").alias("digest"), F.length("line").cast("long").alias("chars"))


USABLE_SEGMENTS = f"""
WITH s AS (SELECT DISTINCT {sql.strip(sql.every("s", f"[{S.BLANK}]+", " "))} AS line FROM (SELECT unnest({_SPLIT_SENTENCE}) AS s FROM (SELECT {URDU_SQL} AS text FROM documents)))
SELECT md5(line) AS digest, length(line)::BIGINT AS chars FROM s WHERE length(line) >= 40 AND NOT ({" OR ".join(f"contains(line, {q(m)})" for m in corpus.MARKUP)})
AND coalesce(length(regexp_replace(line, '[^؀-ۿݐ-ݿ]', '', 'g')) / nullif(length(regexp_replace(line, '\\P{{L}}', '', 'g')), 0) >= 0.6, false)"""


def mapped_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as another classifier's labels, by the commonest language of their documents; en and fr stand for themselves."""
    pairs = _docs(spark, sf_dir).select(F.col("source").alias("said"), F.col("lang").alias("truth"))
    own = _docs(spark, sf_dir).select(F.col("lang").alias("said"), F.lit("de").alias("truth")).where("said IN ('en', 'fr')")
    return corpus.label_map(pairs.union(own), ["en", "fr"])


MAPPED_LABELS = """
WITH p AS (SELECT source AS said, lang AS truth FROM documents UNION ALL SELECT lang, 'de' FROM documents WHERE lang IN ('en', 'fr')),
c AS (SELECT said, truth, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY said ORDER BY n DESC, truth) AS i FROM c)
SELECT said, CASE WHEN said IN ('en', 'fr') THEN said ELSE truth END AS label FROM r WHERE i = 1"""

# Ranking


def bm25_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for the first eight words of each document whose id is divisible by 20."""
    tokens = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.expr("filter(split(lower(text), '[ \\t\\n\\r]+'), w -> w <> '')").alias("tokens"))
    asked = tokens.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.slice("tokens", 1, 8).alias("tokens"))
    top = ranking.bm25_top(tokens, asked)
    return top.select("query_id", "rank", "id", ranking.rounded(F.col("score"), 6).alias("score"))


_TOKENS = "list_filter(string_split_regex(lower(text), '[ \\t\\n\\r]+'), lambda w: w <> '')"
BM25_NEIGHBOURS = f"""
WITH d AS (SELECT doc_id AS id, {_TOKENS} AS t FROM documents), a AS (SELECT avg(len(t)) AS a, count(*) AS n FROM d),
p AS (SELECT id, term, count(*) AS tf, any_value(size) AS size FROM (SELECT id, len(t) AS size, unnest(t) AS term FROM d) GROUP BY 1, 2),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, a GROUP BY term, n),
u AS (SELECT DISTINCT id AS query_id, unnest(t[:8]) AS term FROM d WHERE id % 20 = 0),
s AS (SELECT query_id, p.id, round(sum(idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / a))), 9) AS score FROM u JOIN f USING (term) JOIN p USING (term), a GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10"""


def lead_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _docs(spark, sf_dir).select("doc_id", "source", ranking.lead(F.col("text")).alias("x"))
    return cut.select("doc_id", F.col("x.lead").alias("lead"), F.md5("x.rest").alias("rest"), ranking.half(F.col("source")).alias("part"))


LEAD_SENTENCES = """
WITH c AS (SELECT doc_id, source, text, least(CASE WHEN instr(text, '۔') > 21 THEN instr(text, '۔') END, CASE WHEN instr(text, '.') > 21 THEN instr(text, '.') END) AS cut FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(left(text, cut), '') END AS lead, md5(CASE WHEN cut IS NULL THEN text ELSE substring(text, cut + 1) END) AS rest,
  CASE WHEN sha256(source)[2] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 'val' WHEN source IS NOT NULL THEN 'test' END AS part FROM c"""


def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources as clusters of documents, languages as their classes."""
    return ranking.b_cubed(_docs(spark, sf_dir).select(F.col("doc_id").alias("item"), F.col("source").alias("cluster"), F.col("lang").alias("gold")))


CLUSTER_SCORES = """
WITH n AS (SELECT count(*) OVER (PARTITION BY source, lang) AS k, count(*) OVER (PARTITION BY source) AS c, count(*) OVER (PARTITION BY lang) AS g FROM documents),
s AS (SELECT avg(k / c) AS p, avg(k / g) AS r FROM n) SELECT round(p, 4) AS precision, round(r, 4) AS recall, round(2 * p * r / (p + r), 4) AS f1 FROM s"""


def aligned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns beside their lower-case ones: how often they are the same."""
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "text", F.lower("text").alias("low"))
    found = ranking.aligned(turns, "text", "low").withColumn("conv", F.col("conv_id") % 7)
    return ranking.accuracy_by(found, "conv", F.col("a") == F.col("b"))


_OWN_WORDS = "list_filter(string_split_regex({}, '[ \\t\\r\\n]+'), lambda w: w <> '' AND NOT regexp_full_match(w, '[\\p{{Nd}}.,:/-]+'))"
ALIGNED_WORDS = f"""
WITH b AS (SELECT conv_id, {_OWN_WORDS.format("text")} AS a, {_OWN_WORDS.format("lower(text)")} AS b FROM conversations),
w AS (SELECT conv_id % 7 AS conv, unnest(a) AS a, unnest(b) AS b FROM b WHERE len(a) = len(b)), g AS (SELECT conv, count(*) AS n, count(*) FILTER (WHERE a = b) AS hits FROM w GROUP BY conv)
SELECT conv, n, round(n / sum(n) OVER (), 4) AS share, round(hits / n, 4) AS accuracy FROM g"""

# Evaluation


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "labels").select("doc_id", F.expr(CONFIDENCE_COLUMN).cast("double").alias("m"), (F.col("quality") == 1).alias("ok"))


_JUDGED = f"j AS (SELECT {CONFIDENCE} AS m, quality = 1 AS ok FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL)"


def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = evaluate.calibration_errors(evaluate.calibration_bins(_judged(spark, sf_dir), F.col("m"), F.col("ok")))
    return errors.select(F.round("ece", 4).alias("ece"), F.round("mce", 4).alias("mce"))


CALIBRATION_ERROR = f"""
WITH {_JUDGED}, b AS (SELECT least(greatest(ceil(m * 15), 1), 15) AS bin, count(*) AS n, round(abs(count(*) FILTER (WHERE ok) / count(*) - sum(m) / count(*)), 6) AS gap FROM j GROUP BY 1)
SELECT round(sum(n * gap) / sum(n), 4) AS ece, round(max(gap), 4) AS mce FROM b"""


def margin_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.bands(_judged(spark, sf_dir), F.col("m"), F.col("ok"))


MARGIN_BANDS = f"""
WITH {_JUDGED}, b AS (SELECT CASE WHEN m < 0.02 THEN 0.0 WHEN m < 0.05 THEN 0.02 WHEN m < 0.1 THEN 0.05 ELSE 0.1 END::DOUBLE AS band, ok FROM j WHERE m >= 0 AND m < 99)
SELECT band, count(*) AS n, round(count(*) FILTER (WHERE ok) / count(*), 4) AS accuracy FROM b GROUP BY band"""


def margin_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.deciles(_judged(spark, sf_dir), F.col("m"), F.col("ok"))


MARGIN_DECILES = f"""
WITH {_JUDGED}, r AS (SELECT *, row_number() OVER (ORDER BY m, ok) - 1 AS pos, count(*) OVER () AS n FROM j),
d AS (SELECT i + 1 AS decile, m, ok FROM r, range(10) AS t(i) WHERE pos >= i * n // 10 AND pos < (i + 1) * n // 10)
SELECT decile, round(min(m), 4) AS margin_from, round(max(m), 4) AS margin_to, count(*) AS n, round(count(*) FILTER (WHERE ok) / count(*), 4) AS accuracy, count(*) FILTER (WHERE NOT ok) AS errors FROM d GROUP BY decile"""


def error_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.retention(_judged(spark, sf_dir), F.col("m"), F.col("ok"))


ERROR_RETENTION = f"""
WITH {_JUDGED}, r AS (SELECT *, row_number() OVER (ORDER BY m, ok) - 1 AS pos, count(*) OVER () AS n FROM j),
k AS (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.99]::DOUBLE[]) AS keep)
SELECT keep, count(*) FILTER (WHERE pos >= floor(n * (1 - keep))) AS n, round(count(*) FILTER (WHERE ok AND pos >= floor(n * (1 - keep))) / count(*) FILTER (WHERE pos >= floor(n * (1 - keep))), 4) AS accuracy,
  count(*) FILTER (WHERE NOT ok AND pos >= floor(n * (1 - keep))) AS errors_kept, count(*) FILTER (WHERE NOT ok) AS errors_total FROM r, k GROUP BY keep"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages guessed by the source's commonest language."""
    docs = _docs(spark, sf_dir).select("source", "lang")
    said = corpus.label_map(docs.select(F.col("source").alias("said"), F.col("lang").alias("truth")), [])
    met = docs.join(said, F.col("source").eqNullSafe(F.col("said"))).select(F.col("lang").alias("truth"), F.col("label").alias("pred"))
    return met


_GUESSES = """
c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT source AS s, lang AS pred FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS i FROM c) WHERE i = 1),
x AS (SELECT lang AS truth, pred FROM documents JOIN g ON source IS NOT DISTINCT FROM s)"""


def language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir).groupBy("truth", "pred").agg(F.count("*").alias("n"))
    found = evaluate.classes(cells)
    return found.select("label", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


_CLASSES = """
s AS (SELECT truth AS label, 1 AS seen, 0 AS said, (truth = pred)::INT AS hit FROM x UNION ALL SELECT pred, 0, 1, 0 FROM x),
y AS (SELECT label, sum(seen)::BIGINT AS support, sum(hit) / nullif(sum(said), 0) AS precision, sum(hit) / nullif(sum(seen), 0) AS recall, 2 * sum(hit) / nullif(sum(seen) + sum(said), 0) AS f1 FROM s GROUP BY label)"""
LANGUAGE_SCORES = f"WITH {_GUESSES}, {_CLASSES} SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM y"


def average_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.averages(evaluate.classes(_cells(spark, sf_dir).groupBy("truth", "pred").agg(F.count("*").alias("n"))))


AVERAGE_SCORES = f"""
WITH {_GUESSES}, {_CLASSES} SELECT round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1, round(sum(coalesce(recall, 0) * support) / sum(support), 6) AS micro_f1, count(*) FILTER (WHERE support > 0) AS classes FROM y"""


def confusion_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_cells(spark, sf_dir), ["de", "en", "es", "fr"])


CONFUSION_TABLE = f"WITH {_GUESSES} SELECT truth, " + ", ".join(f"count(*) FILTER (WHERE pred = '{c}') AS {c}" for c in ("de", "en", "es", "fr")) + " FROM x GROUP BY truth"


def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of quality documents in each source."""
    met = _read(spark, sf_dir, "labels").join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id").where("quality IS NOT NULL")
    sums = met.groupBy("source").agg(F.count_if(F.col("quality") == 1).alias("hits"), F.count("*").alias("n"))
    return sums.select("source", "n", evaluate.wilson(F.col("hits"), F.col("n")).alias("w")).select("source", "n", "w.*")


WILSON_INTERVALS = """
WITH s AS (SELECT source, count(*) FILTER (WHERE quality = 1) / count(*) AS p, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY source),
w AS (SELECT *, 1.96::DOUBLE AS z, 1 + 3.8416::DOUBLE / n AS d FROM s),
b AS (SELECT source, n, p, (p + z * z / (2 * n)) / d AS c, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d AS h FROM w)
SELECT source, n, round(p, 4) AS rate, round(greatest(0, c - h), 4) AS lo, round(least(1, c + h), 4) AS hi FROM b"""


def accuracy_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "lang", "source", F.when(F.length("text") < 1000, "short").otherwise("long").alias("kind"))
    met = docs.join(_read(spark, sf_dir, "labels"), "doc_id")
    return evaluate.scores_by(met, F.col("quality") == 1, [["lang"], ["lang", "source"], ["kind"], []]).drop("level")


ACCURACY_SETS = """
WITH x AS (SELECT lang, source, CASE WHEN length(text) < 1000 THEN 'short' ELSE 'long' END AS kind, quality = 1 AS ok FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL)
SELECT kind, lang, source, count(*) AS n, count(*) FILTER (WHERE ok) AS hits, round(count(*) FILTER (WHERE ok) / count(*), 4) AS accuracy FROM x GROUP BY GROUPING SETS ((lang), (lang, source), (kind), ())"""


def size_or_variety(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select("doc_id", "lang", "source")
    return evaluate.size_or_variety(rows, "lang", "source", "doc_id", "29")


SIZE_OR_VARIETY = """
WITH s AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2),
m AS (SELECT lang AS l, source AS s, n / sum(n) OVER (PARTITION BY lang) AS share, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source DESC) AS i FROM s),
d AS (SELECT doc_id, lang, source, s, share, ('0x' || md5('29|' || doc_id)[1:8])::BIGINT / 4294967296.0::DOUBLE AS u FROM documents JOIN m ON lang IS NOT DISTINCT FROM l WHERE i = 1)
SELECT doc_id, lang, source, 'one' AS arm FROM d WHERE source IS NOT DISTINCT FROM s UNION ALL SELECT doc_id, lang, source, 'many' FROM d WHERE u < share"""

# Language identification


def _labelled_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in Urdu letters under their document's language, with their part."""
    lines = _docs(spark, sf_dir).select("lang", F.explode(F.split(_urdu(), "\n")).alias("text")).where("lang IS NOT NULL")
    return lines.withColumn("part", langid.part_of(F.col("text")))


_RUNS = "array_to_string(regexp_extract_all(nfc_normalize({}), " + q(S.LANGUAGE_RUN) + "), ' ')"
_PART = "CASE WHEN b < 0.80::DOUBLE THEN 'train' WHEN b < 0.95::DOUBLE THEN 'val' ELSE 'test' END"


def _gram_sql(x: str) -> str:
    """Grams of one and two characters."""
    chars = f"string_split(' ' || {x} || ' ', '')"
    return f"list_filter(list_concat({chars}, list_transform(list_zip(({chars})[:-2], ({chars})[2:]), lambda p: p[1] || p[2])), lambda g: length(g) = 1 OR trim(g) <> '')"


_TRAIN = f"""
a AS (SELECT lang, text, ('0x' || sha256(text)[1:2])::INT / 256 AS b FROM (SELECT lang, unnest(string_split({URDU_SQL}, chr(10))) AS text FROM documents WHERE lang IS NOT NULL)),
l AS (SELECT lang, {_PART} AS part, {_RUNS.format("text")} AS t FROM a),
g AS (SELECT lang, unnest({_gram_sql("t")}) AS gram FROM l WHERE part = 'train' AND length(t) >= 20),
c AS (SELECT lang, gram, count(*) AS n FROM g GROUP BY 1, 2)"""


def gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 300 most frequent grams (of one or two letters) of each language, from the training lines."""
    train = _labelled_lines(spark, sf_dir).where("part = 'train'")
    return langid.most_frequent(langid.gram_counts(train, 2), 300)


GRAM_COUNTS = f"WITH {_TRAIN} SELECT lang, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c) WHERE r <= 300"


def identified_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of the middle 200 letters of each document, by a model of two-letter grams."""
    train = _labelled_lines(spark, sf_dir).where("part = 'train'")
    model = langid.fit(langid.gram_counts(train, 2), 2, top=300)
    middle = F.substring("text", F.greatest(F.floor((F.length("text") - 200) / 2), F.lit(0)).cast("int") + 1, F.lit(200))
    docs = _docs(spark, sf_dir).select("doc_id", middle.alias("text")).withColumn("text", _urdu())  # a letter for each letter
    found = langid.identify(docs, model)
    return found.select("doc_id", "language", F.round("margin", 3).alias("margin"), F.get("ranking", F.lit(1))["code"].alias("second"), "short")


IDENTIFIED_LANGUAGES = f"""
WITH {_TRAIN}, k AS (SELECT lang, gram, n FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c) WHERE r <= 300),
v AS (SELECT count(DISTINCT gram) AS v FROM k), z AS (SELECT lang, ln(0.03::DOUBLE) - ln(sum(n) + 0.03::DOUBLE * v) AS unseen FROM k, v GROUP BY lang, v),
d AS (SELECT doc_id, {_RUNS.format(f"substring({URDU_SQL}, greatest((length(text) - 200) // 2, 0) + 1, 200)")} AS t FROM documents),
e AS (SELECT doc_id, length(t) AS size, unnest({_gram_sql("t")}) AS gram FROM d WHERE regexp_matches(t, '[^ ]')),
n AS (SELECT doc_id, any_value(size) AS size, count(*) AS grams FROM e GROUP BY doc_id),
s AS (SELECT doc_id, lang, sum(ln((n + 0.03::DOUBLE) / 0.03::DOUBLE)) AS s FROM e JOIN k USING (gram) GROUP BY 1, 2),
f AS (SELECT n.doc_id, size, z.lang, coalesce(s, 0) + grams * unseen AS score FROM n CROSS JOIN z LEFT JOIN s ON s.doc_id = n.doc_id AND s.lang = z.lang),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS i FROM f),
w AS (SELECT doc_id, max(lang) FILTER (WHERE i = 1) AS language, max(lang) FILTER (WHERE i = 2) AS second, round((max(score) FILTER (WHERE i = 1) - max(score) FILTER (WHERE i = 2)) / any_value(size), 4) AS margin FROM r GROUP BY doc_id)
SELECT d.doc_id, language, coalesce(round(margin, 3), 0) AS margin, second, coalesce(length(regexp_replace(t, '\\P{{L}}', '', 'g')) < 20, true) AS short FROM d LEFT JOIN w USING (doc_id)"""


def distinctive_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters of few languages, where each language's lines also hold a letter of its own."""
    extra = F.when(F.col("lang") == "en", "ٹ").when(F.col("lang") == "fr", "ڑ").otherwise("ۆ")
    lines = _docs(spark, sf_dir).select("lang", F.concat(_urdu(), F.lit(" "), extra).alias("text")).where("lang IS NOT NULL")
    found = langid.distinctive_letters(langid.gram_counts(lines, 1))
    return found.select("lang", F.array_join("letters", "").alias("letters"))


DISTINCTIVE_LETTERS = f"""
WITH l AS (SELECT lang, {_RUNS.format(f"{URDU_SQL} || ' ' || CASE lang WHEN 'en' THEN 'ٹ' WHEN 'fr' THEN 'ڑ' ELSE 'ۆ' END")} AS t FROM documents WHERE lang IS NOT NULL),
g AS (SELECT lang, unnest(string_split(' ' || t || ' ', '')) AS c FROM l WHERE length(t) >= 20), n AS (SELECT lang, c, count(*) AS n FROM g WHERE c <> ' ' GROUP BY 1, 2),
s AS (SELECT lang, c, n / sum(n) OVER (PARTITION BY lang) AS share FROM n),
k AS (SELECT c FROM s GROUP BY c HAVING count(*) FILTER (WHERE share >= 1e-3::DOUBLE) BETWEEN 1 AND 3 AND coalesce(max(share) FILTER (WHERE share < 1e-3::DOUBLE), 0) < 2e-5::DOUBLE)
SELECT lang, string_agg(c, '' ORDER BY c) AS letters FROM s WHERE share >= 1e-3::DOUBLE AND c IN (SELECT c FROM k) GROUP BY lang"""

QUERIES = {f.__name__: f for f in (
    line_bigrams, bigram_contexts, corpus_census, source_fingerprints, english_sentences, sampled_documents, cross_language_lines, letters_by_language, own_letters, usable_segments, mapped_labels,
    bm25_neighbours, lead_sentences, cluster_scores, aligned_words, calibration_error, margin_bands, margin_deciles, error_retention, language_scores, average_scores, confusion_table, wilson_intervals,
    accuracy_sets, size_or_variety, gram_counts, identified_languages, distinctive_letters,
)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES}
