"""Queries over the functions that read numbers and change letters, each with its DuckDB equivalent.

Where a function can't be said in SQL, its input is made so that SQL knows the answer: numbers are spelled and read back,
texts are built around known numbers and links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lafzspark.functions import figures, letters, numbers
from lafzspark.functions import text as T
from lafzspark.plans import sql
from lafzspark.plans.catalog import LATIN, URDU, URDU_SQL, WORDS_SQL, _read, _urdu
from lafzspark.resources import numerals as N
from lafzspark.resources import roman as R
from lafzspark.resources import script as S

q = sql.q


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey")


def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers spelled in words, with South Asian groups and Urdu digits, and in Roman letters, read back."""
    key = F.col("o_orderkey")
    spelled, grouped = figures.number_to_words(key * 1_000_003), figures.format_number(key * 1_000_003, True)
    roman = F.concat((key % 90 + 1).cast("string"), F.lit(" lakh "), (key % 900 + 1).cast("string"), F.lit(" hazar dedh"))
    mixed = F.concat(F.lit("sawa "), (key % 90 + 1).cast("string"), F.lit(" crore"))
    return _orders(spark, sf_dir).select("o_orderkey", numbers.parse_whole_number(spelled).cast("long").alias("words"), numbers.parse_number(grouped).alias("digits"), numbers.parse_number(roman).alias("roman"), numbers.parse_number(mixed).alias("mixed"))


PARSED_NUMBERS = """
SELECT o_orderkey, o_orderkey * 1000003 AS words, (o_orderkey * 1000003)::DOUBLE AS digits, ((o_orderkey % 90 + 1) * 100000 + (o_orderkey % 900 + 1) * 1000 + 1.5)::DOUBLE AS roman,
  ((o_orderkey % 90 + 1.25) * 10000000)::DOUBLE AS mixed FROM orders"""


def parsed_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    words = F.concat(figures.number_to_words(key), F.lit(N.ORDINAL_ENDINGS[0]))
    return _orders(spark, sf_dir).select("o_orderkey", numbers.parse_ordinal(words).alias("words"), numbers.parse_ordinal(F.concat(key.cast("string"), F.lit("th"))).alias("roman"), numbers.parse_ordinal(figures.number_to_words(key)).alias("cardinal"))


PARSED_ORDINALS = "SELECT o_orderkey, o_orderkey AS words, o_orderkey AS roman, NULL::BIGINT AS cardinal FROM orders"


def found_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an amount in words, one with a scale letter and an ordinal stand in a text."""
    key = F.col("o_orderkey")
    text = F.concat(F.lit("کل "), figures.number_to_words(key + 100), F.lit("، phir "), (key % 90 + 1).cast("string"), F.lit("k aur "), (key % 50 + 1).cast("string"), F.lit("ویں do"))
    found = _orders(spark, sf_dir).select("o_orderkey", F.explode(numbers.find_numbers(text)).alias("s"))
    return found.select("o_orderkey", "s.text", "s.value", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), "s.ordinal")


FOUND_NUMBERS = f"""
WITH p AS (SELECT o_orderkey, {sql.number_to_words('(o_orderkey + 100)')} AS w, (o_orderkey % 90 + 1)::VARCHAR || 'k' AS k, (o_orderkey % 50 + 1)::VARCHAR || 'ویں' AS o FROM orders)
SELECT o_orderkey, w AS text, (o_orderkey + 100)::DOUBLE AS value, 3 AS start, 3 + length(w) AS end, false AS ordinal FROM p
UNION ALL SELECT o_orderkey, k, (o_orderkey % 90 + 1) * 1000.0::DOUBLE, 10 + length(w), 10 + length(w) + length(k), false FROM p
UNION ALL SELECT o_orderkey, o, (o_orderkey % 50 + 1)::DOUBLE, 15 + length(w) + length(k), 15 + length(w) + length(k) + length(o), true FROM p"""


def spaced_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged compounds before and behind each text."""
    merged = F.element_at(F.array(*[F.lit(w) for w in S.MERGED]), (F.col("doc_id") % len(S.MERGED) + 1).cast("int"))
    text = F.concat(merged, F.lit(" "), _urdu(), F.lit(" "), merged, F.lit("نہ "), merged, F.lit("۔"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.fix_spacing(text)).alias("digest"))


SPACED_TEXT = f"""
WITH p AS (SELECT doc_id, {URDU_SQL} AS u, ([{", ".join(q(w) for w in S.MERGED)}])[doc_id % {len(S.MERGED)} + 1] AS m, ([{", ".join(q(w) for w in S.MERGED.values())}])[doc_id % {len(S.MERGED)} + 1] AS f FROM documents)
SELECT doc_id, md5(f || ' ' || u || ' ' || m || 'نہ ' || f || '۔') AS digest FROM p"""


def links_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with links at known places, and a private-use character that must stay."""
    k = F.col("doc_id").cast("string")
    text = F.concat(F.lit("see http://x.co/"), k, F.lit(". then @u"), k, F.lit(" \ue000 a"), k, F.lit("@b.co,\nwww.y.z end#t")) 
    return _read(spark, sf_dir, "documents").select("doc_id", T.remove_links(text).alias("text"))


LINKS_REMOVED = "SELECT doc_id, 'see. then \ue000,' || chr(10) || ' end' AS text FROM documents"


def presentation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in presentation forms, normalised."""
    forms = F.translate(F.col("text"), LATIN, "ﺍﺏﭺﺩﮮﻑﮒﻩﻱﺝﻙﻝﻡﻥﻭﭖﻕﺭﺱﺕﻉﮊﺥﯼﺯﺹ" * 2)
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(forms)).alias("digest"))


PRESENTATION_FORMS = f"SELECT doc_id, md5({sql.normalize(f'translate(text, {q(LATIN)}, {q(chr(0x627) + 'بچدےفگهيجكلمنوپقرستعژخیزص')} || {q(chr(0x627) + 'بچدےفگهيجكلمنوپقرستعژخیزص')})')}) AS digest FROM documents"


def composed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose vowels are in parts: letter, then one mark or two."""
    parts = F.replace(F.replace(F.col("text"), F.lit("e"), F.lit("é")), F.lit("u"), F.lit("ǖ"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalize(parts)).alias("digest"))


COMPOSED_TEXTS = f"SELECT doc_id, md5({sql.normalize(f'replace(replace(text, {q("e")}, {q("e" + chr(0x301))}), {q("u")}, {q("u" + chr(0x308) + chr(0x304))})')}) AS digest FROM documents"


def kept_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens without stopwords, and the stems of all."""
    tokens = _read(spark, sf_dir, "documents").select("doc_id", T.words(_urdu()).alias("t"))
    kept, stems = T.remove_stopwords(F.col("t"), normalized=True), T.stem_tokens(F.col("t"), normalized=True)
    return tokens.select("doc_id", F.md5(F.array_join(kept, " ")).alias("kept"), F.md5(F.array_join(stems, " ")).alias("stems"))


KEPT_TOKENS = f"""
WITH t AS (SELECT doc_id, {sql.words(sql.normalize(URDU_SQL))} AS t FROM documents)
SELECT doc_id, md5(array_to_string(list_filter(t, lambda w: NOT ({sql.stop("w")})), ' ')) AS kept, md5(array_to_string(list_transform(t, lambda w: {sql.stem("w")}), ' ')) AS stems FROM t"""


def stretched_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigrams of letters of whole texts, with and without their ends, as digests."""
    grams = lambda n, pad: F.md5(F.array_join(T.character_ngrams(F.col("text"), n, pad), "|"))
    return _read(spark, sf_dir, "documents").select("doc_id", grams(2, True).alias("padded"), grams(4, False).alias("plain"))


STRETCHED_GRAMS = """
WITH c AS (SELECT doc_id, text, string_split('<' || text || '>', '') AS p, string_split(text, '') AS t FROM documents)
SELECT doc_id, md5(CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(list_zip(p[:-2], p[2:]), lambda x: x[1] || x[2]), '|') END) AS padded,
  md5(CASE WHEN len(t) < 4 THEN text ELSE array_to_string(list_transform(list_zip(t[:-4], t[2:-3], t[3:-2], t[4:]), lambda x: x[1] || x[2] || x[3] || x[4]), '|') END) AS plain FROM c"""

# Letters


def _urdu_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words between blanks."""
    return _read(spark, sf_dir, "documents").select(F.explode(F.split(_urdu(), r"[ \t\r\n]+")).alias("word")).where("word <> ''").distinct()


_BLANK_WORDS = f"w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex({URDU_SQL}, '[ \\t\\r\\n]+')) AS word FROM documents) WHERE word <> '')"


def roman_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words in Roman letters, with and without short vowels."""
    w = F.col("word")
    return _urdu_words(spark, sf_dir).select("word", letters.rules_to_roman(w).alias("roman"), letters.rules_to_roman(w, False).alias("bare"))


_MAP = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in (R.LETTERS | R.MARKS).items()) + "}"
_IN_LETTERS = "(" + ", ".join(q(c) for c in R.LETTERS if c not in letters.JOINED) + ")"
ROMAN_BY_RULES = f"""
WITH {_BLANK_WORDS},
c AS (SELECT word, string_split(translate({sql.normalize("word")}, '۰۱۲۳۴۵۶۷۸۹', '0123456789'), '') AS c FROM w),
p AS (SELECT word, c, list_transform(c, lambda x: coalesce({_MAP}[x], CASE WHEN x <= chr(127) THEN x WHEN regexp_full_match(x, '[{S.BLANK}]') THEN ' ' WHEN x = chr(8204) OR (regexp_full_match(x, '\\p{{M}}') AND regexp_full_match(x, '[{S.URDU_BLOCKS}]')) THEN '' ELSE x END)) AS p FROM c)
SELECT word, array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i > 1 AND c[i] IN {_IN_LETTERS} AND regexp_matches(right(p[i - 1], 1), '\\p{{L}}') AND right(p[i - 1], 1) NOT IN ('a', 'e', 'i', 'o', 'u')
  AND p[i] <> '' AND left(p[i], 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN 'a' || p[i] ELSE p[i] END), '') AS roman, array_to_string(p, '') AS bare FROM p"""


def roman_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words in Roman letters: curated spellings first."""
    listed = spark.createDataFrame([(w,) for w in [*letters.curated(), *R.PHRASES]], "word string")
    return _urdu_words(spark, sf_dir).union(listed).distinct().select("word", letters.to_roman(F.col("word")).alias("roman"))


def transliterated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lower-case words in Urdu letters, with what decided each: one word's whole text."""
    lowered = F.translate(F.col("text"), LATIN[26:], LATIN[:26])
    w = _read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(lowered, F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    found = w.select("word", letters.transliterate(F.col("word")).alias("x"))
    return found.select("word", F.col("x.text").alias("urdu"), F.element_at("x.sources", 1)["tag"].alias("tag"))


_WORD_MAP = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in R.LEXICON.items()) + "}"


def _runs(x: str, times: int) -> str:
    for c in LATIN[:26]:
        x = f"regexp_replace({x}, '{c}{{3,}}', '{c * times}', 'g')"
    return x


_GREETS = q("^(?:(?:as+ala+m(?:[ou])|wa?)?a?la[iy]+ku[mn])$")
TRANSLITERATED_WORDS = f"""
WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(translate(text, '{LATIN[26:]}', '{LATIN[:26]}'), '[a-z]+')) AS word FROM documents),
f AS (SELECT word, CASE WHEN word = 'k' THEN 'ke' ELSE word END AS a, {_runs("word", 2)} AS two, {_runs("word", 1)} AS one FROM w),
c AS (SELECT word, CASE WHEN {_WORD_MAP}[a] IS NOT NULL OR a = two THEN a WHEN {_WORD_MAP}[two] IS NOT NULL THEN two WHEN {_WORD_MAP}[one] IS NOT NULL THEN one WHEN word = 'k' THEN a ELSE two END AS form FROM f)
SELECT word, CASE WHEN word IN {sql.listed(sorted(R.KEPT_LATIN))} THEN word ELSE coalesce({_WORD_MAP}[form], {sql.rules_to_urdu("form")}) END AS urdu,
  CASE WHEN word IN {sql.listed(sorted(R.KEPT_LATIN))} THEN 'english' WHEN {_WORD_MAP}[form] IS NOT NULL THEN 'lexicon' ELSE 'rules' END AS tag FROM c"""


def transliteration_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the first 300 letters of each conversation's turn the lexicon and the rules decide."""
    found = _read(spark, sf_dir, "conversations").select("conv_id", "turn", letters.transliterate(F.col("text")).alias("x"))
    return found.select("conv_id", "turn", F.size("x.sources").cast("long").alias("tokens"), letters.coverage(F.col("x")).alias("c")).select("conv_id", "turn", "tokens", "c.*")


def consonant_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lafzspark.operators import channel

    return _urdu_words(spark, sf_dir).select("word", channel.urdu_key(F.col("word")).alias("key"))


def _keys_sql() -> str:
    from lafzspark.operators import channel

    classes = channel.URDU_CLASSES
    kept = "".join(classes.values())
    x = f"regexp_replace(translate(word, {q(kept)}, {q(''.join(c * len(own) for c, own in classes.items()))}), '[^{''.join(classes)}]', '', 'g')"
    x = f"CASE WHEN regexp_matches(word, '[A-Z]') THEN regexp_replace(translate(regexp_replace(word, '[A-Z]', '', 'g'), {q(kept)}, {q(''.join(c * len(own) for c, own in classes.items()))}), '[^{''.join(classes)}]', '', 'g') ELSE {x} END"
    for c in classes:
        x = f"regexp_replace({x}, '{c}+', '{c}', 'g')"
    return x


CONSONANT_KEYS = f"WITH {_BLANK_WORDS} SELECT word, {_keys_sql()} AS key FROM w"

QUERIES = {f.__name__: f for f in (
    parsed_numbers, parsed_ordinals, found_numbers, spaced_text, links_removed, presentation_forms, composed_texts, kept_tokens, stretched_grams, roman_by_rules, roman_words, transliterated_words,
    transliteration_shares, consonant_keys,
)}
ORACLE_SQL = {name: globals()[name.upper()] for name in QUERIES if name.upper() in globals()}
