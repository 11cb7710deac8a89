"""What queries at 1 GB need: tables are read once, work is counted in batches and dealt to all cores, with the same results."""

import itertools
import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from lafzspark.functions import plain
from lafzspark.functions import text as T
from lafzspark.operators import channel, corpus, langid, ranking
from tests.test_invariants import HOSTILE


def _watched(spark, rows, schema):
    """rows, and how many of them were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(run, schema), seen


def test_grams_are_counted_in_one_pass(spark):
    lines = [("ur", "یہ کتاب میری ہے اور میں اسے پڑھ رہا ہوں"), ("ar", "هذا الكتاب لي وأنا أقرأه الآن في البيت"), ("fa", "این کتاب من است و من آن را می خوانم")]
    rows, seen = _watched(spark, lines, "lang string, text string")
    model = langid.fit(langid.gram_counts(rows, 3), 3)
    assert langid.identify(spark.createDataFrame([(1, "میں کتاب پڑھ")], "doc_id long, text string"), model).first()["language"] == "ur"
    assert seen.value == 3


def test_counted_grams_against_brute_force():
    draw = random.Random(1)
    texts = ["".join(draw.choice("ابپ  تٹ") for _ in range(draw.randint(0, 30))) for _ in range(100)]
    held = Counter()
    for t in texts:
        p = f" {t} "
        held.update(p[i : i + n] for n in range(1, 7) for i in range(len(p) - n + 1) if n == 1 or p[i : i + n].strip(" "))
    assert langid.counted_grams(texts, 6) == held and langid.counted_grams([], 2) == Counter()


def test_bigrams_read_texts_once_for_a_channel(spark):
    rows, seen = _watched(spark, [("کتاب نام کتاب نام کتاب نام",), ("نام کتاب",)], "text string")
    words = spark.createDataFrame([("کتاب", 4), ("نام", 4)], "word string, n long")
    model = channel.from_tables(channel.Emissions(), words, None, *corpus.bigrams(rows, words))
    assert (model.bigrams, model.totals["کتاب"], seen.value) == ({"کتاب": {"نام": 3}, "نام": {"کتاب": 3}}, (3, 1), 2)


def test_spelling_is_dealt_to_all_cores(spark):
    words = spark.createDataFrame([(w,) for w in ("کتاب", "نام", "کام", "بات")], "word string")
    model = channel.Channel(channel.Emissions(), {"نام": 3}, {"نام": {"naam": 3}})
    found = channel.romanised_words(words, model)
    assert [tuple(r) for r in found.collect()] == [("نام", "naam")] and found.rdd.getNumPartitions() >= 4


def test_tokens_in_python_are_those_of_the_expressions(spark):
    for r in spark.createDataFrame([(t,) for t in HOSTILE if "\n" not in t], "t string").select("t", T.words(F.col("t")).alias("w")).collect():
        assert plain.words(r["t"]) == r["w"]


def _model():
    """More words under one key than are weighed one by one."""
    words = {f"ک{a}ت{b}": 3 + i for i, (a, b) in enumerate((a, b) for a in ["", *"اوی"] for b in ["", *"اویےئآ"])}
    row = {"ک": {"k": 0.9, "c": 0.1}, "ت": {"t": 1.0}, "ا": {"a": 0.7, "aa": 0.3}, "و": {"o": 0.6, "u": 0.4}, "ی": {"i": 0.8, "": 0.2}, "ے": {"e": 1.0}, "ئ": {"": 1.0}, "آ": {"a": 1.0}}
    return channel.Channel(channel.Emissions(letter=row), words, {"کات": {"kat": 5}, "کوتی": {"kuti": 2, "koti": 1}})


def test_words_weighed_at_once_are_those_weighed_one_by_one(monkeypatch):
    romans = ["kat", "kati", "kota", "kuti", "kt", "kaata", "kite", "zz", "ktttt"]
    at_once = [_model().candidates(r) for r in romans]
    monkeypatch.setattr(channel, "FEW", 10**9)
    assert at_once == [_model().candidates(r) for r in romans] and len(at_once[0]) > 3


def test_common_words_are_looked_up_once(spark, monkeypatch):
    romans = spark.createDataFrame([("kat", 3), ("kuti", 2), ("zz", 1)], "roman string, n long")
    model = channel.with_common(_model(), romans, most=2)
    assert sorted(model.common) == ["kat", "kuti"] and model.candidates("zz") == _model().candidates("zz")
    held = _model().candidates("kat")
    monkeypatch.setattr(channel.Channel, "_candidates", lambda self, roman: None)
    assert model.candidates("kat") == held


def test_turns_keys_are_dealt_to_all_cores(spark):
    rows = spark.createDataFrame([("kat", 1), ("Kat", 2), ("kuti", 3)], "word string, pos long")
    found = channel.variant_groups(rows, _model())
    assert sorted(r["variants"] for r in found.collect()) == [["kat", "Kat"], ["kuti"]]
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_scores_are_rounded_as_in_sql(spark):
    draw = random.Random(5)
    scores = [(draw.randrange(8 * 10**6, 8388608) * 10 + 5) / 10**7 for _ in range(20_000)]
    rows = spark.createDataFrame(list(enumerate(scores)), "i int, x double").select("i", ranking.rounded(F.col("x"), 6).alias("y"), F.round("x", 6).alias("z")).orderBy("i").collect()
    held = [r[0] for r in duckdb.execute("SELECT round(x, 6) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [scores]).fetchall()]
    assert [r["y"] for r in rows] == held and [r["z"] for r in rows] != held


def _pairs_one_by_one(text):
    before = corpus.START
    for w in plain.words(text):
        if w == "\n":
            before = corpus.START
        elif plain.is_urdu_word(w):
            yield before, w
            before = w
        else:
            before = corpus.UNKNOWN


def _counted(texts, behind=None):
    held = Counter()
    for batch in corpus.counted_neighbours(iter([pa.RecordBatch.from_arrays([pa.array([*texts, None], pa.string())], names=["t"])]), behind):
        for prev, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held[prev, word] += n
    return held


def test_pairs_of_words_against_one_by_one(monkeypatch):
    draw = random.Random(2)
    letters = [*"ابپکهيےیہك  \n\n\r\t\x0b\x1c\u0085\xa0‌ًٔ́.,@#:/12۵a", "ﷲ", "ﷺ", "ﹰ", "http://", "ﻻ", "www.", "é", "　"]
    texts = [*HOSTILE, *("".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(3000))]
    held = Counter(p for t in texts for p in _pairs_one_by_one(t))
    behind = {w for w, _ in list(held)[::3]}
    known = Counter({p: n for p, n in held.items() if p[0] in behind | {corpus.START, corpus.UNKNOWN}})
    assert _counted(texts) == held and _counted(texts, behind) == known and _counted([]) == Counter()
    monkeypatch.setattr(corpus, "HELD_PAIRS", 50)
    assert _counted(texts) == held


def test_pieces_of_text_are_normalised_once(monkeypatch):
    seen, own = [], plain.words
    monkeypatch.setattr(plain, "words", lambda text: seen.append(text) or own(text))
    assert _counted(["کتاب نام، کتاب۔ نام.\nکتاب"] * 50)["کتاب", "نام"] == 100
    assert len(seen) <= 4


def test_bigrams_behind_known_words(spark):
    rows = spark.createDataFrame([("کتاب نام کتاب نام کتاب نام بات نام\nبات",), ("نام کتاب کام",)], "text string")
    words = spark.createDataFrame([("کتاب", 4), ("نام", 4)], "word string, n long")
    whole, some = (channel.from_tables(channel.Emissions(), words, None, *corpus.bigrams(rows, words, **x)) for x in ({}, {"behind": {"کتاب", "نام"}}))
    assert (whole.bigrams, whole.totals) == (some.bigrams, some.totals) and some.totals["کتاب"] == (4, 2)


def _drawn_model(draw):
    """Letters that give several pieces, words of one key and several lengths, some of them attested."""
    row = lambda: {p: draw.random() for p in draw.sample(["", "k", "t", "a", "ka", "at", "i", "kat", "aa"], 5)}
    emissions = channel.Emissions(letter={c: {p: x / 5 for p, x in row().items()} for c in "کتاویےئ"})
    words = {"ک" + "".join(draw.choice("اویےئ") for _ in range(draw.randint(0, 5))) + "ت" + "".join(draw.choice("اویےئ") for _ in range(draw.randint(0, 3))): draw.randint(1, 900) for _ in range(400)}
    attested = {w: {draw.choice(["kat", "kaat", "kati", "kitaka"]): draw.randint(1, 9)} for w in list(words)[::3]}
    return channel.Channel(emissions, words, attested)


def test_words_that_cannot_win_are_dropped_without_loss(monkeypatch):
    draw = random.Random(4)
    models, romans = [_drawn_model(draw) for _ in range(4)], ["kat", "kaat", "kati", "kt", "kitaat", "kaaataka", "katakataka", "k" * 12 + "t"]
    at_once = [m._candidates(r) for m in models for r in romans]
    monkeypatch.setattr(channel, "FEW", 10**9)
    assert at_once == [m._candidates(r) for m in models for r in romans] and any(len(x) == 5 for x in at_once)


def test_sentences_look_up_a_word_before_once(monkeypatch):
    draw, words = random.Random(6), ["کات", "کوت", "کیت"]
    row = {"ک": {"k": 1.0}, "ت": {"t": 1.0}, "ا": {"a": 0.6, "o": 0.4}, "و": {"o": 0.6, "a": 0.4}, "ی": {"a": 0.5, "o": 0.5}}
    bigrams = {a: {b: draw.randint(1, 30) for b in words if draw.random() < 0.7} for a in words}
    totals = {a: (sum(own.values()) + 5, len(own) + 1) for a, own in bigrams.items() if own}
    model = channel.Channel(channel.Emissions(letter=row), {"کات": 5, "کوت": 4, "کیت": 9}, {}, bigrams, totals)
    run = ["kat", "kot", "kat", "kat", "kot"]

    def score(path):
        e = sum(dict(model.candidates(r))[w] for r, w in zip(run, path, strict=True))
        return e + model.lm_weight * sum(model.log_bigram(w, b) for b, w in itertools.pairwise(["<s>", *path]))

    best = max(itertools.product(words, repeat=len(run)), key=score)
    monkeypatch.setattr(channel.Channel, "log_bigram", None)
    assert [w for w, _ in model.decode(run, {})] == list(best)


def test_plain_letters_are_normalised_like_all_others(monkeypatch):
    letters = [chr(i) for i in range(0x600, 0x700)]
    texts = [a + b for a in letters for b in ["", *letters]]
    short = [plain.normal(t) for t in texts]
    monkeypatch.setattr(plain, "_PLAIN", re.compile("(?!)"))
    assert short == [plain.normal(t) for t in texts]
