"""Language identification, tagging and the channel, on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from lafzspark.operators import channel, corpus, evaluate, langid, ranking, tagging

LINES = [("ur", "یہ کتاب میری ہے اور میں اسے پڑھ رہا ہوں"), ("ar", "هذا الكتاب لي وأنا أقرأه الآن في البيت"), ("fa", "این کتاب من است و من آن را می خوانم")]


def test_languages_against_brute_force(spark):
    train = spark.createDataFrame(LINES, "lang string, text string")
    model = langid.fit(langid.gram_counts(train, 3), 3)
    texts = [(1, "میں کتاب پڑھ"), (2, "هذا البيت"), (3, "abc"), (4, None), (5, "این")]
    found = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}

    def grams(t):
        p = f" {t} "
        return [p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if n == 1 or p[i : i + n].strip()]

    counts = {c: {g: grams(t).count(g) for g in grams(t)} for c, t in LINES}
    size = len({g for c in counts.values() for g in c})
    for i, t in texts:
        if not t or t.isascii():
            assert (found[i]["language"], found[i]["margin"], found[i]["ranking"], found[i]["short"]) == (None, 0.0, [], True)
            continue
        scores = {c: sum(math.log((own.get(g, 0) + 0.03) / (sum(own.values()) + 0.03 * size)) for g in grams(t)) for c, own in counts.items()}
        order = sorted(scores, key=lambda c: (-scores[c], c))
        assert [r["code"] for r in found[i]["ranking"]] == order
        assert [r["score"] for r in found[i]["ranking"]] == pytest.approx([scores[c] for c in order])
        assert found[i]["margin"] == round((scores[order[0]] - scores[order[1]]) / len(t), 4)
    assert found[1]["name"] == "Urdu" and "ہ" not in found[2]["evidence"].get("ur", [])


def test_keys_cover_and_meet(spark):
    words = ["وزیراعظم", "اسٹیشن", "کتاب", "چھوٹا", "ABC"]
    keys = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(channel.urdu_key(F.col("w"))).collect()]
    assert keys == [channel.key_of(w) for w in words] == ["ZRZM", "STSN", "KTP", "CT", ""]
    assert "STSN" in channel.roman_keys("istation") and "KTP" in channel.roman_keys("kitab")
    assert channel.covers("کتاب", "kitab") and not channel.covers("وزیراعظم", "wazir") and channel.covers("وزیراعظم", "wazir e azam".replace(" ", ""))
    assert len(channel.roman_keys("sgcmsgcmsgcmsgcm")) <= channel.MOST_KEYS


PAIRS = [("کتاب", "kitab", 9), ("کتاب", "kitaab", 3), ("میں", "main", 8), ("نام", "naam", 6), ("کام", "kaam", 6), ("بات", "baat", 5), ("رات", "raat", 5), ("دن", "din", 4), ("کان", "kaan", 2), ("مکان", "makan", 4)]


@pytest.fixture(scope="module")
def model(spark):
    pairs = spark.createDataFrame(PAIRS, "urdu string, roman string, n long")
    emissions = channel.train_emissions(pairs, 4)
    vocabulary = pairs.groupBy(F.col("urdu").alias("word")).agg(F.sum("n").alias("n"))
    return pairs, emissions, vocabulary, channel.from_tables(emissions, vocabulary, pairs)


def test_expected_pieces_are_shares_of_all_dealings():
    found = channel.expected_pieces("کت", "kt", None)
    by_letter = {}
    for (letter, _, _), _, n in found:
        by_letter[letter] = by_letter.get(letter, 0) + n
    assert by_letter == pytest.approx({"ک": 1.0, "ت": 1.0})
    assert channel.expected_pieces("ک", "kkkkk", None) == []


def test_training_learns_letters(model):
    _, emissions, _, found = model
    assert max(emissions.letter["ک"], key=emissions.letter["ک"].get)[0] == "k"
    for table in (emissions.letter, emissions.place, emissions.full):
        assert all(sum(row.values()) <= 1 + 1e-9 for row in table.values())
    assert emissions.log("کتاب", "kitab") > emissions.log("کتاب", "makan")


def test_candidates_by_join_are_those_of_the_model(spark, model):
    pairs, emissions, vocabulary, found = model
    romans = ["kitab", "naam", "raat", "kaam"]
    rows = channel.candidate_rows(spark.createDataFrame([(r,) for r in romans], "roman string"), vocabulary, emissions, pairs).orderBy("roman", "rank").collect()
    for roman in romans:
        mine = [(r["word"], r["emission"]) for r in rows if r["roman"] == roman]
        assert [w for w, _ in mine] == [w for w, _ in found.candidates(roman)]
        assert [e for _, e in mine] == pytest.approx([e for _, e in found.candidates(roman)])


def test_decoding_and_spelling(spark, model):
    found = model[3]
    assert [w for w, _ in found.decode(["naam", "kitab"], {})] == ["نام", "کتاب"]
    assert found.decode(["kitab", "pata"], {"pata": "پتہ"})[1] == ("پتہ", "lexicon")
    assert found.decode([], {}) == [] and found.romanised("کتاب") == "kitab"
    assert found.key("nahi!") == "نہیں" and found.key("Kitab") == "کتاب" and found.key("کِتاب") == "کتاب"
    rows = spark.createDataFrame([("nahi", 1), ("kitab", 2), ("nhi", 3), ("nahi", 4), ("kitaab", 5)], "word string, pos long")
    assert {r["key"]: r["variants"] for r in channel.variant_groups(rows, found).collect()} == {"نہیں": ["nahi", "nhi"], "کتاب": ["kitab", "kitaab"]}
    text = spark.createDataFrame([("mera naam hai, kitab.\nraat",)], "t string").select(channel.transliterate(F.col("t"), found, spark).alias("x")).first()["x"]
    assert text["text"] == "میرا نام ہے، کتاب۔\nرات"
    pair = channel.Channel(model[1], {"کتاب": 5, "نام": 5, "کتابنام": 50}, {"کتاب": {"kitab": 9}, "نام": {"naam": 9}})
    assert "".join(w for _, w, _ in channel.SentenceReader(pair).read("kitab-e-naam")) == "کتابنام"
    assert "".join(w for _, w, _ in channel.SentenceReader(found).read("kitab-e-naam")) == "کتاب نام"
    assert "".join(w for _, w, _ in channel.SentenceReader(found).read("ye-e-kitab")) == "یۂ کتاب"
    best = {r["roman"]: (r["urdu"], r["tag"]) for r in channel.best_words(spark.createDataFrame([("Kitab",), ("nahi",), ("zzz",)], "roman string"), found).collect()}
    assert best["Kitab"] == ("کتاب", "vocabulary") and best["nahi"] == ("نہیں", "lexicon") and best["zzz"][1] == "rules"
    with pytest.raises(ValueError, match="vocabulary"):
        channel.from_tables(model[1], model[2], most=2)


def test_tags_against_all_sequences(spark):
    words = lambda *w: spark.createDataFrame([(x, n) for n, x in enumerate(w, 1)], "word string, n long")
    urdu, english = words("kal", "baje", "gayi", "karo"), words("meeting", "cancel", "report", "office")
    t = tagging.Tagger(tagging.side(urdu, urdu), tagging.side(english, english))
    text = ["kal", "meeting", "cancel", "ho", "gayi", "hai"]
    import itertools

    def score(tags):
        total = sum(t.both(w)[k] for w, k in zip(text, tags, strict=True))
        return total + sum(math.log(0.8 if a == b else 0.2) for a, b in itertools.pairwise(tags))

    best = max(itertools.product((0, 1), repeat=len(text)), key=score)
    assert t.tags(text) == [("ur", "en")[k] for k in best] and t.tags([]) == []
    assert t.tagged("kal 3 baje, x1 a@b.co é") == [("kal", "ur"), ("3", "num"), ("baje", "ur"), (",", "punct"), ("x1", "code"), ("a@b.co", "id"), ("é", "other")]
    assert math.isfinite(t.english.log("z" * 400)) and t.both("hai")[1] == -math.inf
    row = spark.createDataFrame([("kal meeting",)], "t string").select(tagging.tag_roman(F.col("t"), t, spark).alias("x")).first()["x"]
    assert [r["token"] for r in row] == ["kal", "meeting"]


def test_b_cubed_by_hand(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 1, "y"), ("d", 2, "y")], "item string, cluster int, gold string")
    r = ranking.b_cubed(rows).first()
    assert (r["precision"], r["recall"]) == (round((2 / 3 + 2 / 3 + 1 / 3 + 1) / 4, 4), round((1 + 1 + 0.5 + 0.5) / 4, 4))


def test_planted_duplicates_and_letters(spark):
    line = "یہ ایک لمبی سی سطر ہے جو دو جگہ ہے"
    rows = spark.createDataFrame([("a", line), ("b", "یہ  ایک لمبِی سی سطـر ہے جو دو جگہ ہے "), ("a", "short"), ("b", "short"), ("a", "own line of some length here")], "label string, line string")
    found = corpus.cross_label_duplicates(rows, "label", "line").collect()
    assert [(r["labels"], r["n"]) for r in found] == [(["a", "b"], 2)]
    assert corpus.join_back(rows, corpus.cross_label_duplicates(rows, "label", "line"), "line").count() == 2


def test_samples_splices_and_lines(spark):
    assert [r["id"] for r in corpus.every_kth(spark.range(10), "id", 4).orderBy("id").collect()] == [0, 2, 5, 7]
    row = spark.createDataFrame([("a b c d", "x y", 5)], "u string, e string, k long").select(corpus.splice(F.col("u"), F.col("e"), F.col("k")).alias("s")).first()["s"]
    assert [r["token"] for r in row if r["tag"] == "ur"] == list("abcd") and 1 <= sum(r["tag"] == "en" for r in row) <= 2
    words = spark.createDataFrame([("a", 90), ("b", 10)], "word string, n long")
    lines = corpus.shuffled_lines(words, 200, 3).collect()
    drawn = [w for r in lines for w in r["line"].split()]
    assert len(lines) == 200 and 0.85 < drawn.count("a") / len(drawn) < 0.95
    assert {r["line"] for r in corpus.shuffled_lines(words, 200, 3).collect()} == {r["line"] for r in lines}


def test_selection_and_temperatures(spark):
    assert evaluate.worse({"a": (0, 9), "b": (5, 5)}) == "a" and evaluate.worse({"a": (9, 0)}) is None and evaluate.worse({"a": (0, 5), "b": (0, 4)}) is None
    z, p = evaluate.two_proportions(50, 100, 50, 100)
    assert (z, p) == (0.0, 1.0)
    rows = spark.createDataFrame([([0.0, 4.0], int(i % 10 < 8)) for i in range(100)], "scores array<double>, truth int")
    assert evaluate.fit_temperature(rows)[0] == pytest.approx(4 / math.log(4), rel=0.02)
    assert spark.createDataFrame([(8, 10), (0, 0)], "h int, n int").select(evaluate.wilson(F.col("h"), F.col("n")).alias("w")).collect()[1]["w"] is None
