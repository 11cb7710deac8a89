"""What must hold for any text: hostile and random ones."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lafzspark.functions import guards, letters, numbers, plain
from lafzspark.functions import text as T
from lafzspark.operators import corpus, evaluate

HOSTILE = [
    "", " ", "\n\n", "\x00\x1b[31m", "\ufeffab", "\u200cکتاب\u200d", "ﷲ ﻻ ﺁ", "😀" * 50, "👨\u200d👩\u200d👧", "a" * 40_000, "http://" * 500, "@" * 2000, "a@" * 2000 + "b", "۱۲۳،۴۵۶" * 200,
    " " * 64_000 + "x", "\n " * 5000, "َ" * 500, "é" + "\u0301" * 300, "-e-" * 300, "?!" * 800, "ek " * 2000, "A.B.C." * 300, "نننن" * 500, "\ue000\ue001\ue002",
]


def test_hostile_texts(spark):
    began = time.time()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "i int, t string")
    c = F.col("t")
    found = rows.select("i", "t", T.normalize(c).alias("n"), T.words(c, True).alias("w"), T.sentences(c).alias("s"), T.remove_links(c).alias("l"), letters.transliterate(c).alias("x"), numbers.find_numbers(c).alias("f"), letters.to_roman(c).alias("r"), T.fix_spacing(c).alias("p"))
    for r in found.collect():
        assert r["n"] == plain.normal(r["t"]), r["i"]
        at = 0
        for w in r["w"]:
            at = r["n"].index(w, at) + len(w)
        assert "".join("".join(r["w"]).split()) == "".join(r["n"].split()), r["i"]
        assert all(r["t"].encode("utf-16-le", "surrogatepass").decode("utf-16-le")[s["start"] : s["end"]] == s["text"] for s in r["f"])
        assert [s["token"] for s in r["x"]["sources"]] is not None and r["l"] is not None and r["r"] is not None and r["p"] is not None
    again = found.select("n").where(~T.normalize(F.col("n")).eqNullSafe(F.col("n")))
    assert again.count() == 0 and time.time() - began < 60


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abz -.,?!@#/:۱5کهي آ\u0654\u0640\u200c\u200d\ufe8e\ufdf2\n"), st.characters()), max_size=40))
def test_any_text(text):
    once = plain.normal(text)
    assert plain.normal(once) == once
    out = letters.Reader({}).read(text)
    assert "".join(t for t, _, _ in out) == plain.clean(text)
    assert "".join("".join(t for t, _ in letters.roman_tokens(text)).split()) == "".join(text.split())
    for s in numbers.spans(text):
        assert text[s["start"] : s["end"]] == s["text"]


def test_guards(spark):
    rows = spark.createDataFrame([(1, "a", ["b"])], "n int, t string, w array<string>")
    guards.require_text(rows, "t", "f")
    guards.require_words(rows, "w", "f")
    with pytest.raises(TypeError, match=r"f\(\) takes a STRING column, n is INT"):
        guards.require_text(rows, "n", "f")
    with pytest.raises(TypeError, match="t is STRING"):
        guards.require_words(rows, "t", "f")
    for bad in (True, float("nan"), 1.5, "1"):
        with pytest.raises(ValueError, match="threshold"):
            T.is_urdu(F.col("t"), bad)


def test_english_stays_when_told_apart():
    reader = letters.Reader({"hai": "ہے"}, tags=lambda ws: ["en" if w == "Hello" else "ur" for w in ws])
    assert [(w, t) for _, w, t in reader.read("Hello, email hai?") if t != "space"] == [("Hello", "english"), (",", "passthrough"), ("email", "english"), ("ہے", "lexicon"), ("؟", "punctuation")]


def test_chains_arms_and_digests(spark):
    pairs = spark.createDataFrame([("<s>", "a", 3), ("a", "b", 1), ("b", "c", 9), ("b", "d", 1)], "prev string, word string, n long")
    lines = [r["line"] for r in corpus.chained_lines(pairs, 50, 5).collect()]
    assert len(lines) == 50 and set(lines) <= {"a b c", "a b d"} and lines.count("a b c") > lines.count("a b d")
    rows = spark.createDataFrame([("x", [0.0, 2.0], 1), ("x", [0.0, 2.0], 0), ("y", [3.0, 0.0], 0)], "g string, scores array<double>, truth int")
    arms = {r["g"]: r for r in evaluate.calibration_arms(rows, "g", 1.0).collect()}
    assert arms["x"]["accuracy"] == 0.5 and arms["y"]["ece"] == pytest.approx(1 - 0.9526, abs=1e-3)
    assert evaluate.balanced(evaluate.calibration_arms(rows, "g", 1.0)).first()["accuracy"] == 0.75
    assert set(evaluate.left_out(rows, "g")) == {"x", "y"}
    same = corpus.inputs_digest({"a": 1}, {"t": pairs})
    assert same == corpus.inputs_digest({"a": 1}, {"t": pairs.orderBy(F.desc("n"))}) != corpus.inputs_digest({"a": 2}, {"t": pairs})
