"""Published examples of each column function."""

import pytest
from pyspark.sql import functions as F

from lafzspark.functions import figures, letters
from lafzspark.functions import text as T

CASES = [
    (T.normalize, "string", {"كتاب": "کتاب", "کِتاب": "کتاب", "کـــتاب": "کتاب", "أحمد": "احمد", "ﻛﺘﺎﺏ": "کتاب", "ﷲ": "اللہ", "٣": "۳", "a \t\n  b  ": "a\nb", "": ""}),
    (lambda c: T.normalize(c, digits=True, punctuation=True), "string", {"۱۲۳": "123", "کیا؟": "کیا?"}),
    (T.resolve_heh, "string", {"بهی": "بھی", "کچه": "کچھ", "سنده": "سندھ", "نه": "نہ", "الله": "اللہ"}),
    (T.remove_links, "string", {"dekho http://x.co. phir": "dekho. phir", "a\nhttp://x.co\nb": "a\n\nb", "x@y.co": ""}),
    (T.words, "string", {"رابطہ: test@x.com یا 0300-1234567": ["رابطہ", "test@x.com", "یا", "0300-1234567"], "": []}),
    (lambda c: T.words(c, True), "string", {"کیا، واقعی؟": ["کیا", "،", "واقعی", "؟"]}),
    (T.sentences, "string", {"یہ ہے۔ وہ ہے؟  ok. x": ["یہ ہے۔", "وہ ہے؟", "ok.", "x"], "": []}),
    (T.fix_spacing, "string", {"اس نے کام کردیا۔": "اس نے کام کر دیا۔", "کردیانہ": "کردیانہ"}),
    (T.stem, "string", {"کتابوں": "کتاب", "لڑکیاں": "لڑک", "کرتا": "کرت", "پڑھتا": "پڑھ", "گاؤں": "گاؤں"}),
    (lambda c: T.stem(c, light=True), "string", {"پڑھتا": "پڑھت"}),
    (lambda c: T.stem(c, min_stem=2), "string", {"کرتا": "کر"}),
    (lambda c: T.remove_stopwords(F.split(c, " ")), "string", {"یہ اچھا نہیں ہے": ["اچھا", "نہیں"]}),
    (T.character_ngrams, "string", {"ab": ["<ab", "ab>"], "": [], "a": ["<a>"]}),
    (T.is_urdu, "string", {"کتاب": True, "abc": False, "12": False}),
    (figures.format_number, "double", {1234567.0: "12,34,567", -0.0: "0", 1e-05: "0.00001", 1.5e20: "15,00,00,00,00,00,00,00,00,000", -12345.5: "-12,345.5", 1e-16: "0.0000000000000001", 0.0012345678901234567: "0.0012345678901234567", 1e25: "1,00,00,00,00,00,00,00,00,00,00,00,000", float("nan"): None, float("-inf"): None, 0.5: "0.5", 1000.0: "1,000"}),
    (figures.number_to_words, "long", {150000: "ایک لاکھ پچاس ہزار", 10**7: "ایک کروڑ", 0: "صفر", -1: None, 10**13: None}),
    (letters.rules_to_urdu, "string", {"ali": "الی"}),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_examples(spark, number):
    function, kind, cases = CASES[number]
    rows = spark.createDataFrame([(x,) for x in [*cases, None]], f"x {kind}").select(function(F.col("x"))).collect()
    assert [r[0] for r in rows] == [*cases.values(), None]


def test_normalising_twice_changes_nothing(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(T.normalize(F.col("text")).alias("x"))
    assert texts.where(~T.normalize(F.col("x")).eqNullSafe(F.col("x"))).count() == 0
