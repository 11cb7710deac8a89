"""Letters both ways, with what decided each token."""

import pytest
from pyspark.sql import functions as F

from lafzspark.functions import letters
from lafzspark.functions import text as T
from lafzspark.resources import roman as R

TEXTS = {
    "mera naam Ali hai": ("میرا نام الی ہے", "lexicon rules rules lexicon"),
    "Dr. Ali, kya hal h?": ("ڈاکٹر الی، کیا ہال ہے؟", "lexicon passthrough rules punctuation lexicon rules lexicon punctuation"),
    "PIA ki BBC U.S.A": ("پی آئی اے کی بی بی سی یو ایس اے", "acronym lexicon acronym acronym"),
    "KYA HAAL HAI": ("کیا ہال ہے", "lexicon rules lexicon"),
    "assalam o alaikum": ("السلام علیکم", "lexicon"),
    "nahiii yr": ("نہیں یار", "lexicon lexicon"),
    "iPhone pe lol http://x.co. 5th 2.5": ("iPhone پے lol http://x.co. 5th 2.5", "english lexicon english identifier passthrough passthrough passthrough"),
    "یہ hai...": ("یہ ہے...", "already-urdu lexicon passthrough passthrough passthrough"),
    "aur-e-hai mera-o-meri": ("اور ہے میرا و میری", "lexicon izafat lexicon lexicon izafat lexicon"),
    "mera-e-hai": ("میرائے ہے", "lexicon izafat lexicon"),
    "a \n\tb\x00": ("ا \n\tب", "rules rules"),
}


def test_transliteration(spark):
    rows = spark.createDataFrame([(k,) for k in TEXTS], "t string").select("t", letters.transliterate(F.col("t")).alias("x")).collect()
    for r, (urdu, tags) in zip(rows, TEXTS.values(), strict=True):
        assert (r["x"]["text"], " ".join(s["tag"] for s in r["x"]["sources"])) == (urdu, tags), r["t"]
        assert {s["tag"] for s in r["x"]["sources"]} <= set(R.SOURCE_TAGS)


def test_marks_stay_latin_when_asked(spark):
    row = spark.createDataFrame([("kya hai?",)], "t string").select(letters.transliterate(F.col("t"), urdu_punctuation=False)["text"]).first()
    assert row[0] == "کیا ہے?"


def test_larger_tables_are_parameters():
    assert letters.Reader({"ali": "علی"}, {"naam": "نام"}).read("Ali naam") == [("Ali", "علی", "lexicon"), (" ", " ", "space"), ("naam", "نام", "vocabulary")]


def test_coverage(spark):
    found = spark.createDataFrame([("mera naam یہ hai",), ("12",)], "t string").select(letters.coverage(letters.transliterate(F.col("t"))).alias("c")).collect()
    assert [tuple(r["c"]) for r in found] == [(0.5, 0.25, 0.25), (0.0, 0.0, 0.0)]


ROMAN = {"کھانا 😀 جملہ؟ میں": ("khana 😀 jamalah? min", "khana 😀 jmlh? min", "khana 😀 jamalah? main"), "وزیر اعظم زندہ باد ۱۲": ("ozir aazam zanadah bad 12", "ozir aazm zndh bad 12", "wazir-e-azam zindabad 12"), "": ("", "", "")}


def test_roman(spark):
    c = F.col("t")
    rows = spark.createDataFrame([(k,) for k in ROMAN], "t string").select(letters.rules_to_roman(c), letters.rules_to_roman(c, False), letters.to_roman(c)).collect()
    assert [tuple(r) for r in rows] == list(ROMAN.values())


def test_stretched_words():
    assert letters.collapsed("nahiii", {"nahi": "x"}) == "nahi"
    assert letters.collapsed("bohttt", {}, {"boht": 1.0}.get and (lambda w: {"boht": 1.0}.get(w, 0.0))) == "boht"
    assert letters.collapsed("hmmm", {}) == "hmm" and letters.collapsed("Accha", {}) == "accha"


@pytest.mark.parametrize(("text", "want"), [("ab http://x.co c", "ab c"), ("x@y.co,z", ",z"), ("a@b #c d", "a d"), ("see www.x.y.", "see.")])
def test_links_leave_and_all_else_stays(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.remove_links(F.col("t"))).first()[0] == want


def test_marks_compose_in_any_script(spark):
    row = spark.createDataFrame([("é ǖ آ ḱ",)], "t string").select(T.compose(F.col("t"))).first()
    assert row[0] == "é ǖ آ ḱ"
