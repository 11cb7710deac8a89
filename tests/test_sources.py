"""Files of any encoding, the command line, streams and SQL names."""

import codecs
import io

import pytest
from pyspark.sql import functions as F

from lafzspark import __main__ as cli
from lafzspark.plans import register
from lafzspark.sources import decoded_lines, read_documents, read_lexicon, read_lines, write_json_lines, write_lines
from lafzspark.sources.texts import InputError, looks_mangled
from lafzspark.streaming import event_counts, read_stream, word_counts

LINES = ["یہ ہے", "", "kya hai?"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-32"])
def test_encodings(spark, tmp_path, encoding):
    lines = LINES if encoding != "utf-16-le" else ["kya hai", "wo"]
    (tmp_path / "a.txt").write_bytes(("\n".join(lines) + "\n").encode(encoding))
    assert [r["line"] for r in read_lines(spark, str(tmp_path / "a.txt")).collect()] == lines


def test_bad_bytes_are_named():
    with pytest.raises(InputError, match="f, line 2: byte 0xFF is not utf-8"):
        decoded_lines(b"ok\n\xff\n", "f")
    with pytest.raises(InputError, match="unknown encoding"):
        decoded_lines(b"", "f", "nope")
    assert decoded_lines(codecs.BOM_UTF8 + b"a\r\nb", "f") == ["a", "b"]


def test_documents_lexicon_and_sinks(spark, tmp_path):
    (tmp_path / "d.txt").write_text("one\n\n  \ntwo\n")
    assert [r["text"] for r in read_documents(spark, str(tmp_path / "d.txt")).collect()] == ["one", "two"]
    spark.createDataFrame([(1, "x")], "id int, body string").write.parquet(str(tmp_path / "p"))
    assert read_documents(spark, str(tmp_path / "p")).collect()[0]["text"] == "x"
    (tmp_path / "l.tsv").write_text("Hai\tہے\nbad\n")
    assert read_lexicon(spark, str(tmp_path / "l.tsv")) == {"hai": "ہے"}
    rows = spark.createDataFrame([("یہ", 1)], "line string, n int")
    write_lines(rows, "line", str(tmp_path / "out"))
    write_json_lines(rows, str(tmp_path / "json"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "json")).collect()] == ['{"line":"یہ","n":1}']
    with pytest.raises(Exception, match="exists"):
        write_lines(rows, "line", str(tmp_path / "out"))
    asked = [r[0] for r in spark.createDataFrame([("????",), ("kya?? hai?",), ("??",)], "t string").select(looks_mangled(F.col("t"))).collect()]
    assert asked == [True, False, False]


@pytest.mark.parametrize(
    ("argv", "want"),
    [(["to-urdu", "kya", "hai?"], "کیا ہے؟"), (["to-urdu", "--latin-punctuation", "kya hai?"], "کیا ہے?"), (["to-roman", "میں"], "main"), (["to-roman", "--method", "rules", "میں"], "min"), (["normalize", "كتاب"], "کتاب"), (["words", "a, b"], "a b"), (["normalize", "--json", "كتاب"], '{"input":"كتاب","text":"کتاب"}')],
)
def test_commands(spark, argv, want):
    out = io.StringIO()
    cli.run(spark, cli.parser().parse_intermixed_args(argv), out)
    assert out.getvalue() == want + "\n"


def test_streams_count_as_tables_do(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/conversations.parquet").select("text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    query = word_counts(read_stream(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("lafz_words").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert sorted(map(tuple, spark.table("lafz_words").collect())) == sorted(map(tuple, word_counts(docs).collect()))


def test_windows_close_behind_the_watermark(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "e"))
    counted = event_counts(read_stream(spark, str(tmp_path / "e")), "ts", "event_type")
    query = counted.writeStream.format("memory").queryName("lafz_events").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = {tuple(r) for r in event_counts(spark.read.parquet(str(tmp_path / "e")), "ts", "event_type").collect()}
    assert {tuple(r) for r in spark.table("lafz_events").collect()} <= want


def test_sql_names(spark):
    register.register(spark)
    row = spark.sql("SELECT lafz_parse_number('dedh lakh') AS a, lafz_parse_ordinal('21st') AS b, lafz_normalize('كتاب') AS c, lafz_transliterate('kya hai').text AS d, lafz_parse_number(NULL) AS e, size(lafz_find_numbers('15 lakh')) AS f").first()
    assert tuple(row) == (150_000.0, 21, "کتاب", "کیا ہے", None, 1)
    assert [tuple(r) for r in spark.sql("SELECT text, value FROM lafz_number_rows('do lakh, 5k')").collect()] == [("do lakh", 200_000.0), ("5k", 5_000.0)]
