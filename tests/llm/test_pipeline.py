"""The pipeline's stages against brute force over their own inputs."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from lafzspark.llm import private_data, toxicity
from tests.llm.test_dealt import ODD, brute_components, brute_contamination, documents, texts

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    again = docs.where("doc_id < 3")
    docs = docs.union(again).union(again.limit(1).withColumn("doc_id", F.lit(None).cast("long"))).union(again.limit(1).withColumn("text", F.lit(None).cast("string")))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        after = spark.createDataFrame(made.collect(), made.schema)
        given, left = texts(docs), None
        if name != "mixing":
            assert after.columns == docs.columns
            left = sorted(texts(after), key=repr)
        if name == "toxicity":
            bad = {(r["doc_id"]) for r in toxicity.toxicity(docs, labels).where("predicted = 1").collect()}
            assert left == sorted((x for x in given if x[0] not in bad), key=repr)
        elif name == "ngram_jaccard_join":
            groups = brute_components(given)
            want = sorted({d for d, _, c in groups if d == c and d is not None})
            assert sorted(d for d, _ in left if d is not None) == want
        elif name == "benchmark_decontamination":
            clean = {(d) for d, _, hit, _ in brute_contamination(given, bench, 10) if not hit}
            assert left == sorted((x for x in given if x[0] in clean), key=repr)
        elif name == "private_data":
            trie = private_data.automaton()
            assert left == sorted(((d, private_data.masked(t, private_data.find(trie, t)) if t else t) for d, t in given), key=repr)
        else:
            assert sorted(r["doc_id"] or -1 for r in after.collect()) == sorted((d or -1) for d, _ in given)
        docs = after
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_with_odd_rows_extra_columns_and_empty_tables(spark):
    """Nulls, repeated rows, very long texts and columns whose names clash with those that the operators use."""
    odd = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for frame, most in ((odd, len(ODD)), (odd.limit(0), 0)):
            made = stage(spark, frame, SF)
            found = made.collect()
            assert len(found) <= most, name
            if name != "mixing":
                assert made.columns == odd.columns
                assert {r["doc_id"] for r in found} == ({r[0] for r in ODD} if most else set()) or name == "ngram_jaccard_join"
            elif most:
                assert len(found) == most


def test_no_operator_swallows_import_errors():
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    for f in [root / "corpus_pipeline.py", *(root / "lafzspark" / "llm").glob("*.py")]:
        assert not re.search(r"except (ImportError|ModuleNotFoundError|Exception)|except:", f.read_text()), f
