"""The ten operators against brute force, on the smallest tables and on hand-made rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lafzspark.llm import chat, decontaminate, labelled, mixing, mtree, private_data, quality, registry, shingle_join, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, "a b c d e f g h", "x"),
    (1, "a b c d e f g h", "x"),
    (2, None, None),
    (3, "", "y"),
    (4, "  \n\t ", "y"),
    (5, "one", None),
    (None, "a b c d e f g h i", "x"),
    (6, "wörd " * 30_000, "z"),
    (7, "x" * 100_000, "z"),
    (8, "é ü ß \U0001f600 tail end", "z"),
]


def documents(spark, rows=ODD):
    """With extra columns whose names clash with those that operators use themselves."""
    made = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, source string, i int")
    return made.select("doc_id", "text", "source", *[F.lit(1).alias(c) for c in ("node", "size", "word", "n", "row", "chunk", "label", "p", "target", "b_source")])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(frame):
    return [(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# 1


def brute_dedup(found, window):
    words = [WORD.findall(t or "") for _, t in found]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(found, words, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [3, 35])
def test_dedup(spark, docs, window):
    for frame in (docs, documents(spark)):
        found = substring_dedup.substring_dedup(frame, window)
        n = F.aggregate("removed", F.lit(0), lambda a, x: a + x["end"] - x["start"]).alias("n_removed")
        assert rows(found.select("doc_id", "n_words", n, "kept_text"), "doc_id", "n_words", "n_removed", "kept_text") == brute_dedup(texts(frame), window)


# 2 and 10


def damerau(a, b):  # with swaps of neighbours, each letter edited once
    d = np.zeros((len(a) + 1, len(b) + 1), int)
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[-1, -1]


def planted(spark):
    clean = [(i, f"the cat sat on mat number {i} and looked at the sea " * 3) for i in range(400)]
    bad = [(1000 + i, f"the cat {w} sat on mat {i} you {w} and the sea " * 2) for i in range(150) for w in ("blockhead", "nitwitted", "gloop")]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(clean + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k >= len(clean)), int(k < len(clean))) for k in range(len(clean + bad))], "doc_id long, toxic int, quality int")
    return docs, labels


def test_toxicity_finds_misspelled_terms_and_spares_quotations(spark):
    docs, labels = planted(spark)
    more = [
        (9001, "what a blokchead he is , you blokchead"), (9002, "you blockhaed and your blockheed friend"), (9003, "the sea and the cat sat on a mat"),
        (9004, ""), (9005, None), (9006, "You NITWITTED fool"), (None, "you gloop"),
    ]
    frame = docs.union(spark.createDataFrame(more, "doc_id long, text string"))
    found = {r["doc_id"]: r for r in toxicity.toxicity(frame, labels).collect()}
    assert [found[i]["predicted"] for i in (9001, 9002, 9003, 9004, 9005, 9006, None)] == [1, 1, 0, 0, 0, 1, 1]
    assert found[9004]["score"] == found[9005]["score"] == found[9003]["score"]
    assert all(found[r["doc_id"]]["predicted"] == r["toxic"] for r in labels.collect())
    assert found[9001]["score"] > 0.5 > found[9003]["score"]


def test_toxicity_catches_misspelled_terms_in_real_texts(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    clean = [r["text"].split()[:95] for r in docs.join(labels.where("toxic = 0"), "doc_id").where(labelled.is_held_out(F.col("doc_id"), 4, 2)).where(F.size(F.split("text", " ")) >= 120).orderBy("doc_id").limit(100).collect()]
    wrong = ["idoit", "wortless", "patehtic", "disgustting", "stupidd"]
    made = [(10_000_000 + i, " ".join(w)) for i, w in enumerate(clean)]
    made += [(20_000_000 + i, " ".join([*w[:50], *wrong, *w[50:]])) for i, w in enumerate(clean)]
    made += [(30_000_000 + i, " ".join([*w, "oron", "oron"])) for i, w in enumerate(clean)]
    found = toxicity.toxicity(docs.union(spark.createDataFrame(made, "doc_id long, text string")), labels).where("doc_id >= 10000000")
    rate = {r["part"]: r["rate"] for r in found.groupBy(F.expr("doc_id DIV 10000000").alias("part")).agg(F.avg("predicted").alias("rate")).collect()}
    assert len(clean) == 100 and rate[2] > 0.95 and rate[1] < 0.05 and rate[3] < 0.05


def test_levenshtein_automata_agree_with_distance():
    entries = ["abcde", "abdce", "aab", "abcabcabca"]
    automaton = toxicity.Automaton([(e, False) for e in entries])
    rng = np.random.default_rng(0)
    words = {"".join(rng.choice(list("abcde"), n)) for n in (2, 3, 4, 5, 6) for _ in range(400)}
    for e in entries:
        words |= {e[:i] + c + e[i + k :] for i in range(len(e)) for k in (0, 1, 2) for c in ("", "z", "ab")}
    allowed = {e: 0 if len(e) < 5 else 1 if len(e) < 9 else 2 for e in entries}
    for w in sorted(words):
        want = min((damerau(w, e) for e in entries if damerau(w, e) <= allowed[e]), default=None)
        assert automaton.edits(w) == want, w
    stem = toxicity.Automaton([("abcde", True)])
    assert [stem.edits(w) for w in ("abcdexyz", "abcxexyz", "abxxexyz", "abcd")] == [0, 1, None, 1]


@pytest.mark.parametrize(("name", "label", "modulus", "held"), [("op2_toxicity", "toxic", 4, 2), ("op10_quality", "quality", 5, 0)])
def test_models_on_held_out_rows(spark, name, label, modulus, held):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = registry.QUERIES[name](spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    both = found.join(labels, "doc_id").where("held_out").collect()
    positive = [r["score"] for r in both if r[label] == 1]
    negative = [r["score"] for r in both if r[label] == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in positive for n in negative])
    assert auc > 0.8
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in both)


def test_models_with_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    for f in (toxicity.toxicity, quality.quality):
        for table in (labels, labels.limit(0)):
            assert f(documents(spark), table).count() == len(ODD)
        assert f(documents(spark).limit(0), labels).count() == 0


def test_quality_scores_are_sums_over_tables(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train_model(docs.select("doc_id", "text"), labels)
    assert any(np.abs(t).max() > 0 for t in model["tables"])
    place = lambda edges, v: sum(v >= e for e in edges)

    def brute(text):
        x = quality.features((text or "").encode())
        z = model["base"] + sum(t[place(e, v)] for e, t, v in zip(model["edges"], model["tables"], x, strict=True))
        z += sum(t[place(model["coarse"][i], x[i]), place(model["coarse"][j], x[j])] for i, j, t in model["pairs"])
        return 1 / (1 + np.exp(-z))

    want = {i: brute(t) for i, t in texts(docs)}
    for r in quality.quality(docs, labels).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_toxicity_scores_are_those_of_counted_hits(spark):
    docs, labels = planted(spark)
    model = toxicity.train_model(docs, labels)
    assert model.entries
    allowed = {}
    for text, stem in model.entries:
        n = 0 if len(text) < toxicity.ONE_EDIT else 1 if len(text) < toxicity.TWO_EDITS else 2
        allowed[text, stem] = 0 if (text, stem) in model.exact else min(n, 1) if stem else n

    def edits(word):
        found = [min(damerau(word[:k], t) for k in range(len(word) + 1)) if stem else damerau(word, t) for t, stem in model.entries]
        near = [d for d, e in zip(found, model.entries, strict=True) if d <= allowed[e]]
        return None if not near or (min(near) and word in model.ordinary) else min(near)

    some = ["what a blokchead he is you nitwited", "she said \"you gloop\" and left", "he \" is\na gloop and a blockhead", "", "the cat sat", "You BLOCKHEAD! blockhaed"]
    some += [r["text"] for r in docs.where("doc_id % 97 = 0").collect()]
    for text in some:
        words, plain, close, quoted = re.findall(r"[^\W_]+", text.lower()), 0, 0, 0
        for m in re.finditer(r"[^\W_]+", text.lower()):
            e = edits(m[0])
            if e is None:
                continue
            line = text[text.rfind("\n", 0, m.start()) + 1 :].split("\n")[0]
            at = m.start() - (text.rfind("\n", 0, m.start()) + 1)
            inside = line[:at].count('"') % 2 == 1 and '"' in line[at:]
            before = re.findall(r"[^\W_]+", text.lower()[: m.start()])[-toxicity.CONTEXT :]
            if inside or set(before) & toxicity.REPORTING:
                quoted += 1
            elif e:
                close += 1
            else:
                plain += 1
        hits = plain + model.share * close
        z = np.dot(model.weights, [np.log1p(hits), np.log1p(quoted), 100 * hits / max(len(words), 1), 1.0])
        assert toxicity.scores(model)([text])[0] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9), text


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert np.mean((quality.score(model, x[3000:]) > 0.5) == y[3000:]) > 0.9


# 3


def brute_contamination(found, items, window):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = defaultdict(set)
    for item, text in items:
        w = norm(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins[tuple(w[i : i + window])].add(str(item))
    sizes = {len(k) for k in wins}
    out = []
    for doc, text in found:
        w, hit, who = norm(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in wins:
                    hit.update(range(i, i + n))
                    who |= wins[k]
        out.append((doc, len(w), len(hit), sorted(who)))
    return sorted(out, key=repr)


def test_decontaminate(spark, docs):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    odd = spark.createDataFrame([(1, "A, b C"), (2, None), (3, "..."), (4, "b c"), (4, "wörd"), (None, "tail")], "item_id long, text string")
    cases = [(docs, items, 10), (documents(spark), odd, 10), (documents(spark), odd, 2), (documents(spark), odd.limit(0), 10), (documents(spark).limit(0), odd, 10)]
    for frame, bench, window in cases:
        known = [("" if r["item_id"] is None else r["item_id"], r["text"]) for r in bench.collect()]
        want = brute_contamination(texts(frame), known, window)
        for most in (1 << 20, 8 if bench is not items else 4000):
            found = decontaminate.decontaminate(frame, bench, window, most)
            assert rows(found, "doc_id", "n_words", "n_hit", "items") == want
            clean = sorted((d for d, _, n, _ in want if not n), key=repr)
            assert sorted((r["doc_id"] for r in decontaminate.drop_contaminated(frame, bench, window, most).collect()), key=repr) == clean


def test_contaminated_spans_are_of_the_original_text(spark):
    frame = spark.createDataFrame([(1, "é - One, TWO; three. four"), (2, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert decontaminate.decontaminate(frame, bench).where("doc_id = 1").first()["spans"] == [(4, 19)]


# 4


def water(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = Fraction(sum(sizes.values())), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        more = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not more:
            return {s: float(most * sizes[s] if s in full else level * weight[s]) for s in order}
        full |= more


def test_mixing(spark, docs):
    for frame in (docs, documents(spark)):
        given = frame.select("doc_id", "source", "text").collect()
        sizes = Counter()
        for r in given:
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        found = mixing.mix_sources(frame, block=16).collect()
        want = water(sizes)
        assert sorted(((r["doc_id"], r["source"], r["size"]) for r in found), key=repr) == sorted(((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in given), key=repr)
        taken, longest = Counter(), Counter()
        for r in found:
            assert r["source_size"] == sizes[r["source"]]
            assert r["target"] == pytest.approx(want[r["source"]])
            assert 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
            taken[r["source"]] += r["taken"]
            longest[r["source"]] = max(longest[r["source"]], r["size"])
        for s in sizes:
            assert abs(taken[s] - want[s]) < longest[s] + 1e-3 or not longest[s]
        again = mixing.mix_sources(frame.repartition(3), block=16)
        assert rows(again, "doc_id", "taken") == sorted(((r["doc_id"], r["taken"]) for r in found), key=repr)
    assert mixing.mix_sources(documents(spark).limit(0)).count() == 0


def test_mixing_has_no_python_and_hits_targets(spark):
    sf = "/root/testdata/sf0.01"
    found = registry.QUERIES["op4_mix_sources"](spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    for r in found.join(source, "doc_id").groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t"), F.max("size").alias("longest")).collect():
        assert abs(r["n"] - r["t"]) < r["longest"]


def test_mixing_with_a_third_of_equal_rows(spark):
    frame = spark.createDataFrame([(None, "same words here", "a")] * 400 + [(i, "w " * (i % 9 + 1), "ab"[i % 2]) for i in range(800)], "doc_id long, text string, source string")
    found = mixing.mix_sources(frame, block=16)
    assert found.count() == 1200
    same = [r["copies"] for r in found.where("doc_id IS NULL").collect()]
    assert len(same) == 400 and max(same) - min(same) <= 1
    for r in found.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect():
        assert abs(r["n"] - r["t"]) < 9


# 5


def brute_top(vectors, k):
    use = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    out = []
    for q, x in sorted({i: v for i, v in use if i % 20 == 0}.items()):
        best = sorted(((-int(x[: len(v)] @ v[: len(x)]), i) for i, v in use if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


def test_top_k(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet")
    odd = spark.createDataFrame(
        [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (20, [-1.0, 0.5]), (None, [1.0, 1.0]), (6, []), (40, [0.0, 0.0]), (7, [float("inf"), 0.0])],
        "vec_id long, embedding array<float>",
    ).withColumn("block", F.lit(3))
    for frame in (given, odd, odd.limit(0)):
        want = brute_top([(r["vec_id"], r["embedding"]) for r in frame.collect()], 20)
        for block in (mtree.BLOCK, 40):
            found = mtree.exact_top_k(frame, F.col("vec_id") % 20 == 0, block=block, queries_at_once=10, sample=64)
            assert rows(found, "query_id", "rank", "vec_id", "score") == want


# 6


def test_token_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    special = [(20, "a <|endoftext|> b<|startoftext|>c ''s don't WE'VE x y 12é é\x0b\x1cz ́a"), (21, "İSTANBUL ΑΣ <|ENDOFTEXT|>")]
    for frame in (docs, documents(spark), spark.createDataFrame(special, "doc_id long, text string")):
        want = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False))) for i, t in texts(frame)), key=repr)
        for hot in (8, 65536):
            assert rows(token_counts.token_counts(frame, path, hot), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(documents(spark).limit(0), path).count() == 0


# 7


def brute_components(found, size=5, percent=80):
    sets = []
    for doc, text in found:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (doc, _) in enumerate(sets):
        low[root(i)].append(doc)
    name = {r: min((d for d in v if d is not None), default=None) for r, v in low.items()}
    return sorted(((doc, len(s), name[root(i)]) for i, (doc, s) in enumerate(sets)), key=repr)


def copies(spark):
    """A family of near copies, larger than a block, with chains, and unrelated texts that share a passage."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    out = []
    for i in range(90):
        words = list(base)
        for at in rng.integers(0, 120, 1 + i % 9):
            words[at] = f"v{rng.integers(1000)}"
        out.append((500 - i, " ".join(words), None))
    out += [(1000 + i, " ".join([*base[:20], *(f"u{i}_{k}" for k in range(30))]), None) for i in range(40)]
    out += [(2000 + i, " ".join(f"c{k}" for k in range(i, i + 60)), None) for i in range(30)]
    return spark.createDataFrame(out, "doc_id long, text string, source string")


def test_jaccard_components(spark, docs):
    for frame, block in ((docs, 512), (documents(spark), 512), (copies(spark), 512), (copies(spark), 16)):
        found = shingle_join.jaccard_components(frame, block=block)
        assert rows(found, "doc_id", "n_shingles", "component_id") == brute_components(texts(frame))
    assert shingle_join.jaccard_components(documents(spark).limit(0)).count() == 0
    found = shingle_join.jaccard_components(copies(spark), fetch_rows=0)
    assert rows(found, "doc_id", "n_shingles", "component_id") == brute_components(texts(copies(spark)))


def test_pairs_just_above_the_threshold_share_a_key():
    """The routing's recall over pairs of 0.80 to 0.85, against their whole sets."""
    rng = np.random.default_rng(11)
    pairs = []
    while len(pairs) < 1500:
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, int(rng.integers(20, 260)))]
        other = list(words)
        for at in rng.integers(0, len(words), max(1, len(words) // 50)):
            other[at] = f"v{rng.integers(1 << 40)}"
        sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other)]
        if 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) <= 0.85:
            pairs.append((" ".join(words), " ".join(other)))
    column = pa.array([t for pair in pairs for t in pair])
    n = len(column)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), column], names=["doc_id", "text_hash", "text"])
    keys = next(shingle_join._sketch(5)(iter([batch]))).column("keys").to_pylist()
    assert all(set(keys[i]) & set(keys[i + 1]) for i in range(0, n, 2))


def test_rows_without_ids_link_and_leave(spark):
    bridge = [(1, "a b c d e f g h i j k l m n o", None), (None, "a b c d e f g h i j k l m n o p", None), (2, "a b c d e f g h i j k l m n o p q r", None)]
    lone = [(None, "one two three four five six seven eight nine ten", None)] * 3 + [(None, "one two three four five six seven eight nine ten eleven", None)]
    blank = [(None, None, None), (7, "", None), (7, "", None), (1, " ", None)]
    frame = spark.createDataFrame(bridge + lone + blank, "doc_id long, text string, source string")
    for fetch_rows in (shingle_join.FETCH_ROWS, 0):
        found = shingle_join.jaccard_components(frame, fetch_rows=fetch_rows)
        assert rows(found, "doc_id", "n_shingles", "component_id") == brute_components(texts(frame))
        left = sorted(texts(shingle_join.drop_near_duplicates(frame, fetch_rows)), key=repr)
        assert [(i, (t or "")[:3]) for i, t in left] == [(1, "a b"), (7, ""), (None, "one"), (None, "")]


# 8


def test_chat(spark):
    frame = spark.createDataFrame(
        [(1, 0, "user", "a\\b<c#"), (1, 1, "assistant", "</turn>\n### x: y"), (1, 2, "user", None), (2, 0, "user", "only"), (3, 1, "assistant", ""), (3, 1, "assistant", "tie"), (3, 0, "sys:#<", "s"), (None, None, None, None), (4, 0, "assistant", "\\l\\\\h é😀")],
        "conv_id long, turn long, role string, text string",
    ).withColumn("at", F.lit(1))
    examples = chat.chat_examples(frame).cache()
    by = defaultdict(list)
    for r in examples.withColumn("loss", chat.trained_text(F.col("text"), F.col("loss_start"), F.col("loss_length"))).withColumn("turns", chat.parsed(F.col("text"))).collect():
        by[r["conv_id"]].append(r)
    given = defaultdict(list)
    for r in frame.collect():
        given[r["conv_id"]].append((-1 if r["turn"] is None else r["turn"], r["role"] or "", r["text"] or ""))
    assert set(by) == set(given)
    for conv, turns in given.items():
        turns.sort()
        made = sorted(by[conv], key=lambda r: r["example"])
        assert [tuple(t) for t in made[-1]["turns"]] == [t[1:] for t in turns]
        assert [r["loss"] for r in made if r["loss_length"] is not None] == [t for _, role, t in turns if role == "assistant"]
        for r in made:
            assert [tuple(t) for t in r["turns"]] == [t[1:] for t in turns[: r["n_turns"]]]
    assert chat.chat_examples(frame.limit(0)).count() == 0
    plan = registry.QUERIES["op8_chat_examples"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 9


def brute_private(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(("email", "ip", "card", "phone")[k], a, b) for a, k, b in sorted(out)]


def test_private_data(spark, docs):
    rng = np.random.default_rng(5)
    pieces = list("@.+- ()0123456789ab%_é\n") + ["4111 1111 1111 1111", "1.2.3.4", "a@b.co", "+1 (555) 123-4567", "://"]
    hard = [(i, "".join(rng.choice(pieces, 60)), None) for i in range(800)]
    hard += [(900, "a@b@c.com x@y.z.w. 1.2.3.4.5.6.7.8 256.1.1.1 1.2.3.0004 a@-.- 4111-1111-1111-1111 +1+123456789 " * 3, None)]
    for frame in (docs, documents(spark), documents(spark, hard)):
        found = {}
        for r in private_data.private_data(frame).collect():
            found.setdefault(r["doc_id"], []).append([tuple(s) for s in r["spans"] if s["kind"] in private_data.BASE_KINDS])
        want = {}
        for i, t in texts(frame):
            want.setdefault(i, []).append(brute_private(t or ""))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    trie = private_data.automaton()
    text = "see ftp://joe:pw@host.example/x, IBAN: DE89 3704 0044 0532 0130 00 and Account no. 12345678."
    more = [(k, text[a:b]) for k, a, b in private_data.find(trie, text) if k in ("login", "account")]
    assert more == [("login", "joe:pw@host.example"), ("account", "DE89 3704 0044 0532 0130 00"), ("account", "12345678")]
    assert private_data.masked("call a@b.co now", [("email", 5, 11)]) == "call [email] now"


def test_account_numbers_with_groups_of_letters_are_whole():
    trie = private_data.automaton()
    ids = ["GB29 NWBK 6016 1331 9268 19", "GB29 NWBK 6016 1331 9268 18", "MT84 MALT 0110 0001 2345 MTLC AST0 01S", "NL91 ABNA 0417 1643 00", "SC18 SSCB 1101 0000 0000 0000 1497 USD", "GB29NWBK60161331926819"]
    for x in ids:
        for before, after in (("IBAN ", ""), ("pay to iban: ", ", please"), ("IBAN ", " please"), ("IBAN ", " PLEASE PAY NOW")):
            text = before + x + after
            assert [text[a:b] for k, a, b in private_data.find(trie, text) if k == "account"] == [x], text
    for blanks in (1, 20, 30, 500):
        text = "account" + " " * blanks + "number: MT84 MAL1 0110 0001 2345 MTL1 AST0 01S"
        assert private_data.masked(text, [x for x in private_data.find(trie, text) if x[0] == "account"]) == "account" + " " * blanks + "number: [account]"
    for text, want in (("passport no. AB 123456 of", ["AB 123456"]), ("account 12345678 USD 500", ["12345678"]), ("ACCOUNT IN 2019", []), ("account " + "1" * 35, []), ("iban of no GB29 NWBK", [])):
        assert [text[a:b] for k, a, b in private_data.find(trie, text) if k == "account"] == want, text


def test_registered_queries_have_the_contracted_columns(spark):
    want = {
        "op1": "doc_id n_words n_removed kept_sha256", "op2": "doc_id held_out score predicted", "op3": "doc_id n_words n_hit n_items items_sha256 contaminated", "op4": "doc_id size source_size target taken",
        "op5": "query_id rank vec_id score", "op6": "doc_id n_bytes n_tokens over_limit", "op7": "doc_id n_shingles component_id", "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
        "op9": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op10": "doc_id held_out score predicted",
    }
    for name, query in registry.QUERIES.items():
        assert query(spark, SF).columns == want[name.split("_")[0]].split(), name
    assert labelled.SAMPLE == 20_000
