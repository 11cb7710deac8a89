"""Toxicity: a score for each document, by a lexicon that the labels teach, found through misspellings too.

Method: a lexicon of words and of stems (which any ending may follow) is a trie; Levenshtein automata over it, with
swapped neighbours as one edit, are run in lockstep for all entries and made deterministic as texts need them, so a
word costs a few table steps and most words leave at their second or third letter. The hits' context windows tell
quotation from abuse (quotation marks around a hit, words of reporting before it). A logistic regression over counts
of hits by kind gives the score; a misspelled hit counts as a share, 0 to 1, of an exact one.

Not every word near an entry is a misspelling of it. Words that training documents with label 0 have are ordinary and
never hits, unless those with label 1 have them much more often; and an entry gets edits only while few of its near
words are in just one document with label 0, as their number tells how many ordinary ones no training document has.
The share is learned as if each document with label 0 weren't there when its own words were told to be ordinary.

The lexicon, the ordinary words and the weights are learned from at most SAMPLE labelled documents (labelled.py), which are never the held
out ones; counts of words come combined by task, and at most TERMS of them reach the driver. Scoring is one scan of
the documents, nothing is shuffled, whole texts are read.

Defined cases: a null text counts as empty; an empty text gets the score of a text without hits; without usable labels
the lexicon is empty and each score is the labels' smoothed rate (one half without any label); repeated rows give a
row each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, namedtuple
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm import labelled, scan, tables
from lafzspark.llm.scratch import written

MODULUS, HELD = 4, 2
THRESHOLD = 0.3
WORD = re.compile(r"[^\W_]+")
STEM_SIZES = range(4, 8)
STEM_FORMS = 6
#: How much more often, as a logarithm, documents with label 1 have a word of the lexicon.
ODDS = 3.0
QUOTE = re.compile('["“”«»„]')
REPORTING = frozenset("said says wrote writes called calling quote quoted quotes word words term insult insults reported dit disait sagte schrieb dijo palabra mot wort".split())
CONTEXT = 6
#: Longest entries get two edits; short ones would meet ordinary words.
ONE_EDIT, TWO_EDITS = 5, 9
#: An entry loses its edits when words near it that one clean document has are more than this share of its documents.
UNSEEN = 0.05
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)


class State(dict):
    """A state of the deterministic automaton: letter -> state (None: no entry can match any more)."""

    __slots__ = ("accepts", "automaton", "items")

    def __init__(self, automaton, items):
        super().__init__()
        self.automaton, self.items = automaton, items
        self.accepts = automaton.accepting(items)

    def __missing__(self, letter):
        out = self[letter] = self.automaton.after(self.items, letter)
        return out


class Automaton:
    """Levenshtein automata of all entries, intersected with their trie.

    An item (node, edits, swap): the trie node reached, the edits spent, and the letter that must come next when the
    last two letters were swapped. Entries are (text, is a stem); those in `exact` get no edits, and words in `ordinary`
    are no hits unless they are entries.
    """

    HELD = 200_000

    def __init__(self, entries: list[tuple[str, bool]], exact: Iterable[tuple[str, bool]] = (), ordinary: Iterable[str] = ()):
        self.ordinary, exact = frozenset(ordinary), frozenset(exact)
        self.numbers: dict[int, list[int]] = {}
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, bool]] = {}
        self.allowed = [0]
        for number, (text, stem) in enumerate(entries):
            edits = 0 if len(text) < ONE_EDIT else 1 if len(text) < TWO_EDITS else 2
            edits = 0 if (text, stem) in exact else min(edits, 1) if stem else edits
            at = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in text:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.allowed.append(0)
                at = self.next[at][c]
                self.allowed[at] = max(self.allowed[at], edits)
            self.ends[at] = (edits, stem)
            self.numbers.setdefault(at, []).append(number)
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, State] = {}
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> State | None:
        todo = list(items)
        while todo:  # a letter of the entry is missing in the text
            node, edits, swap = todo.pop()
            if swap == "" and edits < 2:
                for child in self.next[node].values():
                    item = (child, edits + 1, "")
                    if edits + 1 <= self.allowed[child] and item not in items:
                        items.add(item)
                        todo.append(item)
        best: dict[tuple, int] = {}
        for node, edits, swap in items:
            if edits < best.get((node, swap), 9):
                best[node, swap] = edits
        key = frozenset((n, e, s) for (n, s), e in best.items())
        if not key:
            return None
        if key not in self.states:
            self.states[key] = State(self, key)
        return self.states[key]

    def after(self, items, letter: str) -> State | None:
        out = set()
        for node, edits, swap in items:
            if swap == "*":  # a stem is complete: any ending follows
                out.add((node, edits, "*"))
                continue
            if swap:
                if letter == swap[0]:
                    self._reach(out, int(swap[1:]), edits)
                continue
            for c, child in self.next[node].items():
                if c == letter:
                    self._reach(out, child, edits)
                elif edits + 1 <= self.allowed[child]:
                    self._reach(out, child, edits + 1)  # another letter instead
                if edits + 1 <= self.allowed[child] and letter in self.next[child]:
                    out.add((node, edits + 1, f"{c}{self.next[child][letter]}"))  # swapped: c comes next
            if edits + 1 <= self.allowed[node]:
                out.add((node, edits + 1, ""))  # a letter too many
        return self._state(out)

    def _reach(self, out: set, node: int, edits: int) -> None:
        if edits > self.allowed[node]:
            return
        out.add((node, edits, ""))
        end = self.ends.get(node)
        if end and end[1] and edits <= end[0]:
            out.add((node, edits, "*"))

    def accepting(self, items) -> int | None:
        """The fewest edits with which an entry is complete."""
        found = [e for n, e, s in items if s == "*" or (s == "" and n in self.ends and e <= self.ends[n][0])]
        return min(found, default=None)

    def _after(self, word: str) -> State | None:
        state = self.start
        for c in word:
            state = state[c]
            if state is None:
                return None
        return state

    def edits(self, word: str) -> int | None:
        state = self._after(word)
        if state is None or (state.accepts and word in self.ordinary):
            return None
        return state.accepts

    def _found(self, word: str) -> list[tuple[int, int]]:
        """(edits, number) of each entry that the word is, or is a misspelling of."""
        state = self._after(word)
        items = () if state is None else state.items
        return sorted({(e, k) for n, e, s in items if s == "*" or (s == "" and n in self.ends and e <= self.ends[n][0]) for k in self.numbers[n]})

    def near(self, word: str) -> list[int]:
        return sorted({k for e, k in self._found(word) if e})

    def entry(self, word: str) -> int | None:
        return next((k for e, k in self._found(word) if not e), None)


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _quoted(text: str, places: list[int]) -> list[bool]:
    """Which places stand behind an odd number of quotation marks of their line, with another one behind them in it."""
    marks = [m.start() for m in QUOTE.finditer(text)]
    if not marks:
        return [False] * len(places)
    out = []
    for at in places:
        first, last = bisect_left(marks, text.rfind("\n", 0, at) + 1), bisect_left(marks, at)
        end = text.find("\n", at)
        out.append((last - first) % 2 == 1 and last < len(marks) and (end < 0 or marks[last] < end))
    return out


def features(automaton: Automaton, text: str) -> tuple[float, ...]:
    """Abusive hits, misspelled ones, quoted ones, and the number of all words."""
    if len(automaton.states) > automaton.HELD:
        automaton.reset()
    lowered = text.lower()
    words = WORD.findall(lowered)
    found = {w: e for w in set(words) if (e := automaton.edits(w)) is not None}
    if not found:
        return (0.0, 0.0, 0.0, float(len(words)))
    plain = close = quoted = 0
    before: list[str] = []
    inside = _quoted(lowered, [m.start() for m in WORD.finditer(lowered) if m[0] in found])
    k = 0
    for w in words:
        e = found.get(w)
        if e is not None:
            if inside[k] or not REPORTING.isdisjoint(before[-CONTEXT:]):
                quoted += 1
            elif e:
                close += 1
            else:
                plain += 1
            k += 1
        before.append(w)
        if len(before) > 64:
            del before[:-CONTEXT]
    return (float(plain), float(close), float(quoted), float(len(words)))


def inputs(counts: np.ndarray, share: float) -> np.ndarray:
    """The model's inputs from rows of features()."""
    hits = counts[:, 0] + share * counts[:, 1]
    return np.column_stack([np.log1p(hits), np.log1p(counts[:, 2]), 100.0 * hits / np.maximum(counts[:, 3], 1.0)])


def _term_counts(batches):
    """(term, is a stem, documents with label 1, with label 0) of this task."""
    held: dict[tuple[str, bool], list[int]] = {}

    def out():
        batch = pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in held]), pa.array([s for _, s in held]), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
            names=["term", "stem", "yes", "no"],
        )
        held.clear()
        return batch

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            words = set(terms(text or ""))
            stems = {w[:k] for w in words for k in STEM_SIZES if len(w) > k}
            for key in [(w, False) for w in words] + [(s, True) for s in stems]:
                held.setdefault(key, [0, 0])[0 if label else 1] += 1
            if len(held) > 400_000:
                yield out()
    if held:
        yield out()


def lexicon(train: DataFrame) -> list[tuple[str, bool]]:
    """Words, and stems of several words, that documents with label 1 have much more often than others."""
    yes, no = train.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*") - F.coalesce(F.sum("label"), F.lit(0))).first()
    if not yes or not no:
        return []
    counts = train.mapInArrow(_term_counts, "term string, stem boolean, yes long, no long").groupBy("term", "stem").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    odds = F.log((F.col("yes") + 0.5) / (yes + 1.0)) - F.log((F.col("no") + 0.5) / (no + 1.0))
    least = max(4, yes // 200)
    # A word of the lexicon is not just rare: it must be frequent, and nearly absent elsewhere.
    counts = counts.withColumn("odds", odds).where((F.col("odds") >= ODDS) & (F.col("yes") >= F.when(F.col("stem"), least).otherwise(F.lit(min(4, least)))))
    rows = counts.collect()  # of the bounded sample
    words = {r["term"]: r["yes"] for r in rows if not r["stem"]}
    stems = {r["term"]: r["yes"] for r in rows if r["stem"]}
    forms = Counter(w[:k] for w in words for k in STEM_SIZES if len(w) > k)
    wide = {s: n for s, n in stems.items() if forms[s] >= STEM_FORMS and max((words.get(w, 0) for w in words if w.startswith(s)), default=0) < 0.8 * n}
    kept = [s for s, n in wide.items() if not any(t != s and t.startswith(s) and m >= 0.95 * n for t, m in wide.items())]
    kept = [s for s in kept if not any(s != t and s.startswith(t) for t in kept)]
    plain = [w for w, n in words.items() if n >= least and not w.startswith(tuple(kept) or ("\0",))]
    return sorted([(s, True) for s in kept] + [(w, False) for w in plain], key=lambda x: (-(stems if x[1] else words)[x[0]], x))


def _near(entries):
    """(word, entries it is near to, the entry it is, documents with label 1, with label 0) of each task."""

    def run(batches):
        automaton = Automaton(entries)
        held: dict[str, list[int]] = {}
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                if len(automaton.states) > automaton.HELD:
                    automaton.reset()
                for w in {w for w in set(terms(text or "")) if automaton.edits(w) is not None}:
                    held.setdefault(w, [0, 0])[0 if label else 1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([automaton.near(w) for w in held], pa.list_(pa.int32())), pa.array([automaton.entry(w) for w in held], pa.int32()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
            names=["word", "near", "own", "yes", "no"],
        )

    return run


def misspelled(train: DataFrame, entries: list[tuple[str, bool]]) -> tuple[list[tuple[str, bool]], dict[str, bool]]:
    """Entries that get no edits, and the ordinary words near the others: is one document with label 0 all that have it?"""
    yes, no = train.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*") - F.coalesce(F.sum("label"), F.lit(0))).first()
    found = train.mapInArrow(_near(entries), "word string, near array<int>, own int, yes long, no long").groupBy("word")
    found = found.agg(F.min("near").alias("near"), F.min("own").alias("own"), F.sum("yes").alias("yes"), F.sum("no").alias("no")).where("no > 0 OR own IS NOT NULL").collect()
    support = Counter()
    for r in found:
        if r["own"] is not None:
            support[r["own"]] += r["yes"]
    far = [r for r in found if r["own"] is None and math.log((r["yes"] + 0.5) / (yes + 1.0)) - math.log((r["no"] + 0.5) / (no + 1.0)) < ODDS]
    single = Counter(k for r in far if r["no"] == 1 for k in r["near"])
    exact = {k for k, n in single.items() if n > UNSEEN * support[k]}
    return [entries[k] for k in sorted(exact)], {r["word"]: r["no"] == 1 for r in far if not exact.issuperset(r["near"])}


def _features(entries, exact, ordinary):
    once = frozenset(w for w, single in ordinary.items() if single)

    def run(batches):
        automaton = Automaton(entries, exact, ordinary)
        whole = automaton.ordinary
        for batch in batches:
            rows = []
            for t, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                automaton.ordinary = whole if y else whole - once
                rows.append((*features(automaton, t or ""), y))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*rows, strict=True)] or [pa.array([], pa.float64())] * 5, names=["a", "b", "c", "d", "y"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and, last, the intercept (not penalised), by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    ridge = np.diag([penalty] * (len(w) - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(counts: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights, and the share of an exact hit that a misspelled one counts: the likeliest of SHARES under the penalty of
    the weights, which also draws a misspelled hit's weight to that of an exact one (so no evidence means the same)."""
    best = None
    for share in SHARES:
        x = inputs(counts, share)
        w = logistic(x, y, penalty)
        z = x @ w[:-1] + w[-1]
        value = (y * z - np.logaddexp(0.0, z)).sum() - penalty / 2 * (w[:-1] @ w[:-1] + ((1 - share) * w[0]) ** 2)
        if best is None or value > best[0] + 1e-9:
            best = (value, w, share)
    return best[1], best[2]


Model = namedtuple("Model", "entries exact ordinary weights share")


def train_model(docs: DataFrame, labels: DataFrame, sample: int = labelled.SAMPLE) -> Model:
    """The lexicon, the words that are no misspellings, and the weights. docs has doc_id and text."""
    train = written(labelled.training_rows(docs, labels, "toxic", MODULUS, HELD, sample))  # read four times
    entries = lexicon(train)
    exact, ordinary = misspelled(train, entries) if entries else ([], {})
    rows = train.mapInArrow(_features(entries, exact, ordinary), "a double, b double, c double, d double, y double").collect()
    data = np.array(sorted(tuple(r) for r in rows), float).reshape(-1, 5)
    weights, share = fit(data[:, :4], data[:, 4])
    return Model(entries, exact, sorted(ordinary), weights.tolist(), share)


def scores(model: Model):
    """Texts -> scores, with an automaton of its own."""
    automaton, w = Automaton(model.entries, model.exact, model.ordinary), np.array(model.weights)

    def run(texts: list) -> np.ndarray:
        x = inputs(np.array([features(automaton, t or "") for t in texts], float).reshape(-1, 4), model.share)
        return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))

    return run


def _score(model: Model):
    def run(batches):
        score = scores(model)
        for batch in batches:
            for a, b in scan.slices(np.full(len(batch), 1), 2048):
                found = score(batch.column("text").slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(found)], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = labelled.SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    own = tables.id_text(docs, id_col, text_col)
    scored = own.mapInArrow(_score(train_model(own, labels, sample)), tables.schema(own, "score double"))
    held = labelled.is_held_out(F.col("doc_id"), MODULUS, HELD).alias("held_out")
    return scored.select("doc_id", held, "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = labelled.SAMPLE) -> DataFrame:
    """docs without the rows that toxicity() predicts to be toxic; nothing is shuffled."""
    model = train_model(tables.id_text(docs, "doc_id", "text"), labels, sample)

    def flags():
        score = scores(model)
        return lambda batch: pa.array(score(batch.column("text").to_pylist()) < THRESHOLD)

    return tables.rows_kept(docs, flags)
