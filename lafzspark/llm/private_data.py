"""Personal data in texts: e-mail and IP addresses, card and phone numbers, credentials in URLs, account numbers.

Method: one Aho-Corasick automaton finds anchors (at-signs, schemes, digits, plus signs, cue words); a local,
deterministic parser expands each anchor to its borders and validates it. Each kind's matches are leftmost and don't
overlap, and a candidate that fails validation is dropped without another try inside it.

Every document is handled by itself, in a batch; nothing is shuffled and each text is scanned once from end to end.
All parsers run in time linear in the text.

Defined cases: a null text counts as empty; repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lafzspark.llm import scan, tables

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "login", "account")
CUES = ("iban", "account", "acct", "passport", "ssn")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/?#@:<>\"']+(?::[^\s/?#@<>\"']*)?@[A-Za-z0-9.-]+(?::[0-9]+)?")
ACCOUNT = re.compile(r"(?i:(?:\s*(?:number|nr|no|id))?)[\s.:#=]{1,4}(?=[A-Za-z0-9])")
LONGEST = 34
ACCOUNT_GROUP = re.compile(rf"[A-Z0-9]{{1,{LONGEST + 1}}}(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
IBAN_START = re.compile(r"[A-Z]{2}[0-9]{2}")


def automaton():
    trie = ahocorasick.Automaton()
    for anchor in ("@", "://", "+", *"0123456789"):
        trie.add_word(anchor, anchor[-1] if anchor != "://" else "s")
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            trie.add_word(form, "c")
    trie.make_automaton()
    return trie


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(groups: list[str]) -> int:
    return sum(c.isdigit() for g in groups for c in g)


def _iban(groups: list[str]) -> bool:
    whole = "".join(groups)
    return bool(IBAN.fullmatch(whole)) and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1


def _prefix(groups: list[str], counts, digits: int = 4) -> int:
    """Leading groups that count, up to the last one with a digit; 0 if they aren't 6 to 34 characters with that many digits."""
    n = next((k for k, g in enumerate(groups) if not counts(k, g)), len(groups))
    while n and not _digits(groups[n - 1 : n]):
        n -= 1
    return n if 6 <= sum(map(len, groups[:n])) <= LONGEST and _digits(groups[:n]) >= digits else 0


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier behind a cue that ends at `at`: groups of capitals and digits, 6 to 34 characters, 4 digits at least.

    Groups of letters count in what is an IBAN by its check digits, or begins as one and is printed in fours; in others
    short ones do where the groups of digits before them are no identifier by themselves and there are 6 digits.
    """
    found = ACCOUNT.match(text, at)
    if not found:
        return None
    start = here = found.end()
    groups: list[str] = []
    ends: list[int] = []
    while sum(map(len, groups)) <= LONGEST and (m := ACCOUNT_GROUP.match(text, here)):
        groups.append(m[0])
        ends.append(m.end())
        if text[m.end() : m.end() + 1] not in (" ", "-"):
            break
        here = m.end() + 1
    n = next((k for k in range(len(groups), 0, -1) if _iban(groups[:k])), 0)
    if not n:
        n = _prefix(groups, lambda k, g: _digits([g]))
        if IBAN_START.match("".join(groups)):
            n = max(n, _prefix(groups, lambda k, g: len(g) <= 4 and all(len(x) == 4 for x in groups[:k])))
        n = n or _prefix(groups, lambda k, g: _digits([g]) or len(g) <= 4, 6)
    return (start, ends[n - 1]) if n else None


def find(trie, text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    out: list[tuple[int, int, int]] = []
    email = ip = card = phone = login = account = 0  # where each kind's next match may start
    for at, kind in trie.iter(text):
        if kind.isdigit():
            if at >= card:
                m = CARD.match(text, at)
                card = m.end() if m else at + 1
                if m and 12 <= m.end() - at:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, m.end()))
            if at >= ip:
                m = IP.match(text, at)
                ip = m.end() if m else DIGITS.match(text, at).end()
                if m and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                    out.append((at, 1, m.end()))
        elif kind == "@":
            start = at
            while start > email and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                email = m.end()
                out.append((start, 0, email))
            else:
                email = max(email, at + 1)
        elif kind == "+":
            if at >= phone and (m := PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((at, 3, phone))
        elif kind == "s":
            if at + 1 >= login and (m := LOGIN.match(text, at + 1)):
                login = m.end()
                out.append((at + 1, 4, login))
        elif at + 1 >= account and (x := _account(text, at + 1)):
            account = x[1]
            out.append((x[0], 5, account))
    return [(KINDS[k], a, b) for a, k, b in sorted(out)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(redact: bool):
    def run(batches):
        trie = automaton()
        for batch in batches:
            for a, b in scan.slices(np.full(len(batch), 1), 1024):
                texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
                found = [find(trie, t) for t in texts]
                cols = [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in f] for f in found], SPANS),
                ]
                if redact:
                    cols.append(pa.array([masked(t, f) if f else None for t, f in zip(texts, found, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "spans", "redacted"][: len(cols)])

    return run


def masked(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones together, under the first one's kind) replaced by its kind in brackets."""
    out, done = [], 0
    for kind, a, b in found:
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def private_data(docs: DataFrame, redact: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (kind, start, end in code points) and, if asked for, redacted (null where nothing was found)."""
    own = tables.id_text(docs, id_col, text_col)
    out = "spans array<struct<kind:string,start:int,end:int>>" + ", redacted string" * redact
    return own.mapInArrow(_scan(redact), tables.schema(own, out))


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _equals(kind: str):
    return lambda x: x == kind


def op9(spark, sf_dir: str) -> DataFrame:
    found = private_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span of personal data replaced by its kind in brackets, and n_chars, if there is one, brought up to date."""
    columns = docs.columns

    def run(batches):
        trie = automaton()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [find(trie, t) if t else [] for t in texts]
            texts = [masked(t, f) if f else t for t, f in zip(texts, found, strict=True)]
            new = {"text": pa.array(texts, batch.schema.field("text").type)}
            if "n_chars" in columns:
                sizes = [len(t) if f else n for t, f, n in zip(texts, found, batch.column("n_chars").to_pylist(), strict=True)]
                new["n_chars"] = pa.array(sizes, batch.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)

    return docs.mapInArrow(run, docs.schema)
