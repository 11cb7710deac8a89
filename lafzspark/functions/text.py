"""Column functions for Urdu text: normalising, tokens, stopwords and stems. All are Catalyst expressions; NULL gives NULL.

Python's `\\w`, `\\s` and `\\d` are written as explicit classes, because Java's differ. Canonical composition covers letters with
up to two marks in canonical order; Hangul syllables in parts stay so.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from lafzspark.functions.guards import require_number
from lafzspark.resources import script as S

WORD_CHARS = r"\p{L}\p{N}_"
NOT_BLANK = f"[^{S.BLANK}]"
LINK_ENDS = r".,;:!?؟،۔)\]}'\""
WORD = f"[{WORD_CHARS}{S.WORD_LETTERS}]+"
MARK = f"[^{WORD_CHARS}{S.BLANK}{S.WORD_LETTERS}]"
NUMBER = r"\p{Nd}+(?:[.,:/٫٬-]\p{Nd}+)+"


def identifier(look_behind: bool = True, label: int = 255) -> str:
    """URLs, addresses, mentions and tags; without look-behind and with a shorter label for engines that need it."""
    tail = f"(?:{NOT_BLANK}*[^{S.BLANK}{LINK_ENDS}]|{NOT_BLANK})"
    guard = f"(?<![{WORD_CHARS}.+-])" if look_behind else ""
    email = f"{guard}[{WORD_CHARS}.+-]{{1,64}}@[{WORD_CHARS}-]{{1,{label}}}\\.[{WORD_CHARS}.-]*[{WORD_CHARS}]"
    return f"https?://{tail}|www\\.{tail}|{email}|[@#][{WORD_CHARS}]+"


@cache
def shapes() -> tuple[dict[str, str], dict[str, str]]:
    """Presentation forms by their letters: those of one letter, and those of several or none."""
    chars = [chr(c) for low, high in S.SHAPES for c in range(low, high + 1)]
    found = {c: unicodedata.normalize("NFKC", c).lstrip(" ") for c in chars}
    found = {c: x for c, x in found.items() if x != c}
    return {c: x for c, x in found.items() if len(x) == 1}, {c: x for c, x in found.items() if len(x) != 1}


def bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x computed once however often it stands in the result."""
    return F.element_at(F.transform(F.array(x), use), 1)


@cache
def compositions() -> dict[str, str]:
    """Pairs of a character and a mark by the character that they compose."""
    found = {}
    for code in (*range(0xC0, 0xAC00), *range(0xF900, 0x10000)):
        parts = unicodedata.decomposition(chr(code))
        if parts and parts[0] != "<" and " " in parts and unicodedata.normalize("NFC", chr(code)) == chr(code):
            found["".join(chr(int(x, 16)) for x in parts.split())] = chr(code)
    return found


def compose(t: Column) -> Column:
    """Letters with up to two marks in canonical order, in composed form; only pairs are looked up."""
    table = F.from_json(F.lit(json.dumps(compositions())), "map<string,string>")

    def once(x: Column) -> Column:
        parts = F.regexp_extract_all(x, F.lit(r"(?s)\P{M}\p{M}|."), F.lit(0))
        return F.array_join(F.transform(parts, lambda c: F.when(F.length(c) > 1, F.coalesce(F.element_at(table, c), c)).otherwise(c)), "")

    return F.when(t.rlike(r"\p{M}"), once(once(t))).otherwise(t)


def expand_shapes(t: Column) -> Column:
    """Letters for their presentation forms. A test by ranges comes first: a class of several hundred single characters is slow."""
    single, several = shapes()
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")
    one = F.translate(t, "".join(single), "".join(single.values()))
    chars = F.transform(F.split(one, ""), lambda c: F.when(c >= chr(S.SHAPES[0][0]), F.coalesce(F.element_at(table, c), c)).otherwise(c))
    ranges = "".join(f"{chr(low)}-{chr(high)}" for low, high in S.SHAPES)
    return F.when(t.rlike(f"[{ranges}]"), F.array_join(chars, "")).otherwise(t)


def resolve_heh(t: Column) -> Column:
    """Arabic heh as the aspirated heh behind a letter that can be aspirated, else as the round one."""
    t = F.regexp_replace(t, f"([{S.ASPIRABLE}]){S.HEH}", f"$1{S.ASPIRATED_HEH}")
    return F.replace(t, F.lit(S.HEH), F.lit(S.ROUND_HEH))


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^[{S.BLANK}]+|[{S.BLANK}]+\\z", "")


def normalize(
    t: Column, unify: bool = True, diacritics: bool = True, digits: bool = False, punctuation: bool = False, zwnj: bool = False, whitespace: bool = True
) -> Column:
    """One spelling for what reads alike; the flags say which differences are removed."""
    t = bound(t, compose)
    t = F.regexp_replace(t, f"{S.CONTROL}|{S.ZERO_WIDTH}|{S.TATWEEL}", "")
    if unify:
        t = F.translate(bound(t, expand_shapes), S.LETTERS_FROM + S.ARABIC_DIGITS, S.LETTERS_TO + S.URDU_DIGITS)
        t = resolve_heh(t)
    if diacritics:
        t = F.regexp_replace(t, S.DIACRITICS, "")
    if digits:
        t = F.translate(t, S.ARABIC_DIGITS + S.URDU_DIGITS, S.ASCII_DIGITS * 2)
    if punctuation:
        t = F.translate(t, S.PUNCTUATION_FROM, S.PUNCTUATION_TO)
    if zwnj:
        t = F.regexp_replace(t, S.JOINERS, "")
    if whitespace:
        t = F.regexp_replace(t, f"(?<![{S.BLANK}])[{S.BLANK}]*\\n[{S.BLANK}]*", "\n")
        t = strip(F.regexp_replace(t, S.SPACES, " "))
    return t


def is_urdu(t: Column, threshold: float = 0.5) -> Column:
    """Whether at least this share of the letters is in the blocks that hold Urdu; without letters false."""
    threshold = require_number(threshold, "threshold", 0, 1)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    own = F.length(F.regexp_replace(t, rf"[^\p{{L}}&&[{S.URDU_BLOCKS}]]|[^{S.URDU_BLOCKS}]|\P{{L}}", ""))
    return F.when(t.isNotNull(), F.coalesce(own / F.nullif(letters, F.lit(0)) >= threshold, F.lit(False)))


def remove_links(t: Column) -> Column:
    """Without URLs, addresses, mentions and tags, and with one space where two words would meet."""
    own, gap, last = "\ue000", "\ue000\ue002", "\ue002"  # the text's own U+E000 is followed by U+E001 meanwhile
    t = F.regexp_replace(F.replace(t, F.lit(own), F.lit("\ue000\ue001")), identifier(), gap)
    t = F.regexp_replace(t, f"[ \\t]*(?:{gap})+(?!{gap})(?=[^{S.BLANK}\\p{{L}}\\p{{N}}])", "")
    t = F.regexp_replace(t, f"(?<=[^{S.BLANK}{last}])(?:{gap})+(?!{gap})(?=[^{S.BLANK}])", " ")
    t = F.replace(F.replace(t, F.lit(gap), F.lit("")), F.lit("\ue000\ue001"), F.lit(own))
    return strip(F.regexp_replace(t, "[ \\t]+", " "))


def words(t: Column, keep_punctuation: bool = False) -> Column:
    """Tokens of the normalised text: links, numbers with separators, words (and single marks)."""
    pattern = f"{identifier()}|{NUMBER}|{WORD}" + (f"|{MARK}" if keep_punctuation else "")
    return F.regexp_extract_all(normalize(t), F.lit(pattern), F.lit(0))


def sentences(t: Column) -> Column:
    parts = F.split(normalize(t), f"(?<=[{S.SENTENCE_ENDS}])[{S.BLANK}]+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def fix_spacing(t: Column) -> Column:
    """Whole words that are merged compounds, written apart; all else untouched."""
    tokens = F.regexp_extract_all(t, F.lit(f"{WORD}|[^{WORD_CHARS}{S.WORD_LETTERS}]+"), F.lit(0))
    table = F.create_map(*[F.lit(x) for pair in S.MERGED.items() for x in pair])
    fixed = F.array_join(F.transform(tokens, lambda w: F.coalesce(F.element_at(table, w), w)), "")
    return F.when(t.rlike("|".join(S.MERGED)), fixed).otherwise(t)


def windows(t: Column, n: int) -> Column:
    """All windows of n characters, in one pass (a substring for each would read the text anew from its start)."""
    return F.regexp_extract_all(t, F.lit(f"(?s)(?![\\x{{DC00}}-\\x{{DFFF}}])(?=(.{{{n}}}))"), F.lit(1))


def character_ngrams(t: Column, n: int = 3, pad: bool = True) -> Column:
    if n < 1:
        raise ValueError("n must be 1 or more")
    token = F.concat(F.lit("<"), t, F.lit(">")) if pad else t
    empty = F.array().cast("array<string>")
    return F.when(t == "", empty).when(F.length(token) < n, F.array(token)).when(t.isNotNull(), windows(token, n))


def is_stopword(w: Column, include_negation: bool = False, normalized: bool = False) -> Column:
    """normalized: w is a token of words(), or was normalised otherwise."""
    test = lambda x: F.when(x.isin(S.NEGATION), F.lit(include_negation)).otherwise(x.isin(S.STOPWORDS))
    return test(w) if normalized else bound(normalize(w), test)


def remove_stopwords(tokens: Column, include_negation: bool = False, normalized: bool = False) -> Column:
    return F.filter(tokens, lambda w: ~is_stopword(w, include_negation, normalized))


def stem(w: Column, light: bool = False, min_stem: int = 3, normalized: bool = False) -> Column:
    """w without the first listed suffix that leaves at least min_stem letters; normalized as in is_stopword."""

    def cut(x: Column) -> Column:
        chosen = F.when(x.isin(S.PROTECTED), 0)
        for suffix in S.LIGHT_SUFFIXES if light else S.SUFFIXES:
            chosen = chosen.when(x.endswith(suffix) & (F.length(x) >= len(suffix) + min_stem), len(suffix))
        return F.left(x, F.length(x) - chosen.otherwise(0))

    return cut(w) if normalized else bound(normalize(w), cut)


def stem_tokens(tokens: Column, light: bool = False, min_stem: int = 3, normalized: bool = False) -> Column:
    return F.transform(tokens, lambda w: stem(w, light, min_stem, normalized))


def is_non_joining(c: Column) -> Column:
    """Whether a letter never joins the one behind it."""
    return c.isin(*S.NON_JOINING)
