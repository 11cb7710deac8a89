"""Normalising of one string, for functions that run in Arrow batches; the column functions in text.py do the same."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lafzspark.functions import text as T
from lafzspark.resources import script as S

_ASPIRABLE = re.compile(f"([{S.ASPIRABLE}]){S.HEH}")
_SHAPE = re.compile("[" + "".join(f"{chr(low)}-{chr(high)}" for low, high in S.SHAPES) + "]")
_REMOVED = re.compile(f"{S.CONTROL.replace('{9F}', '9F')}|{S.ZERO_WIDTH}|{S.TATWEEL}")
_DIACRITICS = re.compile(S.DIACRITICS)
_LETTERS = str.maketrans(S.LETTERS_FROM + S.ARABIC_DIGITS, S.LETTERS_TO + S.URDU_DIGITS)
_TO_ASCII = str.maketrans(S.ARABIC_DIGITS + S.URDU_DIGITS, S.ASCII_DIGITS * 2)
_AROUND_LINES = re.compile(rf"[{S.BLANK}]*\n[{S.BLANK}]*")
_SPACES = re.compile(S.SPACES)


#: Letters that nothing but _LETTERS and the rules for heh can change, alone or next to each other.
_PLAIN = re.compile("[" + "".join(c for c in map(chr, range(0x621, 0x6D4)) if c.isalpha() and unicodedata.is_normalized("NFC", c) and not any(p.search(c) or p.search(c.translate(_LETTERS)) for p in (_SHAPE, _REMOVED, _DIACRITICS, _SPACES))) + "]+")


def expand(text: str) -> str:
    return _SHAPE.sub(lambda m: unicodedata.normalize("NFKC", m[0]).lstrip(" "), text)


def clean(text: str) -> str:
    """Composed, without control characters."""
    return re.sub(S.CONTROL.replace("{9F}", "9F"), "", unicodedata.normalize("NFC", text))


def normal(text: str, digits: bool = False, whitespace: bool = True) -> str:
    if _PLAIN.fullmatch(text):
        return _ASPIRABLE.sub(rf"\1{S.ASPIRATED_HEH}", text.translate(_LETTERS)).replace(S.HEH, S.ROUND_HEH)
    text = _REMOVED.sub("", unicodedata.normalize("NFC", text))
    text = expand(text).translate(_LETTERS)
    text = _ASPIRABLE.sub(rf"\1{S.ASPIRATED_HEH}", text).replace(S.HEH, S.ROUND_HEH)
    text = _DIACRITICS.sub("", text)
    if digits:
        text = text.translate(_TO_ASCII)
    if whitespace:
        text = _SPACES.sub(" ", _AROUND_LINES.sub("\n", text)).strip()
    return text


#: Tokens of text.words() and ends of lines, in Python's dialect; and words in the blocks that hold Urdu, if all letters.
_WORDS = re.compile(f"\n|{T.identifier()}|{T.NUMBER}|{T.WORD}".replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{Nd}", r"\d"))
_URDU = re.compile(f"[{S.URDU_BLOCKS}]+")


def words(text: str) -> list[str]:
    """As text.words(), with an \\n between the lines' tokens."""
    return _WORDS.findall(normal(text))


def is_urdu_word(w: str) -> bool:
    return w.isalpha() and _URDU.fullmatch(w) is not None


def arrow_column(function: Callable, kind: str) -> Callable[..., Column]:
    """function of one value as a column function over Arrow batches; NULL gives NULL."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else function(x) for x in column.to_pylist()], arrow_type)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    arrow_type = to_arrow_type(StructType.fromDDL(f"x {kind}")["x"].dataType)
    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)
