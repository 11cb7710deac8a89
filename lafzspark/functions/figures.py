"""Column functions that write numbers: South Asian grouping and Urdu words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lafzspark.resources import numerals as N
from lafzspark.resources import script as S


def format_number(x: Column, urdu_digits: bool = False) -> Column:
    """Three digits, then groups of two, in positional form whatever the exponent; NaN and infinity give NULL."""
    text = x.cast("string")
    part = lambda k: F.regexp_extract(text, r"^-?(\d+)\.?(\d*)(?:E([+-]?\d+))?\z", k)
    digits = F.concat(part(1), part(2))
    point = F.length(part(1)) + F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
    whole = F.when(point > 0, F.rpad(F.left(digits, point), F.greatest(point, F.lit(0)), "0")).otherwise("")
    whole = F.coalesce(F.nullif(F.regexp_replace(whole, "^0+", ""), F.lit("")), F.lit("0"))
    rest = F.when(point < 0, F.concat(F.repeat(F.lit("0"), -point), digits)).otherwise(F.substring(digits, point + 1, F.length(digits)))
    rest = F.regexp_replace(rest, r"0+\z", "")
    head = F.left(whole, F.greatest(F.length(whole) - 3, F.lit(0)))
    head = F.regexp_replace(head, r"(?<=\d)(?=(?:\d\d)+\z)", ",")
    shown = F.concat_ws(",", F.nullif(head, F.lit("")), F.right(whole, F.lit(3)))
    shown = F.concat(shown, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    shown = F.when(text.startswith("-") & digits.rlike("[1-9]"), F.concat(F.lit("-"), shown)).otherwise(shown)
    if urdu_digits:
        shown = F.translate(shown, S.ASCII_DIGITS + ",.", S.URDU_DIGITS + "٬٫")
    return F.when(digits != "", shown)


def _below_thousand(x: Column, units: Column) -> Column:
    hundreds, rest = (x / 100).cast("long"), (x % 100).cast("int")
    name = lambda n: F.element_at(units, n.cast("int") + 1)
    return F.concat_ws(" ", F.when(hundreds > 0, F.concat_ws(" ", name(hundreds), F.lit(N.HUNDRED))), F.when(rest > 0, name(rest)))


def number_to_words(x: Column) -> Column:
    """Whole numbers from 0 to below 10**13 in Urdu words; others give NULL."""
    units, x = F.array(*[F.lit(w) for w in N.UNITS]), x.cast("long")
    parts, rest = [], x
    for word, scale in N.SCALES.items():
        count = F.floor(rest / F.lit(scale).cast("decimal(20,0)")).cast("long")
        parts.append(F.when(count > 0, F.concat_ws(" ", _below_thousand(count, units), F.lit(word))))
        rest = x % scale
    parts.append(F.when(rest > 0, _below_thousand(rest, units)))
    return F.when(x == 0, F.lit(N.UNITS[0])).when((x > 0) & (x < 10**13), F.concat_ws(" ", *parts))
