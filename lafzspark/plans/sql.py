"""The column functions as DuckDB SQL, from the same tables of letters; its regular expressions have no look-around."""

from __future__ import annotations

from lafzspark.functions import text as T
from lafzspark.resources import numerals as N
from lafzspark.resources import roman as R
from lafzspark.resources import script as S


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def every(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def heh(x: str) -> str:
    return f"replace({every(x, f'([{S.ASPIRABLE}]){S.HEH}', chr(92) + '1' + S.ASPIRATED_HEH)}, {q(S.HEH)}, {q(S.ROUND_HEH)})"


def strip(x: str) -> str:
    return every(x, f"^[{S.BLANK}]+|[{S.BLANK}]+$", "")


def normalize(x: str) -> str:
    """Defaults of the column function; texts without presentation forms."""
    x = every(f"nfc_normalize({x})", f"{S.CONTROL}|{S.ZERO_WIDTH}|{S.TATWEEL}", "")
    x = heh(f"translate({x}, {q(S.LETTERS_FROM + S.ARABIC_DIGITS)}, {q(S.LETTERS_TO + S.URDU_DIGITS)})")
    x = every(every(x, S.DIACRITICS, ""), f"[{S.BLANK}]*\\n[{S.BLANK}]*", "\n")
    return strip(every(x, S.SPACES, " "))


def words(x: str, keep_punctuation: bool = False) -> str:
    pattern = f"{T.identifier(False, 200)}|{T.NUMBER}|{T.WORD}" + (f"|{T.MARK}" if keep_punctuation else "")
    return f"regexp_extract_all({x}, {q(pattern)})"


def listed(items) -> str:
    return "(" + ", ".join(q(x) for x in items) + ")"


def stop(w: str) -> str:
    return f"CASE WHEN {w} IN {listed(S.NEGATION)} THEN false ELSE {w} IN {listed(S.STOPWORDS)} END"


def stem(w: str, light: bool = False, least: int = 3) -> str:
    cases = "".join(
        f" WHEN ends_with({w}, {q(s)}) AND length({w}) >= {len(s) + least} THEN left({w}, length({w}) - {len(s)})"
        for s in (S.LIGHT_SUFFIXES if light else S.SUFFIXES)
    )
    return f"CASE WHEN {w} IN {listed(S.PROTECTED)} THEN {w}{cases} ELSE {w} END"


def format_number(x: str) -> str:
    """Of a DECIMAL(38, 15)."""
    whole = f"split_part(ltrim({x}::VARCHAR, '-'), '.', 1)"
    rest = f"rtrim(split_part({x}::VARCHAR, '.', 2), '0')"
    head = f"left({whole}, greatest(length({whole}) - 3, 0))"
    grouped = f"reverse(rtrim(regexp_replace(reverse({head}), '(..)', '\\1,', 'g'), ','))"
    return (
        f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN {head} = '' THEN '' ELSE {grouped} || ',' END"
        f" || right({whole}, 3) || CASE WHEN {rest} = '' THEN '' ELSE '.' || {rest} END"
    )


def number_to_words(x: str) -> str:
    units = "[" + ", ".join(q(w) for w in N.UNITS) + "]"

    def below(v: str) -> str:
        name = lambda n: f"{units}[({n}) + 1]"
        hundreds = f"CASE WHEN {v} >= 100 THEN {name(f'{v} // 100')} || ' ' || {q(N.HUNDRED)} END"
        return f"concat_ws(' ', {hundreds}, CASE WHEN {v} % 100 > 0 THEN {name(f'{v} % 100')} END)"

    parts, limit = [], 10**13
    for word, scale in N.SCALES.items():
        v = f"(({x}) % {limit} // {scale})"
        parts.append(f"CASE WHEN {v} > 0 THEN {below(v)} || ' ' || {q(word)} END")
        limit = scale
    v = f"(({x}) % {limit})"
    parts.append(f"CASE WHEN {v} > 0 THEN {below(v)} END")
    return f"CASE WHEN {x} = 0 THEN {q(N.UNITS[0])} WHEN {x} > 0 AND {x} < {10**13} THEN concat_ws(' ', {', '.join(parts)}) END"


def rules_to_urdu(x: str) -> str:
    order = sorted(R.GRAPHEMES, key=lambda g: (-len(g), g))
    table = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in R.GRAPHEMES.items()) + "}"
    parts = f"regexp_extract_all({x}, {q('(?s)' + '|'.join(order) + '|.')})"
    return f"array_to_string(list_transform({parts}, lambda p: coalesce({table}[p], p)), '')"
