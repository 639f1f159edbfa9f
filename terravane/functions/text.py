"""Text analysis as column expressions: folding, tokens, any-token and phrase matches."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Letters that decomposition does not reduce. Fixed values.
_SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T", "ð": "d", "Ð": "D"}
PAIRS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH"}


def fold_tables() -> tuple[str, str]:
    """Letters with marks, and full-width forms, and the ASCII characters that stand for them."""
    found = dict(_SINGLE)
    for n in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F)]:
        base = unicodedata.normalize("NFKD", chr(n))[0]
        if base.isascii() and chr(n) not in found and chr(n) not in PAIRS:
            found[chr(n)] = base
    return "".join(found), "".join(found.values())


FOLD_FROM, FOLD_TO = fold_tables()
_WORD = r"[\p{L}\p{M}\p{N}_&&[^\p{IsHan}\p{IsHiragana}]]"
TOKEN = rf"[\p{{IsHan}}\p{{IsHiragana}}]|{_WORD}+(?:['’.]{_WORD}+)*"


def fold(c: Column) -> Column:
    c = F.translate(c, FOLD_FROM, FOLD_TO)
    for pair, letters in PAIRS.items():
        c = F.replace(c, F.lit(pair), F.lit(letters))
    return c


def tokens_standard(c: Column) -> Column:
    """Words in lower case; Han and Hiragana one character a token. Null stays null."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def tokens_folded(c: Column) -> Column:
    return tokens_standard(fold(c))


def fold_text(s: str) -> str:
    for pair, letters in PAIRS.items():
        s = s.replace(pair, letters)
    return s.translate(str.maketrans(FOLD_FROM, FOLD_TO))


def match_any(tokens: Column, query_tokens: Column) -> Column:
    """Whether any token of the query occurs."""
    return F.arrays_overlap(tokens, query_tokens)


def padded(tokens: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))


def match_phrase(tokens: Column, query_tokens: Column) -> Column:
    """Whether the query's tokens occur in a row; a query without tokens matches nothing."""
    return (F.size(query_tokens) > 0) & F.contains(padded(tokens), padded(query_tokens))


def phrase_count(tokens: Column, query: list[str]) -> Column:
    """How often the tokens of `query` occur in a row."""
    n = len(query)
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - (n - 1)))
    want = F.array(*map(F.lit, query))
    return F.coalesce(F.size(F.filter(at, lambda i: F.slice(tokens, i, n) == want)), F.lit(0))


#: Characters that escaped() puts a backslash before, the backslash first. Fixed values.
ESCAPED = ["\\", "'", "/", "!", '"', "$", "(", ")", "-", "<", "@", "^", "|", "~"]


def escaped(c: Column) -> Column:
    for character in ESCAPED:
        c = F.replace(c, F.lit(character), F.lit("\\" + character))
    return c


def quoted(c: Column) -> Column:
    """Backslashes and single quotes with a backslash before them."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def bool_digit(c: Column) -> Column:
    return c.cast("int").cast("string")
