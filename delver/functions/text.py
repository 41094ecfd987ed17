"""Tokenizer, n-gram windows and string measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def token_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, token), one row a token."""
    return df.select(key, F.posexplode(tokens(text)).alias("pos", "token"))


def windows(terms: Column, n: int) -> Column:
    """All n consecutive terms of an array column."""
    last = F.size(terms) - F.lit(n)
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.slice(terms, i, n))).otherwise(F.array().cast("array<array<string>>"))


def md5_half(token: Column, half: int) -> Column:
    """A 32-bit half (0 or 1) of the token's md5, as a non-negative long."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1 + 8 * half, 8), 16, 10).cast("long")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(F.lower(a), F.lower(b))


def parse_date(x: Column) -> Column:
    """ISO date, else the first 8 characters as YYYYMMDD, else epoch seconds."""
    return F.coalesce(F.try_to_date(x), F.try_to_date(F.substring(x, 1, 8), "yyyyMMdd"), F.to_date(F.timestamp_seconds(x.try_cast("long"))))


def trim_set(x: Column, chars: str) -> Column:
    return F.trim(x, F.lit(chars))


#: Full-width forms and the ideographic space, and their half-width counterparts.
FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
HALF = "".join(map(chr, range(0x21, 0x7F))) + " "


def half_width(x: Column) -> Column:
    """Full-width letters, digits and signs as ASCII."""
    return F.translate(x, FULL, HALF)


def contained_in(text: Column, others: Column) -> Column:
    """Whether the text is a proper substring of one of the array's texts."""
    return F.exists(others, lambda o: o.contains(text) & (F.length(o) > F.length(text)))


def ends_with_any(terms: Column, stops: list[str]) -> Column:
    """Whether the last term is one of the stopwords."""
    return F.coalesce(F.try_element_at(terms, F.lit(-1)).isin(stops), F.lit(False))


def join_terms(terms: Column) -> Column:
    """Terms as a phrase: a space between two alphabetic ones, none beside a Han, Hangul or Kana character."""
    wide = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}]"
    spaced = F.array_join(terms, " ")
    return F.regexp_replace(F.regexp_replace(spaced, f"(?<={wide}) ", ""), f" (?={wide})", "")


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring Han characters, and whole runs of other letters and digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+)"), F.lit(1))
    pairs = lambda r: F.when(r.rlike(r"^\p{IsHan}") & (F.length(r) > 1), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))).otherwise(F.array(r))
    return F.flatten(F.transform(runs, pairs))
