"""Text column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[ \\t\\n\\r\\f]+"


def words(text: Column) -> Column:
    """Split at blanks; no empty words."""
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-case words with ASCII punctuation removed."""
    return words(F.lower(F.translate(text, string.punctuation, "")))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def capitalize_first(text: Column) -> Column:
    """First character upper, the rest unchanged."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def truncate(text: Column, n: int) -> Column:
    """Cut texts of length n or more to n-3 characters and three dots."""
    if n < 3:
        # Fixed value: the message is kept as published, with its spelling.
        return F.lit("Tuncation must be at least 3 characters.")
    return F.when(F.length(text) >= n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def letter_count(text: Column, letter: str) -> Column:
    """Occurrences of one letter, upper or lower case."""
    low = F.lower(text)
    return (F.length(low) - F.length(F.replace(low, F.lit(letter.lower()), F.lit("")))).cast("int")


def char_counts(text: Column) -> Column:
    """Map from each character to its number of occurrences, case-sensitive."""
    chars = F.array_distinct(F.split(text, ""))
    return F.map_from_arrays(
        chars, F.transform(chars, lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))))


def vowel_counts(text: Column) -> Column:
    low = F.lower(text)
    vowels = F.filter(F.array(*[F.lit(v) for v in "aeiou"]), lambda v: F.contains(low, v))
    return F.map_from_arrays(
        vowels, F.transform(vowels, lambda v: (F.length(low) - F.length(F.replace(low, v, F.lit("")))).cast("int")))


def thousands(number: Column) -> Column:
    """Whole number with commas between groups of three digits."""
    return F.format_number(number, 0)


def money_text(number: Column, width: int = 0, symbol: str = "$") -> Column:
    """Symbol, padding to ``width``, sign, grouped digits and two decimals."""
    shown = F.concat(F.when(number < 0, "-").otherwise(""), F.format_number(F.abs(number.cast("decimal(18,2)")), 2))
    return F.concat(F.lit(symbol), F.lpad(shown, F.greatest(F.length(shown), F.lit(width)), F.lit(" ")) if width else shown)


def parse_money(text: Column) -> Column:
    """``"$2,629.13 "`` -> 2629.13; unreadable text -> null."""
    return F.regexp_replace(text, "[$, ]", "").try_cast("decimal(18,2)")


def mask_account(text: Column, length: int = 8) -> Column:
    """Drop dashes, require ``length`` characters, hide the last three; otherwise null."""
    bare = F.replace(text, F.lit("-"), F.lit(""))
    return F.when(F.length(bare) == length, F.concat(F.substring(bare, 1, length - 3), F.lit("***")))


def normal_name(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def strong_password(text: Column) -> Column:
    """At least ten characters with an upper-case letter and a digit."""
    return (F.length(text) >= 10) & text.rlike("[A-Z]") & text.rlike("[0-9]")


def number_after_colon(text: Column) -> Column:
    """The number after the first colon, or null."""
    return F.regexp_extract(text, ":\\s*(-?[0-9]+(?:\\.[0-9]+)?)", 1).try_cast("double")


def skip_repeats(items: Column) -> Column:
    """Drop items equal to the one just before them."""
    # paired with a shifted copy: a lambda that looked back into `items` would rebuild it per item
    shifted = F.concat(F.array(F.lit(None).cast("string")), items)
    pairs = F.zip_with(items, shifted, lambda x, before: F.when(x.eqNullSafe(before), None).otherwise(x))
    return F.filter(pairs, lambda x: x.isNotNull())
