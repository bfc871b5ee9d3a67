"""Text columns: cleaning, spelling unification, tokens and n-grams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w and \s are ASCII-only, so word and blank characters are spelled out.
WORD = r"\p{L}\p{N}_"
BLANK = r"\t\n\x0b\f\r\x1c-\x1f\x85\p{Z}"


def strip(text: Column) -> Column:
    """Remove blank characters of any script from both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^[{BLANK}]+", ""), f"[{BLANK}]+$", "")


def clean_text(text: Column) -> Column:
    """Lower-case words and blanks only; NULL becomes the empty string."""
    lowered = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return strip(F.regexp_replace(lowered, f"[^{WORD}{BLANK}]", ""))


def joined_text(*parts: Column) -> Column:
    """Parts joined by one space, NULL counting as empty (unlike concat_ws)."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(" "), F.coalesce(part.cast("string"), F.lit(""))]
    return F.concat(*pieces[1:])


def lowered_text(text: Column) -> Column:
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def unify_spelling(text: Column, replacements: Sequence[tuple[str, str]]) -> Column:
    """Lower-case, then apply the replacements one after the other."""
    result = F.lower(text)
    for old, new in replacements:
        result = F.replace(result, F.lit(old), F.lit(new))
    return result


def blank_separated(text: Column) -> Column:
    """Words between blanks, punctuation kept, in order."""
    return F.filter(F.split(text, f"[{BLANK}]+"), lambda word: word != "")


def letter_words(text: Column) -> Column:
    """Whole words made of three or more ASCII letters, in order."""
    return F.regexp_extract_all(
        text, F.lit(f"(?<![{WORD}])[a-zA-Z]{{3,}}(?![{WORD}])"), F.lit(0))


def words(column: str, stop_words: Sequence[str]) -> Column:
    """Lower-case runs of two or more word characters that are no stop words.

    Written as one SQL expression so that a long stop list is sent to the JVM
    at once; Catalyst turns the IN list into a hash lookup.
    """
    runs = f"regexp_extract_all(lower(`{column}`), r'[{WORD}]{{2,}}', 0)"
    if not stop_words:
        return F.expr(runs)
    listed = ", ".join("'" + word.replace("\\", "").replace("'", "\\'") + "'"
                       for word in stop_words)
    return F.expr(f"filter({runs}, word -> word NOT IN ({listed}))")


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by each neighbouring pair joined with a space."""
    pairs = F.zip_with(
        tokens, F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda left, right: F.concat(left, F.lit(" "), right))
    return F.concat(tokens, F.filter(pairs, lambda pair: pair.isNotNull()))


def common_words(left: Column, right: Column) -> Column:
    """How many distinct words both arrays hold."""
    return F.size(F.array_intersect(left, right))
