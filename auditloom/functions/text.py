"""Small text helpers as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F


def strip(col) -> Column:
    """Remove white space of every kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def filled(col) -> Column:
    """Empty string to NULL."""
    return F.nullif(col, F.lit(""))


def or_else(col, default) -> Column:
    """The value, or ``default`` where it is NULL or empty."""
    return F.coalesce(filled(col), default if isinstance(default, Column) else F.lit(default))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def has_any(col: Column, words) -> Column:
    """True when one of the words occurs in the text (plain substrings)."""
    return any_of([col.contains(w) for w in words])


def words_pattern(words, whole=()) -> str:
    """One alternation for a list of words; those in ``whole`` must stand alone."""
    parts = [re.escape(w).replace("\\ ", " ").replace("\\-", "-") for w in words if w not in whole]
    alone = [w for w in words if w in whole]
    if alone:
        parts.append("(?:^|[^a-z0-9])(?:" + "|".join(alone) + ")(?:[^a-z0-9]|$)")
    return "|".join(parts)


def has_words(col: Column, words, whole=()) -> Column:
    """True where ``words_pattern`` is found, by plain substrings: the pattern is tried only on texts that hold a word of ``whole``."""
    alone = [w for w in words if w in whole]
    plain = [w for w in words if w not in whole]
    tests = [has_any(col, plain)] if plain else []
    if alone:
        tests.append(has_any(col, alone) & col.rlike(words_pattern(alone, whole)))
    return any_of(tests)


def lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def once(col: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it.

    In a CASE the value would be computed again in every branch that is reached.
    """
    return F.get(F.transform(F.array(col), body), F.lit(0))
