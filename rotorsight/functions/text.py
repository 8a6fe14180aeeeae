"""Text expressions: normalisation, heading levels, line types, quality features."""

from __future__ import annotations

import html
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .. import limits as L
from .scalars import col, strip

U = "(?U)"      # Unicode-aware white space, digits and word boundaries


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def bound(value: Column, use) -> Column:
    """``use(value)`` with a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def holds(text: Column, *signs: str) -> Column:
    """Does a text hold one of some literal strings?"""
    return reduce(or_, [F.contains(text, F.lit(s)) for s in signs])


def normalise(text) -> Column:
    """Zero-width characters, HTML entities, Markdown escapes and superfluous space removed.

    Only texts with an ampersand before something like a name reach the Python worker; for the
    others it sees a null.
    """
    plain = replaced(col(text), "[\ufeff\u200b\u200c\u200d]", "",
                     lambda x: holds(x, "\ufeff", "\u200b", "\u200c", "\u200d"))
    entity = bound(plain, lambda x: F.when(holds(x, "&") & x.rlike("&[^\t\n\f <&;]"), x))
    plain = F.coalesce(_unescape(entity), plain)
    return fold_space(replaced(plain, "\u00a0", " ", lambda x: holds(x, "\u00a0")))


def replaced(text: Column, pattern: str, replacement: str, where=None) -> Column:
    """``regexp_replace`` that copies a text only where something matches.

    ``where`` may be a cheaper test that passes every text with a match.
    """
    test = where or (lambda x: x.rlike(pattern))
    return bound(text, lambda x: F.when(test(x), F.regexp_replace(x, pattern, replacement))
                 .otherwise(x))


def fold_space(text: Column) -> Column:
    """Escapes undone, white space before line ends dropped, runs of it folded.

    A run is matched only if it is not a single space already, so ordinary text is not rewritten.
    """
    runs = U + r"(?:[^\S\n ]| (?=[^\S\n]))[^\S\n]*"
    at_end = lambda x: holds(x, " \n", "\t\n") | F.endswith(x, F.lit(" ")) | F.endswith(x, F.lit("\t"))
    text = replaced(text, r"\\([_*#\[\]()~`])", "$1", lambda x: holds(x, "\\"))
    text = replaced(text, r"(?dm)[ \t]+$", "", at_end)
    text = replaced(text, runs, " ")
    return strip(replaced(text, r"\n{3,}", "\n\n", lambda x: holds(x, "\n\n\n")))


def matches(value, pattern: str) -> Column:
    return col(value).rlike(U + pattern)


def heading_level(line) -> Column:
    """Level of a heading line (Markdown, numbered, appendix, Chinese numeral), else null."""
    line = col(line)
    part = lambda pattern, group: F.regexp_extract(line, U + pattern, group)
    number, rest = part(L.NUMBER_HEADING_PATTERN, 1), part(L.NUMBER_HEADING_PATTERN, 2)
    sentence = matches(line, L.SENTENCE_END_PATTERN)
    not_title = (rest.rlike(r"(?U)\d") | matches(rest, L.UNIT_PATTERN)
                 | F.contains(rest, F.lit("□")) | matches(rest, L.SENTENCE_END_PATTERN)
                 | (~F.contains(number, F.lit(".")) & (F.length(line) > 20)))
    depth = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    return (F.when(matches(line, L.MD_HEADING_PATTERN), F.length(part(L.MD_HEADING_PATTERN, 1)))
            .when(F.length(line) > 30, None)
            .when(matches(line, L.NUMBER_HEADING_PATTERN), F.when(~not_title, depth))
            .when((matches(line, L.APPENDIX_HEADING_PATTERN)
                   | matches(line, L.CHINESE_HEADING_PATTERN)) & ~sentence, 1).cast("int"))


def clean_title(line) -> Column:
    """Heading text without Markdown decoration."""
    bare = F.regexp_replace(col(line), U + L.MD_HEADING_PATTERN, "$2")
    return strip(F.regexp_replace(strip(bare), r"^[*_`]+|[*_`]+$", ""))


def quality_features(text) -> dict[str, Column]:
    """Counts and vocabulary found in a text, and whether it is worth reading."""
    text = F.coalesce(col(text), F.lit(""))
    found = lambda pattern, case: F.array_sort(F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), case)))
    chars = F.length(F.regexp_replace(text, U + r"\s+", ""))
    digits = F.length(F.regexp_replace(text, U + r"\D", ""))
    units = found(L.QUALITY_UNIT_PATTERN, lambda x: F.lower(x))
    tags = found(L.QUALITY_TAG_PATTERN, lambda x: F.upper(x))
    keys = found(L.QUALITY_KEY_PATTERN, lambda x: F.upper(x))
    return {"chars": chars, "digits": digits, "units": units, "tags": tags, "keys": keys}


def credible() -> Column:
    """Long enough, with digits, and with a unit, a tag or a field name."""
    return ((F.col("chars") >= L.QUALITY_MIN_CHARS) & (F.col("digits") >= L.QUALITY_MIN_DIGITS)
            & (F.size(F.concat("units", "tags", "keys")) > 0))
