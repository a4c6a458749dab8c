"""Text expressions: tokens, titles, abstracts, years, topic labels. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results depend on them.
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}_]+(?:['’][\p{L}\p{N}\p{M}_]+)*"
NO_TITLE = "No Title"
DEFAULT_QUERY = "machine learning"


def _blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased words in order of appearance; a missing text has none."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.regexp_extract_all(lowered, F.lit(TOKEN_PATTERN), F.lit(0))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def abstract_after_title(text: Column, title: Column) -> Column:
    """What follows the title and the one separator behind it; the whole text where no title is stored.

    Takes the title as stored, before any fallback.
    """
    rest = F.substring(text, F.length(title) + F.lit(2), F.length(text))
    return F.when(title.isNull(), text).otherwise(rest)


def title_or_default(title: Column) -> Column:
    return F.when(_blank_to_null(title).isNull(), F.lit(NO_TITLE)).otherwise(title)


def parse_year(raw: Column) -> Column:
    """``2003.0`` and ``2003`` give 2003; ``None``, blanks and anything unreadable give NULL."""
    return F.split(raw, "[.]")[0].try_cast("int")


def topic_label(words: Column, sep: str = " ") -> Column:
    return F.array_join(words, sep)


def query_or_default(text: Column, default: str = DEFAULT_QUERY) -> Column:
    return F.coalesce(_blank_to_null(text), F.lit(default))


def none_to_null(text: Column, spellings: Sequence[str] = ("None", "")) -> Column:
    """Line files spell a missing value as a word or an empty line."""
    return F.when(~F.trim(text).isin(*spellings), text)
