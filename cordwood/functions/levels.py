"""Severity names, ranks and guesses as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cordwood.constants import LEVEL_SPELLINGS, LEVEL_WORDS, RANKED_SPELLINGS

_OF_SPELLING = {spelling: level for level, spellings in LEVEL_SPELLINGS.items() for spelling in spellings}


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def normalize_level(raw: Column) -> Column:
    """Canonical level of any spelling; null or blank is Information, unknown names come out in title case."""
    word = F.trim(raw)
    known = F.try_element_at(_lookup(_OF_SPELLING), F.upper(word))
    title = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(word.substr(F.lit(2), F.length(word))))
    return F.when(raw.isNull() | (word == ""), F.lit("Information")).otherwise(F.coalesce(known, title))


def normalize_level_text(raw: str | None) -> str:
    """normalize_level for one Python string."""
    word = (raw or "").strip()
    return _OF_SPELLING.get(word.upper(), word[:1].upper() + word[1:].lower()) if word else "Information"


def severity(level: Column) -> Column:
    """Rank 0..5 of a level that is spelled in a ranked way, else null."""
    return F.try_element_at(_lookup(RANKED_SPELLINGS), F.upper(level))


def guess_severity(line: Column) -> Column:
    """Highest rank of all level words in an unstructured line, null if there is none."""
    words = F.regexp_extract_all(line, F.lit(r"(?iU)\b(" + "|".join(LEVEL_WORDS) + r")\b"), F.lit(1))
    ranks = {w: RANKED_SPELLINGS.get(_OF_SPELLING[w].upper()) for w in LEVEL_WORDS}
    return F.array_max(F.transform(words, lambda w: F.try_element_at(_lookup(ranks), F.upper(w))))


def syslog_level(code: Column) -> Column:
    """Level of a syslog severity number (0 emergency .. 7 debug)."""
    return (
        F.when(code.isNull(), F.lit(None).cast("string"))
        .when(code.between(0, 2), "Fatal")
        .when(code == 3, "Error")
        .when(code == 4, "Warning")
        .when(code.between(5, 6), "Information")
        .otherwise("Debug")
    )


def http_level(status: Column) -> Column:
    """Level of an HTTP status."""
    return (
        F.when(status.isNull(), F.lit(None).cast("string"))
        .when(status >= 500, "Error")
        .when(status >= 400, "Warning")
        .otherwise("Information")
    )


def line_severity(structured_level: Column, inherited_level: Column, text: Column) -> Column:
    """Rank of the structured (else inherited) level, else what the text suggests."""
    return F.coalesce(severity(F.coalesce(structured_level, inherited_level)), guess_severity(text))
