"""Text expressions. White space is Unicode's as Python's str.split sees it, spelled out because Java's \\s is ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that split() takes as white space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; case is kept."""
    return stripped(F.regexp_replace(text, f"{SPACE}+", " "))


def token_count(text: Column) -> Column:
    """Runs of other characters."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def present(text: Column) -> Column:
    """Null instead of an empty string."""
    return F.when(text != "", text)


def non_blank(text: Column) -> Column:
    return F.when(stripped(text) != "", text)


def page_id_from_path(path: Column) -> Column:
    """Last part of a path without its extension, other characters than [A-Za-z0-9_-] as underscores; "page" if nothing
    is left.
    """
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(present(F.regexp_replace(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "[^A-Za-z0-9_-]", "_")), F.lit("page"))
