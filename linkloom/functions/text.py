"""Small text helpers shared by the URL and anchor functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters (Spark's plain trim only drops U+0020).
WHITE_SPACE = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WORDS_AND_GAPS = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
MAX_TEXT = 2**31 - 1


def strip_space(text: Column) -> Column:
    """Drop white space at both ends. Most texts have none, so the ends are looked at first."""
    spaces = list(WHITE_SPACE)
    needed = F.substring(text, 1, 1).isin(spaces) | F.substring(text, -1, 1).isin(spaces)
    return F.when(needed, F.trim(text, F.lit(WHITE_SPACE))).otherwise(text)


def is_plain(text: Column) -> Column:
    """Whether a text in lower case holds only ASCII letters, digits and single blanks, none of them at an end.

    Such texts are their own normal form, so regular expressions are left to the others.
    """
    simple = (F.translate(text, "abcdefghijklmnopqrstuvwxyz0123456789 ", "") == "") & ~text.contains("  ")
    return simple & ~text.startswith(" ") & ~text.endswith(" ")


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def null_if_empty(text: Column) -> Column:
    return F.when(text != "", text)


def title_case(text: Column) -> Column:
    """Upper-case the first letter after every non-alphanumeric character.

    ``initcap`` only breaks words at white space, so the text is cut into runs of
    letters/digits and runs of everything else instead.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(_WORDS_AND_GAPS), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.substring(run, 2, MAX_TEXT))),
        "",
    )
