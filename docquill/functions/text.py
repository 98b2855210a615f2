"""Words of a text for searching, and plain text of markup and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STOP = (
    "a an and are as at be but by for from had has have he her his if in into is it its no not of on or she so that the this to was we with you"
).split()

#: Parts of Unicode that separate words: all but letters and numbers.
BREAK = r"[^\p{IsAlphabetic}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-case words of more than one byte, without stop words, in order; NULL has none."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK, -1)
    return F.filter(words, lambda w: (F.octet_length(w) > 1) & ~w.isin(STOP))


def without_tags(markup: Column) -> Column:
    """Markup with each tag replaced by a blank, runs of white space joined."""
    return F.trim(F.regexp_replace(F.regexp_replace(markup, r"<[^>]*>", " "), r"\s+", " "))
